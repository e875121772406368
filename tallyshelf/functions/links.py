"""Addresses of pages and pictures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyshelf.functions.text import strip

# Hosts that relative addresses belong to.
SEARCH_HOST = "https://so.m.jd.com"
LIST_PICTURES = "https://img13.360buyimg.com"
DETAIL_PICTURES = "https://img30.360buyimg.com"
CAMPAIGN_PICTURES = "https://img12.360buyimg.com"
PICTURE_ENDINGS = ("jpg", "jpeg", "png", "webp", "avif", "gif", "dpg")
SHOP_PAGES = ("list.jd.com", "item.jd.com", "mall.jd.com")


def https(c: Column) -> Column:
    """The address with https where it names http or no scheme but a host."""
    return F.when(c.startswith("//"), F.concat(F.lit("https:"), c)).when(
        c.startswith("http://"), F.concat(F.lit("https://"), F.substring(c, 8, 1 << 20))
    )


def page_address(c: Column | str) -> Column:
    """STR6."""
    u = strip(c)
    return F.coalesce(https(u), F.when(u.startswith("/"), F.concat(F.lit(SEARCH_HOST), u)), u)


def list_picture(c: Column | str) -> Column:
    """STR7: the full address of a picture in a search list."""
    u = strip(c)
    rest = F.regexp_replace(u, "^/+", "")
    return F.coalesce(
        https(u),
        F.when(u.startswith("https://"), u),
        F.when(F.contains(F.lower(u), F.lit("360buyimg.com")), F.concat(F.lit("https://"), rest)),
        F.when(rest.startswith("jfs/"), F.concat(F.lit(f"{LIST_PICTURES}/n2/s480x480_"), rest)),
        F.when(F.rlike(rest, F.lit("^n[0-9]+/")), F.concat(F.lit(f"{LIST_PICTURES}/"), rest)),
        u,
    )


def detail_picture(c: Column | str) -> Column:
    """STR8: the full address of the main picture of a product page."""
    u = strip(c)
    sized = F.concat(F.lit(f"{LIST_PICTURES}/n2/s480x480_"), F.substring(u, 1, 700))
    return F.coalesce(https(u), F.when(u.startswith("jfs/"), sized), F.substring(u, 1, 800))


def asset_address(c: Column | str) -> Column:
    """STR9: the full address of something a product description shows; empty for inline data."""
    u = strip(c)
    quoted = F.rlike(u, F.lit("""^(".*"|'.*')$""")) & (F.length(u) >= 2)
    u = F.when(quoted, strip(F.substr(u, F.lit(2), F.length(u) - 2))).otherwise(u)
    full = F.coalesce(
        F.when(F.lower(u).startswith("data:"), F.lit("")),
        https(u),
        F.when(u.startswith("/sku/jfs/"), F.concat(F.lit(DETAIL_PICTURES), u)),
        F.when(u.startswith("/cms/jfs/"), F.concat(F.lit(CAMPAIGN_PICTURES), u)),
        F.when(u.startswith("/jfs/"), F.concat(F.lit(f"{DETAIL_PICTURES}/sku"), u)),
        F.when(u.startswith("jfs/"), F.concat(F.lit(f"{DETAIL_PICTURES}/sku/"), u)),
        u,
    )
    return F.substring(full, 1, 900)


def addresses_in(html: Column | str) -> Column:
    """STR10: addresses that a description names, in the order styles, list of small pictures, quoted and bare sources."""
    h = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    styles = F.transform(
        F.regexp_extract_all(h, F.lit(r"(?i)url\s*\(\s*([^)]+)\s*\)"), 1), lambda x: F.regexp_replace(strip(x), "^[\"']+|[\"']+$", "")
    )
    small = F.split(F.regexp_extract(h, r"(?is)zbViewWeChatMiniImages[^>]*\bvalue\s*=\s*[\"']([^\"']+)[\"']", 1), ",")
    double = F.regexp_extract_all(h, F.lit(r"(?is)<img\b[^>]*\bsrc\s*=\s*(\"[^\"]*\"|'[^']*')"), 1)
    quoted = F.transform(double, lambda x: F.substr(x, F.lit(2), F.length(x) - 2))
    bare = F.regexp_extract_all(h, F.lit(r"(?i)<img\b[^>]*\bsrc\s*=\s*([^\s>'\"]+)"), 1)
    return F.filter(F.transform(F.concat(styles, small, quoted, bare), strip), lambda x: x != "")


def picture_list(found: Column, most: int = 32_000, between: str = "; ") -> Column:
    """STR11, SET7: full addresses without style sheets and shop pages, each once, joined and cut."""

    def wanted(u: Column) -> Column:
        low = F.lower(u)
        sheet = F.contains(low, F.lit("sku-market-gw.jd.com")) & low.endswith(".css")
        page = F.rlike(low, F.lit("|".join(SHOP_PAGES).replace(".", r"\.")))
        picture = F.rlike(low, F.lit(r"\.(" + "|".join(PICTURE_ENDINGS) + ")$"))
        return (u != "") & ~sheet & (~page | picture)

    joined = F.array_join(F.array_distinct(F.filter(F.transform(found, asset_address), wanted)), between)
    return F.when(F.length(joined) > most, F.concat(F.substring(joined, 1, most - 3), F.lit("..."))).otherwise(joined) if most > 0 else joined


def listed_addresses(joined: Column | str) -> Column:
    """STR26: the http addresses of a joined list, in order."""
    parts = F.split(strip(joined), r"\s*;\s*|\s*[\r\n]+\s*")
    return F.filter(F.transform(parts, strip), lambda x: x.startswith("http://") | x.startswith("https://"))
