"""Products, product pages and reviews out of raw payloads.

Payloads nest as they please, so one small vectorised function walks them and hands out the objects that have
one of the wanted keys, in document order. All that follows, which objects count and what their fields
become, are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.functions.links import detail_picture, list_picture, page_address
from tallyshelf.functions.price import merged_coupon
from tallyshelf.functions.text import distinct_texts, filled, is_rank_text, plain, squeeze, strip, without_tags
from tallyshelf.sources.landed import Fields, first_scalar, json_body, kind_of, scalar, variant, whole_number

# The keys under which payloads have what a product row needs.
NESTS = ("wareInfo", "product", "skuInfo", "item", "main", "content", "base", "exContent", "excontent")
SKU, TITLE = ("wareId", "skuId", "itemId", "wid", "productId"), ("wareName", "wname", "name", "title", "skuName")
PRICE = ("jdPrice", "jdPriceText", "realPrice", "price", "priceText", "p", "salePrice", "purchasePrice")
ORIGINAL = ("oriPrice", "originalPrice", "marketPrice", "linePrice", "mPrice", "maoPrice", "strikePrice")
COUPON = ("couponPrice", "subsidyPrice", "promoPrice")
SHOWN_COUPON = ("couponPrice", "purchasePrice", "finalPrice", "subsidyPrice")
PICTURE = ("imageurl", "imageUrl", "imgUrl", "picUrl", "image", "squareImage", "squarePic", "imgDfsUrl")
PAGE = ("toUrl", "clickUrl", "wareUrl", "href", "itemUrl", "detailUrl", "skuUrl", "pUrl")
SHOP_PAGE, PLACE = ("shopUrl", "storeUrl", "shopURL", "jumpUrl"), ("deliveryAddress", "area", "procity", "stockAddress", "sendAddr")
SHOP, FUZZY = ("shopName", "venderName", "storeName", "shop_name"), ("commentFuzzy", "comment_fuzzy", "cmtFuzzy", "evaluationFuzzy")
SECKILL, PROPERTIES = ("seckillInfo", "secKill", "secKillInfo", "miaosha", "flashSale"), ("propertyList", "properties", "wareProps", "props")
AD_FLAGS = ("isAdv", "isAd", "isP4p", "is_p4p", "adFlag")
FLOOR_NAMES_LEFT_OUT = ("wareid", "skuid", "itemid", "imageurl", "imgurl", "href", "url", "cid", "shopid", "venderid")
# Where a product's tags are: lists of them, objects whose titles count, the texts of a tag, and the names of lists of texts anywhere below.
TAG_LISTS = (
    "wareBeltList", "beltList", "labelList", "tagList", "wareTags", "tags", "icons", "serviceIcons", "iconList", "iconList1", "iconList2", "iconList3", "iconList4",
    "textTagList", "beltAttrs", "serviceTags", "benefitList", "sellPoints", "commonTagList",
)
TAG_TITLED = ("newRegionFloor", "midTagList", "paragraphInfo", "floatLayerInfo", "drawer")
TAG_TEXTS = ("text", "name", "title", "desc", "msg", "beltMsg", "labelName", "typeName", "showName", "content", "beltTitle")
TEXT_LISTS = (
    "title", "subtitle", "subtitles", "sellpoint", "sellpoints", "usp", "usps", "textlist", "textlists", "wordlist", "keywords", "highlight", "highlights", "sellingpoint",
    "sellingpoints", "featurelist", "pointlist", "points", "shorttitle", "shorttitles", "recommendreason", "reasonlist", "icontexts", "icontext", "tagtexts", "descs", "labels",
)
#: Of a product's texts: tags of a list, texts of a tag, how deep and wide the search for lists goes, how many lists count and how many of their entries.
TAGS, TEXTS_OF_TAG, DEEPEST, WIDEST, LISTS, ENTRIES = 30, 25, 14, 90, 80, 40
REVIEW = ("commentId",)
#: Characters of payloads that are objects of Python's, and a batch of results, at once; a longer payload is by itself.
AT_ONCE = 1 << 20


def objects_with(keys: tuple[str, ...], nests: tuple[str, ...] = (), wanted: tuple[str, ...] = ()):
    """A vectorised function from JSON text to its objects with one of the keys, in document order.

    Each is given as JSON text, with what its objects under ``nests`` have hoisted where it has nothing
    itself, and with its texts (JSN8, JSN9): those of its tags, then those of lists of texts below it, squeezed, each
    once whatever its case, of two characters or more, and without selling points (JSN29) but for tags that repeat
    one elsewhere. With ``wanted``, objects have these keys only and no texts. The function carries all it needs, and
    its memory is a batch of Spark's and what becomes of AT_ONCE characters, however many payloads a task has.
    """
    tag_lists, tag_titled, tag_texts, text_lists = TAG_LISTS, TAG_TITLED, TAG_TEXTS, frozenset(TEXT_LISTS)
    tags, texts_of_tag, deepest, widest, most_lists, entries, at_once = TAGS, TEXTS_OF_TAG, DEEPEST, WIDEST, LISTS, ENTRIES, AT_ONCE

    @F.arrow_udf("array<struct<object:string,texts:array<string>>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import json

        import pyarrow as pa
        import pyarrow.compute as pc

        def hoisted(d: dict) -> dict:
            out = dict(d)
            for nest in nests:
                for k, v in (out[nest].items() if isinstance(out.get(nest), dict) else ()):
                    if out.get(k) in (None, "", [], {}):
                        out[k] = v
            return out

        def strings(x, most: int = texts_of_tag) -> list[str]:
            return [y for y in (x[:most] if isinstance(x, list) else [x]) if isinstance(y, str) and y.strip()]

        def listed(d: dict, key: str, most: int | None) -> list:
            return d[key][:most] if isinstance(d.get(key), list) else []

        def scalar(d: dict, names: tuple[str, ...]) -> list[str]:
            return [t for t in (str(d[k]).strip() for k in names if d.get(k) is not None and not isinstance(d[k], dict | list)) if t][:1]

        def of_tag(tag, names: tuple[str, ...]):
            """(name, text) of a tag: whole lists on the way to the first text that stands by itself."""
            for name in names if isinstance(tag, dict) else ():
                for t in strings(tag.get(name)):
                    yield name, t
                if isinstance(tag.get(name), str) and tag[name].strip():
                    return

        def selling(d: dict):
            yield from strings(d["sellingPoint"], None) if isinstance(d.get("sellingPoint"), list) else ()
            for x in listed(d, "benefitList", tags):
                yield from strings(x.get("title")) if isinstance(x, dict) else ()
            for x in listed(d, "sellPoints", texts_of_tag):
                yield from scalar(x, ("text", "title", "name", "desc")) if isinstance(x, dict) else strings(x)

        def candidates(d: dict):
            """(text, whether it goes if it is a selling point) in order."""
            for key in tag_lists:
                if isinstance(d.get(key), dict):
                    yield from ((t, False) for _, t in of_tag(d[key], tag_texts))
                for tag in listed(d, key, tags):
                    yield from ((t, False) for t in (strings(tag) if isinstance(tag, str) else ()))
                    yield from ((t, key == "benefitList" and name == "title") for name, t in of_tag(tag, tag_texts))
            for key in tag_titled:
                yield from ((t, True) for t in strings(d[key].get("title"))) if isinstance(d.get(key), dict) else ()
            for tag in listed(d, "midTagList", texts_of_tag):
                alone = [tag[k] for k in tag_texts[:5] if isinstance(tag.get(k), str) and tag[k].strip()] if isinstance(tag, dict) else []
                yield from ((t, False) for t in alone[:1])
            todo, seen = [(d, None, 0)], 0
            while todo:
                node, name, depth = todo.pop()
                if isinstance(node, list) and name in text_lists and seen < most_lists:
                    seen += 1
                    for x in node[:entries]:
                        yield from ((t, True) for t in (scalar(x, ("text", "name", "title", "desc", "value", "content")) if isinstance(x, dict) else strings(x)))
                if depth <= deepest:
                    below = [(v, k.lower()) for k, v in node.items()] if isinstance(node, dict) else [(v, None) for v in node[:widest]]
                    todo += [(v, k, depth + 1) for v, k in reversed(below) if isinstance(v, dict | list)]

        def texts(d: dict) -> list[str]:
            squeezed = lambda t: " ".join(t.split())
            sold, out = {squeezed(t).casefold() for t in selling(d)}, {}
            for t, goes in candidates(d):
                t = squeezed(t)
                if len(t) >= 2 and not (goes and t.casefold() in sold):
                    out.setdefault(t.casefold(), t)
            return list(out.values())

        def walk(body: str | None) -> list[dict] | None:
            try:
                root = json.loads(body) if body else None
            except (ValueError, RecursionError):
                return None
            out, todo = [], [root]
            while todo:
                node = todo.pop()
                if isinstance(node, dict):
                    whole = hoisted(node)
                    if any(k in whole for k in keys):
                        own = {k: whole[k] for k in wanted if k in whole} if wanted else whole
                        out.append({"object": json.dumps(own, ensure_ascii=False), "texts": texts(whole) if nests and not wanted else []})
                    todo += reversed(list(node.values()))
                elif isinstance(node, list):
                    todo += reversed(node)
            return out

        kind = pa.list_(pa.struct([("object", pa.string()), ("texts", pa.list_(pa.string()))]))
        for bodies in batches:
            sizes, start, held = pc.fill_null(pc.utf8_length(bodies), 0).to_pylist(), 0, 0
            for i, size in enumerate(sizes):
                if i > start and held + size > at_once:
                    yield pa.array(map(walk, bodies[start:i].to_pylist()), kind)
                    start, held = i, 0
                held += size
            if start < len(sizes):
                yield pa.array(map(walk, bodies[start:].to_pylist()), kind)

    return found


def with_objects(raw: DataFrame, body: str, keys: tuple[str, ...], nests: tuple[str, ...] = ()) -> DataFrame:
    """raw without its body, a row for each object: position, v (a variant), fields (its keys with their texts) and texts.

    A struct of the wanted keys in place of the map is much slower: the optimizer parses the object anew for every key.
    """
    rest = [c for c in raw.columns if c != body]
    listed = raw.select(*rest, F.posexplode(objects_with(keys, nests)(json_body(body))).alias("position", "found"))
    fields = F.from_json("found.object", "map<string,string>").alias("fields")
    return listed.select(*rest, "position", F.try_parse_json("found.object").alias("v"), fields, F.col("found.texts").alias("texts"))


def texts_at(v: Column, path: str) -> Column:
    """The strings of an array at a path, or of one string there; an empty array if there is neither."""
    kind = kind_of(v, path)
    many = F.when(kind == "ARRAY", F.try_variant_get(v, path, "array<string>")).when(kind == "STRING", F.array(F.try_variant_get(v, path, "string")))
    return F.filter(F.coalesce(many, F.array().cast("array<string>")), lambda x: filled(x).isNotNull())


def entries_at(v: Column, path: str) -> Column:
    return F.coalesce(F.when(kind_of(v, path) == "ARRAY", F.try_variant_get(v, path, "array<variant>")), F.array().cast("array<variant>"))


def when_held(own: Fields, key: str, of) -> Column:
    """of(variant, path) where the object has the key, else an empty array."""
    none = F.array().cast("array<variant>" if of is entries_at else "array<string>")
    return F.when(own.has(key), of(own.v, f"$.{key}")).otherwise(none)


def selling_points(own: Fields) -> Column:
    """JSN7: the selling points, or else the titles of benefits and the listed points, each once."""
    listed = F.col("_listed")
    titles = F.flatten(F.transform(F.slice(when_held(own, "benefitList", entries_at), 1, 30), lambda x: texts_at(x, "$.title")))
    points = F.transform(F.slice(when_held(own, "sellPoints", entries_at), 1, 25), lambda x: F.coalesce(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")), first_scalar(x, "text", "title", "name", "desc")))
    return plain(F.array_join(distinct_texts(F.when(F.size(listed) > 0, F.slice(listed, 1, 25)).otherwise(F.concat(titles, points))), " | "), 1200)


def sales_floor(own: Fields) -> Column:
    """JSN11: the entries of the sales floor as name:text, without names that only identify things."""

    def entry(x: Column) -> Column:
        text, name = squeeze(first_scalar(x, "text", "msg", "desc")), first_scalar(x, "attr", "type", "key")
        bare = (name == "") | F.lower(name).isin(*FLOOR_NAMES_LEFT_OUT)
        return F.when(text == "", F.lit(None)).when(bare, text).otherwise(F.concat(name, F.lit(":"), text))

    return plain(F.array_join(F.transform(F.slice(when_held(own, "commentSalesFloor", entries_at), 1, 30), entry), " | "), 800)


def final_price(own: Fields) -> Column:
    """JSN5: the estimated price of the first final price that has one."""
    of = lambda k: own.first(f"{k}.estimatedPrice", f"{k}.price")
    return F.coalesce(*[F.nullif(of(k), F.lit("")) for k in ("finalPrice", "mockFinalPrice", "intervalNewPrice")], F.lit(""))


def property_line(own: Fields) -> Column:
    """JSN12: colour, category id, short name and properties in one line."""

    def entry(x: Column) -> Column:
        name, value = first_scalar(x, "name", "key"), first_scalar(x, "value", "text")
        text = F.when(F.schema_of_variant(x) == "STRING", F.substring(filled(F.try_variant_get(x, "$", "string")), 1, 120))
        return F.coalesce(text, F.when((name != "") & (value != ""), F.concat(name, F.lit(":"), value)))

    lists = [F.array_compact(F.transform(F.slice(when_held(own, k, entries_at), 1, 25), entry)) for k in PROPERTIES]
    chosen = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast("array<string>"))
    named = lambda label, *keys: F.when(own.first(*keys) != "", F.concat(F.lit(label), own.first(*keys)))
    extra = F.array_compact(F.array(named("颜色规格:", "color"), named("类目:", "catid", "cid3", "cid3Name"), named("简称:", "shortName")))
    return F.substring(F.array_join(F.concat(extra, chosen), " | "), 1, 4000)


def is_ad(own: Fields) -> Column:
    """JSN13: whether an explicit flag marks an advert."""
    flags = [F.lower(own.scalar(k)).isin("1", "true", "yes", "y") for k in AD_FLAGS]
    return F.coalesce(*[F.when(f, f) for f in flags], F.lit(False))


def ware_inputs(own: Fields) -> dict[str, Column]:
    """What several parts of a listing row's columns look at; columns of their own, so that each is computed once."""
    return {
        "_sku": own.first(*SKU),
        "_coupon": plain(own.first(*COUPON), 80),
        "_final": final_price(own),
        "_shown": F.coalesce(*[own.scalar(f"priceShow.{k}") for k in SHOWN_COUPON], F.lit("")),
        "_shop_id": own.first("shopId"),
        "_shop_page": own.first(*SHOP_PAGE),
        "_page": own.first(*PAGE),
        "_picture": own.first(*PICTURE),
        "_listed": when_held(own, "sellingPoint", texts_at),
    }


def ware_columns(own: Fields, texts: Column) -> dict[str, Column]:
    """JSN4: the columns of a listing row, from ware_inputs beside the object."""
    sku, shown, shop_id, page = F.col("_sku"), F.col("_shown"), F.col("_shop_id"), F.col("_page")
    shop_page = page_address(F.col("_shop_page"))
    ranks = F.filter(distinct_texts(texts), is_rank_text)
    seckill = F.coalesce(*[F.coalesce(own.scalar(k), F.nullif(own.first(*[f"{k}.{x}" for x in ("text", "title", "name", "status")]), F.lit(""))) for k in SECKILL], F.lit(""))
    return {
        "item_id": F.substring(F.coalesce(F.nullif(own.first("wareId", "wid"), F.lit("")), sku), 1, 80),
        "sku_id": F.substring(sku, 1, 80),
        "title": plain(own.first(*TITLE)),
        "price": plain(own.first(*PRICE), 120),
        "coupon_price": merged_coupon(F.col("_coupon"), F.col("_final"), shown),
        "original_price": plain(own.first(*ORIGINAL), 120),
        "selling_point": selling_points(own),
        "comment_sales_floor": sales_floor(own),
        "hot_list_rank": plain(F.array_join(ranks, " | "), 600),
        "comment_count": plain(own.first(*FUZZY), 120),
        "shop_name": plain(own.first(*SHOP), 200),
        "shop_url": F.when(shop_page != "", F.substring(shop_page, 1, 2000)).when(shop_id != "", F.concat(F.lit("https://mall.jd.com/index-"), shop_id, F.lit(".html"))).otherwise(""),
        "shop_info_url": F.substring(page_address(own.first("shopInfoUrl", "brandUrl")), 1, 2000),
        "location": plain(own.first(*PLACE), 200),
        "detail_url": F.when(page != "", F.substring(page_address(page), 1, 2500)).when(sku != "", F.concat(F.lit("https://item.m.jd.com/product/"), sku, F.lit(".html"))).otherwise(""),
        "image": F.substring(list_picture(F.col("_picture")), 1, 1200),
        "seckill_info": plain(seckill, 400),
        "attributes": property_line(own),
        "leaf_category": F.substring(own.first("leafCategory", "cid3Name", "catid"), 1, 80),
    }


def wares(raw: DataFrame, body: str = "body") -> DataFrame:
    """JSN2-JSN13: the products of search payloads, of equal skus in one payload the first.

    raw has the body and columns that name a payload, such as file, page and keyword.
    """
    names = [c for c in raw.columns if c != body]
    found = with_objects(raw, body, SKU, NESTS)
    own = Fields(F.col("v"), F.col("fields"))
    columns = ware_columns(own, F.col("texts"))
    rows = found.withColumns(ware_inputs(own)).select(*names, "position", *[c.alias(k) for k, c in columns.items()])
    good = rows.where(F.rlike("sku_id", F.lit("^[0-9]{5,}$")) & (F.length("title") >= 2))
    row = F.struct(*[F.col(c) for c in good.columns if c not in (*names, "sku_id")])
    first = good.groupBy(*names, "sku_id").agg(F.min_by(row, "position").alias("row"))
    return first.select(*names, "sku_id", "row.*")


def next_cursors(raw: DataFrame, page: str, cursor: str, body: str = "body") -> DataFrame:
    """JSN14: raw without its body, with next_cursor: the smallest s above the request's among a payload's objects of the page after the request's.

    page and cursor name the columns with the request's numbers. An object's page is under page, or else pageNo (unless
    it is 0) or pageIndex; null if no object has the next page's number and a larger s.
    """

    def fits(x: Column) -> Column:
        v = F.try_parse_json(x["object"])
        at = F.coalesce(whole_number(v, "$.page"), F.nullif(whole_number(v, "$.pageNo"), F.lit(0)), whole_number(v, "$.pageIndex"))
        s = whole_number(v, "$.s")
        return F.when((at == F.col(page) + 1) & (s > F.col(cursor)), s)

    rest = [c for c in raw.columns if c != body]
    rows = raw.withColumn("_found", objects_with(("s",))(json_body(body)))
    return rows.select(*rest, F.array_min(F.transform("_found", fits)).alias("next_cursor"))


def marked_advert(own: Fields) -> Column:
    """JSN13 for an entry of a listing, whose flag may also be in one of its nested objects."""
    flag = lambda k: F.lower(F.coalesce(*[own.scalar(p) for p in (k, *[f"{n}.{k}" for n in NESTS])], F.lit(""))).isin("1", "true", "yes", "y")
    return reduce(or_, [flag(k) for k in AD_FLAGS])


def of_objects(objects: Column, text, v, of) -> Column:
    """of(Fields) for each entry of an array, whose JSON text and variant are text(entry) and v(entry); each is parsed once."""
    parsed = F.transform(objects, lambda x: F.struct(v(x).alias("v"), F.from_json(text(x), "map<string,string>").alias("fields")))
    return F.transform(parsed, lambda x: of(Fields(x["v"], x["fields"])))


def cursor_steps(raw: DataFrame, page: str, cursor: str, body: str = "body") -> DataFrame:
    """AGG30: raw without its body, with step: how far the next request's cursor moves.

    The distance to the next cursor that the payload names; else one less than the entries of its list that are no
    adverts (all, if all are); else the same of the distinct products at any depth; 1 at least, null if there are none of all these.
    Each payload is looked at where it lies: nothing is shuffled.
    """
    rest = [c for c in raw.columns if c != body]
    least_one = lambda x: F.when(x < 1, F.lit(1)).otherwise(x)
    stepped = lambda natural, total: least_one(F.when(natural > 0, natural).otherwise(total) - 1)
    walked = raw.withColumn("_objects", objects_with(SKU, NESTS, (*SKU, *TITLE, *AD_FLAGS))(json_body(body)))
    ware = lambda own: F.struct(own.first(*SKU).alias("sku"), plain(own.first(*TITLE)).alias("title"), is_ad(own).alias("ad"))
    wares = of_objects(F.col("_objects"), lambda x: x["object"], lambda x: F.try_parse_json(x["object"]), ware)
    good = F.filter(wares, lambda x: F.rlike(x["sku"], F.lit("^[0-9]{5,}$")) & (F.length(x["title"]) >= 2))
    walked = walked.withColumn("_good", good).withColumn("_natural", F.array_distinct(F.transform(F.filter("_good", lambda x: ~x["ad"]), lambda x: x["sku"])))
    walked = walked.withColumn("_by_walk", F.when(F.size("_good") > 0, stepped(F.size("_natural"), F.size("_good")))).drop("_objects", "_good", "_natural")
    listed = walked.withColumn("_list", F.try_variant_get(variant(body), "$.data.wareList", "array<variant>"))
    entries = F.when(F.forall("_list", lambda x: kind_of(x, "$") == "OBJECT") & (F.size("_list") > 0), F.col("_list"))
    shown = F.filter(of_objects(entries, F.to_json, lambda x: x, marked_advert), lambda ad: ~ad)
    listed = listed.withColumn("_by_list", stepped(F.size(shown), F.size(entries))).drop("_list")
    named = next_cursors(listed, page, cursor, body).withColumn("_named", F.col("next_cursor") - F.col(cursor))
    step = F.when(F.col("_by_walk").isNotNull(), F.coalesce(least_one(F.col("_named")), "_by_list", "_by_walk"))
    return named.select(*rest, step.cast("long").alias("step"))


def first_category(v: Column) -> dict[str, Column]:
    """JSN22: category and guid of the first review that a product page shows: what stands before "_" in its mark, and its id; blank without."""
    at = lambda k: F.coalesce(scalar(v, f"$.commentInfoList[0].{k}"), F.lit(""))
    return {"category": strip(F.split_part(at("maidianInfo"), F.lit("_"), F.lit(1))), "guid": at("guid")}


def detail_columns(v: Column) -> dict[str, Column]:
    """JSN15-JSN18: the columns of a product page."""
    at = lambda path: F.coalesce(scalar(v, f"$.{path}"), F.lit(""))
    one = lambda *paths: F.coalesce(*[scalar(v, f"$.{p}") for p in paths], F.lit(""))
    entries = entries_at(v, "$.productAttributeVO.attributes")
    pairs = F.transform(entries, lambda x: F.struct(first_scalar(x, "labelName").alias("k"), first_scalar(x, "labelValue").alias("v")))
    brand = F.try_element_at(F.filter(pairs, lambda x: x["k"] == "品牌"), F.lit(1))["v"]
    line = F.array_join(F.transform(F.filter(pairs, lambda x: (x["k"] != "") & (x["v"] != "")), lambda x: F.concat(x["k"], F.lit(":"), x["v"])), "; ")
    stock = F.coalesce(F.nullif(without_tags(at("stockInfo.stockDesc"), 500), F.lit("")), without_tags(at("stockInfo.promiseResult"), 500))
    banner = at("beltBanner")
    return {
        "detail_sku_title": F.substring(at("skuHeadVO.skuTitle"), 1, 2000),
        "detail_price_final": F.coalesce(scalar(v, "$.price.finalPrice.price"), F.substring(at("price.p"), 1, 64)),
        "detail_price_original": F.coalesce(scalar(v, "$.price.op"), F.substring(at("price.p"), 1, 64)),
        "detail_purchase_price": F.substring(at("bestPromotion.purchasePrice"), 1, 64),
        "detail_shop_name": F.substring(at("itemShopInfo.shopName"), 1, 500),
        "detail_shop_id": F.substring(at("itemShopInfo.shopId"), 1, 32),
        "detail_shop_url": F.substring(F.regexp_replace(at("itemShopInfo.shopUrl"), "^//", "https://"), 1, 500),
        "detail_vender_id": F.substring(at("pageConfigVO.venderId"), 1, 32),
        "detail_page_sku_id": F.substring(at("pageConfigVO.skuid"), 1, 32),
        "detail_category_path": F.substring(F.array_join(texts_at(v, "$.pageConfigVO.catName"), " > "), 1, 500),
        "detail_main_image": detail_picture(one("pageConfigVO.src", "mainImageVO.mainImageArea.imageUrl")),
        "detail_stock_text": stock,
        "detail_delivery_promise": without_tags(one("stockInfo.promiseResult", "stockInfo.promiseInfoText"), 800),
        "detail_sku_name": F.substring(at("wareInfoReadMap.sku_name"), 1, 2000),
        "detail_product_id": F.substring(at("wareInfoReadMap.product_id"), 1, 32),
        "detail_main_sku_id": F.substring(at("wareInfoReadMap.main_sku_id"), 1, 32),
        "detail_brand": F.substring(F.coalesce(scalar(v, "$.wareInfoReadMap.cn_brand"), brand, F.lit("")), 1, 200),
        "detail_product_attributes": F.substring(line, 1, 4000),
        "detail_belt_banner": F.substring(F.regexp_replace(banner, "^//", "https://"), 1, 800),
        "detail_csfh_text": F.substring(at("csfhText"), 1, 200),
    }


def details(raw: DataFrame, body: str = "body") -> DataFrame:
    """JSN15, JSN33, PRJ11: each page's columns and parsed, whether its payload is an object; blank columns if it is not."""
    rows = raw.withColumn("_v", variant(body)).withColumn("parsed", F.coalesce(kind_of(F.col("_v"), "$") == "OBJECT", F.lit(False)))
    rest = [c for c in raw.columns if c != body]
    return rows.select(*rest, "parsed", *[F.when(F.col("parsed"), c).otherwise("").alias(k) for k, c in detail_columns(F.col("_v")).items()])


def reviews(raw: DataFrame, sku: str = "sku_id", body: str = "body") -> DataFrame:
    """JSN19-JSN21, SET5: the reviews of payloads, of equal ids of a sku the first in each payload."""
    names = [c for c in raw.columns if c != body]
    v = F.col("v")
    text = squeeze(first_scalar(v, "tagCommentContent", "commentData"))
    found = with_objects(raw, body, REVIEW).where(filled(first_scalar(v, "commentId")).isNotNull())
    found = found.where(scalar(v, "$.userNickName").isNotNull() | (text != ""))
    pictures = F.transform(entries_at(v, "$.pictureInfoList"), lambda x: F.nullif(first_scalar(x, "largePicURL", "largePicUrl"), F.lit("")))
    rows = found.select(
        *names,
        "position",
        first_scalar(v, "commentId").alias("comment_id"),
        squeeze(first_scalar(v, "userNickName")).alias("user_nick_name"),
        text.alias("tag_comment_content"),
        squeeze(first_scalar(v, "commentDate", "newCommentDate")).alias("comment_date"),
        squeeze(first_scalar(v, "buyCountText", "repurchaseInfo")).alias("buy_count_text"),
        F.array_distinct(F.array_compact(pictures)).alias("large_pic_urls"),
        first_scalar(v, "commentScore").alias("comment_score"),
    )
    row = F.struct(*[F.col(c) for c in rows.columns if c not in (*names, "comment_id")])
    return rows.groupBy(*names, "comment_id").agg(F.min_by(row, "position").alias("row")).select(*names, "comment_id", "row.*")


def business_ok(v: Column) -> Column:
    """FLT13: an object that does not say it failed and whose code is missing or 0."""
    failed = F.coalesce(F.try_variant_get(v, "$.success", "boolean") == F.lit(False), F.lit(False))
    code = F.try_variant_get(v, "$.code", "string")
    return (kind_of(v, "$") == "OBJECT") & ~failed & F.coalesce(code == "0", F.lit(True))


def search_quality(body: Column | str) -> Column:
    """JSN26: what became of a search request: empty_body, not_json, no_wares, ok or no_list."""
    v, text = variant(body), filled(body)
    return (
        F.when(text.isNull(), "empty_body")
        .when(v.isNull(), "not_json")
        .when(kind_of(v, "$.data.wareList") != "ARRAY", "no_list")
        .when(kind_of(v, "$.data.wareList").isNull(), "no_list")
        .when(F.size(entries_at(v, "$.data.wareList")) == 0, "no_wares")
        .otherwise("ok")
    )


# What product markup looks like where there is no payload.
EMBEDDED = (
    r'(?is)"wareId"\s*:\s*"?(\d{5,20})"?.{0,1200}?"wareName"\s*:\s*"([^"]{2,300})".{0,1200}?"(?:jdPrice|price|priceText|mainPrice)"\s*:\s*"?([\d.]{1,12})"?',
    r'(?is)"skuId"\s*:\s*"?(\d{5,20})"?.{0,1200}?"title"\s*:\s*"([^"]{2,300})".{0,1200}?"(?:price|priceText|jdPrice)"\s*:\s*"?([\d.]{1,12})"?',
    r'(?is)"(?:wareId|skuId)"\s*:\s*"?(\d{5,20})"?.{0,1200}?"(?:wareName|title|name)"\s*:\s*"([^"]{2,300})"()',
)
ANCHOR, WINDOW = r'(?is)(data-sku\s*=\s*"\d{5,20}".{0,4480})', 4500


def embedded_products(html: Column | str) -> Column:
    """JSN23: sku_id, title and price of the products in scripts, by the first pattern that finds any."""
    h = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))

    def of(pattern: str) -> Column:
        whole = F.regexp_extract_all(h, F.lit(pattern), 0)
        part = lambda i: (lambda x: F.regexp_extract(x, pattern, i))
        return F.filter(F.transform(whole, lambda x: F.struct(part(1)(x).alias("sku_id"), plain(part(2)(x), 300).alias("title"), part(3)(x).alias("price"))), lambda x: x["title"] != "")

    lists = [of(p) for p in EMBEDDED]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], lists[-1])


def marked_products(html: Column | str) -> Column:
    """JSN24: sku_id, title, price, detail_url, shop_name and image of elements with a product number, each once, with a title."""
    h = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    starts = F.transform(F.split(h, r"(?i)(?=data-sku\s*=\s*\"\d{5,20}\")"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    windows = F.transform(F.filter(starts, lambda s: F.rlike(s["x"], F.lit(r'(?i)^data-sku\s*=\s*"'))), lambda s: F.substring(s["x"], 1, WINDOW))
    got = lambda x, pattern: F.regexp_extract(x, pattern, 1)

    def product(x: Column) -> Column:
        sku = got(x, r'(?i)data-sku\s*=\s*"(\d{5,20})"')
        titles = [F.nullif(got(x, rf'(?i){k}\s*=\s*"([^"]{{2,300}})"'), F.lit("")) for k in ("title", "alt", "data-name")]
        page = F.nullif(page_address(got(x, r'(?i)href\s*=\s*"([^"]+)"')), F.lit(""))
        return F.struct(
            sku.alias("sku_id"),
            plain(F.coalesce(*titles, F.lit("")), 300).alias("title"),
            got(x, r"(?:¥|&yen;)\s*([\d.]{1,12})").alias("price"),
            F.substring(F.coalesce(page, F.concat(F.lit("https://item.m.jd.com/product/"), sku, F.lit(".html"))), 1, 2000).alias("detail_url"),
            plain(got(x, r'(?i)data-shopname\s*=\s*"([^"]{2,80})"'), 80).alias("shop_name"),
            F.substring(list_picture(got(x, r'(?i)(?:data-lazy-img|data-img|src)\s*=\s*"([^"]+\.(?:jpg|jpeg|png|webp)[^"]*)"')), 1, 1200).alias("image"),
        )

    return F.filter(F.transform(windows, product), lambda p: p["title"] != "")
