"""Queries on cells: markup, addresses, tags and ingredients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.functions import category, ingredients, links, text
from tallyshelf.plans.inputs import parts
from tallyshelf.plans.registry import register
from tallyshelf.sources import landed
from tallyshelf.sources.tables import table

@register(r"SELECT page_id, left(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' '), 500) AS text FROM pages")
def html_strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR2, STR3: markup as one line, references left alone."""
    return table(spark, sf_dir, "pages").select("page_id", text.without_tags("html", 500).alias("text"))


@register(r"""
WITH t AS (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS t FROM pages), a AS (SELECT page_id, replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"') AS t FROM t),
  b AS (SELECT page_id, replace(replace(replace(t, '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', ' ') AS t FROM a), c AS (SELECT page_id, replace(replace(replace(t, '&yen;', '¥'), '&middot;', '·'), '&amp;', '&') AS t FROM b)
SELECT page_id, left(trim(regexp_replace(t, '\s+', ' ', 'g'), ' '), 2000) AS text FROM c
""")
def html_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR1: with references decoded."""
    return table(spark, sf_dir, "pages").select("page_id", text.plain("html").alias("text"))


@register("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1), E' \\t\\n\\r') AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@register("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS href FROM pages)
SELECT page_id, CASE WHEN href LIKE '//%' THEN 'https:' || href WHEN href LIKE '/%' THEN 'https://so.m.jd.com' || href WHEN href LIKE 'http://%' THEN 'https://' || substr(href, 8) ELSE href END AS address,
  count(*) AS n FROM l GROUP BY page_id, address
""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR6, JSN24: full addresses of the links of each page."""
    found = F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'), 1))
    rows = table(spark, sf_dir, "pages").select("page_id", found.alias("href")).select("page_id", links.page_address("href").alias("address"))
    return rows.groupBy("page_id", "address").agg(F.count(F.lit(1)).alias("n"))


KINDS = ("//img.x/", "http://img.x/", "https://img.x/", "jfs/t1/", "/jfs/t1/", "n5/", "img14.360buyimg.com/", "data:")
RAW = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{k}' || p_brand" for i, k in enumerate(KINDS)) + " END"


def raw_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % 8 + 1).cast("int")), "p_brand")
    return parts(spark, sf_dir).select("p_partkey", raw.alias("raw"))


@register(f"""
WITH r AS (SELECT p_partkey, p_partkey % 8 AS k, {RAW} AS raw FROM part)
SELECT p_partkey,
  CASE WHEN k = 0 THEN 'https:' || raw WHEN k = 1 THEN 'https://' || substr(raw, 8) WHEN k = 2 THEN raw WHEN k = 3 THEN 'https://img13.360buyimg.com/n2/s480x480_' || raw
    WHEN k = 4 THEN 'https://img13.360buyimg.com/n2/s480x480_' || substr(raw, 2) WHEN k = 5 THEN 'https://img13.360buyimg.com/' || raw WHEN k = 6 THEN 'https://' || raw ELSE raw END AS list_picture,
  CASE WHEN k = 0 THEN 'https:' || raw WHEN k = 1 THEN 'https://' || substr(raw, 8) WHEN k = 3 THEN 'https://img13.360buyimg.com/n2/s480x480_' || raw ELSE raw END AS detail_picture,
  CASE WHEN k = 0 THEN 'https:' || raw WHEN k = 1 THEN 'https://' || substr(raw, 8) WHEN k = 3 THEN 'https://img30.360buyimg.com/sku/' || raw
    WHEN k = 4 THEN 'https://img30.360buyimg.com/sku' || raw WHEN k = 7 THEN '' ELSE raw END AS asset
FROM r
""")
def url_canonicalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR7-STR9."""
    return raw_addresses(spark, sf_dir).select(
        "p_partkey", links.list_picture("raw").alias("list_picture"), links.detail_picture("raw").alias("detail_picture"), links.asset_address("raw").alias("asset")
    )


@register()
def description_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR10, STR11, STR26, SET7: pictures that each page's markup names, joined and split again."""
    markup = F.concat(F.lit("<div style=\"background:url('//a.x/bg.jpg')\"><img src='/jfs/"), F.col("page_id").cast("string"), F.lit(".png'><img src=jfs/b.jpg>"), "html")
    joined = links.picture_list(links.addresses_in(markup))
    return table(spark, sf_dir, "pages").select("page_id", joined.alias("joined"), F.size(links.listed_addresses(joined)).alias("n"))


@register("""
WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '热卖榜' WHEN 1 THEN 'top ' || p_name WHEN 2 THEN '第 3 名' WHEN 3 THEN '热销' || p_brand ELSE p_name END AS tag FROM part)
SELECT p_partkey, p_partkey % 5 <> 4 AS is_rank FROM t
""")
def rank_text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR5."""
    k = F.col("p_partkey") % 5
    tag = F.when(k == 0, "热卖榜").when(k == 1, F.concat(F.lit("top "), "p_name")).when(k == 2, "第 3 名").when(k == 3, F.concat(F.lit("热销"), "p_brand")).otherwise(F.col("p_name"))
    return parts(spark, sf_dir).select("p_partkey", text.is_rank_text(tag).alias("is_rank"))


#: One text of each kind that the judgements tell apart.
SAMPLES = (
    "配料：小麦粉、燕麦、食用盐",
    "小麦粉（含量≥50%），燕麦麸皮，食用盐，食品添加剂（碳酸氢钠）",
    "小麦粉、燕麦片、食用植物油、白砂糖",
    "鸡胸 1块，黄瓜 半根，鸡蛋 2个，小葱 3根",
    "第一步：准备食材，下锅翻炒",
    "https://img.x/1.jpg;https://img.x/2.jpg",
    "无",
    "图中没有配料",
    "[1, 2]",
    "",
)


def sample_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, SAMPLES)), (F.col("p_partkey") % len(SAMPLES) + 1).cast("int"))
    return parts(spark, sf_dir).select("p_partkey", raw.alias("raw"))


@register("""
SELECT p_partkey, p_partkey % 10 IN (3, 4) AS recipe, p_partkey % 10 IN (0, 1, 2) AS signals, p_partkey % 10 IN (0, 1, 2) AS acceptable, p_partkey % 10 = 5 AS addresses FROM part
""")
def ingredient_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR15, STR21-STR24 on texts whose kind is known."""
    raw = F.col("raw")
    return sample_texts(spark, sf_dir).select(
        "p_partkey",
        ingredients.is_recipe(raw).alias("recipe"),
        ingredients.has_table_signals(raw).alias("signals"),
        ingredients.is_acceptable(raw).alias("acceptable"),
        ingredients.is_address_list(raw).alias("addresses"),
    )


@register("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || '；' || p_brand WHEN 1 THEN p_type WHEN 2 THEN '（详情长图链接，无配料正文；可在采集侧开启配料识别后重新跑批次）' ELSE '—' END AS shown FROM part
""")
def ingredient_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR16-STR18, PRJ7: text, else attributes, else a note, else a dash."""
    k = F.col("p_partkey") % 4
    body = F.when(k == 0, F.concat("p_name", F.lit("\r\n\n "), "p_brand")).when(k < 3, F.lit("https://img.x/1.jpg")).otherwise("")
    attrs = F.when(k == 1, F.concat(F.lit("产地:x; 配料表："), "p_type", F.lit("; 净含量:1"))).otherwise("")
    return parts(spark, sf_dir).select("p_partkey", ingredients.shown_ingredients(body, F.lit(""), attrs).alias("shown"))


@register("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || '、' || p_brand || '、' || p_type END AS cleaned FROM part
""")
def ingredient_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR19, STR20: a tail of three words or fewer said over and over is cut, the brand before it included, as are closing quotes."""
    tail = F.when(F.col("p_partkey") % 2 == 0, F.repeat(F.lit("，xx、yy"), 40)).otherwise(F.concat(F.lit("，"), "p_type"))
    raw = F.concat("p_name", F.lit("、"), "p_brand", tail, F.lit("”\""))
    return parts(spark, sf_dir).select("p_partkey", ingredients.sanitised(raw).alias("cleaned"))


@register("""
SELECT p_partkey, left(p_name || '/' || p_brand, 12) || CASE WHEN length(p_name || '/' || p_brand) > 12 THEN '…' ELSE '' END AS cell,
  p_brand || '_' || p_type AS folder, '20240101 120000' AS batch, p_name AS keyword FROM part
""")
def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ7, PRJ10, STR27, STR28."""
    folder = F.concat(F.lit("20240101_120000_"), "p_name")
    return parts(spark, sf_dir).select(
        "p_partkey",
        text.table_cell(F.concat(F.lit(" "), "p_name", F.lit("|"), "p_brand", F.lit("\n")), 12).alias("cell"),
        text.safe_segment(F.concat("p_brand", F.lit("?"), "p_type")).alias("folder"),
        text.batch_label(folder).alias("batch"),
        text.keyword_of(folder).alias("keyword"),
    )


@register("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a > ' || p_type WHEN 1 THEN p_brand WHEN 2 THEN p_name ELSE '' END AS category,
  CASE p_partkey % 4 WHEN 0 THEN 'a > ' || p_type WHEN 1 THEN p_brand ELSE '' END AS shown,
  CASE p_partkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN p_brand WHEN 2 THEN left(p_name, 80) ELSE '' END AS top FROM part
""")
def category_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR13, PRJ3, AGG6: the category of a row by path, leaf category and short name."""
    k = F.col("p_partkey") % 4
    path = F.when(k == 0, F.concat(F.lit(" a > "), "p_type", F.lit(" "))).otherwise(" ")
    leaf = F.when(k < 2, F.concat("p_brand", F.lit("\u3000"))).otherwise("")
    attributes = F.when(k == 2, F.concat(F.lit("类目:12 | 简称： "), "p_name", F.lit(" | x"))).when(k == 3, F.concat(F.lit("简称:"), "p_name"))
    rows = parts(spark, sf_dir).select("p_partkey", path.alias("path"), leaf.alias("leaf"), attributes.alias("attributes"))
    whole = category.category_cell("path", "leaf", "attributes")
    return rows.select("p_partkey", whole.alias("category"), category.product_category("path", "leaf").alias("shown"), category.top_segment(whole).alias("top"))


@register("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN p_brand WHEN 3 THEN '' ELSE p_type END AS value FROM part
""")
def scalar_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4: the first key with a scalar that is not blank."""
    k, q = F.col("p_partkey") % 5, lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    a = F.when(k == 0, q(F.concat(F.lit("  "), "p_name"))).when(k == 1, F.col("p_size").cast("string")).when(k == 2, F.lit("null")).when(k == 3, F.lit('{"x": 1}')).otherwise(F.lit('" "'))
    b = F.when(k == 2, q(F.col("p_brand"))).when(k == 3, F.lit("[1]")).when(k == 4, q(F.concat("p_type", F.lit("\\n")))).otherwise(F.lit('"never"'))
    body = F.concat(F.lit('{"b":'), b, F.lit(',"a":'), a, F.lit("}"))
    return parts(spark, sf_dir).select("p_partkey", landed.first_scalar(landed.variant(body), "none", "a", "b").alias("value"))


@register("""
SELECT p_partkey, 'https://a.x/' || p_partkey || '.jpg; https://img30.360buyimg.com/sku/jfs/' || p_brand || '.png; https://b.x/' || p_size || '.webp; https://c.x/d' || CASE WHEN p_size % 2 = 0 THEN '; https://item.jd.com/1.gif' ELSE '' END AS joined,
  CAST(4 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n FROM part
""")
def described_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR10, STR11, STR26, SET7: the pictures of a description: styles, small pictures and sources, without pages and style sheets, each once."""
    html = F.concat(
        F.lit("<link href=x><div style=\"background: URL( '//a.x/"), F.col("p_partkey").cast("string"), F.lit(".jpg' )\"><input id=zbViewWeChatMiniImages value='/jfs/"), F.col("p_brand"),
        F.lit(".png, https://item.jd.com/1.html,//sku-market-gw.jd.com/a.css'><img class=k src=\"http://b.x/"), F.col("p_size").cast("string"), F.lit(".webp\"><IMG src=//c.x/d><img src='data:image/png;base64,xx'>"),
        F.when(F.col("p_size") % 2 == 0, F.lit("<img src=https://item.jd.com/1.gif><img src=//c.x/d>")).otherwise(F.lit("")),
    )
    joined = links.picture_list(links.addresses_in(html))
    return parts(spark, sf_dir).select("p_partkey", joined.alias("joined")).select("p_partkey", "joined", F.size(links.listed_addresses("joined")).alias("n"))
