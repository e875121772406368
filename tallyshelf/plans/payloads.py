"""Queries on raw payloads: landed JSON built from the driver's tables, as crawls leave it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.plans.inputs import parts
from tallyshelf.plans.registry import register
from tallyshelf.sources import landed, payloads
from tallyshelf.sources.tables import table

LISTED = "p_partkey % 4 <> 3"
#: A page takes the parts of a brand whose keys lie in one thousand, forty or so.
FILE = "p_brand || '-' || CAST(CAST(floor(p_partkey / 1000) AS BIGINT) AS VARCHAR)"


def search_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of each brand, a page each, with its parts as products in several shapes and, for one part in four, without a usable number."""
    page = F.concat("p_brand", F.lit("-"), F.floor(F.col("p_partkey") / 1000).cast("string"))
    key = (F.col("p_partkey") + 100_000).cast("string")
    number = F.when(F.col("p_partkey") % 4 == 3, "12").otherwise(key)
    ware = F.to_json(
        F.struct(
            F.struct(number.alias("skuId"), F.col("p_name").alias("wareName")).alias("wareInfo"),
            F.format_string("%.2f", "p_retailprice").alias("jdPrice"),
            F.struct(F.format_string("%d.5", "p_size").alias("estimatedPrice")).alias("finalPrice"),
            F.array(F.col("p_type"), F.col("p_type"), F.lit(" ")).alias("sellingPoint"),
            F.array(F.struct(F.lit("sold").alias("attr"), F.lit("1万+").alias("text")), F.struct(F.lit("skuId").alias("attr"), F.col("p_brand").alias("text"))).alias("commentSalesFloor"),
            F.array(F.struct(F.lit("x").alias("text")), F.struct(F.concat(F.lit("热卖榜 "), "p_brand").alias("text"))).alias("tagList"),
            F.col("p_size").alias("catid"),
            F.col("p_brand").alias("shortName"),
            F.lit("7").alias("shopId"),
            F.lit("jfs/t1/a.jpg").alias("imageurl"),
        )
    )
    wares = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", ware.alias("w")))), lambda x: x["w"]), ",")
    body = F.concat(F.lit('cb({"data":{"resultCount":9,"deep":[{"wareList":['), wares, F.lit("]}]}});"))
    return parts(spark, sf_dir).groupBy(page.alias("file")).agg(body.alias("body"))


@register(f"""
SELECT {FILE} AS file, CAST(p_partkey + 100000 AS VARCHAR) AS sku_id, p_name AS title, CAST(p_size AS VARCHAR) || '.5' AS coupon_price, p_type AS selling_point,
  'sold:1万+ | ' || p_brand AS comment_sales_floor, '热卖榜 ' || p_brand AS hot_list_rank, 'https://mall.jd.com/index-7.html' AS shop_url,
  'https://item.m.jd.com/product/' || CAST(p_partkey + 100000 AS VARCHAR) || '.html' AS detail_url, 'https://img13.360buyimg.com/n2/s480x480_jfs/t1/a.jpg' AS image,
  '类目:' || CAST(p_size AS VARCHAR) || ' | 简称:' || p_brand AS attributes FROM part WHERE {LISTED}
""")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN1-JSN13: products out of wrapped and nested payloads."""
    cols = ("file", "sku_id", "title", "coupon_price", "selling_point", "comment_sales_floor", "hot_list_rank", "shop_url", "detail_url", "image", "attributes")
    return payloads.wares(search_bodies(spark, sf_dir)).select(*cols)


@register(f"SELECT {FILE} AS file, 'no_list' AS quality, count(*) > 0 AS readable FROM part GROUP BY 1")
def response_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN26, FLT13, JSN31: payloads whose list is not where it should be, but which are readable."""
    rows = search_bodies(spark, sf_dir)
    return rows.select("file", payloads.search_quality("body").alias("quality"), payloads.business_ok(landed.variant("body")).alias("readable"))


def detail_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.to_json(
        F.struct(
            F.struct(F.struct(F.when(F.col("p_partkey") % 2 == 0, F.format_string("%d", "p_size")).alias("price")).alias("finalPrice"), F.lit("9.9").alias("p")).alias("price"),
            F.struct(F.array(F.lit("food"), F.lit(" "), F.col("p_type"), F.col("p_brand")).alias("catName")).alias("pageConfigVO"),
            F.struct(F.concat(F.lit("<b>in</b> stock "), "p_brand").alias("stockDesc")).alias("stockInfo"),
            F.struct(
                F.array(
                    F.struct(F.lit("品牌").alias("labelName"), F.col("p_brand").alias("labelValue")),
                    F.struct(F.lit("size").alias("labelName"), F.format_string("%d", "p_size").alias("labelValue")),
                    F.struct(F.lit("none").alias("labelName"), F.lit("").alias("labelValue")),
                ).alias("attributes")
            ).alias("productAttributeVO"),
        )
    )
    return parts(spark, sf_dir).select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.lit("[1]")).otherwise(own).alias("body"))


@register("""
SELECT p_partkey, p_partkey % 5 <> 0 AS parsed, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '9.9' END AS detail_price_final,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'food > ' || p_type || ' > ' || p_brand END AS detail_category_path, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS detail_brand,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '品牌:' || p_brand || '; size:' || CAST(p_size AS VARCHAR) END AS detail_product_attributes,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'in stock ' || p_brand END AS detail_stock_text FROM part
""")
def detail_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN15-JSN18, JSN33, PRJ11."""
    cols = ("p_partkey", "parsed", "detail_price_final", "detail_category_path", "detail_brand", "detail_product_attributes", "detail_stock_text")
    return payloads.details(detail_bodies(spark, sf_dir)).select(*cols)


@register("""
SELECT CAST(conv_id AS VARCHAR) AS sku_id, CAST(turn AS VARCHAR) AS comment_id, role AS user_nick_name, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS tag_comment_content, 'https://p.x/1.jpg' AS pictures
FROM conversations WHERE turn % 3 <> 2
""")
def comment_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN19-JSN21, SET5: reviews at any depth; those that repeat an id, or have neither name nor text, do not count."""
    whole = F.col("turn") % 3 != 2
    picture = F.struct(F.lit("https://p.x/1.jpg").alias("largePicURL"))
    own = F.struct(F.format_string("%d", "turn").alias("commentId"), F.when(whole, F.col("role")).alias("userNickName"), F.when(whole, F.col("text")).alias("commentData"), F.array(picture, picture).alias("pictureInfoList"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.to_json(own).alias("c")))), lambda x: F.concat(F.lit('{"commentInfo":'), x["c"], F.lit("}")))
    body = F.concat(F.lit('{"result":{"floors":[['), F.array_join(F.concat(listed, F.slice(listed, 1, 1)), ","), F.lit("]]}}"))
    raw = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("sku_id")).agg(body.alias("body"))
    found = payloads.reviews(raw)
    return found.select("sku_id", "comment_id", "user_nick_name", "tag_comment_content", F.array_join("large_pic_urls", ",").alias("pictures"))


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, with two products in their markup."""
    key = (F.col("page_id") + 10_000).cast("string")
    more = F.concat(
        F.lit('<li data-sku="'), key, F.lit('" data-shopname="shop &amp; co"><a href="//x.y/'), key, F.lit('"><img alt="first &lt;one&gt;" src="jfs/a.png"></a>¥ 12.5</li>'),
        F.lit('<li data-sku="9'), key, F.lit('"><i>no title</i></li><script>{"wareId":"8'), key, F.lit('","x":1,"wareName":"in script","jdPrice":"3.20"}</script>'),
    )
    return table(spark, sf_dir, "pages").select("page_id", F.concat("html", more).alias("html"))


@register("""
SELECT page_id, CAST(page_id + 10000 AS VARCHAR) AS sku_id, 'first <one>' AS title, '12.5' AS price, 'https://x.y/' || CAST(page_id + 10000 AS VARCHAR) AS detail_url, 'shop & co' AS shop_name,
  'https://img13.360buyimg.com/n2/s480x480_jfs/a.png' AS image FROM pages
""")
def marked_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN24, JSN32: products by the numbers that elements carry; one without a title does not count."""
    return marked_pages(spark, sf_dir).select("page_id", F.explode(payloads.marked_products("html")).alias("p")).select("page_id", "p.*")


@register("SELECT page_id, '8' || CAST(page_id + 10000 AS VARCHAR) AS sku_id, 'in script' AS title, '3.20' AS price FROM pages")
def embedded_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN23, JSN25: products in scripts."""
    return marked_pages(spark, sf_dir).select("page_id", F.explode(payloads.embedded_products("html")).alias("p")).select("page_id", "p.*")


@register("""
SELECT p_partkey, p_name || '/T ' || p_size || '/a ' || p_name || '/m1/' || p_type || '/N' || p_brand || '/mid ' || p_brand || '/L ' || p_size || '/p1 ' || p_brand AS texts FROM part
""")
def tag_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN8, JSN9, JSN29: the texts of tags and of lists of texts, without selling points that are repeated as titles."""
    name, brand, kind, size = F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")
    titled = lambda t: F.struct(t.alias("title"))
    own = F.to_json(
        F.struct(
            F.lit("100001").alias("skuId"),
            F.array(kind).alias("sellingPoint"),
            F.array(F.struct(F.array(kind, brand).alias("title"), F.lit(None).cast("string").alias("text")), F.struct(F.lit(None).cast("array<string>").alias("title"), kind.alias("text"))).alias("benefitList"),
            F.struct(F.array(F.concat(F.lit("a "), name)).alias("desc"), F.lit("m1").alias("msg"), F.lit("behind the first").alias("content")).alias("iconList2"),
            titled(F.array(kind, F.concat(F.lit("N"), brand))).alias("newRegionFloor"),
            F.array(F.struct(F.lit(" ").alias("text"), F.concat(F.lit("mid  "), brand).alias("msg"))).alias("midTagList"),
            F.struct(F.array(F.struct(F.array(kind, F.lit("7"), F.concat(F.lit("L "), size), F.upper(name)).alias("Labels"))).alias("a")).alias("deep"),
            F.array(F.concat(F.lit("p1 "), brand), F.lit(" ")).alias("points"),
        )
    )
    tags = F.concat(F.lit('"tagList":["x","'), name, F.lit('",{"name":" ","title":"T '), size, F.lit('"},5,null]'))
    body = F.concat(F.lit("{"), tags, F.lit(","), F.substring(own, 2, 1 << 20))
    rows = parts(spark, sf_dir).select("p_partkey", body.alias("body"))
    return payloads.with_objects(rows, "body", payloads.SKU, payloads.NESTS).select("p_partkey", F.array_join("texts", "/").alias("texts"))


def requests(spark: SparkSession, sf_dir: str, body) -> DataFrame:
    return parts(spark, sf_dir).select("p_partkey", (F.col("p_partkey") % 3).alias("page"), (F.col("p_partkey") % 10).alias("cursor"), body.alias("body"))


@register("SELECT p_partkey, p_partkey % 3 AS page, p_partkey % 10 AS cursor, CASE WHEN p_size % 4 > 0 THEN p_partkey % 10 + p_size END AS next_cursor FROM part")
def next_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN14: the next page's cursor, wherever a payload has it."""
    page, s = F.col("p_partkey") % 3 + 1, F.col("p_partkey") % 10
    at = lambda name, p, x: F.struct(p.alias(name), x.alias("s"))
    later = F.when(F.col("p_size") % 4 > 0, s + F.col("p_size")).otherwise(s)
    body = F.to_json(
        F.struct(
            F.struct(at("page", page, later + 5).alias("b"), at("pageNo", page.cast("string"), F.concat(F.lit(" "), later.cast("string"))).alias("a"), at("pageIndex", page, F.lit("none")).alias("c")).alias("data"),
            F.array(F.array(at("page", page + 1, s + 1)), F.array(at("page", page, s - 1))).alias("lists"),
        )
    )
    moved = F.when(F.col("p_size") % 4 > 0, body).otherwise(F.regexp_replace(body, '"page":', '"pages":'))
    return payloads.next_cursors(requests(spark, sf_dir, F.concat(F.lit("cb("), moved, F.lit(")"))), "page", "cursor")


@register("""
SELECT p_partkey, CAST(CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 4 = 0 THEN p_size WHEN p_partkey % 4 = 1 THEN greatest(1, p_size % 5) ELSE greatest(1, p_size % 7) END AS BIGINT) AS step FROM part
""")
def cursor_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG30: steps from a named cursor, from the entries of a list, from products at any depth, and of payloads without products."""
    shape, page, s = F.col("p_partkey") % 4, F.col("p_partkey") % 3, F.col("p_partkey") % 10
    wares = lambda n: F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((F.lit(100_000) + i).cast("string").alias("skuId"), F.col("p_name").alias("wareName"), F.lit("0").alias("isAd")))
    advert = F.array(F.struct(F.lit("999999").alias("skuId"), F.col("p_name").alias("wareName"), F.lit("true").alias("isAd")))
    few, many = F.concat(wares(F.col("p_size") % 5), advert), F.concat(wares(F.col("p_size") % 7), advert)
    listed = F.to_json(F.struct(F.struct(few.alias("wareList")).alias("data")))
    named = F.to_json(F.struct((page + 1).alias("page"), (s + F.col("p_size")).alias("s")))
    deep = F.to_json(F.struct(F.array(F.struct(many.alias("x")), F.struct(many.alias("x"))).alias("data")))
    body = F.when(shape == 3, F.lit('{"data":{"wareList":[]}}')).when(shape == 0, F.concat(F.lit('{"next":'), named, F.lit(","), F.substring(listed, 2, 1 << 20))).when(shape == 1, listed).otherwise(deep)
    return payloads.cursor_steps(requests(spark, sf_dir, body), "page", "cursor").select("p_partkey", "step")


@register("SELECT p_partkey, CASE WHEN p_partkey % 4 > 1 THEN p_brand ELSE '' END AS category, CASE WHEN p_partkey % 4 > 0 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS guid FROM part")
def first_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN22: category and id of the first review."""
    mark = F.when(F.col("p_partkey") % 4 > 1, F.concat(F.lit(" "), "p_brand", F.lit("_1_"), "p_type"))
    one = F.struct(F.col("p_partkey").alias("guid"), mark.alias("maidianInfo"))
    body = F.to_json(F.struct(F.when(F.col("p_partkey") % 4 > 0, F.array(one, one)).otherwise(F.slice(F.array(one), 1, 0)).alias("commentInfoList")))
    columns = payloads.first_category(landed.variant("body"))
    return parts(spark, sf_dir).select("p_partkey", body.alias("body")).select("p_partkey", *[c.alias(k) for k, c in columns.items()])


@register("""
SELECT p_partkey, ['empty_body', 'not_json', 'no_wares', 'ok', 'no_list', 'no_list', 'ok'][p_partkey % 7 + 1] AS quality, p_partkey % 7 IN (2, 3, 4) AS readable FROM part
""")
def response_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN26, FLT13: what became of requests, every state of them."""
    bodies = (" ", "<html>", '{"data":{"wareList":[]}}', 'f({"code":0,"data":{"wareList":[{"skuId":"1"}]}});', '{"data":{"wareList":{}}}', "[1]", '{"code":3,"data":{"wareList":[1]}}')
    body = F.element_at(F.array(*map(F.lit, bodies)), (F.col("p_partkey") % 7 + 1).cast("int"))
    rows = parts(spark, sf_dir).select("p_partkey", body.alias("body"))
    return rows.select("p_partkey", payloads.search_quality("body").alias("quality"), F.coalesce(payloads.business_ok(landed.variant("body")), F.lit(False)).alias("readable"))
