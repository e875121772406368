"""Queries on tables that tasks write and that are read back: exports, chunks by key, the catalogue in buckets, the matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.functions.category import group_key
from tallyshelf.operators import brief, catalog
from tallyshelf.plans.inputs import products
from tallyshelf.plans.registry import register
from tallyshelf.sources import answers, cursor, exports
from tallyshelf.sources.shared import scratch
from tallyshelf.sources.tables import table
from tallyshelf.streaming import upsert


@register("""
SELECT CAST(c_custkey AS VARCHAR) AS row_index, CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE c_name || ', "x"' || chr(10) || 'y' END AS title, CASE WHEN c_nationkey % 2 = 0 THEN '["' || c_mktsegment || '"]' ELSE '[]' END AS pics FROM customer
""")
def export_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1, SNK2, SNK4, PRJ5: customers as the part files of a CSV export, without the column that is blank throughout, read back."""
    title = F.when(F.col("c_nationkey") % 3 == 0, F.lit(None)).otherwise(F.concat("c_name", F.lit(', "x"\ny')))
    pics = F.when(F.col("c_nationkey") % 2 == 0, F.array("c_mktsegment")).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_index"), title.alias("title"), F.lit(" ").alias("blank"), pics.alias("pics"))
    made = exports.export({"all": (rows, {"名称": "title", "空": "blank", "图": "pics"})}, "all", "csv", {"job_id": 1}, scratch(spark, "export"))
    return exports.read_csv(spark, made["sections"][0]["path"], ["row_index", "名称", "图"]).toDF("row_index", "title", "pics")


@register("""
SELECT unnest(['[', ']']) AS line, CAST(1 AS BIGINT) AS n UNION ALL SELECT '  {', count(*) FROM customer
UNION ALL SELECT '  }' || CASE WHEN c_custkey = m THEN '' ELSE ',' END, count(*) FROM customer, (SELECT max(c_custkey) AS m FROM customer) GROUP BY 1
UNION ALL SELECT '    "row_index": ' || c_custkey || ',', 1 FROM customer UNION ALL SELECT '    "title": "' || c_name || ' \\"q\\""', 1 FROM customer
""")
def export_json_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3: the lines of a JSON export, with how often each stands there."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_index"), F.concat("c_name", F.lit(' "q"')).alias("title"), F.lit("").alias("blank"))
    made = exports.export({"rows": (rows, {"名称": "title", "空": "blank"})}, "rows", "json", {"job_id": 1}, scratch(spark, "export"))
    return spark.read.text(made["sections"][0]["path"]).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 400 AS chunk, o_orderkey, o_totalprice FROM orders")
def cursor_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12: all chunks of the orders, each row with its chunk by the chunks' bounds."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    numbered = catalog.numbered(rows, ["o_orderkey"])
    bounds = cursor.bounds(rows, "o_orderkey")
    own = numbered.withColumn("chunk", F.floor(F.col("row_index") / cursor.SIZE)).join(bounds, "chunk").where("o_orderkey >= first")
    return own.select("chunk", "o_orderkey", "o_totalprice")


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 400 OFFSET 800")
def cursor_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12: the third chunk of the orders, by a scan of its key range."""
    rows = cursor.laid_out(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", scratch(spark, "laid-out"))
    return cursor.Cursor(rows, "o_orderkey").chunk(2)


@register("""
SELECT 'jd' AS platform, CAST(p_partkey AS VARCHAR) AS sku_id, p_name AS title, CASE WHEN p_size % 5 = 0 THEN lower(p_brand) ELSE p_brand END AS detail_brand, CASE WHEN p_size % 5 = 0 THEN '2' ELSE '1' END AS last_job FROM part
UNION ALL SELECT 'jd', 'c' || c_custkey, '', c_mktsegment, '3' FROM customer WHERE c_nationkey = 3
""")
def catalogue_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAT1: the catalogue after three batches into hashed buckets: all parts, some of them again without titles, other products."""
    path = scratch(spark, "catalogue")

    def rows(df: DataFrame, key, title, brand, job: str) -> DataFrame:
        own = {"platform": F.lit("jd"), "sku_id": key, "title": title, "detail_brand": brand, "last_job": F.lit(job)}
        blank = [F.lit("").alias(c) for c in ("ware_id", "detail_price_final", "detail_category_path", "current_payload", "last_captured_at")]
        return df.select(*[c.alias(k) for k, c in own.items()], *blank)

    parts, key = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    others = table(spark, sf_dir, "customer").where("c_nationkey = 3")
    batches = [
        rows(parts, key, F.col("p_name"), F.col("p_brand"), "1"),
        rows(parts.where("p_size % 5 = 0"), key, F.lit(" "), F.lower("p_brand"), "2"),
        rows(others, F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.lit(""), F.col("c_mktsegment"), "3"),
    ]
    for number, batch in enumerate(batches):
        upsert.apply_batch(batch, path, number, F.col("sku_id"))
    return upsert.current(spark, path).select("platform", "sku_id", "title", "detail_brand", "last_job")


@register("""
WITH g AS (SELECT p_partkey, p_brand, CASE p_size % 5 WHEN 0 THEN '未归类（无类目路径）' WHEN 3 THEN p_type WHEN 2 THEN p_type WHEN 1 THEN p_type ELSE p_type END AS grp FROM part),
  f AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p_partkey) AS place FROM g), b AS (SELECT grp, p_brand, min(place) AS first FROM f WHERE place <= 100 GROUP BY grp, p_brand),
  l AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY first) AS rk FROM b), t AS (SELECT grp, string_agg(p_brand, '/' ORDER BY first) AS brands FROM l WHERE rk <= 15 GROUP BY grp),
  n AS (SELECT grp, count(*) AS sku_count FROM g GROUP BY grp)
SELECT n.grp AS "group", sku_count, brands FROM n JOIN t ON t.grp = n.grp
""")
def matrix_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN27, WIN12, AGG23: the groups of a matrix that is written as a table, their sizes and first brands."""
    own = {"row_index": F.col("p_partkey"), "sku_id": F.col("p_partkey").cast("string"), "title": F.col("p_name"), "detail_brand": F.col("p_brand"), "category": F.col("category"), "group": group_key("category")}
    blank = {c: F.lit("") for c in ("price", "coupon_price", "detail_price_final", "shop_name", "detail_shop_name", "selling_point", "comment_fuzzy")}
    rows = products(spark, sf_dir).select(*[c.alias(k) for k, c in (own | blank).items()])
    return brief.write_matrix(rows, scratch(spark, "matrix")).select("group", "sku_count", F.array_join("distinct_brands_sample", "/").alias("brands"))


@register("""
SELECT 'answer_' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '.json' AS file, CASE WHEN c_nationkey % 4 = 0 THEN 'no json ' || c_name ELSE '{' || chr(10) || '  "name": "' || c_name || '"' || chr(10) || '}' END AS body,
  CASE WHEN c_nationkey % 4 <> 0 THEN c_name END AS name FROM customer
""")
def landed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK14, SRC5: an answer for each customer landed as a file of its own, JSON or not, and read again."""
    path = scratch(spark, "answers")
    text = F.when(F.col("c_nationkey") % 4 == 0, F.concat(F.lit("no json "), "c_name")).otherwise(F.concat(F.lit('{"name":"'), "c_name", F.lit('"}')))
    rows = table(spark, sf_dir, "customer").select(F.format_string("answer_%08d.json", "c_custkey").alias("file"), text.alias("body"))
    answers.land(rows, path)
    return answers.landed(spark, path).select("file", "body", F.get_json_object("body", "$.name").alias("name"))
