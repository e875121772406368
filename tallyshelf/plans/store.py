"""Queries on landed files, on what is browsed and exported, and on answers of models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.functions import replies
from tallyshelf.functions.text import distinct_texts
from tallyshelf.operators import browse, ingest
from tallyshelf.plans import catalogue
from tallyshelf.plans.payloads import detail_bodies
from tallyshelf.plans.registry import register
from tallyshelf.sources import landed, sinks
from tallyshelf.sources.shared import scratch
from tallyshelf.sources.schema import RELATIONS
from tallyshelf.sources.tables import dealt, table
from tallyshelf.streaming.upsert import current

PARTS = {"货号": "p_partkey", "名称": "p_name", "品牌": "p_brand", "空": "blank"}
ORDERS = {"单号": "o_orderkey", "状态": "o_orderstatus", "空": "blank"}


@register("""
SELECT o_orderpriority AS job, 'orders' AS relation, count(*) AS n_rows, 'o_orderkey=单号,o_orderstatus=状态' AS listed FROM orders GROUP BY 1
UNION ALL SELECT p_type, 'parts', count(*), CASE WHEN bool_or(p_size % 2 = 0 AND p_size > 48) THEN 'p_partkey=货号,p_name=名称,p_brand=品牌,blank=空' ELSE 'p_partkey=货号,p_name=名称,p_brand=品牌' END FROM part GROUP BY 1
""")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAT5, BRW2, AGG26: the rows and filled columns of two relations in each job."""
    orders = table(spark, sf_dir, "orders").withColumns({"job": F.col("o_orderpriority"), "blank": F.lit(" ")})
    odd = F.when((F.col("p_size") % 2 == 0) & (F.col("p_size") > 48), "x").otherwise(" ")
    parts = table(spark, sf_dir, "part").withColumns({"job": F.col("p_type"), "blank": odd})
    found = browse.summary({"orders": (orders, ORDERS), "parts": (parts, PARTS)}, "job")
    listed = F.array_join(F.transform("columns", lambda x: F.concat(x["key"], F.lit("="), x["label"])), ",")
    return found.select("job", "relation", "n_rows", listed.alias("listed"))


CUSTOMERS = """prod AS (SELECT 'view' AS platform, CAST(c_custkey AS VARCHAR) AS sku_id, c_name AS title, c_mktsegment AS detail_brand, c_nationkey AS nation, c_name AS last_captured_at FROM customer)"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.lit("view").alias("platform"),
        F.col("c_custkey").cast("string").alias("sku_id"),
        F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("detail_brand"),
        F.to_json(F.struct(F.col("c_nationkey").cast("string").alias("pipeline_keyword"))).alias("current_payload"),
        F.col("c_name").alias("last_captured_at"),
    )


@register(f"""
WITH {catalogue.SNAPS}, {CUSTOMERS}, shown AS (SELECT * FROM prod WHERE position('household' IN lower(detail_brand)) > 0 AND nation = 3 ORDER BY last_captured_at DESC, sku_id LIMIT 200),
  f AS (SELECT platform, sku_id, count(*) AS n FROM sn GROUP BY platform, sku_id)
SELECT shown.sku_id, title, coalesce(n, 0) AS n_snapshots FROM shown LEFT JOIN f ON f.platform = shown.platform AND f.sku_id = shown.sku_id
""")
def product_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAT4: a page of products by text and keyword."""
    found = browse.product_list(customers(spark, sf_dir), catalogue.snaps(spark, sf_dir), "Household", "3", 200)
    return found["results"].select("sku_id", "title", "n_snapshots")


@register(f"WITH {catalogue.SNAPS} SELECT job, last AS captured_at FROM sn WHERE platform = 'view' AND sku_id = '8'")
def product_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAT4, WIN8: the snapshots of one product."""
    return browse.history(catalogue.snaps(spark, sf_dir), "view", "8").select("job", "captured_at")


@register("""
SELECT p_partkey AS row_index, '{"货号":"' || CAST(p_partkey AS VARCHAR) || '","名称":"' || p_name || CASE WHEN p_size > 25 THEN '","品牌":"' || p_brand ELSE '' END || '"}' AS cells FROM part
""")
def sparse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ6: rows under the headers of an export, without blank cells."""
    rows = table(spark, sf_dir, "part").withColumn("p_brand", F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(" "))
    return rows.select(F.col("p_partkey").alias("row_index"), F.to_json(browse.sparse_row(rows, PARTS)).alias("cells"))


@register('SELECT p_partkey AS row_index, p_partkey AS "货号", p_name AS "名称", p_brand AS "品牌" FROM part')
def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ9: rows under the headers of an export."""
    return browse.as_sheet(table(spark, sf_dir, "part").withColumn("row_index", F.col("p_partkey")), PARTS)


@register("""
SELECT m.p_partkey AS row_index, CAST(m.p_partkey + 1 AS VARCHAR) AS sku_id, m.p_name AS detail_body_ingredients, CASE WHEN d.p_partkey % 5 = 0 THEN '' ELSE d.p_brand END AS detail_brand
FROM part AS m JOIN part AS d ON d.p_partkey = m.p_partkey + 1
""")
def details_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6, SNK13: detail rows from landed payloads for a merged table, one of whose products has none."""
    files = detail_bodies(spark, sf_dir).select(F.format_string("ware_%d_response.json", "p_partkey").alias("file"), "body")
    merged = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_index"), (F.col("p_partkey") + 1).cast("string").alias("sku_id"), F.col("p_name").alias("detail_body_ingredients"))
    return ingest.regenerated_details(files, merged).select("row_index", "sku_id", "detail_body_ingredients", "detail_brand")


@register("""
WITH t AS (SELECT p_size AS product, p_partkey AS place, p_name, p_brand = 'Brand#2' AS failed, p_type = 'ECONOMY' AND p_brand <> 'Brand#2' AS good FROM part),
  h AS (SELECT product, max(place) FILTER (WHERE good) AS hit FROM t GROUP BY product)
SELECT t.product, max(p_name) FILTER (WHERE place = hit) AS text, max('u' || CAST(place AS VARCHAR)) FILTER (WHERE place = hit) AS url, count(*) FILTER (WHERE hit IS NULL OR place >= hit) AS tried,
  count(*) FILTER (WHERE (hit IS NULL OR place > hit) AND failed) AS errors, count(*) FILTER (WHERE (hit IS NULL OR place > hit) AND NOT failed) AS rejected
FROM t JOIN h ON h.product = t.product GROUP BY t.product
""")
def last_accepted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR25: of each product the last picture whose text is accepted."""
    tries = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("product"), F.col("p_partkey").alias("at"), F.col("p_name").alias("text"), F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"),
        (F.col("p_brand") == "Brand#2").alias("failed"), "p_type",
    )
    return ingest.last_accepted(tries, "product", "at", "text", "url", "failed", F.col("p_type") == "ECONOMY")


@register("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name || '/' || p_brand END AS phrases,
  CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN '{"phrases":["' || p_name || '"," ","' || p_brand || '"]}' ELSE 'see: {"phrases": [" ' || p_name || '", "' || p_brand || '"]} ok' END AS bare,
  'a ' || p_name || p_brand AS content, p_name || '/' || lower(p_brand) AS keys, p_name || '/' || p_brand AS once, '{"a":"' || p_name || '","b":' || p_size || '}' AS payload FROM part
""")
def reply_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR30, STR34, STR35, JSN29, SET6, SNK8: texts, objects and parts in answers."""
    name, brand, form = F.col("p_name"), F.col("p_brand"), F.col("p_size") % 3
    json = F.concat(F.lit('```json\n{"phrases":["'), name, F.lit('"," ","'), brand, F.lit('"]}\n``` \n```'))
    loose = F.concat(F.lit('see: {"phrases": [" '), name, F.lit('", "'), brand, F.lit('"]} ok'))
    reply = F.when(form == 0, F.concat(F.lit("```\n"), name, F.lit("\n```"))).when(form == 1, json).otherwise(loose)
    content = F.concat(F.lit('["a ", {"type": "text", "text": "'), name, F.lit('"}, {"x": 1}, {"text": "'), brand, F.lit(' "}, 3]'))
    several = F.array(name, F.upper(name), brand, F.lit(" "), F.concat(F.lit(" "), brand))
    payload = F.concat(F.lit('{"b": '), F.col("p_size").cast("string"), F.lit(', "a": "'), name, F.lit('"}'))
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select(
        "p_partkey",
        F.array_join(replies.phrases(F.when(form == 1, replies.without_fence(reply)).otherwise(reply)), "/").alias("phrases"),
        replies.without_fence(reply).alias("bare"),
        replies.content_text(content).alias("content"),
        F.array_join(replies.text_keys(several), "/").alias("keys"),
        F.array_join(distinct_texts(several), "/").alias("once"),
        sinks.sorted_payload(payload).alias("payload"),
    )


@register("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || ' \"x\", ' || chr(10) || 'y' AS p_name, p_brand, '' AS blank FROM part")
def landed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1-SRC4, SNK1: a CSV table written and read by its headers: quotes and line breaks stay, ends of cells are stripped."""
    path = scratch(spark, "landed")
    text = F.concat(F.lit(" "), "p_name", F.lit(' "x", \ny'))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("货号"), F.lit("z").alias("另"), text.alias("名称"), F.col("p_brand").alias("品牌"))
    rows.write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False).csv(path)
    return landed.read_table(spark, path, PARTS)


@register("SELECT CAST(count(*) AS BIGINT) AS result_count, CASE WHEN p_brand < 'Brand#2' THEN p_brand END AS list_keyword FROM part GROUP BY p_brand")
def landed_result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5: the declared counts of search payloads, a file each."""
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    data = F.struct(F.col("n").cast("string").alias("resultCount"), F.when(F.col("p_brand") < "Brand#2", F.col("p_brand")).otherwise(" ").alias("listKeyWord"))
    path = scratch(spark, "search")
    counts.select(data.alias("data")).write.option("maxRecordsPerFile", 1).json(path)
    return landed.result_counts(spark, path).drop("file")


@register("""
SELECT p_partkey, CAST(i AS INTEGER) AS slot, CASE i WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN 'w' ELSE '' END AS sku_id, CASE i WHEN 1 THEN p_brand ELSE '' END AS short_name FROM part, (SELECT unnest([0, 1, 2]) AS i) AS x
""")
def listing_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC9, JSN31: the places of listings, also those without a product."""
    body = F.concat(F.lit('{"data":{"wareList":[{"skuId":'), F.col("p_partkey").cast("string"), F.lit('},{"wareId":" w","shortName":"'), "p_brand", F.lit('"},{"shortName":{}}]}}'))
    return landed.slots(table(spark, sf_dir, "part").select("p_partkey", body.alias("body")), "p_partkey")


@register("SELECT CAST(p_partkey AS VARCHAR) AS sku_id, '{\"a\":' || p_size || '}' AS body FROM part")
def landed_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7, SRC10: reviews by line among blank lines, comments and broken lines."""
    path, key = scratch(spark, "reviews"), F.col("p_partkey").cast("string")
    good = F.concat(F.lit(' {"sku": " '), key, F.lit(' ", "parsed": {"a": '), F.col("p_size").cast("string"), F.lit("}} "))
    lines = F.explode(F.array(good, F.concat(F.lit("# "), key), F.lit("  "), F.lit("{")))
    table(spark, sf_dir, "part").select(lines.alias("value")).write.text(path)
    return landed.reviews_by_line(spark, path)


@register("SELECT o_orderkey, o_orderstatus AS job_id, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS version FROM orders")
def jobs_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK6, SRC11: the partition of one job written anew, those of others left alone, then each job read by itself."""
    path = scratch(spark, "jobs")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("job_id"))
    sinks.replace_job(rows.withColumn("version", F.lit(1)), path)
    sinks.replace_job(rows.where("job_id = 'P'").withColumn("version", F.lit(2)), path)
    first, second, third = (sinks.rows_of_job(spark, path, job) for job in ("F", "O", "P"))
    return first.unionByName(second).unionByName(third)


@register("SELECT p_partkey, p_name FROM part UNION ALL SELECT p_partkey, p_name FROM part")
def lines_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7: rows appended twice as lines of JSON."""
    path = scratch(spark, "lines")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    sinks.append_lines(rows, path)
    sinks.append_lines(rows, path)
    return spark.read.schema(rows.schema).json(path)


@register("""
WITH p AS (SELECT count(*) AS n FROM part), c AS (SELECT count(*) AS n FROM customer), two AS (SELECT unnest(['007', '7']) AS job)
SELECT 'search' AS relation, job, n AS n_rows, n - 1 AS last_index FROM p, two UNION ALL SELECT 'detail', job, n, n - 1 FROM p, two UNION ALL SELECT 'comments', '007', n, n - 1 FROM c
UNION ALL SELECT 'merged', job, n, n - 1 FROM p, two UNION ALL SELECT 'snapshots', job, n, NULL FROM p, two UNION ALL SELECT 'products', '7', n, NULL FROM p
""")
def runs_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAT3, SNK6, SRC11, WIN14: runs 7 and 007 with all parts as products and all customers as comments, then run 7 again without comments."""
    folder, store = scratch(spark, "landed-run"), scratch(spark, "store")
    parts, texts = dealt(table(spark, sf_dir, "part"), "p_partkey"), dealt(table(spark, sf_dir, "customer"), "c_custkey")
    own = {
        "search": {"sku_id": "p_partkey", "title": "p_name"},
        "detail": {"sku_id": "p_partkey", "detail_brand": "p_brand"},
        "merged": {"sku_id": "p_partkey", "title": "p_name", "detail_brand": "p_brand"},
        "comments": {"sku_id": "c_custkey", "tag_comment_content": "c_name"},
    }
    files = {r: f"{folder}/{r}" for r in own} | {"none": f"{folder}/none"}
    for relation, cells in own.items():
        headers = {internal: header for header, internal in RELATIONS[relation].items()}
        rows = texts if relation == "comments" else parts
        rows.select(*[F.col(c).alias(headers[k]) for k, c in cells.items()]).write.options(header=True, quote='"', escape='"').csv(files[relation])
    for job, comments in (("7", "comments"), ("007", "comments"), ("7", "none")):
        ingest.ingest_run(spark, files | {"comments": files[comments]}, store, job, "jd", "t")
    counted = lambda rows, name, job, last: rows.groupBy(job.alias("job")).agg(F.count(F.lit(1)).alias("n_rows"), last.alias("last_index")).select(F.lit(name).alias("relation"), "job", "n_rows", "last_index")
    nothing = F.max(F.lit(None).cast("long"))
    found = [counted(sinks.stored(spark, f"{store}/{r}"), r, F.col("job_id"), F.max("row_index")) for r in ("search", "detail", "comments", "merged")]
    found += [counted(sinks.stored(spark, f"{store}/snapshots"), "snapshots", F.col("job_id"), nothing), counted(current(spark, f"{store}/products"), "products", F.col("last_job"), nothing)]
    return reduce(DataFrame.unionByName, found)
