"""Queries on the product catalogue and on browsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.operators import catalog
from tallyshelf.plans.registry import register
from tallyshelf.sources.tables import table

#: Rows before are of an older run, so that about half of the products of sf0.001 and of sf0.01 are new after it.
CUT = "TIMESTAMP '2024-01-02 00:00:00'"
EVENTS = """ev AS (SELECT event_id, ts, event_type AS platform, CAST(user_id AS VARCHAR) AS sku_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 't' || CAST(event_id AS VARCHAR) END AS title,
   CASE WHEN event_id % 4 = 0 THEN '' ELSE 'b' || CAST(event_id % 7 AS VARCHAR) END AS detail_brand, props FROM events)"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingested rows: an event each, its type as platform and its user as product."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("platform"),
        F.col("user_id").cast("string").alias("sku_id"),
        F.lit("").alias("ware_id"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("t"), k.cast("string"))).alias("title"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("b"), (k % 7).cast("string"))).alias("detail_brand"),
        F.lit("").alias("detail_price_final"),
        F.lit("").alias("detail_category_path"),
        F.col("props").alias("current_payload"),
        F.date_format("ts", "yyyy-MM-dd").alias("last_job"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_captured_at"),
        "ts",
    )


@register(f"""
WITH {EVENTS}, k AS (SELECT DISTINCT platform, sku_id FROM ev),
  l AS (SELECT platform, sku_id, detail_brand, props, row_number() OVER (PARTITION BY platform, sku_id ORDER BY event_id DESC) AS rk FROM ev),
  t AS (SELECT platform, sku_id, title, row_number() OVER (PARTITION BY platform, sku_id ORDER BY event_id DESC) AS rk FROM ev WHERE title <> ''),
  o AS (SELECT DISTINCT platform, sku_id FROM ev WHERE ts < {CUT})
SELECT k.platform, k.sku_id, coalesce(t.title, '') AS title, l.detail_brand, l.props AS current_payload, o.sku_id IS NULL AS created
FROM k JOIN l ON l.platform = k.platform AND l.sku_id = k.sku_id AND l.rk = 1 LEFT JOIN t ON t.platform = k.platform AND t.sku_id = k.sku_id AND t.rk = 1
LEFT JOIN o ON o.platform = k.platform AND o.sku_id = k.sku_id WHERE true
""")
def product_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAT1: all rows applied to the catalogue of those before CUT: blank titles leave the old one, blank brands erase it."""
    every, order = rows(spark, sf_dir), F.col("event_id")
    nothing = catalog.batch_products(every.where("event_id < 0"), order)
    old = catalog.upserted(nothing, every.where(f"ts < {CUT}"), order).drop("created")
    return catalog.upserted(old, every, order).select("platform", "sku_id", "title", "detail_brand", "current_payload", "created")


SNAPS = f"""{EVENTS}, s AS (SELECT platform, sku_id, strftime(ts, '%Y-%m-%d') AS job, event_id, props FROM ev),
  sn AS (SELECT platform, sku_id, job, max(event_id) AS last FROM s GROUP BY platform, sku_id, job)"""


def snaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = rows(spark, sf_dir).withColumns({"captured_at": F.col("event_id"), "payload": F.col("current_payload"), "job": F.col("last_job")})
    return catalog.snapshots(every, F.col("event_id"), "job")


@register(f"WITH {SNAPS} SELECT sn.platform, sn.sku_id, sn.job, sn.last AS captured_at, props AS payload FROM sn JOIN ev ON ev.event_id = sn.last")
def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAT2, PRJ8: one snapshot per product and job, the last row's."""
    return snaps(spark, sf_dir)


@register(f"""
WITH {SNAPS}, k AS (SELECT 'view' AS platform, CAST(c_custkey AS VARCHAR) AS sku_id FROM customer), f AS (SELECT platform, sku_id, count(*) AS n FROM sn GROUP BY platform, sku_id)
SELECT k.platform, k.sku_id, coalesce(n, 0) AS n_snapshots FROM k LEFT JOIN f ON f.platform = k.platform AND f.sku_id = k.sku_id
""")
def product_snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON7: every customer as a product, most of them without snapshots."""
    keys = table(spark, sf_dir, "customer").select(F.lit("view").alias("platform"), F.col("c_custkey").cast("string").alias("sku_id"))
    return catalog.with_snapshot_counts(keys, snaps(spark, sf_dir))


@register("""
SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus AS status, o_orderpriority AS priority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'
""")
def snapshot_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON8, FLT9: rows with what their job says, of jobs in a readable state."""
    jobs = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(jobs, "l_orderkey")


@register(f"""
WITH {EVENTS}, n AS (SELECT * FROM ev WHERE ts >= {CUT}), o AS (SELECT DISTINCT platform, sku_id FROM ev WHERE ts < {CUT}),
  c AS (SELECT count(*) AS created FROM (SELECT DISTINCT n.platform, n.sku_id FROM n LEFT JOIN o ON o.platform = n.platform AND o.sku_id = n.sku_id WHERE o.sku_id IS NULL) AS d)
SELECT count(*) AS rows_in_csv, count(*) AS rows_ingested, count(*) AS snapshots_upserted, max(created) AS products_created FROM n, c
""")
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG27: the rows from CUT on, against the catalogue of all rows before."""
    every = rows(spark, sf_dir)
    return catalog.ingest_stats(every.where(f"ts >= {CUT}"), every.where(f"ts < {CUT}"))


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def paged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN5, FLT10: the third page of 50 rows."""
    return catalog.page_of(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 3, 50)


@register("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200 OFFSET 10")
def newest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN6-WIN8: newest first, ties by key, at most 200."""
    return catalog.newest(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 500, 10)


@register("SELECT p_partkey, p_name FROM part WHERE position('red' IN lower(p_name)) > 0 OR position('red' IN lower(p_brand)) > 0")
def search_icontains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT5, CAT6."""
    return catalog.containing(table(spark, sf_dir, "part"), ["p_name", "p_brand"], " RED ").select("p_partkey", "p_name")


@register("""SELECT event_id FROM events WHERE props = '{"k": 7}'""")
def json_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT6, FLT4."""
    return catalog.with_member(table(spark, sf_dir, "events"), "props", "k", "7").select("event_id")


@register("""
SELECT CAST(place AS INTEGER) AS place, "column", filled FROM (
  SELECT 0 AS place, 'p_name' AS "column", bool_or(trim(p_name) <> '') AS filled FROM part UNION ALL
  SELECT 1, 'p_brand', bool_or(trim(p_brand) <> '') FROM part UNION ALL SELECT 2, 'blank', false) AS x
""")
def nonempty_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BRW1-BRW4: which columns have anything in them, in one pass."""
    return catalog.filled_columns(table(spark, sf_dir, "part").select("p_name", "p_brand", F.lit("  ").alias("blank")))


@register("SELECT o_orderstatus AS job, count(*) AS n FROM orders GROUP BY o_orderstatus")
def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG26."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("job")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS row_index, l_returnflag AS job FROM lineitem")
def row_index_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN14: dense numbers from 0 within each job."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    cols = table(spark, sf_dir, "lineitem").select(*keys, F.col("l_returnflag").alias("job"))
    return catalog.numbered(cols, keys, "job")


@register("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders")
def row_index_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN14: dense numbers over a whole table, without bringing it into one task."""
    return catalog.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@register("""
WITH s AS (SELECT date_trunc('hour', ts) AS w, event_type FROM events) SELECT w AS start, w + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n FROM s GROUP BY w, event_type
""")
def event_counts_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by time window, as the streaming form counts them."""
    from tallyshelf.streaming.upsert import counted_by_window

    return counted_by_window(table(spark, sf_dir, "events"), "ts", "event_type")
