"""Queries on readings below charts, records of jobs, metadata of runs, and specifications in cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.functions import specs
from tallyshelf.operators import lexicon, rank, readings, records
from tallyshelf.plans.comments import SCOPE, TAGGED, any_of
from tallyshelf.plans.inputs import LISTING, at, listing, texts
from tallyshelf.plans.payloads import detail_bodies
from tallyshelf.plans.registry import register
from tallyshelf.sources import exports, landed, sinks
from tallyshelf.sources.schema import RELATIONS
from tallyshelf.sources.shared import put_text, scratch
from tallyshelf.sources.tables import table


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def share_sql(n: str, total: str, decimals: int = 1) -> str:
    """n of total in per cent as text, halves to the even digit."""
    scaled = f"(({n}) * {1000 if decimals else 100})"
    q = f"({scaled} // ({total}) + CASE WHEN 2 * ({scaled} % ({total})) > ({total}) OR (2 * ({scaled} % ({total})) = ({total}) AND {scaled} // ({total}) % 2 = 1) THEN 1 ELSE 0 END)"
    return f"(CAST({q} // 10 AS VARCHAR) || '.' || CAST({q} % 10 AS VARCHAR))" if decimals else f"CAST({q} AS VARCHAR)"


def between_sql(parts: tuple[str, ...], *cells: str) -> str:
    return " || ".join([quoted(parts[0]), *[f"CAST({c} AS VARCHAR) || {quoted(t)}" for c, t in zip(cells, parts[1:], strict=True)]])


def shares_sql(label: str) -> str:
    """Per leaf category: c1 and c3 in millionths, the top label, labelled rows and all rows."""
    return f"""SELECT a.leaf_category, CAST(round(round(n1 / CAST(n AS DOUBLE), 6) * 1000000) AS BIGINT) AS c1, CAST(round(round(n3 / CAST(n AS DOUBLE), 6) * 1000000) AS BIGINT) AS c3, top, coalesce(n, 0) AS n, n_all
  FROM (SELECT leaf_category, count(*) AS n_all FROM shelf GROUP BY 1) AS a LEFT JOIN (SELECT leaf_category, max(n) AS n1, sum(n) FILTER (WHERE rk <= 3) AS n3, max(label) FILTER (WHERE rk = 1) AS top, sum(n) AS n FROM
    (SELECT *, row_number() OVER (PARTITION BY leaf_category ORDER BY n DESC, first_seen) AS rk FROM
      (SELECT leaf_category, {label} AS label, count(*) AS n, min(ord) AS first_seen FROM shelf WHERE {label} <> '' GROUP BY 1, 2)) GROUP BY 1) AS g ON g.leaf_category = a.leaf_category"""


SHELF = f"{LISTING}, shelf AS (SELECT * REPLACE (CASE WHEN size % 4 = 0 OR leaf_category = 'PROMO' THEN '' ELSE brand END AS brand, CASE WHEN size % 7 = 0 THEN '' ELSE shop_name || '|x' END AS shop_name) FROM listing)"
CELL = "replace({}, '|', '/')"
HEAD, END = f"'', {quoted(readings.HEADING)}, ''", "''"


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing with rows that name no brand or no shop, and one category without brands."""
    rows = listing(spark, sf_dir)
    brand = F.when((F.col("size") % 4 == 0) | (F.col("leaf_category") == "PROMO"), "").otherwise(F.col("brand"))
    return rows.withColumns({"brand": brand, "shop_name": F.when(F.col("size") % 7 == 0, "").otherwise(F.concat("shop_name", F.lit("|x")))})


def numbered_lines(rows: DataFrame, *by: str) -> DataFrame:
    return rows.select(*by, F.posexplode("lines").alias("place", "line"))


def unnested(source: str, lines: str, by: str, where: str = "TRUE") -> str:
    return f"SELECT {by}, CAST(unnest(range(len(ls))) AS INTEGER) AS place, unnest(ls) AS line FROM (SELECT {by}, [{lines}] AS ls FROM ({source}) AS q WHERE {where})"


BRAND = f"{between_sql(readings.BRAND_TOP, 'n', 'n_all', CELL.format('top'), share_sql('c1', '1000000'))}, {between_sql(readings.BRAND_THREE, share_sql('c3', '1000000'))}"
SHOP = (
    f"{between_sql(readings.SHOP_ROWS, 'n', 'n_all')}, {between_sql(readings.SHOP_TOP, CELL.format('top'), share_sql('c1', '1000000'))}, "
    f"{between_sql(readings.SHOP_THREE, share_sql('c3', '1000000'))}"
)


@register(f"""
WITH {SHELF} SELECT 'brand' AS kind, * FROM ({unnested(shares_sql("brand"), f"{HEAD}, {BRAND}, {END}", "leaf_category", "n > 0")})
UNION ALL SELECT 'shop', * FROM ({unnested(shares_sql("shop_name"), f"{HEAD}, {SHOP}, {END}", "leaf_category", "n > 0")})
""")
def share_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC2: the lines below the shares of brands and of shops of each category; a category without brands has none."""
    rows = shelf(spark, sf_dir)
    n_all = rows.groupBy("leaf_category").agg(F.count(F.lit(1)).alias("n_all"))
    brands = n_all.join(rank.concentration_by(rows, F.col("brand"), at(), "leaf_category"), "leaf_category", "left").withColumn("lines", readings.brand_lines())
    shops = n_all.join(rank.concentration_by(rows, F.col("shop_name"), at(), "leaf_category"), "leaf_category", "left").withColumn("lines", readings.shop_lines())
    of = lambda kind, df: numbered_lines(df.select(F.lit(kind).alias("kind"), "leaf_category", "lines"), "kind", "leaf_category")
    return of("brand", brands).unionByName(of("shop", shops))


@register(f"""
WITH {LISTING}, c AS (SELECT flag, leaf_category || ' | ' || brand AS label, count(*) AS n, min(ord) AS first_seen FROM listing GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY n DESC, first_seen) AS rk,
    sum(n) OVER (PARTITION BY flag) AS total FROM c),
  g AS (SELECT flag, count(*) AS labels, max(total) AS total, max({CELL.format("label")}) FILTER (WHERE rk = 1) AS top, max(n) AS n1,
    list('| ' || {CELL.format("label")} || ' | ' || n || ' | ' || {share_sql("n", "total")} || '% |' ORDER BY rk) FILTER (WHERE rk <= 5) AS cells FROM r GROUP BY flag),
  l AS (SELECT flag, [{HEAD}, {between_sql(readings.CATEGORY_TOP, "labels", "total", "top", share_sql("n1", "total"))}, {quoted(readings.CATEGORY_NOTE)}, '', {", ".join(map(quoted, readings.CATEGORY_TABLE))}] || cells || [''] AS ls FROM g)
SELECT flag, CAST(unnest(range(len(ls))) AS INTEGER) AS place, unnest(ls) AS line FROM l
""")
def category_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC2: the lines and the table of five below the category mix of each return flag."""
    counts = rank.label_counts(listing(spark, sf_dir), F.concat_ws(" | ", "leaf_category", "brand"), at(), "flag")
    return numbered_lines(readings.category_lines(rank.ranked(counts, "flag"), "flag"), "flag")


#: Scenes of one word each, more than the lines show.
WORD_SCENES = tuple((w, (w,)) for w in ("the", "an", "er", "in", "th", "es", "en")) + (("none", ("no such words",)),)


@register(f"""
WITH s AS ({" UNION ALL ".join(f"SELECT lang, {i} AS place, {quoted(w)} AS scenario, count(*) FILTER (WHERE {any_of(t)}) AS n, count(*) AS total, min(doc_id) FILTER (WHERE {any_of(t)}) AS first FROM documents GROUP BY lang" for i, (w, t) in enumerate(WORD_SCENES))}),
  r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, first, place) AS rk FROM s WHERE n > 0),
  g AS (SELECT lang, string_agg({between_sql(readings.SCENARIO_PART, "scenario", "n", share_sql("n", "total", 0))}, {quoted(readings.SCENARIO_TOP[1])} ORDER BY rk) FILTER (WHERE rk <= 5) AS head,
    string_agg(scenario, {quoted(readings.SCENARIO_TAIL[1])} ORDER BY rk) FILTER (WHERE rk > 5) AS tail FROM r GROUP BY lang),
  l AS (SELECT lang, list_filter([{quoted(readings.SCENARIO_TOP[0])} || head || {quoted(readings.SCENARIO_TOP[2])}, {quoted(readings.SCENARIO_TAIL[0])} || tail || {quoted(readings.SCENARIO_TAIL[2])}], lambda x: x IS NOT NULL) AS ls FROM g)
SELECT lang, CAST(unnest(range(len(ls))) AS INTEGER) AS place, unnest(ls) AS line FROM l
""")
def scenario_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC3: the scenarios of the texts of each language, five with shares and the others by name."""
    rows = texts(spark, sf_dir)
    counts = lexicon.scenario_counts(rows, "text", F.col("doc_id"), WORD_SCENES, "lang")
    return numbered_lines(readings.scenario_lines(counts, rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_texts")), "lang"), "lang")


@register("""
SELECT p_type AS "group", row_number() OVER (PARTITION BY p_type ORDER BY CAST(p_partkey AS VARCHAR), p_partkey) - 1 AS place, '| ' || p_partkey || ' | ' || left(p_name, 8) || CASE WHEN length(p_name) > 8 THEN '…' ELSE '' END || ' | ' || p_brand || ' |' AS line FROM part
""")
def matrix_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN4: the rows of each group's table in the order of the product's number as text."""
    parts = table(spark, sf_dir, "part").select(F.col("p_type").alias("group"), F.col("p_partkey").alias("row_index"), F.col("p_partkey").cast("string").alias("sku_id"), "p_name", "p_brand")
    return readings.matrix_lines(parts, {"sku_id": 48, "p_name": 8, "p_brand": 20})


JOB = "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'cancelled' ELSE 'running' END"


@register(f"""
WITH j AS (SELECT o_orderkey AS id, {JOB} AS status, o_custkey % 3 = 0 AS inline_cookie_used, CASE WHEN o_custkey % 5 = 0 THEN ' ' ELSE 'run/' || o_custkey END AS run_dir, o_custkey FROM orders)
SELECT id, status, inline_cookie_used, run_dir, CASE WHEN status <> 'running' AND run_dir <> ' ' THEN
  concat_ws(',', CASE WHEN c_nationkey % 4 = 0 THEN 'merged' END, CASE WHEN c_nationkey % 4 = 1 THEN 'comments' END, CASE WHEN c_nationkey % 2 = 1 THEN 'report' END) END AS artifacts
FROM j LEFT JOIN customer ON c_custkey = o_custkey
""")
def shown_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ12: orders as jobs, with the files that their customers' folders hold."""
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "cancelled").otherwise("running")
    folder = lambda c: F.concat(F.lit("run/"), F.col(c).cast("string"))
    jobs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), status.alias("status"), F.when(F.col("o_custkey") % 3 == 0, "pin=1").otherwise(" ").alias("cookie_text"),
        F.when(F.col("o_custkey") % 5 == 0, " ").otherwise(folder("o_custkey")).alias("run_dir"),
    )
    kept = F.element_at(F.array(*[F.lit(x) for x in ("keyword_pipeline_merged.csv", "comments_flat.csv", "notes.txt", "run_meta.json")]), (F.col("c_nationkey") % 4 + 1).cast("int"))
    report = F.when(F.col("c_nationkey") % 2 == 1, "competitor_analysis.md").otherwise("competitor_analysis.txt")
    files = table(spark, sf_dir, "customer").select(folder("c_custkey").alias("run_dir"), F.explode(F.array(kept, report, report)).alias("file"))
    there = [F.when(F.col(f"analysis_artifacts.{key}"), key) for key in records.ARTIFACTS]
    artifacts = F.when(F.col("analysis_artifacts").isNotNull(), F.concat_ws(",", *there))
    return records.job_records(jobs, files).select("id", "status", "inline_cookie_used", "run_dir", artifacts.alias("artifacts"))


@register(f"""
WITH {TAGGED}, s AS (SELECT count(*) AS i, count(*) FILTER (WHERE scope_tag <> '') AS k, count(*) FILTER (WHERE scope_tag = '') AS d FROM tags)
SELECT unnest(['keyword', 'scenario_filter_stats.input_rows', 'scenario_filter_stats.kept_rows', 'scenario_filter_stats.dropped_rows', 'merged_rows', 'comment_flat_rows']) AS key,
  unnest(['shelf', CAST(i AS VARCHAR), CAST(k AS VARCHAR), CAST(d AS VARCHAR), CAST((SELECT count(*) FROM part) AS VARCHAR), CAST((SELECT count(*) FROM documents) AS VARCHAR)]) AS value FROM s
""")
def run_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK9, SRC8: a run's metadata with what its filter kept, written and read back."""
    parts, path = table(spark, sf_dir, "part"), f"{scratch(spark, 'run')}/run_meta.json"
    stats = {"scenario_filter_stats": lexicon.scope_stats(parts, ["p_name", "p_brand"], **SCOPE)}
    put_text(spark, path, sinks.run_metadata({"keyword": "shelf"}, {"merged": parts, "comment_flat": texts(spark, sf_dir)}, stats))
    found = landed.run_meta(spark, path)
    cells = [(f"{k}.{x}", str(y)) for k, v in found.items() if isinstance(v, dict) for x, y in v.items()]
    cells += [(k, str(v)) for k, v in found.items() if not isinstance(v, dict)]
    return spark.createDataFrame(cells, "key string, value string")


@register("""
SELECT CAST(m.p_partkey + 1 AS VARCHAR) AS sku_id, m.p_name || ', "x"' AS detail_body_ingredients, CASE WHEN d.p_partkey % 5 = 0 THEN '' ELSE d.p_brand END AS detail_brand
FROM part AS m JOIN part AS d ON d.p_partkey = m.p_partkey + 1
""")
def details_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK13: the detail table anew from landed payloads, as a CSV that is read back."""
    files = detail_bodies(spark, sf_dir).select(F.format_string("ware_%d_response.json", "p_partkey").alias("file"), "body")
    merged = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_index"), (F.col("p_partkey") + 1).cast("string").alias("sku_id"), F.concat("p_name", F.lit(', "x"')).alias("detail_body_ingredients"))
    path = scratch(spark, "details")
    exports.rewrite_details(files, merged, path)
    sheet = RELATIONS["detail"]
    return exports.read_csv(spark, path, list(sheet)).toDF(*sheet.values()).select("sku_id", "detail_body_ingredients", "detail_brand")


@register("""
SELECT c_custkey, CASE k WHEN 0 THEN '1' WHEN 1 THEN array_to_string(range(a, b + 1), ',') WHEN 2 THEN array_to_string(range(a, b + 1), ',') WHEN 3 THEN a || ',' || b WHEN 4 THEN CAST(a AS VARCHAR) END AS pages,
  CASE WHEN k IN (1, 2) THEN CAST(a AS DOUBLE) END AS low, CASE WHEN k IN (1, 2) THEN CAST(b AS DOUBLE) END AS high
FROM (SELECT c_custkey, c_custkey % 6 AS k, c_nationkey AS a, c_nationkey + c_custkey % 9 AS b FROM customer)
""")
def page_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT11, FLT12: pages and ranges that cells name: blank, either end first, lists, single numbers and what is no range."""
    k, a, b = F.col("c_custkey") % 6, F.col("c_nationkey").cast("string"), (F.col("c_nationkey") + F.col("c_custkey") % 9).cast("string")
    cell = F.when(k == 0, " ").when(k == 1, F.concat(a, F.lit(" - "), b)).when(k == 2, F.concat(b, F.lit("-"), a)).when(k == 3, F.concat(a, F.lit(" ,,"), b)).when(k == 4, a).otherwise(F.concat(F.lit("x-"), a))
    rows = table(spark, sf_dir, "customer").select("c_custkey", specs.pages_of_spec(cell).alias("pages"), specs.range_of_spec(cell).alias("r"))
    return rows.select("c_custkey", F.array_join("pages", ",").alias("pages"), "r.low", "r.high")
