"""The product catalogue: current rows, snapshots per job, and how both are browsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.functions.text import strip
from tallyshelf.sources.shared import written

KEY = ("platform", "sku_id")
#: Of these a blank value leaves the old one; all others are replaced even by blanks.
STICKY = ("ware_id", "title")
#: Jobs and parts of jobs whose first numbers are broadcast at most.
MOST_SHIFTS = 100_000
REPLACED = ("detail_brand", "detail_price_final", "detail_category_path", "current_payload", "last_job", "last_captured_at")


def batch_products(rows: DataFrame, order: Column) -> DataFrame:
    """CAT1: a batch as one row per product: the last row's values, but of STICKY columns the last that are not blank."""
    named = rows.where(strip("sku_id") != "").withColumn("_at", order)
    last = [F.max_by(c, "_at").alias(c) for c in REPLACED]
    kept = [F.max_by(F.when(strip(c) != "", F.col(c)), F.when(strip(c) != "", F.col("_at"))).alias(c) for c in STICKY]
    return named.groupBy(*KEY).agg(*kept, *last).fillna("", list(STICKY))


def upserted(current: DataFrame, rows: DataFrame, order: Column) -> DataFrame:
    """CAT1: current products with a batch of rows applied; created says which are new."""
    new = batch_products(rows, order)
    old = current.select(*KEY, *[F.col(c).alias(f"_old_{c}") for c in (*STICKY, *REPLACED)], F.lit(True).alias("_known"))
    both = old.join(new.withColumn("_new", F.lit(True)), list(KEY), "full")
    sticky = [F.coalesce(F.nullif(strip(c), F.lit("")), F.col(f"_old_{c}"), F.lit("")).alias(c) for c in STICKY]
    replaced = [F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in REPLACED]
    return both.select(*KEY, *sticky, *replaced, F.col("_known").isNull().alias("created"))


def snapshots(rows: DataFrame, order: Column, *job: str) -> DataFrame:
    """CAT2: of each product and job the payload and time of the last row."""
    named = rows.where(strip("sku_id") != "").withColumn("_at", order)
    return named.groupBy(*KEY, *job).agg(F.max_by("captured_at", "_at").alias("captured_at"), F.max_by("payload", "_at").alias("payload"))


def with_snapshot_counts(products: DataFrame, snaps: DataFrame) -> DataFrame:
    """JON7: products with the number of their snapshots, 0 if they have none."""
    counts = snaps.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_snapshots"))
    return products.join(counts, list(KEY), "left").fillna(0, ["n_snapshots"])


def ingest_stats(rows: DataFrame, current: DataFrame) -> DataFrame:
    """AGG27: rows read, rows with a sku, and products that are new; repeated skus count as rows, once as products."""
    named = rows.where(strip("sku_id") != "")
    created = named.select(*KEY).distinct().join(current.select(*KEY), list(KEY), "left_anti").agg(F.count(F.lit(1)).alias("products_created"))
    total = rows.agg(
        F.count(F.lit(1)).alias("rows_in_csv"),
        F.count_if(strip("sku_id") != "").alias("rows_ingested"),
        F.count_if(strip("sku_id") != "").alias("snapshots_upserted"),
    )
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(total).join(one(created), "_one").drop("_one")


def clamped(value: int | None, low: int, high: int, default: int) -> int:
    """FLT10."""
    return default if value is None else max(low, min(high, value))


def page_of(rows: DataFrame, order: list, page: int | None = 1, size: int | None = 50) -> DataFrame:
    """WIN5: one page of rows in order; sizes from 1 to 200. The offset and limit are part of the plan, the sort keeps as many rows."""
    size, page = clamped(size, 1, 200, 50), max(1, page or 1)
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def newest(rows: DataFrame, time: str, tie: str, limit: int | None = 50, offset: int | None = 0) -> DataFrame:
    """WIN6, WIN7, WIN8: rows from the newest on; ties by the second column."""
    return rows.orderBy(F.desc(time), tie).offset(max(0, offset or 0)).limit(clamped(limit, 1, 200, 50))


def containing(rows: DataFrame, cells: list[str], query: str) -> DataFrame:
    """FLT5, CAT6: the rows with the query in any of the cells, whatever the letter case; all rows for a blank query."""
    if not query.strip():
        return rows
    found = F.lit(False)
    for c in cells:
        found = found | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(query.strip().lower()))
    return rows.where(found)


def with_member(rows: DataFrame, payload: str, member: str, value: str) -> DataFrame:
    """FLT6: the rows whose JSON payload has the value under the member's name."""
    return rows.where(F.get_json_object(payload, f"$.{member}") == value)


def has_content(rows: DataFrame, column: str) -> Column:
    """Whether a cell is neither null nor blank; an empty array counts as blank."""
    c = F.col(f"`{column}`")
    return F.coalesce(F.size(c) > 0, F.lit(False)) if dict(rows.dtypes)[column].startswith("array") else strip(c) != ""


def filled_columns(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """BRW1: column and whether any of its cells is not blank, for all columns in one pass, in their order."""
    columns = columns or rows.columns
    flags = rows.agg(*[F.coalesce(F.bool_or(has_content(rows, c)), F.lit(False)).alias(f"c{i}") for i, c in enumerate(columns)])
    listed = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.col(f"c{i}").alias("filled")) for i, c in enumerate(columns)])
    return flags.select(F.explode(listed).alias("x")).select("x.*")


def kept_columns(rows: DataFrame, always: tuple[str, ...] = ("id", "row_index")) -> list[str]:
    """BRW4: the names of filled columns, preceded by those that always stay; one row reaches the driver for each column."""
    found = [r.column for r in filled_columns(rows, [c for c in rows.columns if c not in always]).orderBy("place").collect() if r.filled]
    return [c for c in always if c in rows.columns] + found


def numbered(rows: DataFrame, order: list, *by: str) -> DataFrame:
    """WIN14: row_index, dense from 0 within each job (the columns by), or over all rows.

    Rows are sorted by job and order over ranges. Rows that are equal in all of these columns stay in one task, so the order should name a row.
    """
    return numbered_as_they_stand(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order), *by)


def numbered_as_they_stand(rows: DataFrame, *by: str) -> DataFrame:
    """WIN14: row_index, dense from 0 within each job (the columns by), or over all rows, in the order of partitions and of the rows in them.

    Rows are written, so that each has a partition and a place in it. What a partition holds of a job is counted, and the counts of
    the partitions before say where its rows begin: a job with all rows is numbered by all tasks.
    """
    parts = written(rows.withColumn("_id", F.monotonically_increasing_id()), "numbered")  # a range sort may cut anew when it runs again
    split = parts.withColumns({"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    runs = split.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = runs.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by_{c}") for c in by], (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    shifts = written(shifts, "number-shifts")  # a row for each job, and for each partition that a job goes on in
    if shifts.count() <= MOST_SHIFTS:
        shifts = F.broadcast(shifts)
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return split.join(shifts, same).withColumn("row_index", F.col("_place") + F.col("_shift")).drop("_id", "_part", "_place", "_p", "_shift", *[f"_by_{c}" for c in by])
