"""A run's tables into the store: first the rows of its relations, then the products and snapshots of its merged table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.operators import catalog, steps
from tallyshelf.sources.landed import exists, read_table
from tallyshelf.sources.schema import RELATIONS
from tallyshelf.sources.shared import written
from tallyshelf.sources.sinks import replace_job, rows_of_job
from tallyshelf.streaming.upsert import apply_batch, current, versions


def relation_rows(spark: SparkSession, path: str, relation: str, job: str) -> DataFrame:
    """WIN14: a relation's CSV file as rows of a job, numbered as they stand in the file; a file with quoted line breaks is read by one task."""
    return catalog.numbered_as_they_stand(read_table(spark, path, RELATIONS[relation]).withColumn("job_id", F.lit(job)), "job_id")


def ingest_run(
    spark: SparkSession, files: dict[str, str], store: str, job: str, platform: str, captured_at: str, manifest: str | None = None
) -> dict[str, Any]:
    """CAT3, AGG27: files (relation to path) into the tables under store; running it again for a job changes nothing but its time.

    The job's partitions of search, detail and comments are written first and stay if there is no merged table, which
    the result then tells. With one, the next version of products and the job's partition of snapshots follow. With
    a manifest folder the run can be stopped and goes on where it was (UDF2, JOB4); see steps.run.
    """

    def relation(name: str) -> int:
        replace_job(relation_rows(spark, files[name], name, job), f"{store}/{name}", jobs=[job])
        return rows_of_job(spark, f"{store}/{name}", job).count()

    def merged_rows() -> DataFrame:
        rows = rows_of_job(spark, f"{store}/merged", job)
        cells = [c for c in rows.columns if c not in ("row_index", "job_id")]
        return rows.withColumns({
            "platform": F.lit(platform),
            "current_payload": F.to_json(F.struct(*cells)),
            "last_job": F.lit(job),
            "last_captured_at": F.lit(captured_at),
        })

    def stats() -> dict[str, int]:
        return catalog.ingest_stats(merged_rows(), current(spark, f"{store}/products")).first().asDict()

    def products() -> int:
        done = versions(spark, f"{store}/products")
        number = done[-1] + 1 if done else 0
        apply_batch(merged_rows(), f"{store}/products", number, F.col("row_index"))
        return number

    def snapshots() -> None:
        snaps = merged_rows().withColumns({"captured_at": F.col("last_captured_at"), "payload": F.col("current_payload")})
        replace_job(catalog.snapshots(snaps, F.col("row_index"), "job_id"), f"{store}/snapshots", jobs=[job])

    first = [(r, lambda r=r: relation(r)) for r in ("search", "detail", "comments")]
    second = [("merged", lambda: relation("merged")), ("stats", stats), ("products", products), ("snapshots", snapshots)]
    chosen = first + second if exists(spark, files["merged"]) else first
    found = {name: work() for name, work in chosen} if manifest is None else steps.run(spark, chosen, manifest)
    missing = {"error": f"no merged table: {files['merged']}", "rows_ingested": 0, "snapshots_upserted": 0}
    return {"dataset": {f"{r}_rows": found[r] for r, _ in first}, "merged": found.get("stats", missing)}


def detail_rows(files: DataFrame, merged: DataFrame) -> DataFrame:
    """SRC6: the detail columns anew from landed payloads (file, body), for each row of merged whose product has one, in any order.

    Ingredients come from merged. Rows without a sku or without a payload are left out; a broken payload gives blank columns.
    """
    from tallyshelf.sources.payloads import details

    bodies = files.select(F.regexp_extract("file", r"^ware_(.+)_response\.json$", 1).alias("sku_id"), "body").where("sku_id <> ''")
    rows = merged.where("sku_id <> ''").select("row_index", "sku_id", "detail_body_ingredients")
    return rows.join(details(bodies).drop("parsed"), "sku_id")


def regenerated_details(files: DataFrame, merged: DataFrame) -> DataFrame:
    """detail_rows in order of row_index. The sort looks at them twice, so they are written first."""
    return written(detail_rows(files, merged), "details").orderBy("row_index")


def last_accepted(tries: DataFrame, key: str, position: str, text: str, url: str, failed: str, accepted) -> DataFrame:
    """STR25: per key the text and url of the last picture whose text is accepted, and the counts that explain why there is none.

    tries has a row for each picture with its place, its text and whether reading it failed. tried, errors and rejected
    count the pictures behind the accepted one, or all, as a reader from the back sees them; rejected texts are those that are not blank.
    """
    good = ~F.col(failed) & accepted
    hit = tries.groupBy(key).agg(F.max(F.when(good, F.col(position))).alias("_hit"), F.max_by(F.when(good, F.struct(F.col(text).alias("t"), F.col(url).alias("u"))), F.when(good, F.col(position))).alias("_won"))
    behind = F.col("_hit").isNull() | (F.col(position) > F.col("_hit"))
    seen = tries.join(hit.select(key, "_hit"), key).groupBy(key).agg(
        (F.count_if(behind) + F.count("_hit").cast("boolean").cast("long")).alias("tried"),
        F.count_if(behind & F.col(failed)).alias("errors"),
        F.count_if(behind & ~F.col(failed) & (F.trim(F.coalesce(F.col(text), F.lit(""))) != "")).alias("rejected"),
    )
    return hit.join(seen, key).select(key, F.col("_won.t").alias("text"), F.col("_won.u").alias("url"), "tried", "errors", "rejected")
