"""The catalogue kept up to date from a stream of landed rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyshelf.functions.text import strip
from tallyshelf.operators.catalog import KEY, REPLACED, STICKY, upserted
from tallyshelf.sources.shared import put_text

CATALOGUE = ", ".join(f"{c} string" for c in (*KEY, *STICKY, *REPLACED))
ROWS = CATALOGUE + ", row_index long"


#: Versions that stay beside the newest one, and the buckets into which keys are hashed.
KEPT, BUCKETS = 3, 64


def _files(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _found(spark: SparkSession, pattern: str) -> list[str]:
    at, files = _files(spark, pattern)
    return [str(f.getPath()) for f in files.globStatus(at) or []]


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions under path, in order."""
    return sorted(int(f.rsplit("-", 1)[1].removesuffix(".json")) for f in _found(spark, f"{path}/manifest-*.json"))


def manifest(spark: SparkSession, path: str, version: int) -> dict:
    """Of a version n, the number of buckets, and held: for each bucket with rows the version whose batch wrote it."""
    found = json.loads(spark.read.text(f"{path}/manifest-{version}.json", wholetext=True).first().value)
    return {"n": found["n"], "held": {int(b): v for b, v in found["held"].items()}}


def rows_at(spark: SparkSession, path: str, held: dict[int, int]) -> DataFrame:
    """The rows of buckets as the versions have them."""
    folders = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(held.items())]
    return spark.read.schema(CATALOGUE).parquet(*folders) if folders else spark.createDataFrame([], CATALOGUE)


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the catalogue under path, the latest unless one is named; empty if there is none."""
    done = versions(spark, path)
    return rows_at(spark, path, manifest(spark, path, done[-1] if version is None else version)["held"]) if done else spark.createDataFrame([], CATALOGUE)


def apply_batch(batch: DataFrame, path: str, number: int, order: Column, buckets: int = BUCKETS) -> list[int]:
    """CAT1: makes version number of the catalogue under path from the one before it and a batch of rows; returns the buckets written.

    Keys are hashed into buckets, whose number stays what the first version says. Only buckets that the batch has keys of are read,
    merged and written, below data/version=number; the manifest says where each bucket lies, and a version is
    there when its manifest is. A batch that is applied again starts from the version before its own. Manifests beyond KEPT earlier
    ones go, and buckets that none of the rest names.
    """
    spark = batch.sparkSession
    earlier = [v for v in versions(spark, path) if v < number]
    before = manifest(spark, path, earlier[-1]) if earlier else {"n": buckets, "held": {}}
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(before["n"])).cast("int")
    touched = sorted(r[0] for r in batch.where(strip("sku_id") != "").select(bucket).distinct().collect())  # n at most
    old = rows_at(spark, path, {b: v for b, v in before["held"].items() if b in set(touched)})
    new = upserted(old, batch, order).drop("created").withColumn("bucket", bucket)
    # rows of a bucket meet in a few tasks, however large it is: what is too large for one is split
    new.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={number}")
    held = before["held"] | dict.fromkeys(touched, number)
    put_text(spark, f"{path}/manifest-{number}.json", json.dumps({"n": before["n"], "held": held}))
    kept = [*earlier[-KEPT:], number]
    named = {(v, b) for k in kept for b, v in manifest(spark, path, k)["held"].items()}
    for old_version in earlier[:-KEPT]:
        at, files = _files(spark, f"{path}/manifest-{old_version}.json")
        files.delete(at, False)
    for folder in _found(spark, f"{path}/data/version=*/bucket=*"):
        version, b = (int(x.split("=")[1]) for x in folder.split("/")[-2:])
        if version <= number and (version, b) not in named:
            at, files = _files(spark, folder)
            files.delete(at, True)
    return touched


def catalogue_stream(rows: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Applies each micro-batch of rows to the catalogue as the version named after the batch.

    A batch that runs again after a failure starts from the latest version before its own and overwrites it, so
    each row counts once. A batch other than the first one that finds no version before its own is an error, and so is
    a first batch that finds versions of another stream, which a new checkpoint folder would start.
    Every batch that has waited is taken, then the query ends.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark, files = _files(spark, f"{path}/_streams/{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}")
        done = versions(spark, path)
        if number == 0 and not files.exists(mark):
            if done:
                raise ValueError(f"{path} has versions that another stream made")
            files.create(mark).close()
        if number and not [v for v in done if v < number]:
            raise ValueError(f"{path} has no version before {number}")
        apply_batch(batch, path, number, F.struct("last_captured_at", "row_index"), buckets)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted_by_window(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per key and time window; rows that come later than ``late`` behind the newest are left out of a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", key, "n")
