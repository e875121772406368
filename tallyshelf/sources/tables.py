"""Parquet tables of one folder, and how their rows are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks for each core that dealt rows take, and the fewest of them.
TASKS_A_CORE, LEAST_TASKS = 3, 24


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """rows over all cores by a key that is not skewed.

    A scan gives a task to so many bytes, so a table of short rows is read by one or a few tasks: that is too few where rows become
    payloads and take milliseconds each.
    """
    tasks = max(LEAST_TASKS, TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *key)
