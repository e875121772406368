"""Writers: partitions of a job, lines of JSON, and small exports for people."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyshelf.operators.browse import FIXED, export_columns
from tallyshelf.operators.catalog import kept_columns


#: Behind a relation's path: where its schema is.
SCHEMA_OF = ".schema"


def replace_job(rows: DataFrame, path: str, job: str = "job_id", jobs: list[str] | None = None) -> None:
    """SNK6: the partitions of the named jobs become those that rows has, and others stay; running it again changes nothing.

    A named job without rows loses its partition; without names, the jobs that rows has are those. The schema is kept beside the
    folder, so a job, or all of them, may be empty, and ids stay the texts they are.
    """
    spark, out = rows.sparkSession, rows.withColumn(job, F.col(job).cast("string"))
    spark.createDataFrame([(out.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}{SCHEMA_OF}")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(job).parquet(path)
    if jobs:
        held = {r[0] for r in out.where(F.col(job).isin(jobs)).select(job).distinct().collect()}
        for name in sorted(set(jobs) - held):
            part = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(job, name)
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: all rows of a relation that replace_job keeps; with the types it had, ids as texts."""
    listed = spark.read.text(f"{path}{SCHEMA_OF}").collect()
    return spark.read.schema(StructType.fromJson(json.loads(listed[0].value))).parquet(path)


def append_lines(rows: DataFrame, path: str) -> None:
    """SNK7: one JSON object a row."""
    rows.write.mode("append").json(path)


def rows_of_job(spark: SparkSession, path: str, job: str, column: str = "job_id") -> DataFrame:
    """SRC11: the rows of one job; partitions of others are not read."""
    return stored(spark, path).where(F.col(column) == job)


def run_metadata(flags: dict[str, Any], relations: dict[str, DataFrame], statistics: dict[str, DataFrame] | None = None) -> str:
    """SNK9: a run's settings, statistics and the number of rows of each of its relations, as a JSON object.

    Statistics are relations of one row, such as what a filter kept and dropped, and become objects; one without rows is null.
    """
    found = {}
    for name, rows in (statistics or {}).items():
        row = rows.limit(1).collect()
        found[name] = row[0].asDict(True) if row else None
    counts = {f"{name}_rows": rows.count() for name, rows in relations.items()}
    return json.dumps({**flags, **found, **counts}, ensure_ascii=False, indent=2)


def sorted_payload(c: Column | str) -> Column:
    """SNK8: a JSON text with the keys of its objects in order, on one line; a text that is no JSON as it is."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def csv_text(rows: DataFrame, columns: dict[str, str]) -> str:
    """SNK1-SNK4: a CSV text with a byte order mark: the columns (internal to header) in order, missing ones blank, arrays as JSON.

    For exports that people open; rows come to the driver one partition at a time, in the order they have.
    """
    cells = []
    for c in columns:
        kind = dict(rows.dtypes).get(c)
        cells.append(F.lit("").alias(c) if kind is None else (F.to_json(c) if kind.startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c))
    out = io.StringIO()
    sheet = csv.writer(out)
    sheet.writerow(columns.values())
    for r in rows.select(*cells).toLocalIterator():
        sheet.writerow(list(r))
    return "﻿" + out.getvalue()


def json_text(rows: DataFrame) -> str:
    """SNK3: the rows as a JSON array, without columns that are blank throughout (PRJ5)."""
    found = rows.select(*kept_columns(rows))
    return json.dumps([r.asDict(True) for r in found.toLocalIterator()], ensure_ascii=False, indent=2)


def export(relations: dict[str, tuple[DataFrame, dict[str, str]]], kind: str, form: str, about: dict[str, Any]) -> tuple[str, str]:
    """SNK3, SNK4, BRW3: name and text of an export of one relation of a job, or with kind "all" of each of them.

    Rows go in order of row_index; columns that are blank throughout are left out. For people: the text is held by the driver.
    JSON of all relations is an object that begins with about (job_id and more); CSV of all of them has a section each.
    """
    if kind != "all" and kind not in relations:
        raise ValueError(f"unknown kind: {kind}")
    name = f"job_{about['job_id']}_{kind}.{form}"
    chosen = {k: (rows.orderBy("row_index"), headers) for k, (rows, headers) in relations.items() if kind in ("all", k)}
    if form == "csv":
        texts = {k: csv_text(rows, export_columns(rows, headers)) for k, (rows, headers) in chosen.items()}
        return name, sections(texts) if kind == "all" else texts[kind]
    texts = {k: json.loads(json_text(rows.select(*[c for c in (*FIXED, *headers.values()) if c in rows.columns]))) for k, (rows, headers) in chosen.items()}
    return name, json.dumps({**about, **texts} if kind == "all" else texts[kind], ensure_ascii=False, indent=2)


def sections(parts: dict[str, str]) -> str:
    """SNK4: several CSV texts under their names in one."""
    return "﻿" + "\n".join(f"# {name}\n{text.removeprefix(chr(0xFEFF))}" for name, text in parts.items())


def pack(files: dict[str, str | bytes], needed: str = "competitor_analysis.md") -> bytes:
    """SNK10: a ZIP of named files; the report must be among them."""
    if needed not in files:
        raise FileNotFoundError(needed)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()
