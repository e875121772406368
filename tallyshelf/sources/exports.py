"""Exports written by the tasks that have the rows: part files that are the whole text when they are put one behind the other."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.operators.browse import FIXED, export_columns
from tallyshelf.operators.catalog import kept_columns
from tallyshelf.operators.ingest import detail_rows
from tallyshelf.sources.schema import RELATIONS
from tallyshelf.sources.shared import written

BOM = "﻿"


def _cell(rows: DataFrame, column: str) -> Column:
    kind = dict(rows.dtypes).get(column)
    if kind is None:
        return F.lit("")
    return F.coalesce(F.to_json(column) if kind.startswith("array") else F.col(column).cast("string"), F.lit(""))


def csv_lines(rows: DataFrame, columns: dict[str, str], order: str, mark: str = BOM) -> DataFrame:
    """place and line: the header, then a row each, with the quotes that ``sinks.csv_text`` sets."""
    alone = len(columns) == 1
    quoted = lambda c: F.when(F.rlike(c, F.lit('[",\\r\\n]')) | (F.lit(alone) & (c == "")), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = F.concat_ws(",", *[quoted(_cell(rows, c)) for c in columns])
    head = ",".join('"' + h.replace('"', '""') + '"' if set(h) & set('",\r\n') or alone and not h else h for h in columns.values())
    first = rows.sparkSession.createDataFrame([(-1, mark + head)], "place long, line string")
    return first.unionByName(rows.select(F.col(order).cast("long").alias("place"), line.alias("line")))


def json_lines(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """place and line: an array with an object each, indented by two; objects take several lines."""
    value = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")

    def shown(c: str) -> Column:
        name = f"`{c}`"
        if not dict(rows.dtypes)[c].startswith("array"):
            return value(name)
        inner = F.array_join(F.transform(F.col(name), lambda x: F.concat(F.lit("      "), F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1))), ",\n")
        return F.when(F.col(name).isNull(), "null").when(F.size(name) == 0, "[]").otherwise(F.concat(F.lit("[\n"), inner, F.lit("\n    ]")))

    cells = [F.concat(F.lit(f"    {json.dumps(c, ensure_ascii=False)}: "), shown(c)) for c in columns]
    whole = F.concat(F.lit("  {\n"), F.concat_ws(",\n", *cells), F.lit("\n  }"))
    last = rows.agg(F.max(order).cast("long")).first()[0]
    at = F.col(order).cast("long")
    body = rows.select(at.alias("place"), F.concat(whole, F.when(at < last, ",").otherwise("")).alias("line"))
    ends = [(-1, "[]")] if last is None else [(-1, "["), (last + 1, "]")]
    return body.unionByName(rows.sparkSession.createDataFrame(ends, "place long, line string"))


def put(lines: DataFrame, path: str, ending: str) -> None:
    """Writes lines in order of place over part files whose names go in that order."""
    dealt = lines.repartitionByRange(F.col("place")).sortWithinPartitions("place")
    dealt.select("line").write.mode("overwrite").option("lineSep", ending).text(path)


def export(relations: dict[str, tuple[DataFrame, dict[str, str]]], kind: str, form: str, about: dict[str, Any], path: str) -> dict[str, Any]:
    """SNK3, SNK4: the texts of ``sinks.export`` as folders of part files below path, one for each relation, and the manifest that names them.

    The driver sees names, columns and counts only. A section's parts one behind the other are its text (for JSON, and one line end);
    the manifest, also stored as path/manifest, has the sections in order and what stands before each in a text of all.
    Columns that are blank throughout are left out (PRJ5), rows go in order of row_index, which must name a row.
    """
    if kind != "all" and kind not in relations:
        raise ValueError(f"unknown kind: {kind}")
    sections = []
    for name, (rows, headers) in relations.items():
        if kind not in ("all", name):
            continue
        folder = f"{path}/{len(sections):02d}-{name}"
        if form == "csv":
            put(csv_lines(rows, export_columns(rows, headers), "row_index", "" if kind == "all" else BOM), folder, "\r\n")
        else:
            own = rows.select(*[c for c in (*FIXED, *headers.values()) if c in rows.columns])
            put(json_lines(own, kept_columns(own), "row_index"), folder, "\n")
        lead = "" if kind != "all" or form != "csv" else (BOM if not sections else "\n") + f"# {name}\n"
        sections.append({"name": name, "path": folder, "rows": rows.count(), "before": lead})
    manifest = {"file": f"job_{about['job_id']}_{kind}.{form}", **about, "sections": sections}
    spark = next(iter(relations.values()))[0].sparkSession
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def rewrite_details(files: DataFrame, merged: DataFrame, path: str) -> int:
    """SNK13: the detail table of a run anew from its landed payloads (file, body) and its merged rows, as a CSV of part files; the number of rows."""
    rows = written(detail_rows(files, merged), "details")
    put(csv_lines(rows, {c: header for header, c in RELATIONS["detail"].items()}, "row_index"), path, "\r\n")
    return rows.count()


def manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(f"{path}/manifest").first().value)


def read_csv(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """The rows of a CSV section as texts: the header stands in its first part alone, and so is no header to the reader.

    The line end is named: a reader left to guess takes the first one of each part, which may stand in a quoted cell.
    """
    rows = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).options(header=False, multiLine=True, lineSep="\r\n", quote='"', escape='"').csv(folder)
    first = F.regexp_replace(F.col(f"`{columns[0]}`"), f"^{BOM}", "")
    is_header = first == columns[0]
    for c in columns[1:]:
        is_header = is_header & (F.col(f"`{c}`") == c)
    return rows.where(~F.coalesce(is_header, F.lit(False))).fillna("")
