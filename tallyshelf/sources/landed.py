"""Readers of what a run leaves behind: CSV tables, raw payloads, reviews by line, and small files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.functions.text import filled, strip


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, which may have wildcards, names anything."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found))


def read_table(spark: SparkSession, path: str, headers: dict[str, str]) -> DataFrame:
    """SRC1-SRC4: a CSV file with a header as internal columns; stripped, blank where the file lacks a column or it is empty.

    Columns that headers does not name are not read; a missing file is an empty table. Quotes within quoted
    cells are doubled, and such cells may hold line breaks, which stay.
    """
    nothing = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in headers.values()))
    if not exists(spark, path):
        return nothing
    raw = spark.read.options(header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8").csv(path)
    named = {c.removeprefix("﻿").strip(): c for c in raw.columns}
    cell = lambda h: strip(F.col(f"`{named[h]}`")) if h in named else F.lit("")
    return raw.select(*[cell(h).alias(c) for h, c in headers.items()]) if raw.columns else nothing


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """file (its name) and body of the files under a path with wildcards; none if there are none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file string, body string")
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("file"), F.col("value").alias("body"))


def json_body(c: Column | str) -> Column:
    """JSN1: the JSON text of a payload that may be wrapped in a callback; null if it is neither."""
    t = strip(c)
    inner = F.regexp_extract(t, r"(?s)^[a-zA-Z_$][a-zA-Z0-9_$]*\((.*)\)\s*;*$", 1)
    text = F.when(F.rlike(t, F.lit(r"^[{\[]")), t).when(inner != "", inner)
    return F.when(F.try_parse_json(text).isNotNull(), text)


def variant(c: Column | str) -> Column:
    return F.try_parse_json(json_body(c))


def kind_of(v: Column, path: str) -> Column:
    """The kind of what a variant has at a path: its first word, such as OBJECT, ARRAY, STRING, BIGINT; null if nothing is there."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^([A-Z]+)", 1)


def scalar(v: Column, path: str) -> Column:
    """STR4: the stripped text of a scalar at a path; null for nothing, blanks, objects and arrays."""
    return F.when(~kind_of(v, path).isin("OBJECT", "ARRAY", "VOID"), filled(F.try_variant_get(v, path, "string")))


def first_scalar(v: Column, *keys: str) -> Column:
    return F.coalesce(*[scalar(v, f"$.{k}") for k in keys], F.lit(""))


class Fields:
    """An object as a variant and as a map of its keys to texts, which is parsed once: most keys that are asked for are absent."""

    def __init__(self, v: Column, texts: Column):
        self.v, self.texts = v, texts

    def has(self, key: str) -> Column:
        return self.texts[key.split(".")[0]].isNotNull()

    def scalar(self, key: str) -> Column:
        """STR4, as scalar()."""
        slow = scalar(self.v, f"$.{key}")
        if "." in key:
            return F.when(self.has(key), slow)
        text = self.texts[key]
        return F.when(text.isNotNull(), F.when(F.rlike(text, F.lit(r"^\s*[{\[]")), slow).otherwise(filled(text)))

    def first(self, *keys: str) -> Column:
        return F.coalesce(*[self.scalar(k) for k in keys], F.lit(""))


def whole_number(v: Column, path: str) -> Column:
    """JSN30: a whole number, or a text of digits with an optional sign; null for anything else, truth values too."""
    text, kind = F.try_variant_get(v, path, "string"), kind_of(v, path)
    good = kind.isin("BIGINT", "STRING") & F.rlike(strip(text), F.lit("^-?[0-9]{1,18}$"))
    return F.when(good, strip(text).cast("long"))


def result_counts(spark: SparkSession, folder: str) -> DataFrame:
    """SRC5: per readable search payload its file, the declared result count (null if it is not one), and its keyword."""
    files = whole_files(spark, f"{folder.rstrip('/')}/*.json").withColumn("v", F.try_parse_json("body")).where("v is not null")
    count = whole_number(F.col("v"), "$.data.resultCount")
    keyword = F.when(kind_of(F.col("v"), "$.data.listKeyWord") == "STRING", filled(F.try_variant_get("v", "$.data.listKeyWord", "string")))
    return files.select("file", F.when(count >= 0, count).alias("result_count"), keyword.alias("list_keyword"))


def slots(files: DataFrame, file: str = "file", body: str = "body") -> DataFrame:
    """SRC9, JSN31: file, slot, sku_id and short_name of each place of a listing; blank for places without a product."""
    wares = F.try_variant_get(variant(body), "$.data.wareList", "array<variant>")
    rows = files.select(file, F.posexplode(wares).alias("slot", "ware"))
    return rows.select(
        file, "slot", first_scalar(F.col("ware"), "skuId", "wareId").alias("sku_id"), first_scalar(F.col("ware"), "shortName").alias("short_name")
    )


def lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: the lines of a text file, stripped, without blank ones and comments."""
    if not exists(spark, path):
        return spark.createDataFrame([], "line string")
    return spark.read.text(path).select(strip("value").alias("line")).where("line <> '' and not startswith(line, '#')")


def reviews_by_line(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: sku and the payload of each line that is a JSON object; other lines are left out."""
    v = F.try_parse_json("line")
    return lines(spark, path).where(v.isNotNull()).select(
        first_scalar(v, "sku").alias("sku_id"), F.try_variant_get(v, "$.parsed", "string").alias("body")
    )


def run_meta(spark: SparkSession, path: str) -> dict | None:
    """SRC8: the small JSON object that describes a run, None if it is missing or broken."""
    if not exists(spark, path):
        return None
    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    try:
        found = json.loads(rows[0].value)
    except (IndexError, ValueError):
        return None
    return found if isinstance(found, dict) else None
