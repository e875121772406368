"""What models answer, as columns of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyshelf.functions.text import strip


def without_fence(c: Column | str) -> Column:
    """STR34: the text without the line of backquotes that opens it and those that close it; other text is only stripped."""
    t = strip(c)
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*(?:\n|$)", ""), r"(?U)(?:(?:^|\n)[^\S\n]*```[^\S\n]*)+$", "")
    return F.when(F.startswith(t, F.lit("```")), strip(inner)).otherwise(t)


def _phrases_of(text: Column) -> Column:
    listed = F.try_variant_get(F.try_parse_json(text), "$.phrases", "array<variant>")
    return F.filter(F.transform(listed, lambda x: strip(F.try_variant_get(x, "$", "string"))), lambda x: x != "")


def phrases(c: Column | str) -> Column:
    """STR30: the filled texts of the list named phrases in a JSON object, which a fence or other text may surround; an empty array if there is none."""
    bare = F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.coalesce(_phrases_of(bare), _phrases_of(F.regexp_extract(bare, r"(?s)\{.*\}", 0)), F.array().cast("array<string>"))


def content_text(c: Column | str) -> Column:
    """STR35: the text of a JSON value that is a string or a list of strings and of objects with a text, which are joined; empty for null."""
    v = F.try_parse_json(c)
    kind = lambda x: F.regexp_extract(F.schema_of_variant(x), "^([A-Z]+)", 1)
    one = lambda x: F.when(kind(x) == "OBJECT", F.try_variant_get(x, "$.text", "string")).when(kind(x) == "STRING", F.try_variant_get(x, "$", "string"))
    parts = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(one(x), F.lit("")))
    return strip(F.when(kind(v) == "ARRAY", F.array_join(parts, "")).otherwise(F.try_variant_get(v, "$", "string")))


def text_keys(array: Column) -> Column:
    """JSN29: the texts as a set that tells repeated ones apart: on one line, in lower case, without blanks."""
    return F.array_distinct(F.filter(F.transform(array, lambda x: F.lower(strip(F.regexp_replace(x, r"(?U)\s+", " ")))), lambda x: x != ""))
