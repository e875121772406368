"""Small specifications in cells, and shares as texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyshelf.functions.text import col, strip

NUMBER = r"^\+?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def pages_of_spec(c: Column | str) -> Column:
    """FLT11: the pages, as texts, that a cell names: "2-5" (either end first), "1,3", "4"; a blank cell names page 1.

    Null where a range has ends that are no whole numbers.
    """
    s = strip(c)
    ends = F.transform(F.split(s, "-", 2), lambda x: strip(x).try_cast("int"))
    lo, hi = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
    span = F.when(lo.isNotNull() & hi.isNotNull(), F.sequence(F.least(lo, hi), F.greatest(lo, hi)).cast("array<string>"))
    listed = F.filter(F.transform(F.split(s, ","), lambda x: strip(x)), lambda x: x != "")
    return F.when(s == "", F.array(F.lit("1"))).when(F.contains(s, F.lit(",")), listed).when(F.contains(s, F.lit("-")), span).otherwise(F.array(s))


def range_of_spec(c: Column | str) -> Column:
    """FLT12: low and high of a cell like "30-60" (either end first); null where it is no range of two numbers from 0 on."""
    ends = F.transform(F.split(strip(c), "-", 2), lambda x: F.when(F.rlike(strip(x), F.lit(NUMBER)), strip(x)).try_cast("double"))
    lo, hi = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(F.least(lo, hi).alias("low"), F.greatest(lo, hi).alias("high")))


def share_text(n: Column, total: Column, decimals: int = 1) -> Column:
    """STR29: n of total in per cent, with one decimal or none; halves go to the even digit. Both are whole numbers, total above 0."""
    scaled = n.cast("long") * (1000 if decimals else 100)
    rest = scaled % total
    down = ((scaled - rest) / total).cast("long")
    q = down + F.when((2 * rest > total) | ((2 * rest == total) & (down % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(q / 10).cast("string"), F.lit("."), (q % 10).cast("string")) if decimals else q.cast("string")
