"""Prices in display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyshelf.functions.text import col, first_filled

FULL_WIDTH, ASCII = "０１２３４５６７８９．，", "0123456789.,"
#: Prices outside these bounds, which are themselves outside, are no observations.
LOWEST, HIGHEST = 0.0, 1_000_000.0


def first_number(c: Column | str) -> Column:
    """The first number of a text, thousands separators left out; null if there is none. "20万+" gives 20."""
    digits = F.replace(F.translate(F.coalesce(col(c).cast("string"), F.lit("")), FULL_WIDTH, ASCII), F.lit(","), F.lit(""))
    return F.nullif(F.regexp_extract(digits, r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def price_in(c: Column | str) -> Column:
    """The number of the cell if it is a price, else null."""
    p = first_number(c)
    return F.when((p > LOWEST) & (p < HIGHEST), p)


def observed_price(*cells: Column | str) -> Column:
    """STA1: the first of the cells that holds a price, as a number."""
    return F.coalesce(*[price_in(c) for c in cells])


def shown_price(*cells: Column | str) -> Column:
    """PRJ2: the first filled price cell as it stands."""
    return F.substring(first_filled(*cells), 1, 128)


def merged_coupon(coupon: Column | str, final: Column | str, shown: Column | str = None) -> Column:
    """JSN6: the coupon price, with the final price behind it unless it is in there; else the shown coupon."""
    coupon, final = first_filled(coupon), first_filled(final)
    both = F.substring(F.concat_ws("/", coupon, final), 1, 120)
    joined = F.when(coupon == "", final).when((final == "") | F.contains(coupon, final), coupon).otherwise(both)
    return joined if shown is None else F.when(joined == "", first_filled(shown)).otherwise(joined)
