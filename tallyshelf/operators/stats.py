"""Statistics of prices and listings, and the hints that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.functions.price import observed_price
from tallyshelf.functions.text import filled, is_digits

# Thresholds of the hints and bands.
CONCENTRATED, FRAGMENTED, SPREAD, FEW_COMMENTS, ENOUGH_TEXTS, STRONG_SCENARIO = 0.45, 0.25, 0.35, 5, 5, 0.25
HIGH_SHARE, MIDDLE_SHARE = 0.4, 0.25


def price_stats(prices: DataFrame, price: str = "price", *by: str) -> DataFrame:
    """STA2: n, min, max, mean, and from 2 prices stdev and median, from 4 the hinges q1 and q3; six decimals.

    Hinges are the medians of the lower and the upper half without the middle price. Prices that occur
    often collapse to one row with a count before anything is ordered, and places follow from running
    sums of these counts, so a group is ordered by its distinct prices only.
    """
    counted = prices.where(F.col(price).isNotNull()).groupBy(*by, price).agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy(*by)
    upto = group.orderBy(price).rowsBetween(Window.unboundedPreceding, 0)
    x, c = F.col(price), F.col("c")
    placed = counted.withColumns({"n": F.sum("c").over(group), "to": F.sum("c").over(upto), "mean": F.sum(c * x).over(group)})
    placed = placed.withColumn("mean", F.col("mean") / F.col("n"))
    n, m = F.col("n"), F.floor(F.col("n") / 2)

    def middle(low: Column, high: Column) -> Column:
        """The mean of the prices at two places, which may be one and the same."""
        hit = lambda k: (k.between(F.col("to") - c + 1, F.col("to"))).cast("int")
        return F.sum((hit(low) + hit(high)) * x) / 2

    first, second = F.floor((m + 1) / 2), F.floor((m + 2) / 2)
    stats = placed.groupBy(*by, "n", "mean").agg(
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.sum(c * (x - F.col("mean")) ** 2).alias("squares"),
        middle(F.floor((n + 1) / 2), F.floor((n + 2) / 2)).alias("median"),
        middle(first, second).alias("q1"),
        middle(n - m + first, n - m + second).alias("q3"),
    )
    return stats.select(
        *by,
        "n",
        F.round("min", 6).alias("min"),
        F.round("max", 6).alias("max"),
        F.round("mean", 6).alias("mean"),
        F.when(n >= 2, F.round(F.sqrt(F.col("squares") / F.greatest(n - 1, F.lit(1))), 6)).alias("stdev"),
        F.when(n >= 2, F.round("median", 6)).alias("median"),
        F.when(n >= 4, F.round("q1", 6)).alias("q1"),
        F.when(n >= 4, F.round("q3", 6)).alias("q3"),
    )


def chosen_stats(of_list: DataFrame, of_merged: DataFrame) -> DataFrame:
    """STA3: the statistics of the list if it has any price, else those of the merged table, with their source."""
    both = of_list.withColumns({"source": F.lit("pc_search_export_all_rows"), "_at": F.lit(0)}).unionByName(
        of_merged.withColumns({"source": F.lit("keyword_pipeline_merged"), "_at": F.lit(1)})
    )
    return both.orderBy("_at").limit(1).drop("_at")


def visibility(rows: DataFrame, sku: Column, shop: Column, page: Column, category: Column) -> DataFrame:
    """AGG8: exact counts of rows and of distinct filled skus, shops, pages and categories, and the span of numbered pages."""
    number = F.when(is_digits(filled(page)), filled(page).cast("int"))
    distinct = lambda c: F.count_distinct(filled(c))
    return rows.agg(
        F.count(F.lit(1)).alias("total_rows"),
        distinct(sku).alias("unique_skus"),
        distinct(shop).alias("unique_shops"),
        distinct(page).alias("unique_pages"),
        F.min(number).alias("first_page"),
        F.max(number).alias("last_page"),
        distinct(category).alias("unique_leaf_cats"),
    )


def observations(rows: DataFrame, *cells: str) -> DataFrame:
    """STA1: one price of each row that has any."""
    return rows.select(observed_price(*cells).alias("price")).where("price is not null")


def variation(mean: Column, stdev: Column) -> Column:
    """STA4: stdev / mean where both are above 0, else null."""
    return F.when((stdev > 0) & (mean > 0), stdev / mean)


def share_band(cr1: Column) -> Column:
    """STA7."""
    return F.when(cr1.isNull(), F.lit(None)).when(cr1 >= HIGH_SHARE, "high").when(cr1 >= MIDDLE_SHARE, "middle").otherwise("dispersed")


def hint_codes(cr1: Column, mean: Column, stdev: Column, n_hits: Column, n_comments: Column, n_texts: Column, top_scenario: Column) -> Column:
    """STA6: the hints that the numbers give rise to, as codes in fixed order; ``none`` if there is no other.

    The texts that belong to the codes are in ``operators.brief``.
    """
    found = F.array(
        F.when(cr1 >= CONCENTRATED, "concentrated").when(cr1 < FRAGMENTED, "fragmented"),
        F.when(variation(mean, stdev) > SPREAD, "spread"),
        F.when(n_hits > 0, "topics"),
        F.when(n_comments < FEW_COMMENTS, "few_comments"),
        F.when((n_texts >= ENOUGH_TEXTS) & (top_scenario / n_texts >= STRONG_SCENARIO), "scenario"),
    )
    codes = F.array_compact(found)
    return F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit("none")))


def least_rows_for_brands(n_rows: int) -> int:
    """AGG4: from how many labelled rows brands of a listing are reported."""
    return max(5, int(0.02 * n_rows)) if n_rows else 5


def consensus(values: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    """AGG9: the most frequent value, the first met among equals, the number of distinct values and of values."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = F.min_by(value, F.struct(-F.col("n"), F.col("first")))
    return counts.groupBy(*by).agg(best.alias("consensus"), F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n_values"))
