"""Counted labels, ranked by count and then by first appearance.

Rankings follow the order in which labels are first met, so each input row brings an ``order``
column (a struct is fine) that is total. Counting aggregates before the shuffle; what is ranked
afterwards has one row a label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OTHER = "其他"


def label_counts(df: DataFrame, label: Column, order: Column, *by: str) -> DataFrame:
    """One row per label (and group ``by``): n and first_seen. Blank and null labels are left out."""
    named = df.withColumn("label", label).where((F.col("label").isNotNull()) & (F.col("label") != ""))
    return named.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))


def ranked(counts: DataFrame, *by: str) -> DataFrame:
    """Adds rk, the place by count and then first appearance, within the groups ``by``."""
    return counts.withColumn("rk", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first_seen")))


def top_labels(df: DataFrame, label: Column, order: Column, k: int) -> DataFrame:
    """AGG5, WIN1: the k most frequent labels with their rank from 1; ties go to the label met first."""
    counts = label_counts(df, label, order).orderBy(F.desc("n"), "first_seen").limit(k)
    return ranked(counts).select("rk", "label", "n")


def top_labels_by(df: DataFrame, label: Column, order: Column, k: int, *by: str) -> DataFrame:
    """The k most frequent labels of each group."""
    return ranked(label_counts(df, label, order, *by), *by).where(F.col("rk") <= k).select(*by, "rk", "label", "n")


def concentration(df: DataFrame, label: Column, order: Column) -> DataFrame:
    """AGG1: cr1, cr3 (six decimals), the top label and the number of labelled rows; no row shares if there are none.

    Only the three largest labels are ranked, so nothing but they and a sum leave the aggregation.
    """
    counts = label_counts(df, label, order)
    top = ranked(counts.orderBy(F.desc("n"), "first_seen").limit(3)).select("rk", "label", "n")
    total = counts.agg(F.sum("n").alias("n")).select(F.lit(0).alias("rk"), F.lit(None).cast("string").alias("label"), "n")
    of = lambda rk: F.max(F.when(F.col("rk") == rk, F.col("n")))
    return top.unionByName(total).agg(
        F.round(of(1) / of(0), 6).alias("cr1"),
        F.round(F.sum(F.when(F.col("rk") > 0, F.col("n"))) / of(0), 6).alias("cr3"),
        F.max(F.when(F.col("rk") == 1, F.col("label"))).alias("top_label"),
        of(0).alias("n_rows"),
    )


def concentration_by(df: DataFrame, label: Column, order: Column, *by: str) -> DataFrame:
    """AGG1 within groups."""
    places = ranked(label_counts(df, label, order, *by), *by)
    return (
        places.groupBy(*by)
        .agg(
            F.max("n").alias("n1"),
            F.sum(F.when(F.col("rk") <= 3, F.col("n"))).alias("n3"),
            F.max(F.when(F.col("rk") == 1, F.col("label"))).alias("top_label"),
            F.sum("n").alias("n_rows"),
        )
        .select(*by, F.round(F.col("n1") / F.col("n_rows"), 6).alias("cr1"), F.round(F.col("n3") / F.col("n_rows"), 6).alias("cr3"), "top_label", "n_rows")
    )


def top_with_other(counts: DataFrame, most: int, other: str = OTHER) -> DataFrame:
    """AGG20, AGG21, AGG28: rk, label and n of at most ``most`` slices, two or more; what is beyond them is added up in the last one.

    counts has label, n and first_seen; labels that are blank or have no count are left out (AGG22).
    """
    real = counts.where((F.col("label") != "") & (F.col("n") > 0))
    head = ranked(real.orderBy(F.desc("n"), "first_seen").limit(most + 1)).withColumn("last", F.max("rk").over(Window.partitionBy()))
    kept = head.where((F.col("rk") < most) | (F.col("last") <= most)).select("rk", "label", "n")
    shown = head.where((F.col("rk") < most) & (F.col("last") > most)).select((-F.col("n")).alias("n"), F.lit(1).alias("shown"))
    rest = real.agg(F.sum("n").alias("n")).select("n", F.lit(0).alias("shown")).unionByName(shown)
    rest = rest.agg(F.sum("n").alias("n"), F.sum("shown").alias("shown")).where("shown > 0 and n > 0")
    return kept.unionByName(rest.select(F.lit(most).alias("rk"), F.lit(other).alias("label"), "n"))
