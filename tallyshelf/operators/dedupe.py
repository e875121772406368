"""First, last and limited rows of keys, in a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.functions.text import filled, strip
from tallyshelf.sources.shared import written


def whole_row(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def first_rows(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """WIN2, SET2: of each key that is not blank the first row. Whole rows aggregate before the shuffle, so hot keys are no matter."""
    keyed = df.select(filled(key).alias("_key"), order.alias("_at"), whole_row(df).alias("_row")).where("_key is not null")
    return keyed.groupBy("_key").agg(F.min_by("_row", "_at").alias("_row")).select("_row.*")


def last_rows(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """WIN3: of each key that is not blank the last row."""
    keyed = df.select(filled(key).alias("_key"), order.alias("_at"), whole_row(df).alias("_row")).where("_key is not null")
    return keyed.groupBy("_key").agg(F.max_by("_row", "_at").alias("_row")).select("_row.*")


def first_or_blank(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """SET4, SET5: of each key the first row, and every row with a blank key."""
    return first_rows(df, key, order).unionByName(df.where(strip(key) == ""))


def queue(df: DataFrame, key: Column, order: Column, most: int) -> DataFrame:
    """SET3: the first distinct keys in the order they are met, with their place from 0; one at least."""
    firsts = df.select(filled(key).alias("key"), order.alias("at")).where("key is not null").groupBy("key").agg(F.min("at").alias("at"))
    few = firsts.orderBy("at").limit(max(1, most))
    return few.select((F.row_number().over(Window.orderBy("at")) - 1).alias("place"), "key")


def paged_listing(df: DataFrame, key: str, page: str, order: Column, pages: list, per_page: int = 60) -> DataFrame:
    """SET1: page after page, the first ``per_page`` keys that no earlier page has taken; the rows they come with.

    A row that a full page turns away does not count as seen, so its key may enter on a later page. The first row of each
    key and page is looked up once and written, with keys and places only. Pages depend on each other in
    turn, so each page's keys, per_page at most, are written before the next page is looked at; their names are given. One
    join at the end fetches the rows.
    """
    rows = df.where(filled(key).isNotNull() & F.col(page).isin(pages)).withColumn("_at", order)
    firsts = written(rows.groupBy(F.col(page).alias("_page"), F.col(key).alias("_key")).agg(F.min("_at").alias("_first")), "page-firsts")
    taken = None
    for p in pages:
        own = firsts.where(F.col("_page") == p)
        if taken is not None:
            own = own.join(F.broadcast(taken.select("_key")), "_key", "left_anti")
        new = written(own.orderBy("_first").limit(per_page).select("_page", "_key", "_first"), "page")
        taken = new if taken is None else taken.unionByName(new)
    if taken is None:
        return df.where(F.lit(False))
    same = (rows[key] == F.col("_key")) & (rows[page] == F.col("_page")) & (rows["_at"] == F.col("_first"))
    return rows.join(F.broadcast(taken), same).select(*df.columns)  # per_page rows for each page


def distinct_in_order(df: DataFrame, value: Column, order: Column, k: int) -> DataFrame:
    """SET8: the first k distinct values that are not blank."""
    return queue(df, value, order, k).withColumnRenamed("key", "value")


def not_among(df: DataFrame, value: str, known: DataFrame, order: Column, least: int = 2, most: int = 24, k: int = 22) -> DataFrame:
    """JON10, STR31: new phrases: of least to most code points, not among the known ones, each once, the first k."""
    new = df.withColumn("_value", strip(value)).where(F.length("_value").between(least, most))
    new = new.join(known.select(strip(value).alias("_value")).distinct(), "_value", "left_anti")
    return queue(new.withColumn("_at", order), F.col("_value"), F.col("_at"), k).withColumnRenamed("key", value)


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """JON11: how many distinct filled keys of a occur in b."""
    keys = lambda df: df.select(filled(key).alias("key")).where("key is not null").distinct()
    return keys(a).join(keys(b), "key", "left_semi").agg(F.count(F.lit(1)).alias("n_shared"))
