"""Readable categories of listing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.functions.category import UNRESOLVED, category_id, short_name
from tallyshelf.functions.text import is_digits, strip


def names_of_ids(rows: DataFrame, order: Column) -> DataFrame:
    """JON6: of each numeric category id the first short name that any row gives it."""
    named = rows.select(strip("leaf_category").alias("category_id"), short_name("attributes").alias("name"), order.alias("_at"))
    named = named.where(is_digits("category_id") & (F.col("name") != ""))
    return named.groupBy("category_id").agg(F.min_by("name", "_at").alias("id_name"))


def list_category(rows: DataFrame, order: Column) -> DataFrame:
    """AGG7: rows with label, a readable category, null where there is none.

    A category that is not a bare id stands for itself; an id, in its own cell or in the attributes, takes
    the name that any row gives it, else the row's short name, else a label for unresolved ids; a row
    without an id takes its short name.
    """
    own, short = strip("leaf_category"), short_name("attributes")
    number = F.when(is_digits(own), own).when(own == "", F.nullif(category_id("attributes"), F.lit("")))
    known = names_of_ids(rows, order)
    joined = rows.withColumn("_id", number).join(known.withColumnRenamed("category_id", "_id"), "_id", "left")
    of_id = F.coalesce("id_name", F.nullif(short, F.lit("")), F.lit(UNRESOLVED))
    label = F.when(F.col("_id").isNotNull(), of_id).when(own != "", F.substring(own, 1, 80)).otherwise(F.nullif(short, F.lit("")))
    return joined.withColumn("label", label).drop("_id", "id_name")
