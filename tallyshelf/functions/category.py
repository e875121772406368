"""Categories of products: paths such as "food > biscuits > wholegrain", bare ids, and short names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyshelf.functions.text import col, filled, first_filled, split_filled, strip

# Group labels, and how an attribute line writes ids and short names.
NO_PATH = "未归类（无类目路径）"
NO_SAMPLE = "未归类（评价 SKU 无对应深入样本）"
NO_MERGED = "未归类（无深入合并表）"
UNCLASSIFIED = "未归类"
UNRESOLVED = "未解析类目（列表仅有内部编码且无简称）"
SHORT_NAME = r"简称[:：]\s*([^|]+)"
CATEGORY_ID = r"类目[:：]\s*(\d+)"


def short_name(attributes: Column | str) -> Column:
    """STR12: the short name in an attribute line, empty if there is none."""
    return F.substring(strip(F.regexp_extract(F.coalesce(col(attributes), F.lit("")), SHORT_NAME, 1)), 1, 120)


def category_id(attributes: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(col(attributes), F.lit("")), CATEGORY_ID, 1)


def category_cell(path: Column | str, leaf: Column | str, attributes: Column | str) -> Column:
    """STR13: path, else leaf category, else the short name if the attributes name a category id."""
    by_name = F.when(category_id(attributes) != "", short_name(attributes)).otherwise("")
    return F.coalesce(filled(path), filled(leaf), by_name)


def top_segment(category: Column | str) -> Column:
    """AGG6: what precedes the first ">", else the first 80 code points."""
    c = col(category)
    return F.when(F.contains(c, F.lit(">")), strip(F.substring_index(c, ">", 1))).otherwise(F.substring(c, 1, 80))


def group_key(category: Column | str) -> Column:
    """STR14: the segment that products are compared within, from a path of any depth."""
    parts = split_filled(F.replace(F.coalesce(col(category), F.lit("")), F.lit("＞"), F.lit(">")), ">")
    n = F.size(parts)
    return (
        F.when(n == 0, F.lit(NO_PATH))
        .when(n >= 4, F.try_element_at(parts, F.lit(-2)))
        .when(n >= 2, F.try_element_at(parts, F.lit(2)))
        .otherwise(F.try_element_at(parts, F.lit(1)))
    )


def is_unclassified(group: Column | str) -> Column:
    return col(group).startswith(UNCLASSIFIED)


def product_category(path: Column | str, leaf: Column | str) -> Column:
    """PRJ3."""
    return F.substring(first_filled(path, leaf), 1, 2000)


def chart_slug(group: Column | str, index: Column | str) -> Column:
    """WIN13: a file name part for a group and its place in the order."""
    core = F.substring(F.regexp_replace(F.coalesce(col(group), F.lit("")), r"(?U)[^\w\x{4e00}-\x{9fff}-]", ""), 1, 20)
    return F.concat(F.lit("i"), F.lpad(col(index).cast("string"), 2, "0"), F.lit("_"), F.coalesce(F.nullif(core, F.lit("")), F.lit("group")))
