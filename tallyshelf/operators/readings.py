"""Readings: shares and counts of each group as the few lines of text that a report prints below its charts.

Each function takes one row a group, or one a label of a group, from the operators that count, and gives ``lines``, an
array that is empty where there is nothing to say. Lists inside a line are bounded by the report's own limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.functions.specs import share_text
from tallyshelf.functions.text import strip, table_cell
from tallyshelf.operators.catalog import numbered

# The texts of the lines.
HEADING = "**数据解读（规则摘要）**："
BRAND_TOP = ("- 在含品牌字段的 **", "** 条列表行（占本章结构样本 **", "** 行）中，「", "」曝光约占 **", "%**（按行计，同一 SKU 多行会重复计）。")
BRAND_THREE = ("- 前三品牌合计约 **", "%**；若该比例偏高，说明搜索页品牌集中度高，新品需搭配清晰的差异定位与资源投放，避免与头部在泛词下正面撞车。")
SHOP_ROWS = ("- 含店铺名的列表行共 **", "** 条（结构样本 **", "** 行），反映搜索曝光下的店铺格局。")
SHOP_TOP = ("- 第一大店铺「", "」约占 **", "%**；该指标刻画的是**列表可见度**而非销量，适合用于判断货架被哪些店铺占据。")
SHOP_THREE = ("- 前三店铺合计约 **", "%**；若集中度高，可考虑从店铺矩阵、旗舰店/专营店布局等角度拆解竞争。")
CATEGORY_TOP = ("- 列表侧可读类目/简称共 **", "** 种取值，合计 **", "** 行；其中「", "」行数最多，约占 **", "%**。")
CATEGORY_NOTE = "- 若头部类目占比极高，说明当前关键词下货架被少数品类定义；跨品类机会需结合商详矩阵（§5）再核对。"
CATEGORY_TABLE = ("| 类目/简称（Top 5） | 列表行数 | 占本章结构样本 |", "| --- | ---: | ---: |")
SCENARIO_TOP = ("用户自述的用途/场景（基于预设词组，**非语义分类**）：", "；", "。")
SCENARIO_PART = ("「", "」约 **", "** 条（占有效文本 **", "%**）")
SCENARIO_TAIL = ("另有提及较少的场景标签：", "、", "。")
TABLE_ROWS, SCENARIOS_SHOWN = 5, 5


def _between(texts: tuple[str, ...], *cells: Column) -> Column:
    """The texts with the cells between them."""
    parts = [F.lit(texts[0])]
    for cell, t in zip(cells, texts[1:], strict=True):
        parts += [cell.cast("string"), F.lit(t)]
    return F.concat(*parts)


def _share(c: str) -> Column:
    """A share of six decimals in per cent."""
    return share_text(F.round(F.col(c) * 1_000_000).cast("long"), F.lit(1_000_000))


def _lines(*lines: Column | str) -> Column:
    """The lines that are not null, under the heading."""
    body = F.filter(F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines]), lambda x: x.isNotNull())
    return F.concat(F.array(F.lit(""), F.lit(HEADING), F.lit("")), body, F.array(F.lit("")))


def brand_lines(n_all: str = "n_all") -> Column:
    """DOC2: what the brands' shares (cr1, cr3, top_label, n_rows) say of a group of n_all rows; nothing without a share or a name."""
    top = strip("top_label")
    first = _between(BRAND_TOP, F.col("n_rows"), F.col(n_all), table_cell(top, 36), _share("cr1"))
    third = F.when(F.col("cr3").isNotNull(), _between(BRAND_THREE, _share("cr3")))
    return F.when(F.col("cr1").isNotNull() & (top != ""), _lines(first, third)).otherwise(F.array().cast("array<string>"))


def shop_lines(n_all: str = "n_all") -> Column:
    """DOC2: what the shops' shares say; nothing without rows that name a shop."""
    top = strip("top_label")
    rows = _between(SHOP_ROWS, F.col("n_rows"), F.col(n_all))
    first = F.when(F.col("cr1").isNotNull() & (top != ""), _between(SHOP_TOP, table_cell(top, 40), _share("cr1")))
    third = F.when(F.col("cr3").isNotNull(), _between(SHOP_THREE, _share("cr3")))
    return F.when(F.coalesce(F.col("n_rows"), F.lit(0)) > 0, _lines(rows, first, third)).otherwise(F.array().cast("array<string>"))


def category_lines(mix: DataFrame, *by: str) -> DataFrame:
    """DOC2: a row for each group of mix (rk, label, n): how many labels and rows, the largest one, and a table of the first five."""
    row = F.struct("rk", "label", "n")
    few = F.array_sort(F.collect_list(F.when(F.col("rk") <= TABLE_ROWS, row)))  # TABLE_ROWS at most
    found = mix.groupBy(*by).agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("total"), few.alias("few"))
    top = F.get("few", F.lit(0))
    first = _between(CATEGORY_TOP, F.col("labels"), F.col("total"), table_cell(top["label"], 40), share_text(top["n"], F.col("total")))
    cells = F.transform("few", lambda x: F.concat(F.lit("| "), table_cell(x["label"], 36), F.lit(" | "), x["n"].cast("string"), F.lit(" | "), share_text(x["n"], F.col("total")), F.lit("% |")))
    head = F.array(*[F.lit(x) for x in ("", HEADING, "")], first, F.lit(CATEGORY_NOTE), F.lit(""), *[F.lit(x) for x in CATEGORY_TABLE])
    return found.where("total > 0").select(*by, F.concat(head, cells, F.array(F.lit(""))).alias("lines"))


def scenario_lines(counts: DataFrame, units: DataFrame, *by: str) -> DataFrame:
    """DOC3: a row for each group of counts (rk, scenario, n) that has texts: the first scenarios with shares, the others by name.

    units has n_texts of each group; counts has a row for each scenario of the list at most.
    """
    listed = counts.where("n > 0").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rk", "scenario", "n"))).alias("listed"))
    rows = (listed.join(units, list(by)) if by else listed.crossJoin(F.broadcast(units))).where("n_texts > 0 and size(listed) > 0")  # without by: one row and one row
    part = lambda x: _between(SCENARIO_PART, x["scenario"], x["n"], share_text(x["n"], F.col("n_texts"), 0))
    first = _between((SCENARIO_TOP[0], SCENARIO_TOP[2]), F.array_join(F.transform(F.slice("listed", 1, SCENARIOS_SHOWN), part), SCENARIO_TOP[1]))
    tail = F.array_join(F.transform(F.slice("listed", SCENARIOS_SHOWN + 1, 1 << 20), lambda x: x["scenario"]), SCENARIO_TAIL[1])
    last = F.when(F.size("listed") > SCENARIOS_SHOWN, _between((SCENARIO_TAIL[0], SCENARIO_TAIL[2]), tail))
    return rows.select(*by, F.filter(F.array(first, last), lambda x: x.isNotNull()).alias("lines"))


def matrix_lines(products: DataFrame, cells: dict[str, int], group: str = "group") -> DataFrame:
    """WIN4, PRJ10: group, place and line: the rows of each group's table in the order of sku_id as text, then of row_index.

    cells are the columns and the code points that each shows. A group with most products is ordered by all tasks.
    """
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[table_cell(c, n) for c, n in cells.items()]), F.lit(" |"))
    rows = products.select(group, F.col("sku_id").cast("string").alias("sku_id"), F.col("row_index").alias("at"), line.alias("line"))
    return numbered(rows, ["sku_id", "at"], group).select(group, F.col("row_index").alias("place"), "line")
