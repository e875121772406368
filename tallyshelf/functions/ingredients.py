"""Ingredient texts: choosing, splitting and judging them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyshelf.functions.text import col, first_filled, holds_any, split_filled, strip, table_cell

# Words and patterns by which texts are judged.
PICTURES_ONLY = "（详情长图链接，无配料正文；可在采集侧开启配料识别后重新跑批次）"
RECIPE_WORDS = (
    "做法", "制作步骤", "烹饪步骤", "第一步", "第二步", "第三步", "教程", "准备食材", "食材准备", "下锅", "翻炒", "煮熟", "大火烧开",
    "转小火", "装盘", "小贴士", "腌制", "爆香", "焯水", "切丝", "切丁", "切片", "打匀", "搅拌均匀", "油热", "调味",
)
SPOONS = r"各[一二两三四五六七八九十\d零]+勺"
DISH_AMOUNT = r"[^\n；。,，、]{1,14}\s+\d+(?:\.\d+)?\s*[个只根块片勺条袋包杯碗适量克gG毫升mlML]{1,4}"
HALF_PIECE, HALF_STICK = r"鸡胸|鸡腿|牛肉|猪肉|黄瓜|番茄|土豆|豆腐", r"黄瓜|胡萝卜|玉米|香肠|葱"
AMOUNT_UNIT = r"[个只根块片勺克gG]"
KITCHEN = (
    r"鸡胸|鸡腿|牛腩|牛肉|五花肉|里脊|鸡蛋|鸭蛋|皮蛋|黄瓜|番茄|西红柿|土豆|马铃薯|葱花|蒜末|姜丝|小米椒|青椒|洋葱|胡萝卜|生菜|菠菜|白菜|芹菜|香菜|小葱|"
    r"面条$|挂面|粉条|粉丝"
)
FACTORY = (
    r"食用|食品添加|麦麸|纤维|淀粉|魔芋|提取物|谷朊|谷胱|麸皮|糖浆|山梨|麦芽|柠檬酸|碳酸|酵母|乳粉|全脂|脱脂|果胶|黄原|卡拉胶|海藻酸|小麦|面粉|荞麦|"
    r"燕麦|藜麦|青稞|糙米|黑米|棕榈|植物油|精炼油|氢化|起酥|可可脂"
)
INLINE_CONTENT = r"(?U)[\x{4e00}-\x{9fff}\w·．\d]{1,18}[（(]\s*含量\s*[≥>=＝]?\s*[\d.]+\s*%?\s*[)）]"
LABELS = (r"配料表", r"配\s*料\s*[:：]", r"原\s*料\s*[:：]", r"食品添加剂", r"产品\s*配\s*料")
CONTENTS = (r"含量", r"添加量", r"\d+(?:\.\d+)?\s*[％%]", r"[≥＞>]\s*[\d.]+", r"按\s*添\s*加\s*量\s*递\s*减")
REFUSALS = (
    "无法识别", "没有配料", "看不清", "不存在配料", "未在图中", "未在图片", "抱歉，我", "抱歉，无法", "不能识别", "没有识别到", "图中没有",
    "图片中没有", "无配料", "未见配料",
)
NOTHING = ("无", "暂无", "没有", "无。", "无，")
LIST_TAIL, TAIL_KINDS = 32, 3


def like(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def any_like(c: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(or_, [like(c, p) for p in patterns])


def is_address_list(c: Column | str) -> Column:
    """STR15: whether a cell holds picture addresses where a text should be."""
    t = strip(c)
    head = F.substring(t, 1, 400)
    many = F.contains(t, F.lit(";")) | (F.length(t) > 180) | (F.regexp_count(t, F.lit("http")) >= 2)
    return like(t, "^https?://") | (like(head, "https?://") & many)


def from_attributes(c: Column | str) -> Column:
    """STR16."""
    return strip(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"配料(?:表)?[:：]\s*([^;；]+)", 1))


def one_line(c: Column | str) -> Column:
    """STR17: lines joined by a full-width semicolon."""
    return F.array_join(split_filled(c, r"\r\n|\r|\n"), "；")


def shown_ingredients(text: Column | str, pictures: Column | str, attributes: Column | str, n: int = 420) -> Column:
    """STR18: the text, else what the attributes say, else a note that there are only pictures, else a dash."""
    raw, named = first_filled(text, pictures), from_attributes(attributes)
    return (
        F.when((raw != "") & ~is_address_list(raw), table_cell(one_line(raw), n))
        .when(named != "", table_cell(named, n))
        .when(raw != "", table_cell(F.lit(PICTURES_ONLY), n))
        .otherwise("—")
    )


def segments(c: Column | str) -> Column:
    """STR19."""
    return split_filled(c, "[；、,，]+")


def is_recipe(c: Column | str) -> Column:
    """STR21: whether the text tells how to cook rather than what a pack holds."""
    t = strip(c)
    short = F.filter(split_filled(t, "；"), lambda x: (F.length(x) <= 24) & like(x, r"\d"))
    lines = split_filled(t, r"[\n；]")
    amounts = F.filter(lines, lambda x: (F.length(x) <= 22) & like(x, r"\d") & like(x, AMOUNT_UNIT))
    return (t != "") & (
        holds_any(t, RECIPE_WORDS)
        | like(t, SPOONS)
        | (F.regexp_count(t, F.lit(DISH_AMOUNT)) >= 2)
        | (F.contains(t, F.lit("半块")) & like(t, HALF_PIECE))
        | (F.contains(t, F.lit("半根")) & like(t, HALF_STICK))
        | (F.size(short) >= 4)
        | ((F.size(lines) >= 3) & (F.size(amounts) >= 3))
    )


def is_enumeration(c: Column | str) -> Column:
    """STR22: whether the text lists what packs hold, without a heading."""
    parts = split_filled(strip(c), "[,，、;；]")
    kitchen = F.size(F.filter(parts, lambda x: like(x, KITCHEN)))
    factory = F.size(F.filter(parts, lambda x: like(x, FACTORY)))
    enough = ((F.size(parts) >= 4) & (factory >= 2)) | ((F.size(parts) >= 3) & (factory >= 3))
    return (F.size(parts) >= 3) & (kitchen < 2) & enough


def has_table_signals(c: Column | str) -> Column:
    """STR23."""
    t = strip(c)
    return (t != "") & (like(t, INLINE_CONTENT) | (any_like(t, LABELS) & any_like(t, CONTENTS)) | is_enumeration(t))


def is_acceptable(c: Column | str) -> Column:
    """STR24: whether a recognised text is an ingredient list."""
    t = strip(c)
    parts = segments(t)
    tail = F.slice(parts, F.greatest(F.size(parts) - LIST_TAIL + 1, F.lit(1)), LIST_TAIL)
    repeats = (F.size(parts) >= LIST_TAIL) & (F.size(F.array_distinct(tail)) <= TAIL_KINDS)
    return (
        (F.length(t) >= 6)
        & ~like(t, r"^\s*\[.*\]\s*$")
        & ~holds_any(t, REFUSALS)
        & ~t.isin(*NOTHING)
        & ~is_recipe(t)
        & has_table_signals(t)
        & ~repeats
        & ((F.length(t) >= 18) | like(t, "[，、,;；]"))
    )


def sanitised(c: Column | str, run: int = 28, kinds: int = 3, most: int = 3200) -> Column:
    """STR20: without closing quotes, without a tail that repeats a few words, and not over long.

    The tail starts at the first segment from which ``run`` or more segments have ``kinds`` values or fewer. One fold from
    the last segment on finds it; steps that later ones look at several times are variables of a lambda, so each runs once.
    """
    t = F.regexp_replace(strip(c), "(?U)[\"'“”‘’＂\\s]+$", "")
    once = lambda x, then: F.get(F.transform(F.array(x), then), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0).alias("n"))

    def longer(tail: Column, x: Column) -> Column:
        """The tail with x before it; one more value than kinds ends it."""
        known = F.array_contains(tail["seen"], x)
        seen = F.when(known | (F.size(tail["seen"]) > kinds), tail["seen"]).otherwise(F.concat(tail["seen"], F.array(x)))
        return F.struct(seen.alias("seen"), (tail["n"] + F.when(F.size(seen) <= kinds, 1).otherwise(0)).alias("n"))

    def without_tail(parts: Column) -> Column:
        tail = F.aggregate(F.reverse(parts), start, longer, lambda x: x["n"])
        return once(tail, lambda n: F.slice(parts, 1, F.size(parts) - F.when(n >= run, n).otherwise(0)))

    def ended(head: Column) -> Column:
        last = F.length(F.regexp_extract(head, r"(?s)^(.*[、，,；])", 1))
        return F.concat(once(last, lambda n: F.when(n - 1 > most // 2, F.substr(head, F.lit(1), n)).otherwise(head)), F.lit("…（已截断）"))

    joined = F.regexp_replace(F.array_join(once(segments(t), without_tail), "、"), r"(磷酸三[钾钠][、,，]?\s*){35,}", "磷酸三钾、磷酸三钠等（按国家标准使用）")
    return once(joined, lambda x: F.when(F.length(x) > most, once(F.substring(x, 1, most), ended)).otherwise(x))
