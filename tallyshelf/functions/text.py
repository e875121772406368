"""Cells are strings and a missing cell is the empty string; these expressions keep to that.

A null counts as empty everywhere. White space is what Unicode calls so, the ideographic space included.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """The text without white space at its ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), rf"(?U)^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column | str) -> Column:
    """Stripped, and with each run of white space as one space."""
    return strip(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), rf"(?U){SPACE}+", " "))


def filled(c: Column | str) -> Column:
    """The stripped text, null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def first_filled(*cells: Column | str) -> Column:
    """PRJ1: the first cell that is not blank, stripped; empty if there is none."""
    return F.coalesce(*[filled(c) for c in cells], F.lit(""))


def cut(c: Column | str, n: int, mark: str = "") -> Column:
    """The first n code points, with the mark behind them if something was cut off."""
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def table_cell(c: Column | str, n: int = 120) -> Column:
    """PRJ7: one line without column marks, cut to n code points with an ellipsis; n of 0 or less cuts nothing."""
    line = squeeze(F.translate(F.coalesce(col(c).cast("string"), F.lit("")), "|", "/"))
    return cut(line, n, "…") if n > 0 else line


def holds_any(c: Column | str, words: list[str] | tuple[str, ...]) -> Column:
    """Whether the text contains one of the words as it stands, letter case included."""
    c = col(c)
    return reduce(or_, [F.contains(c, F.lit(w)) for w in words], F.lit(False))


def words_held(c: Column | str, words: list[str] | tuple[str, ...]) -> Column:
    """Those of the words that the text contains, as an array of structs (position, word)."""
    listed = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(w).alias("word")) for i, w in enumerate(words)])
    return F.filter(listed, lambda x: F.contains(col(c), x["word"]))


def occurrences(c: Column | str, word: str) -> Column:
    """How often the word occurs in the text without overlaps."""
    c = F.coalesce(col(c), F.lit(""))
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("long")


def without_tags(c: Column | str, n: int = 0) -> Column:
    """STR2: text of a piece of markup, references left alone."""
    text = squeeze(F.regexp_replace(F.coalesce(col(c), F.lit("")), "<[^>]+>", " "))
    return F.substring(text, 1, n) if n > 0 else text


#: The named references that product texts use.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&yen;", "¥"), ("&middot;", "·"), ("&amp;", "&"))


def plain(c: Column | str, n: int = 2000) -> Column:
    """STR1: text of a piece of markup with its common references decoded, on one line, cut to n code points."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), "<[^>]+>", " ")
    for name, char in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.substring(squeeze(text), 1, n)


def split_filled(c: Column | str, pattern: str) -> Column:
    """The parts between matches of the pattern, stripped, without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), pattern), strip), lambda x: x != "")


def distinct_texts(array: Column) -> Column:
    """SET6: squeezed texts of two code points or more, the first of those that differ in case only."""
    texts = F.filter(F.transform(array, squeeze), lambda x: F.length(x) >= 2)

    def step(kept, x):
        return F.when(F.exists(kept, lambda y: F.lower(y) == F.lower(x)), kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(texts, F.array().cast("array<string>"), step)  # a fold looks at the texts once


def is_digits(c: Column | str) -> Column:
    return F.rlike(col(c), F.lit("^[0-9]+$"))


def safe_segment(c: Column | str, n: int = 48) -> Column:
    """STR28: the text as a folder name."""
    name = F.substring(F.regexp_replace(strip(c), r'[<>:"/\\|?*\n\r\t]', "_"), 1, n)
    return F.coalesce(F.nullif(F.regexp_replace(name, r"^[ .]+|[ .]+$", ""), F.lit("")), F.lit("run"))


def batch_label(folder: Column | str) -> Column:
    """STR27: date and time of a run folder named <date>_<time>_<keyword>, else the name itself."""
    c = col(folder)
    date, time = F.regexp_extract(c, r"^(\d{8})_(\d{6})_", 1), F.regexp_extract(c, r"^(\d{8})_(\d{6})_", 2)
    return F.when(date != "", F.concat_ws(" ", date, time)).otherwise(c)


def keyword_of(folder: Column | str) -> Column:
    """STR27: the keyword in the name of a run folder, else empty."""
    return strip(F.regexp_extract(col(folder), r"^\d{8}_\d{6}_(.+)$", 1))


def is_rank_text(c: Column | str) -> Column:
    """STR5: whether a tag speaks of a place in a best-seller list."""
    t = strip(c)
    return (t != "") & (
        F.contains(t, F.lit("榜"))
        | (F.contains(F.upper(t), F.lit("TOP")) & (F.length(t) <= 48))
        | F.rlike(t, F.lit(r"第\s*\d+\s*名"))
        | (F.contains(t, F.lit("热销")) & (F.length(t) <= 36))
    )
