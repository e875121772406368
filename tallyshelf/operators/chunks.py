"""Texts in chunks of bounded length for readers that take so much at a time.

Where a chunk starts depends on all chunks before it. A group of up to ``RUN`` texts is one array of lengths, and a fold
goes over it. A larger group is numbered and cut into runs of equal numbers of texts, each longer than a chunk. Wherever the
chunk that is open at the start of a run began, the next one starts at one of the run's first texts, a *head*; each run
says for each of its heads which head of the next run follows. Those pointers are joined to ones over 2, 4, 8 ...
runs, for every second, fourth, eighth ... run, until one leads past the last; then the heads that the group's first text
leads to are looked up in reverse, and every run lists its own chunks. No task sees more than a run and the next one's heads.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.functions.text import filled
from tallyshelf.operators.catalog import numbered
from tallyshelf.sources.shared import written

#: Texts of a run; a run has as many as a chunk may have characters at least, so every full run has a head.
RUN = 65_536


def chunked(texts: DataFrame, text: str, group: str, order: str, most: int = 24_000, run: int = RUN) -> DataFrame:
    """WIN10: group, chunk (from 0), texts and characters: texts in order, a new chunk where the next would go beyond ``most``.

    Each text counts one more than its length; blank ones are left out. A text that is over long has a chunk to
    itself. Texts of equal order count in any order. A null group is a group.
    """
    run = max(run, most)
    sized = texts.select(F.col(group).alias("_g"), F.col(order).alias("_at"), filled(text).alias("_t")).where("_t is not null")
    sized = sized.select("_g", "_at", (F.length("_t") + 1).cast("long").alias("_n"))
    counts = sized.groupBy("_g").agg(F.count(F.lit(1)).alias("_texts"))
    large = written(counts.where(F.col("_texts") > run), "large-groups").select(F.col("_g").alias("_large"))  # at most a group for each run texts
    if large.isEmpty():
        found = folded(sized, most)
    else:
        same = F.col("_g").eqNullSafe(F.col("_large"))
        found = folded(sized.join(large, same, "left_anti"), most).unionByName(cut(sized.join(large, same, "left_semi"), most, run))
    return found.withColumnRenamed("_g", group)


def folded(sized: DataFrame, most: int) -> DataFrame:
    """The chunks of groups that fit an array: the fold carries the chunk that is open and those that are closed."""
    listed = sized.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_at", "_n"))).alias("xs"))
    kind = "struct<texts:bigint,characters:bigint>"
    start = F.struct(F.lit(0).cast("long").alias("texts"), F.lit(0).cast("long").alias("characters"), F.array().cast(f"array<{kind}>").alias("closed"))
    open_chunk = lambda a: F.array(F.struct(a["texts"].alias("texts"), a["characters"].alias("characters")))

    def step(acc, x):
        opens = (acc["texts"] > 0) & (acc["characters"] + x["_n"] > most)
        return F.struct(
            F.when(opens, F.lit(1).cast("long")).otherwise(acc["texts"] + 1).alias("texts"),
            F.when(opens, x["_n"]).otherwise(acc["characters"] + x["_n"]).alias("characters"),
            F.when(opens, F.concat(acc["closed"], open_chunk(acc))).otherwise(acc["closed"]).alias("closed"),
        )

    chunks = F.aggregate("xs", start, step, lambda a: F.concat(a["closed"], open_chunk(a)))
    return listed.select("_g", F.posexplode(chunks).alias("chunk", "c")).select("_g", F.col("chunk").cast("long").alias("chunk"), "c.texts", "c.characters")


def starts_after(before: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """For a chunk that starts at each text: where the next one starts, the number of texts if none does."""
    return np.maximum(np.searchsorted(before + sizes, before + most, side="right"), np.arange(len(sizes)) + 1)


def heads_of(before: np.ndarray, most: int) -> int:
    """How many of a run's texts may be the first that starts a chunk; before has the characters in front of each text."""
    return int(np.searchsorted(before, most, side="right"))


def cut(sized: DataFrame, most: int, run: int) -> DataFrame:
    """The chunks of groups of any size."""
    kind = dict(sized.dtypes)["_g"]
    rows = numbered(sized, ["_at"], "_g").select("_g", "_n", F.floor(F.col("row_index") / run).alias("_run"), "row_index")
    rows = written(rows, "runs")

    # A run and the heads of the next: the texts before which the next run has no more than a chunk's characters.
    small = F.pmod("row_index", F.lit(run)) <= most  # heads are among these, as each text has a character
    shared = F.when(small & (F.col("_run") > 0), F.array(F.col("_run"), F.col("_run") - 1)).otherwise(F.array("_run"))
    both = rows.select("_g", F.explode(shared).alias("_run"), "row_index", "_n")

    def pointers(t: pa.Table) -> pa.Table:
        own, at, sizes, here = loaded(t, run)
        before = np.cumsum(sizes) - sizes
        after = starts_after(before, sizes, most)
        heads = heads_of(before[:own], most) if here else min(own, 1)  # the first text of all is its run's only head
        to = np.where(np.arange(len(after)) < own, after, np.arange(len(after)))  # texts of the next run stay where they are
        to = np.append(to, len(to))
        while True:  # pointers along chunks, each round twice as far, until they lead out of the run
            further = to[to]
            if (further == to).all():
                break
            to = further
        led = to[:heads]
        gone = led >= len(at)
        nexts = np.where(gone, 0, at[np.minimum(led, len(at) - 1)])
        return pa.table({"_g": t.column("_g")[:1].combine_chunks().take(pa.array(np.zeros(heads, np.int64))), "_run": pa.array(np.full(heads, here)), "head": pa.array(at[:heads]), "to": pa.array(nexts, mask=gone)})

    jumps = both.groupBy("_g", "_run").applyInArrow(pointers, f"_g {kind}, _run long, head long, to long")
    heads = true_heads(written(jumps, "jumps"))

    def listed(t: pa.Table) -> pa.Table:
        own, at, sizes, here = loaded(t.select(["_g", "_run", "row_index", "_n"]), run)
        before = np.cumsum(sizes) - sizes
        after = starts_after(before, sizes, most)
        first = t.column("head")[0].as_py()
        starts = []
        i = len(at) if first is None else int(np.searchsorted(at, first))
        while i < own:
            starts.append(i)
            i = int(after[i])
        begins, ends = np.array(starts, np.int64), np.array([*starts[1:], i][: len(starts)], np.int64)
        total = np.append(before, before[-1] + sizes[-1])
        return pa.table({
            "_g": t.column("_g")[:1].combine_chunks().take(pa.array(np.zeros(len(starts), np.int64))), "_run": pa.array(np.full(len(starts), here)),
            "place": pa.array(np.arange(len(starts))), "texts": pa.array(ends - begins), "characters": pa.array(total[ends] - total[begins]),
        })

    same = F.col("_g").eqNullSafe(F.col("_hg")) & (F.col("_run") == F.col("_hrun"))
    known = heads.select(F.col("_g").alias("_hg"), F.col("_run").alias("_hrun"), "head")
    with_heads = both.join(known, same, "left").drop("_hg", "_hrun")
    chunks = written(with_heads.groupBy("_g", "_run").applyInArrow(listed, f"_g {kind}, _run long, place long, texts long, characters long"), "chunks")
    earlier = F.sum("_many").over(Window.partitionBy("_g").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    firsts = chunks.groupBy("_g", "_run").agg(F.count(F.lit(1)).alias("_many")).select(F.col("_g").alias("_hg"), F.col("_run").alias("_hrun"), F.coalesce(earlier, F.lit(0)).alias("_first"))
    return chunks.join(firsts, same).select("_g", (F.col("_first") + F.col("place")).alias("chunk"), "texts", "characters")


def loaded(t: pa.Table, run: int) -> tuple[int, np.ndarray, np.ndarray, int]:
    """Of a run with the next one's first texts: how many are its own, the texts' numbers in order, their sizes, and which run it is."""
    here = t.column("_run")[0].as_py()
    at = t.column("row_index").to_numpy()
    order = np.argsort(at, kind="stable")
    at = at[order]
    return int(np.searchsorted(at, (here + 1) * run)), at, t.column("_n").to_numpy()[order], here


def true_heads(jumps: DataFrame) -> DataFrame:
    """_g, _run and head: of each run the head that the group's first text leads to; runs without a chunk's start have none.

    Each round joins pointers of half as many runs, so all rounds together cost twice the first.
    """
    levels, step = [jumps], 1
    while True:
        last = levels[-1]
        aim = F.when(F.col("to").isNotNull(), F.col("_run") + step)
        left = last.where(F.pmod("_run", F.lit(2 * step)) == 0).select("_g", "_run", "head", F.col("to").alias("_mid"), aim.alias("_aim"))
        if left.where("_mid is not null").isEmpty():
            break
        right = last.select(F.col("_g").alias("_rg"), F.col("_run").alias("_rrun"), F.col("head").alias("_rhead"), "to")
        same = F.col("_g").eqNullSafe(F.col("_rg")) & (F.col("_aim") == F.col("_rrun")) & (F.col("_mid") == F.col("_rhead"))
        step *= 2
        levels.append(written(left.join(right, same, "left").select("_g", "_run", "head", "to"), "jumps"))
    heads = written(jumps.where("_run = 0").select("_g", "_run", "head"), "heads")
    for k in reversed(range(len(levels))):
        by = levels[k].select(F.col("_g").alias("_rg"), F.col("_run").alias("_rrun"), F.col("head").alias("_rhead"), "to")
        same = F.col("_g").eqNullSafe(F.col("_rg")) & (F.col("_run") == F.col("_rrun")) & (F.col("head") == F.col("_rhead"))
        led = heads.join(by, same).where("to is not null").select("_g", (F.col("_run") + (1 << k)).alias("_run"), F.col("to").alias("head"))
        heads = written(heads.unionByName(led), "heads")
    return heads


def spread(chunks: DataFrame, group: str, most: int = 12) -> DataFrame:
    """WIN9: at most ``most`` chunks of each group, evenly spread over their order, the first one among them; chunks are numbered from 0."""
    counts = chunks.groupBy(F.col(group).alias("_cg")).agg(F.count(F.lit(1)).alias("_n"))
    place = F.col("chunk").cast("long")
    # chunk is floor(i * n / most) for some i if the first such i, the ceiling of chunk * most / n, still leads to it
    i = F.ceil(place * most / F.col("_n"))
    taken = (F.col("_n") <= most) | ((i < most) & (F.floor(i * F.col("_n") / most) == place))
    return chunks.join(counts, F.col(group).eqNullSafe(F.col("_cg"))).where(taken).drop("_cg", "_n")
