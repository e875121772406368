"""Chunks of groups of any size against one loop over the texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyshelf.operators import catalog, chunks
from tallyshelf.sources.shared import written


def folded(sizes, most):
    out = []
    for n in sizes:
        if out and out[-1][1] + n <= most:
            out[-1] = (out[-1][0] + 1, out[-1][1] + n)
        else:
            out.append((1, n))
    return out


def compare(spark, groups, most, run):
    """groups: name to lengths; rows are shuffled and blank ones stand among them."""
    rng = random.Random(1)
    rows = [(g, i, "x" * n) for g, lengths in groups.items() for i, n in enumerate(lengths)]
    rows += [(g, -1, " \n") for g in groups] + [(g, 3, None) for g in groups]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "name string, at long, text string").repartition(5).selectExpr("*", "1 as _n", "2 as row_index", "3 as chunk")
    found = {}
    for r in chunks.chunked(df, "text", "name", "at", most, run).collect():
        found.setdefault(r.name, {})[r.chunk] = (r.texts, r.characters)
    for g, lengths in groups.items():
        want = folded([n + 1 for n in lengths], most)
        assert found.get(g, {}) == dict(enumerate(want)), g


def test_groups_of_every_shape(spark):
    rng = random.Random(2)
    groups = {f"g{k}": [rng.choice([1, 2, 3, 7, 19, 60]) for _ in range(rng.choice([0, 1, 20, 21, 40, 57, 300]))] for k in range(12)}
    groups |= {None: [1] * 130, "same": [9] * 400, "long": [500] * 90, "last": [1] * 99 + [700], "first": [700] + [1] * 99, "edge": [19] * 60}
    compare(spark, groups, 20, 20)
    compare(spark, groups, 20, 23)
    compare(spark, groups, 57, 3)  # a run never has fewer texts than a chunk has characters


def test_one_group_with_all_rows(spark):
    """In a group of 300,000 texts no task of the pass over runs sees more than a run and the next one's heads."""
    n, most, run = 300_000, 2_000, 20_000
    text = F.repeat(F.lit("x"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).cast("int"))
    df = spark.range(n).select(F.lit("all").alias("g"), "id", text.alias("text"))
    found = {r.chunk: (r.texts, r.characters) for r in chunks.chunked(df, "text", "g", "id", most, run).collect()}
    sizes = [r.n for r in df.orderBy("id").select((F.length("text") + 1).alias("n")).collect()]
    assert found == dict(enumerate(folded(sizes, most)))


@pytest.mark.parametrize("n", [1, 11, 12, 13, 29, 30, 144, 1000])
def test_spread_takes_the_stated_places(spark, n):
    rows = spark.range(n).select(F.lit(None).cast("string").alias("g"), F.col("id").alias("chunk"))
    found = sorted(r.chunk for r in chunks.spread(rows, "g").collect())
    assert found == (list(range(n)) if n <= 12 else [int(i * n / 12) for i in range(12)])


def test_one_job_is_numbered_by_all_tasks(spark, monkeypatch):
    """All rows belong to one job, and a few to others or none: where tables are not too small to be split, each task has a share."""
    n, sorted_rows = 40_000, []
    monkeypatch.setattr(catalog, "written", lambda df, name: sorted_rows.append(written(df, name)) or sorted_rows[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("at"), F.lit("hot").alias("job"))
    df = df.unionByName(spark.createDataFrame([(i, j) for j in ("a", None, "z") for i in (5, 3, 9)], "at long, job string"))
    try:
        found = catalog.numbered(df, ["at"], "job")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = Counter(r.part for r in sorted_rows[0].select(F.shiftright("_id", 33).alias("part")).collect())
    assert len(sizes) >= 4 and max(sizes.values()) < n / 2
    by_job = {}
    for r in found.collect():
        by_job.setdefault(r.job, []).append((r.row_index, r["at"]))
    for rows in by_job.values():
        rows.sort()
        assert [i for i, _ in rows] == list(range(len(rows))) and [x for _, x in rows] == sorted(x for _, x in rows)
    assert {j: len(r) for j, r in by_job.items()} == {"hot": n, "a": 3, None: 3, "z": 3}


def test_numbers_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(catalog, "MOST_SHIFTS", 0)
    df = spark.createDataFrame([(i, i % 3 if i % 5 else None) for i in range(100)], "at int, job int")
    found = catalog.numbered(df, ["at"], "job").collect()
    for job in (0, 1, 2, None):
        own = sorted((r["at"], r.row_index) for r in found if r.job == job)
        assert [i for _, i in own] == list(range(len(own)))
