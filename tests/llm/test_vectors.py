"""Operators on embeddings, against plain loops over all rows."""

import math
from collections import Counter

import numpy as np
import pytest

from tallyshelf.llm import hard_negatives, whitening
from tallyshelf.sources.tables import table

COLUMNS = "vec_id long, embedding array<float>, label int"


def odd_rows(rng, n: int = 230, d: int = 6):
    """Few distinct values, so that scores tie; repeated rows, rows that take no part, ids of any kind."""
    rows = [(i, rng.integers(-3, 4, d).astype(float).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    rows += rows[95:125] + [rows[100]] * 3
    rows += [(None, [1.0] * d, 1), (300, None, 1), (400, [1.0] * d, None), (500, [1.0, None] + [0.0] * (d - 2), 1), (600, [math.nan] * d, 1)]
    rows += [(700, [math.inf] + [0.0] * (d - 1), 2), (800, [1.0, 2.0], 2), (900, [], 0), (-100, [-2.0] * d, 2), (1000, [3.4e38] + [0.0] * (d - 1), 2)]
    return rows


def table_of(spark, rows, extra: bool = True):
    df = spark.createDataFrame(rows, COLUMNS)
    return df.selectExpr("*", "1 as query", "2L as score", "'x' as rank", "3 as copies", "4 as row_block", "5 as n", "6 as whitened") if extra else df


def usable(rows, d):
    return [(i, v, label) for i, v, label in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]


def mined_plainly(rows, d, limit):
    own = []
    for i, v, label in usable(rows, d):
        if label is not None:
            label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
            own.append((i, [max(-limit, min(limit, math.floor(256 * float(np.float32(x))))) for x in v], label))
    first = lambda r: (-r[1], -math.inf if r[0] is None else r[0])
    out = []
    for at, (anchor, x, label) in enumerate(own):
        if anchor is None or anchor % 100:
            continue
        scored = [(i, sum(a * b for a, b in zip(x, y, strict=True)), other, k) for k, (i, y, other) in enumerate(own)]
        for p, ps, _, _ in sorted((r for r in scored if r[2] == label and r[3] != at), key=first)[:5]:
            fit = sorted((r for r in scored if r[2] != label and 30 * ps <= 100 * r[1] <= 90 * ps), key=first)[:10]
            out += [(anchor, p, rank, n, ps, ns) for rank, (n, ns, _, _) in enumerate(fit, 1)]
    return Counter(out)


@pytest.mark.parametrize("parts", [1, 7])
def test_hard_negatives_of_odd_rows(spark, parts, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)  # several blocks
    rows = odd_rows(np.random.default_rng(3))
    found = hard_negatives.hard_negatives(table_of(spark, rows).repartition(parts))
    assert Counter(map(tuple, found.collect())) == mined_plainly(rows, 6, hard_negatives.limit_of(6, 59))


def test_hard_negatives_of_the_table(spark, sf):
    df = table(spark, sf, "embeddings")
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    found = Counter(map(tuple, hard_negatives.hard_negatives(df).collect()))
    assert found and found == mined_plainly(rows, 64, hard_negatives.limit_of(64, 59))


def test_pairs_are_discarded_early_and_none_is_lost():
    """Vectors near few directions: the rotation leaves few pairs to multiply, and all that count among them."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(3000, 8)) @ rng.normal(size=(8, 64)) * 40 + rng.normal(size=(3000, 64))).astype(np.int64)
    block = hard_negatives.Block(np.arange(30), np.zeros(30, np.int64), np.ones(30, np.int64), x[:30])
    scores = x @ x[:30].T
    low, high = np.sort(scores, axis=0)[-20], np.full(30, np.inf)
    r, a, s = block.survivors(x, np.ones(scores.shape, bool), low, high)
    assert len(r) < 0.1 * scores.size
    assert {(i, j) for i, j in zip(*np.nonzero(scores >= low), strict=True)} <= set(zip(r.tolist(), a.tolist(), strict=True))
    assert (s == scores[r, a]).all()


def test_vectors_of_empty_tables(spark):
    for rows in ([], [(100, None, 1)], [(100, [], 1)], [(100, [math.nan, 1.0], 1)]):
        assert hard_negatives.hard_negatives(table_of(spark, rows)).collect() == []
        assert whitening.whitened(table_of(spark, rows)).collect() == []


def whitened_plainly(rows, d):
    own = [(i, [math.floor(1024 * float(np.float32(x))) + 100_000 for x in v]) for i, v, _ in usable(rows, d)]
    x = np.array([v for _, v in own], np.int64)
    n, sums = len(x), x.sum(axis=0)
    off = (n * x - sums) / n
    cov = off.T @ off / n
    deviations = [sum((n * a - s) ** 2 for a, s in zip(v, sums.tolist(), strict=True)) for v in x.tolist()]
    return own, n, off, cov, deviations


def test_whitening_of_the_table(spark, sf):
    df = table(spark, sf, "embeddings")
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    own, n, off, cov, deviations = whitened_plainly(rows, 64)
    values, vectors = np.linalg.eigh(cov)
    found = whitening.whitened(df.repartition(5)).collect()
    assert len(found) == 8 * n and len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9
    at = {i: k for k, (i, _) in enumerate(own)}
    got = np.zeros((n, 8))
    for r in found:
        assert r.n == n and r.deviation == deviations[at[r.vec_id]]
        assert r.explained == pytest.approx(values[-r.component] / values.sum(), rel=1e-9)
        got[at[r.vec_id], r.component - 1] = r.whitened
    want = off @ vectors[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-8
    assert np.abs(got.T @ got / n - np.eye(8)).max() < 1e-9


def test_tiles_and_blocks_of_every_size(spark, monkeypatch):
    """Dimensions that no tile divides, several blocks of rows a batch."""
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 40 * 37)
    rng = np.random.default_rng(11)
    rows = [(i, (rng.normal(size=37) * 2).tolist(), 0) for i in range(300)]
    df = table_of(spark, rows).repartition(3)
    _, n, _, cov, _ = whitened_plainly(rows, 37)
    mid = whitening.centre(df, 37)
    assert mid.n == n
    assert np.allclose(whitening.covariance(df, 37, mid), cov, rtol=1e-12, atol=1e-9)


def test_whitening_of_odd_rows(spark):
    """Fewer dimensions than components, constant and dependent dimensions, repeated rows, rows that take no part."""
    rng = np.random.default_rng(7)
    flat = [(i, [a, 2.0, a], 0) for i, a in enumerate(rng.integers(-9, 9, 50).tolist())]
    flat += [flat[3]] * 4 + [(None, [1.0, 2.0, 1.0], None), (7, None, 1), (8, [1.0], 1), (9, [1.0, None, 2.0], 1), (10, [math.inf, 1.0, 1.0], 1)]
    flat = [(i, v and [None if x is None else float(x) for x in v], label) for i, v, label in flat]
    _, n, _, cov, deviations = whitened_plainly(flat, 3)
    found = whitening.whitened(table_of(spark, flat)).collect()
    assert len(found) == 3 * n == 3 * 55
    assert Counter(r.deviation for r in found if r.component == 1) == Counter(deviations)
    first = [r.whitened for r in found if r.component == 1]
    assert np.mean(np.square(first)) == pytest.approx(1) and all(r.whitened is None for r in found if r.component > 1)
    assert found[0].identity_error < 1e-9
    same = whitening.whitened(table_of(spark, [(1, [0.5, 0.25], 0)] * 3)).collect()
    assert len(same) == 6 and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(0, None, None, None)}


def test_deviations_beyond_a_long(spark):
    rows = [(i, [1e3 * i, 0.0], 0) for i in range(300)]
    _, _, _, _, deviations = whitened_plainly(rows, 2)
    want = {i: v if v < 1 << 63 else None for i, v in enumerate(deviations)}
    assert None in want.values() and {r.vec_id: r.deviation for r in whitening.whitened(table_of(spark, rows)).collect()} == want
