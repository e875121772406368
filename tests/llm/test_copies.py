"""Operators 6 and 7 and the components of links, against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np

from tallyshelf.llm import exact_dedup, ngram_join
from tallyshelf.llm.components import components
from tests.llm.shared import EDGES, STORY, edges, low, none


def test_exact_groups(spark):
    found = exact_dedup.membership(edges(spark)).collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in EDGES:
        groups[low(text)].append(doc_id)
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        want += [(i, keep, len(ids), i == keep, sha) for i in ids]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_texts_that_share_a_hash_stay_apart(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["a b", "A B", "c", "d", "d", "d", "", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, exact_dedup.membership(docs).collect()))
    stay = sorted(r.doc_id for r in exact_dedup.deduplicated(docs).collect())
    for digits in (0, 1):  # every text in one group, and only some
        monkeypatch.setattr(exact_dedup, "content_key", lambda sha, n=digits: exact_dedup.F.substring(sha, 1, n).cast("binary"))
        assert sorted(map(tuple, exact_dedup.membership(docs).collect())) == plain
        assert sorted(r.doc_id for r in exact_dedup.deduplicated(docs).collect()) == stay == [1, 2, 5, 7]


def test_exact_survivors_keep_their_columns(spark):
    docs = edges(spark)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == sorted([2, 3, 4, 7, 8, 9, 10, None, 12], key=repr)
    assert exact_dedup.deduplicated(none(spark)).count() == 0 and exact_dedup.membership(none(spark)).count() == 0


def sets_of(rows, n):
    out = []
    for doc_id, text in rows:
        words = low(text).encode().split()
        k = min(n, len(words))
        out.append((doc_id, {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()))
    return out


def brute_components(rows, n, percent):
    sets = sets_of(rows, n)
    label = {i: i for i in range(len(sets))}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[root(i)] = root(j)
    best = defaultdict(list)
    for i, (doc_id, _) in enumerate(sets):
        best[root(i)].append(doc_id)
    rows = [(d, len(s), min((x for x in best[root(i)] if x is not None), default=None)) for i, (d, s) in enumerate(sets)]
    return sorted(rows, key=repr)


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        at = rng.randrange(len(words))
        words[at : at + rng.choice([0, 1, 1])] = [f"w{rng.randrange(400)}"]
    return words


def corpus(seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for family in range(60):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 15, 40, 120, 400]))]
        if family % 3 == 0:
            base += passage
        for _ in range(rng.randrange(1, 9)):
            rows.append((len(rows), " ".join(edited(rng, base, rng.choice([0, 1, 2, 3, len(base) // 30, len(base) // 60])))))
    return rows


def test_ngrams_of_many_texts_at_once():
    """Words are hashed block by block: neither neighbours nor places change a text's n-grams, and long words count whole."""
    size = ngram_join.BLOCK
    texts = ["x" * (size + 9) + " a b " + "x" * (size + 9) + " a b", "x" * (size + 8) + " a b", "", " \t", "a b c", "A\tb\x0bC ", "É\xa0q " * size, "a" * size + " " + "b" * (size - 1), "w" * 64, "w" * 65]
    for n in (1, 3, 4, 5):
        found = list(ngram_join.ngram_sets([t.encode() for t in texts], n))
        sets = [s for _, s in sets_of(enumerate(texts), n)]
        assert [len(x) for x in found] == [len(s) for s in sets]
        assert all(len(set(a) & set(b)) == len(s & t) for a, s in zip(found, sets) for b, t in zip(found, sets))
        assert all(list(x) == list(next(ngram_join.ngram_sets([t.encode()], n))) for x, t in zip(found, texts))


def test_join_equals_brute_force(spark):
    for seed, n, percent in ((1, 4, 85), (2, 5, 80), (3, 1, 50 + 30)):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = ngram_join.linked_components(docs, n, percent).drop("key").collect()
        assert sorted(map(tuple, found), key=repr) == brute_components(rows, n, percent), (seed, n, percent)


def test_join_of_many_near_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(1300)] + [(5000 + i, " ".join(f"x{i}_{k}" for k in range(30))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in ngram_join.linked_components(docs, 4, 85).collect()}
    want = {d: c for d, _, c in brute_components(rows, 4, 85)}
    assert found == want


def test_join_edges(spark):
    docs = edges(spark)
    found = ngram_join.linked_components(docs, 4, 85).drop("key").collect()
    assert sorted(map(tuple, found), key=repr) == brute_components([r[:2] for r in EDGES], 4, 85)
    kept = ngram_join.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 3, 4, 5, 9, 10, 12}
    assert not {6, 7, 8} & {r.doc_id for r in kept.collect()}
    assert ngram_join.linked_components(none(spark), 4, 85).count() == 0


def test_rows_without_ids_and_repeated_ids_link_others(spark):
    words = [f"w{i}" for i in range(100)]
    at = lambda *changed: " ".join(f"x{i}" if i in changed else w for i, w in enumerate(words))
    rows = [(7, at(0, 1)), (None, at()), (3, at(98, 99)), (None, at()), (9, "far away from all of these"), (9, at(0, 2)), (None, "on its own here")]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string")
    found = ngram_join.linked_components(docs, 4, 92).drop("key").collect()
    want = brute_components(rows * 3, 4, 92)
    assert sorted(map(tuple, found), key=repr) == want and {r[2] for r in want if r[0] == 7} == {3}


def test_pairs_that_no_hub_links(spark):
    """Families of sets that differ from their hubs about as much as may be."""
    rng = random.Random(11)
    rows = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(150)]
        rows += [(len(rows) + i, " ".join(edited(rng, base, rng.choice([2, 3, 4, 5])))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.linked_components(docs, 4, 85).drop("key").collect()
    assert sorted(map(tuple, found), key=repr) == brute_components(rows, 4, 85)


def test_one_of_each_keeps_exactly_one_row_of_each_component(spark):
    kept = ngram_join.one_of_each(edges(spark), 5, 80)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, 5, 9, 10, None, 12], key=repr)
    far = " ".join(f"f{i}" for i in range(20))
    rows = [(1, STORY), (1, STORY + " again"), (2, STORY), (3, far), (3, "something else altogether"), (3, "something else altogether")]
    rows += [(None, far + " more"), (None, "only here"), (None, "it is twice here"), (None, "it is twice here"), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, ngram_join.one_of_each(docs, 5, 80).collect()), key=repr)
    (first,) = (r for r in found if r[0] == 1)
    assert first in rows[:2]
    want = [first, (3, far), (3, "something else altogether"), (None, "only here"), (None, "it is twice here"), (4, None), (4, None)]
    assert found == sorted(want, key=repr)
    assert ngram_join.one_of_each(none(spark), 5, 80).count() == 0


def test_join_on_the_driver_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = ngram_join.linked_components(docs, 4, 85).drop("key").collect()
    assert sorted(map(tuple, found), key=repr) == brute_components(rows, 4, 85)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    near = defaultdict(set)
    for u, v in pairs:
        if u != v:
            near[u].add(v)
            near[v].add(u)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert found[node] == min(seen)
    assert STORY


def test_links_sends_elements_through_one_join(spark, tmp_path, monkeypatch):
    sets = {1: [1, 2, 3, 4], 2: [1, 2, 3, 4, 5], 3: [1, 2, 3, 9], 4: [6, 7]}
    rows = [(sid, np.array(x, "<u8").tobytes()) for sid, x in sets.items()]
    spark.createDataFrame(rows, "sid long, elements binary").write.parquet(str(tmp_path / "looked-up"))
    elements = spark.read.parquet(str(tmp_path / "looked-up"))
    plans = []
    keep = ngram_join.keep
    monkeypatch.setattr(ngram_join, "keep", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or keep(df, name))
    pairs = spark.createDataFrame([(u, len(sets[u]), v, len(sets[v])) for u, v in [(1, 2), (1, 3), (2, 4)]], "u long, su long, v long, sv long")
    found = ngram_join.links(pairs, elements, 80)
    assert [tuple(r) for r in found.collect()] == [(1, 2)]
    (plan,) = [p for name, p in plans if name == "links"]
    assert sum("elements#" in line and "Relation" in line for line in plan.splitlines()) == 1


def test_large_tables_are_compared_in_parts(spark, monkeypatch):
    """What passes UNDIVIDED goes through shuffles in parts, with the same components."""
    rng = random.Random(17)
    rows = corpus(4)
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(150)]
        rows += [(len(rows) + i, " ".join(edited(rng, base, rng.choice([2, 3, 4, 5])))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names, keep = [], ngram_join.keep
    monkeypatch.setattr(ngram_join, "keep", lambda df, name, *more: names.append(name) or keep(df, name, *more))
    monkeypatch.setattr(ngram_join, "UNDIVIDED", 0, raising=False)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    found = ngram_join.linked_components(docs, 4, 85, ngram_join.PASSES).drop("key").collect()
    assert sorted(map(tuple, found), key=repr) == brute_components(rows, 4, 85)
    assert names.count("elements") == ngram_join.PASSES and names.count("overlaps") >= 3 * ngram_join.RANGES


def test_pairs_of_more_bytes_than_the_elements_go_in_shares(spark, monkeypatch):
    rng = random.Random(23)
    top = np.iinfo(np.uint64).max
    sets = {u: np.unique(np.array([0, 1 << 62, 3 << 62, top] + [rng.randrange(40) * (top // 40) for _ in range(rng.randrange(1, 60))], np.uint64)) for u in range(24)}
    elements = spark.createDataFrame([(u, x.astype("<u8").tobytes()) for u, x in sets.items()], "sid long, elements binary")
    pairs = [(u, v) for u in sets for v in sets if u < v]
    asked = spark.createDataFrame([(u, len(sets[u]), v, len(sets[v])) for u, v in pairs], "u long, su long, v long, sv long")
    names, keep = [], ngram_join.keep
    monkeypatch.setattr(ngram_join, "keep", lambda df, name, *more: names.append(name) or keep(df, name, *more))
    monkeypatch.setattr(ngram_join, "UNDIVIDED", 0, raising=False)
    monkeypatch.setattr(ngram_join, "PARTNERS", 5)
    found = {tuple(r) for r in ngram_join.links(asked, elements, 60).collect()}
    shared = {(u, v): len(np.intersect1d(sets[u], sets[v])) for u, v in pairs}
    assert found == {(u, v) for (u, v), n in shared.items() if 100 * n >= 60 * (len(sets[u]) + len(sets[v]) - n)} != set()
    assert names.count("overlaps") > ngram_join.RANGES and names.count("overlaps") == names.count("links") * ngram_join.RANGES


def test_signatures_of_all_parts_are_those_of_one(spark):
    docs = spark.createDataFrame(corpus(6), "doc_id long, text string")
    none_common = np.zeros(0, np.uint64)
    rows = lambda *part: [tuple(r) for r in ngram_join.signature_rows(docs, 4, 85, none_common, *part).distinct().collect()]
    parts = [rows(i, 3) for i in range(3)]
    assert all(parts) and sorted(sum(parts, [])) == sorted(rows())
