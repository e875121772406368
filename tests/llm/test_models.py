"""Operators 1 and 2: stated numbers by brute force, models by held-out quality; and the pipeline."""

import math
import os
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from tallyshelf.llm import common, lm_scoring, ngram_join, quality, queries, token_files
from tests.llm.shared import edges, fold, low, none


def stated(rows):
    """doc_id, held_out, n_tokens, n_known, N and base score of every row."""
    split = [(d, [*low(t).encode().split(), b"\n"]) for d, t in rows]
    held = {d: d is None or fold(d, 10) for d, _ in split}
    counts = Counter(w for d, ws in split if not held[d] for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    of = lambda w: math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1)))
    return [(d, held[d], len(ws), sum(counts[w] > 0 for w in ws), total, math.fsum(map(of, ws))) for d, ws in split]


@pytest.mark.parametrize("hot", [lm_scoring.HOT, 50])
def test_lm_stated_columns(spark, sf, monkeypatch, hot):
    monkeypatch.setattr(lm_scoring, "HOT", hot)
    docs = edges(spark).select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text"))
    found = sorted((tuple(r) for r in lm_scoring.score(docs).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    want = sorted(stated([tuple(r) for r in docs.collect()]), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in found], [r[5] for r in want], rtol=1e-9)
    assert all(r[6] <= 0 for r in found)
    held = [r for r in found if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)  # better than the base on what was held out


def test_lm_probabilities_add_up_to_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    vocab = lm_scoring.vocabulary(lm_scoring.token_counts(docs))
    model = lm_scoring.trained(docs, vocab)
    older, newer, norm = model.tables()
    for a, b in ((0, 0), (3, 5), (400, 7)):
        assert abs(np.exp(older[a].astype(float) + newer[b] - norm[a, b]).sum() - 1) < 1e-4
    size, off, unknown = vocab.discounts()
    for tail in range(lm_scoring.TAILS):
        own = [c for t, k, c in vocab.hot if k == tail and t not in vocab.shortlist]
        if own:
            assert abs(sum((c - off[tail]) / size[tail] for c in own) + unknown[tail] - 1) < 1e-9


def test_lm_classes_and_sums_of_many_at_once():
    texts = [b"", b"a", b"A b\x0bcc. \xc3\xa9", b" \n", b"x" * 70_000 + b" b\n\nhttps://e.x/1", b"ab\x1cc, B"]
    shortlist = {lm_scoring.END: 0, b"b": 1, b"\xc3\xa9": 2}
    want: list[tuple[int, int, int]] = []
    for text in texts:
        own = [0, 0, *[shortlist.get(w, 1 + lm_scoring.SHORTLIST + lm_scoring.looks(w)) for w in lm_scoring.tokens_of(text)], 0]
        want += zip(own, own[1:], own[2:])
    for shorts in (shortlist, {lm_scoring.END: 0}):
        classes = lm_scoring.ClassOf(shorts)
        starts, found = classes.of(b"b q")
        assert starts.tolist() == [0, 2] and found.tolist() == [shorts.get(b"b", 1 + lm_scoring.SHORTLIST + lm_scoring.looks(b"b")), 1 + lm_scoring.SHORTLIST + lm_scoring.looks(b"q")]
    assert list(zip(*[x.tolist() for x in lm_scoring.class_stream(texts, lm_scoring.ClassOf(shortlist))])) == want
    sums = lm_scoring.row_sums(np.array([2, 0, 2]), np.array([[1, 2], [3, 4], [5, 6]], np.float32), 3)
    assert sums.tolist() == [[3, 4], [0, 0], [6, 8]]


def test_lm_empty(spark):
    assert lm_scoring.score(none(spark)).count() == 0


def ranked_above(scores, labels):
    good, bad = scores[labels == 1], scores[labels == 0]
    return ((good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()) if len(good) and len(bad) else 1.0


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = quality.score(docs, labels).join(labels, "doc_id").toPandas()
    held = found[found.held_out]
    assert ranked_above(held.score.to_numpy(), held.quality.to_numpy()) > 0.9
    assert ((found.score >= 0.3) == (found.predicted == 1)).all() and found.score.between(0, 1).all()


def test_quality_edges(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.score(edges(spark), labels).collect()
    assert len(rows) == 13 and all(r.held_out == (r.doc_id is None or fold(r.doc_id, 5)) for r in rows)
    again = [r.score for r in rows if r.doc_id == 6]
    assert again[0] == again[1]
    unlabelled = quality.score(edges(spark), labels.where("false")).collect()
    assert {r.score for r in unlabelled} == {0.5}
    assert quality.score(none(spark), labels).count() == 0
    kept = quality.accepted(edges(spark), labels)
    assert kept.columns == edges(spark).columns


def test_a_repeated_row_takes_one_place_of_the_sample(spark):
    rows = [(i, f"text number {i} with words of its own") for i in range(1, 40)] + [(3, "text number 3 once more")] * 10_000
    rows += [(i, f"junk {i} !!! ??? {i}") for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in dict(rows).items()] * 2, "doc_id long, quality int")
    counts, found = quality.labelled_sample(docs, labels, size=16)
    assert sorted(found) == [0] * 8 + [1] * 8 and counts.shape == (16, quality.TERMS)
    _, found = quality.labelled_sample(docs, labels)
    assert len(found) == sum(not fold(i, 5) for i in dict(rows)) + (not fold(3, 5))


def test_labels_of_other_documents_take_no_place_of_the_sample(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)] + [(None, 1), (3, None)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(0, 4000, 41)] + [(None, "no id"), (9999, "no label")], "doc_id long, text string")
    teachable = sum(not fold(i, 5) for i in range(0, 4000, 41))
    for size in (40, 2 * teachable):
        _, found = quality.labelled_sample(docs, labels, size=size)
        assert len(found) == min(size, teachable)


def test_quality_scores_equal_brute_force(spark, sf):
    """The whole query anew: sample, terms, axes by a full decomposition, votes."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    taught = sorted((q, d) for d, q in labels.items() if not fold(d, 5) and d in dict(docs))
    texts = {d: (t or "").encode() for d, t in docs}
    counts = np.stack([quality.terms(texts[d]).astype(np.float16).astype(float) for _, d in taught])
    weights = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.5
    centre = (counts * weights).mean(axis=0)
    axes = np.linalg.svd(counts * weights - centre, full_matrices=False)[2][: quality.RANK].T
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)
    vectors, y = unit((counts * weights - centre) @ axes), np.array([q for q, _ in taught])
    found = {r.doc_id: r.score for r in queries.QUERIES["op2_quality_classifier"](spark, sf).collect()}
    far = []
    for d, text in texts.items():
        near = vectors @ unit((quality.terms(text) * weights - centre) @ axes)
        top = np.argsort(-near)[: quality.NEIGHBOURS]
        weight = np.maximum(near[top], 0) ** 2
        far.append(abs((weight * y[top]).sum() / weight.sum() - found[d]) if text else abs(y.mean() - found[d]))
    assert np.mean(np.array(far) < 0.02) > 0.97, np.sort(far)[-10:]


def test_words_and_forms_tell_quality(spark):
    """What either kind of terms gives by itself on held-out labels."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality").collect()
    counts = np.stack([quality.terms((r.text or "").encode()) for r in rows])
    y, held = np.array([r.quality for r in rows]), np.array([fold(r.doc_id, 5) for r in rows])
    found = {}
    for name, kept in (("both", slice(None)), ("forms", slice(0, quality.FORMS)), ("words", slice(quality.FORMS, None))):
        only = np.zeros_like(counts)
        only[:, kept] = counts[:, kept]
        model = quality.fit(only[~held], y[~held])
        found[name] = ranked_above(model.votes(only[held]), y[held])
    print(found)
    assert found["both"] > 0.9 and found["words"] > 0.6, found


def test_votes_are_exact():
    texts = [f"text number {i} {'!' * (i % 7)} {'word ' * (i % 5)}".encode() for i in range(60)]
    counts = np.stack([quality.terms(t) for t in texts])
    model = quality.fit(counts, [i % 2 for i in range(60)])
    near = model.embed(counts) @ model.vectors.T
    for i, got in enumerate(model.votes(counts)):
        top = np.sort(near[i])[::-1][: quality.NEIGHBOURS]
        chosen = near[i] >= top[-1] - 1e-7
        weight = np.maximum(near[i][chosen], 0) ** 2
        if chosen.sum() >= quality.NEIGHBOURS:
            assert abs((weight * model.labels[chosen]).sum() / weight.sum() - got) < 1e-3


def test_pipeline(spark, sf):
    out = corpus_pipeline.run(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert 0 < len(out) < len(docs) and out.doc_id.is_unique
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in queries.QUERIES["op2_quality_classifier"](spark, sf).where("predicted = 1").collect()}
    kept = docs[docs.doc_id.isin(good)]
    best = kept.assign(low=kept.text.map(low)).groupby("low").doc_id.max()
    assert set(out.doc_id) <= set(best)
    assert labels.count() and "pipeline" in __spark_entry__.queries()


def test_pipeline_leaves_its_stages_alone_on_disk(spark, sf):
    folder = common.scratch_folder(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert corpus_pipeline.run(spark, sf).count() > 0
    left = sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before)
    assert left == sorted(name for name, _ in corpus_pipeline.STAGES)
    assert spark.conf.get(common.CLEANED) == "false"


def test_links_leave_labels_alone_on_disk(spark):
    docs, folder = edges(spark), common.scratch_folder(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert ngram_join.linked_components(docs, 4, 85).count() == docs.count()
    assert sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before) == ["distinct-sets", "labels", "sets"]


def test_pipeline_of_nothing(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_compression_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(2)
    copy, own = rng.integers(1, 40_000, 3000), rng.integers(1, 300, 20_000)
    docs = [*[np.append(copy, 0)] * 100, np.append(own, 0), np.full(5000, 7), *[np.append(copy[500:2500], 0)] * 50]
    ids, ends = np.concatenate(docs).astype("<u4"), np.cumsum([len(x) for x in docs])
    rules, lengths, symbols, after = token_files.compress(ids, ends)
    assert (token_files.expand(symbols, rules) == ids).all()
    assert np.diff(after, prepend=0)[:100].tolist() == [1] * 100 and lengths.max() >= 3001
    border = set(after.tolist())
    pairs = Counter((a, b) for k, (a, b) in enumerate(zip(symbols.tolist(), symbols[1:].tolist()), 1) if k not in border)
    assert max(pairs.values()) < token_files.LEAST_COUNT
