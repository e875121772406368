"""The license scan, against regular expressions and plain alignments over whole texts."""

import random
import re

import pytest

from tallyshelf.llm import license_scan
from tallyshelf.llm.license_texts import NOTICES, PHRASES
from tallyshelf.sources.tables import table
from tests.llm.shared import COLUMNS, LONG, edges, low, none

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def base_plainly(text):
    words = WORD.findall(low(text))
    found = []
    for phrase, label in PHRASES.items():
        want = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def same_base(rows, texts):
    assert len(rows) == len(texts)
    got = sorted(((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str)
    assert got == sorted(map(base_plainly, texts), key=str)


def test_base_of_edge_cases(spark):
    df = edges(spark)
    found = license_scan.scan(df).collect()
    same_base(found, [r.text for r in df.collect()])
    assert sorted((r.doc_id is None, r.doc_id) for r in found) == sorted((r.doc_id is None, r.doc_id) for r in df.collect())
    assert all((r.labels, r.score, r.spans) == ("", 0.0, "") for r in found)
    assert license_scan.scan(none(spark)).collect() == []


def test_base_of_the_table(spark, sf):
    df = table(spark, sf, "documents")
    found = license_scan.scan(df).collect()
    same_base(found, [r.text for r in df.collect()])
    assert {r.doc_id for r in found} == {r.doc_id for r in df.collect()} and any(r.n_base for r in found)
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in found:
        assert ("gpl-3" in r.labels.split(",")) == ("GNU General Public License, version 3" in texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


ODD = [
    (1, "UNDER the MIT\x00license é under-the-mit-license: under the mit licenses", None, None, None),
    (2, "cc by nc by nc cc by nc cc-by-nc 4", None, None, None),
    (3, "ccé by nc, cc by\x7fnc under the apache license version 2under", None, None, None),
    (4, "apache license, version 2.0 " * 3000, None, None, None),
    (5, "x" * 2_500_000 + " under the mit license", None, None, None),
    (6, LONG + " Cc By Nc " + LONG, None, None, None),
    (6, LONG + " Cc By Nc " + LONG, None, None, None),
    (None, "under the mit license", None, None, None),
]


@pytest.mark.parametrize("most", [0, 10**6])
def test_base_of_odd_texts(spark, monkeypatch, most):
    """Also without any broadcast, with small pieces and rows."""
    monkeypatch.setattr(license_scan, "MOST_PLACES", most)
    monkeypatch.setattr(license_scan, "MOST_TEXTS", most)
    monkeypatch.setattr(license_scan, "ROW_GRAMS", 1000)
    found = license_scan.scan(spark.createDataFrame(ODD, COLUMNS)).collect()
    same_base(found, [t for _, t, *_ in ODD])
    assert {r.labels for r in found if r.doc_id is None} == {"mit"}


def test_notices_edited_and_whole(spark):
    """Each notice between other words, whole and with one word in twelve replaced, left out or added, gives its label and no other."""
    rng = random.Random(2)
    rows = []
    for k, (label, text) in enumerate(NOTICES):
        words = text.split()
        rows.append((2 * k, f"some words before. {text} and some behind it", label, None, None))
        if len(words) < 20:
            continue
        edited = list(words)
        for i in sorted(rng.sample(range(len(words)), len(words) // 12), reverse=True):
            edited[i : i + 1] = rng.choice([["zzz"], [], [edited[i], "qqq"]])
        rows.append((2 * k + 1, "one two " + " ".join(edited) + " three", label, None, None))
    found = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, COLUMNS)).collect()}
    for i, _, label, *_ in rows:
        assert label in found[i].labels.split(","), (label, found[i])
        assert set(found[i].labels.split(",")) <= {label, "cc-by-nc" if label.startswith("cc-by-nc") else label}
        assert found[i].score >= (0.8 if i % 2 else 1 - 1e-9)


def test_scores_are_those_of_plain_alignments():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(3, 90))] for _ in range(2))
        grid = [[0] * (len(b) + 1)]
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(grid[-1][j] + 1 if x == y else max(row[-1], grid[-1][j + 1]))
            grid.append(row)
        own = license_scan.Template("x", " ".join(a), False)
        assert own.common([w.encode() for w in b]) == grid[-1][-1]


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    text = (LONG + " é日本 " + LONG).lower().encode()
    whole = license_scan.grams(text)
    monkeypatch.setattr(license_scan, "PIECE", 300)
    assert (license_scan.grams(text) == whole).all() and len(whole) > 10_000
