"""License scans: diagonal voting of word k-grams.

Texts are runs of digits, letters a-z and characters beyond ASCII, A-Z lower-cased. Every run of ``K`` words becomes a
hash, and all hashes of all texts are joined by Spark with the places where the templates (phrases and whole notices)
have them. A hit at place p of a text and place t of a template votes for the diagonal p - t. Votes are added up by text, template and
diagonal; diagonals a few words apart (words were added or left out) are merged; what spans too few or too many words for the least
score goes, and the words of every other span are read again and aligned with the template. A span's score is twice
the length of their longest common subsequence by the words of both; from ``LEAST_SCORE`` on it counts. Of overlapping spans of
notices the best counts. Phrases count only where all their words stand in a row, and overlap whatever they like.

Hashes leave the Python pass as one array for each ``ROW_GRAMS`` words and are spread to rows inside the join's stage, so
nothing but hits is shuffled, and of hits one row for each diagonal. The templates' places are broadcast up to
``MOST_PLACES`` of them and else joined by a shuffle. Texts are fetched for texts with spans alone, by doc_id and hash.

Defined cases: null and empty texts have no words, no spans, no first and last word, empty labels and score 0; texts
shorter than ``K`` words have none either, as no phrase is; null doc_ids are ids like others; repeated rows give rows of
their own with the same values; words of more than ``PIECE`` bytes count but match nothing; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.llm.common import arrow_pass, keep, text_pass, utf8
from tallyshelf.llm.license_texts import NOTICES, PHRASES

K, LEAST_SCORE = 3, 0.8
#: Diagonals of a notice of so many words that are merged lie a word apart, SLIP words at most.
WORDS_A_SLIP, SLIP = 4, 8
PIECE, ROW_GRAMS = 1 << 20, 1 << 16
#: Places of templates, and texts with spans, that are broadcast at most.
MOST_PLACES, MOST_TEXTS = 100_000, 50_000
PRIME = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x100000001B3
IN_WORD = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans string"
)


class Powers:
    """Powers of BASE and of its inverse, modulo 2 to the power of 64, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = [np.full(n - 1, x % 2**64, np.uint64) for x in (BASE, pow(BASE, -1, 2**64))]
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(s, dtype=np.uint64)]) for s in steps)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start, and the bytes after which they end."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = IN_WORD[np.frombuffer(text, np.uint8)]
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word: a polynomial in its bytes, from running sums over pieces of the text."""
    starts, ends = bounds(text)
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        if high - low <= PIECE:
            up, down = POWERS.first(high - low)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum((np.frombuffer(text, np.uint8, high - low, low).astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
            out[i:j] = (sums[ends[i:j] - low] - sums[starts[i:j] - low]) * down[starts[i:j] - low]
        i = j
    return out


def grams(text: bytes) -> np.ndarray:
    """A hash of every run of K words of a lower-cased text."""
    words = word_hashes(text)
    h = np.full(max(len(words) - K + 1, 0), K, np.uint64)
    for i in range(K):
        h = (h ^ (h >> np.uint64(29))) * PRIME + words[i : len(words) - K + 1 + i]
    return h.view(np.int64)


class Template:
    def __init__(self, label: str, text: str, exact: bool):
        self.label, self.text, self.exact = label, text.lower().encode(), exact
        self.words = words_at(self.text, *bounds(self.text))
        self.slip = 0 if exact else min(SLIP, max(1, len(self.words) // WORDS_A_SLIP))
        #: The places of each word as bits, for alignments.
        self.places: dict[bytes, int] = {}
        for i, w in enumerate(self.words):
            self.places[w] = self.places.get(w, 0) | 1 << i

    def common(self, words: list[bytes]) -> int:
        """The length of the longest common subsequence with words; each step works on all places of the template at once."""
        whole = (1 << len(self.words)) - 1
        free = whole
        for w in words:
            hit = free & self.places.get(w, 0)
            free = ((free + hit) | (free - hit)) & whole
        return len(self.words) - free.bit_count()

    def score(self, words: list[bytes]) -> float:
        return 2 * self.common(words) / (len(self.words) + len(words))


def words_at(text: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [text[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def templates(phrases: dict[str, str], notices: list[tuple[str, str]]) -> list[Template]:
    """Phrases first; each template has at least K words."""
    out = [Template(label, p, True) for p, label in phrases.items()] + [Template(label, t, False) for label, t in notices]
    if short := [t.text for t in out if len(t.words) < K]:
        raise ValueError(f"templates of fewer than {K} words: {short}")
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with two hashes of both as key, so that a text is found again without row numbers."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, F.lit(7), "doc_id").alias("k2"))


def gram_rows(rows: DataFrame) -> DataFrame:
    """k1, k2, first (the place of the first one) and the hashes of the texts' k-grams."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, first, found, size = [], [], [], [], 0
            for i, j, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), strict=True):
                all_grams = grams(text.lower())
                for at in range(0, len(all_grams), ROW_GRAMS):
                    k1.append(i)
                    k2.append(j)
                    first.append(at)
                    found.append(all_grams[at : at + ROW_GRAMS])
                    size += len(found[-1])
                if size > 16 * ROW_GRAMS:
                    yield gram_batch(k1, k2, first, found)
                    k1, k2, first, found, size = [], [], [], [], 0
            yield gram_batch(k1, k2, first, found)

    return text_pass(rows, "k1 long, k2 long, first long, grams array<long>", work, "k1", "k2", "text")


def gram_batch(k1: list[int], k2: list[int], first: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (k1, k2, first)), lists], names=["k1", "k2", "first", "grams"])


def diagonals(rows: DataFrame, known: list[Template]) -> DataFrame:
    """k1, k2, template, diagonal, its votes and its first and last place: every k-gram joined with the templates' places."""
    places = [(int(h), n, t) for n, x in enumerate(known) for t, h in enumerate(grams(x.text).tolist())]
    of_templates = rows.sparkSession.createDataFrame(places, "gram long, template int, t long")
    if len(places) <= MOST_PLACES:
        of_templates = F.broadcast(of_templates)
    spread = gram_rows(rows).select("k1", "k2", "first", F.posexplode("grams").alias("i", "gram"))
    hits = spread.join(of_templates, "gram").withColumn("p", F.col("first") + F.col("i"))
    by = ("k1", "k2", "template", (F.col("p") - F.col("t")).alias("diagonal"))
    return hits.groupBy(*by).agg(F.count(F.lit(1)).alias("votes"), F.min("p").alias("low"), F.max("p").alias("high"))


def of_template(known: list[Template], value) -> Column:
    """A value of each template, by the number in the column template."""
    return F.get(F.array(*[F.lit(value(t)) for t in known]), F.col("template"))


def spans(found: DataFrame, known: list[Template]) -> DataFrame:
    """k1, k2 and spans (template, first word, word after the last, votes), of neighbouring diagonals, that may reach the least score."""
    along = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > of_template(known, lambda t: t.slip)
    runs = found.withColumn("run", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(along))
    merged = runs.groupBy("k1", "k2", "template", "run").agg(
        F.min("low").alias("start"), (F.max("high") + K).alias("end"), F.sum("votes").alias("votes")
    )
    size, own = F.col("end") - F.col("start"), of_template(known, lambda t: len(t.words))
    most = 2 * F.least(size, own) / (size + own)
    near = most >= F.when(of_template(known, lambda t: t.exact), 1.0).otherwise(LEAST_SCORE)
    return merged.where(near).groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("template", "start", "end", "votes"))).alias("spans"))


def judged(text: bytes, listed: list[dict], known: list[Template]) -> tuple:
    """n_base, first_word, last_word, base_labels, labels, score and spans of a lower-cased text with its candidates."""
    starts, ends = bounds(text)
    good = []
    for s in listed:
        t, at = known[s["template"]], slice(s["start"], s["end"])
        score = t.score(words_at(text, starts[at], ends[at]))
        if score >= (1 if t.exact else LEAST_SCORE):
            good.append((score, s["end"] - s["start"], s["votes"], s["start"], t))
    base = [(start, t.label) for _, _, _, start, t in good if t.exact]
    taken: list[tuple[int, int, str, float]] = []
    for score, size, _, start, t in sorted((g for g in good if not g[4].exact), key=lambda g: (-g[0], -g[1], -g[2], g[3], g[4].label)):
        if all(start + size <= a or b <= start for a, b, _, _ in taken):
            taken.append((start, start + size, t.label, score))
    places = [start for start, _ in base]
    labels = {label for _, label in base}
    return (
        len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x[2] for x in taken})),
        max([float(bool(base)), *(x[3] for x in taken)]), ",".join(f"{label}:{a}:{b}:{score:.3f}" for a, b, label, score in sorted(taken)),
    )


def verified(rows: DataFrame, candidates: DataFrame, known: list[Template]) -> DataFrame:
    """k1, k2 and what judged() says of each text with candidates; only their texts leave the scan."""
    if candidates.count() <= MOST_TEXTS:
        candidates = F.broadcast(candidates)
    sent = rows.sparkSession.sparkContext.broadcast(known)
    names = ["k1", "k2", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, listed = utf8(b.column(2)), b.column(3).to_pylist()
            found = [judged(t.lower(), s, sent.value) for t, s in zip(texts, listed, strict=True)]
            columns = [*b.columns[:2], *(list(c) for c in zip(*found, strict=True))] if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, list) else c for c, k in zip(columns, kinds, strict=True)], names=names)

    kinds_of = ", ".join(f"{n} {'double' if k == pa.float64() else 'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds, strict=True))
    joined = rows.join(candidates, ["k1", "k2"]).select("k1", "k2", "text", "spans")
    return arrow_pass(joined, kinds_of, work).dropDuplicates(["k1", "k2"])


def counted(rows: DataFrame) -> DataFrame:
    """doc_id, k1, k2 and n_words of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [len(bounds(t)[0]) for t in utf8(b.column(3))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sizes, pa.int64())], names=["doc_id", "k1", "k2", "n_words"])

    return text_pass(rows, "doc_id long, k1 long, k2 long, n_words long", work, "doc_id", "k1", "k2", "text")


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row for each document; see SCHEMA. spans has label:start:end:score of the notices' spans, in words."""
    rows, known = keyed(docs), templates(phrases, notices)
    candidates = keep(spans(diagonals(rows, known), known), "license-spans")
    held = keep(verified(rows, candidates, known), "licenses")
    blank = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0, "spans": ""}
    return counted(rows).join(held, ["k1", "k2"], "left").fillna(blank).select(*[c.split()[0] for c in SCHEMA.split(", ")])
