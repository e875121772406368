"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs without ASCII white space, A-Z lower-cased, without punctuation at their ends; runs that are all
punctuation are no words, in items and in texts, though first_word and end_word count them as places. Every
``N``-gram of a benchmark item is a seed, however many documents hold it. A document that holds a seed may
be aligned with the seed's item around the place where they meet, by local alignment of words. The score is
the alignment's score divided by that of the whole item aligned with itself, so insertions, deletions and
replaced words lower it gradually; from ``LEAST_SCORE`` on the document holds a copy, verbatim, edited or
paraphrased. Seeds that many documents hold cost little, as places are aligned only where the item's words
stand densely enough: no alignment scores more than the best run of words that counts ``MATCH`` for each word
of the item and the smaller penalty for any other, nor more than the item's words that the place holds at all.

A block of the benchmark, its words and n-grams, is broadcast; a block takes in items of up to
``BLOCK_NGRAMS`` n-grams, which bounds it, and a larger benchmark is worked through in several blocks, all of
them against all documents: a benchmark of many blocks reads all texts as many times. Of copies with a tenth, a fifth and
three tenths of their words replaced, left out or added, seeds find 0.99, 0.98 and 0.94 or more of those that aligning
whole texts would accept (items of 8 to 30 words; a test holds them to 0.9). Documents are read whole where they lie; nothing is shuffled.

Defined cases: null or empty texts hold nothing and null or empty items are held by nothing; an item with
fewer than N words has its whole word sequence as its seed; a copy that keeps no N successive words has none
and is not found; repeated items and repeated rows each give rows
of their own; a document that holds an item several times is reported with its best place, the first of
several; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm.common import arrow_pass, pieces, text_pass, utf8

N, LEAST_SCORE, BLOCK_NGRAMS = 3, 0.4, 500_000
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
MARKS = b".,;:!?\"'()[]{}<>|*#$%&-_/\\"
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Words whose numbers are remembered, and the longest of them in bytes.
REMEMBERED, LONGEST = 150_000, 64


class Words(dict):
    """The benchmark's number of a word as it stands in a text, 0 if it has none and -1 if it is all punctuation; remembered."""

    def __init__(self, numbers: dict[bytes, int]):
        self.numbers = numbers

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(MARKS)
        number = self.numbers.get(bare, 0) if bare else -1
        if len(word) <= LONGEST:
            if len(self) > REMEMBERED:
                self.clear()
            self[word] = number
        return number


def words_of(text: bytes) -> list[bytes]:
    return [w for w in (x.strip(MARKS) for x in text.lower().split()) if w]


def ngrams(numbers: np.ndarray, n: int) -> np.ndarray:
    h = np.full(max(len(numbers) - n + 1, 0), n, np.uint64)
    for i in range(n):
        h = (h ^ (h >> np.uint64(29))) * PRIME + numbers[i : len(numbers) - n + 1 + i].astype(np.uint64)
    return h


class Items:
    """A block of benchmark items with an index of their n-grams."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        split = [(i, words_of(t)) for i, t in rows]
        split = [(i, w) for i, w in split if w]
        self.ids = [i for i, _ in split]
        self.numbers = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for _, ws in split for w in ws))}
        self.words = [np.array([self.numbers[w] for w in ws], np.int64) for _, ws in split]
        self.lengths = sorted({min(N, len(w)) for w in self.words})
        codes = [ngrams(w, min(N, len(w))) for w in self.words]
        self.grams, gram = np.unique(np.concatenate([np.zeros(0, np.uint64), *codes]), return_inverse=True)
        order = np.argsort(gram, kind="stable")
        self.owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(c)) for c in codes]])[order]
        self.first = np.searchsorted(gram[order], np.arange(len(self.grams) + 1))
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.kinds = [np.unique(w, return_counts=True) for w in self.words]

    def found(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a document where n-grams of the block start, and which they are."""
        ats, grams = [], []
        for n in self.lengths:
            if len(numbers) < n or not len(self.grams):
                continue
            whole = numbers[: len(numbers) - n + 1] > 0
            for i in range(1, n):
                whole = whole & (numbers[i : len(numbers) - n + 1 + i] > 0)
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            code = ngrams(numbers, n)[at]
            g = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
            same = self.grams[g] == code
            ats.append(at[same])
            grams.append(g[same])
        return (np.concatenate(ats), np.concatenate(grams)) if ats else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def matches(self, numbers: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, score, first word, word after the last) for each item of the block that a document holds."""
        held = np.flatnonzero(numbers >= 0)
        numbers = numbers[held]
        at, gram = self.found(numbers)
        if not len(at):
            return []
        times = self.first[gram + 1] - self.first[gram]
        entry = np.repeat(self.first[gram] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        owner, diagonal = self.owner[entry], np.repeat(at, times) - self.place[entry]
        order = np.lexsort((diagonal, owner))
        owner, diagonal = owner[order], diagonal[order]
        size = self.sizes[owner]
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (np.diff(diagonal) > size[1:])]))
        best: dict[int, tuple[float, int, int]] = {}
        for s, e in zip(new, [*new[1:], len(owner)], strict=True):
            item = self.words[owner[s]]
            slack = 4 + len(item) // 3
            low = max(0, int(diagonal[s]) - slack)
            window = numbers[low : int(diagonal[e - 1]) + len(item) + slack]
            if bound(*self.kinds[owner[s]], window) < LEAST_SCORE * MATCH * len(item):
                continue
            score, end = align(item, window)
            if score >= LEAST_SCORE * MATCH * len(item) and score > best.get(owner[s], (0,))[0]:
                back = align(item[::-1], window[:end][::-1])[1]
                best[owner[s]] = score, low + end - back, low + end
        return [(self.ids[k], score / (MATCH * len(self.words[k])), int(held[a]), int(held[b - 1]) + 1) for k, (score, a, b) in sorted(best.items())]


def bound(kinds: np.ndarray, times: np.ndarray, window: np.ndarray) -> float:
    """What no alignment of a window with an item exceeds; kinds are the item's distinct words, and their times."""
    at = np.minimum(np.searchsorted(kinds, window), len(kinds) - 1)
    held = kinds[at] == window
    most = MATCH * np.minimum(np.bincount(at[held], minlength=len(kinds)), times).sum()
    run = np.concatenate([[0], np.cumsum(np.where(held, MATCH, max(MISMATCH, GAP)))])
    return float(min(most, (run - np.minimum.accumulate(run)).max()))


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int]:
    """Smith-Waterman: the best local score and the place in the window after which it ends.

    A row of the table takes a few operations on whole rows; gaps along the row are a running maximum.
    """
    step = -GAP * np.arange(len(window) + 1)
    above, best, end = np.zeros(len(window) + 1), 0.0, 0
    for word in item:
        row = np.maximum(above + GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(window == word, MATCH, MISMATCH))
        above = np.maximum.accumulate(row + step) - step
        at = int(above.argmax())
        if above[at] > best:
            best, end = float(above[at]), at
    return best, end


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark's items in blocks; each reaches the driver by itself."""
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.greatest(F.size(F.split("text", r"\s+")), F.lit(1))
    total = rows.agg(F.sum(size)).first()[0] or 0
    number = max(1, -(-2 * total // BLOCK_NGRAMS))  # hashing fills some blocks more than others
    for k in range(number):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k).orderBy("item_id", "text")
        yield Items([(r.item_id, r.text.encode()) for r in part.collect()])


def numbers_of(text: bytes, words: Words) -> np.ndarray:
    return np.array(list(map(words.__getitem__, text.lower().split())), np.int64)


MATCHES = "doc_id long, item_id long, score double, first_word long, end_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that it holds; see MATCHES."""
    found = []
    for items in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            words = Words(own.numbers)
            for b in pieces(batches):
                ids, texts = b.column(0).to_pylist(), utf8(b.column(1))
                rows = [(i, *m) for i, t in zip(ids, texts, strict=True) for m in own.matches(numbers_of(t, words))]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                cols = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in MATCHES.split(", ")])

        found.append(text_pass(docs, MATCHES, work, "doc_id", "text"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with their columns as they are."""
    at, out = docs.columns.index("text"), docs
    for items in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            words = Words(own.numbers)
            for b in pieces(batches):
                texts = utf8(b.column(at).fill_null(""))
                yield b.filter(pa.array([not own.matches(numbers_of(t, words)) for t in texts], pa.bool_()))

        out = arrow_pass(out, docs.schema, work)
    return out
