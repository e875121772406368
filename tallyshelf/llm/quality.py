"""Quality scores by similarity-weighted votes of labelled latent-semantic neighbours.

A text becomes counts of terms: its words, lower-cased, in 2,048 hash bins; 1,024 pairs of adjacent byte classes
(letters, digits, spaces and the commoner marks have classes of their own); and 32 bins that say how far words
repeat, side by side and over the text. Log frequencies, weighted by how few labelled texts have a term and centred,
are projected on the leading singular vectors of the labelled sample: its latent-semantic space.

Fitting draws a bounded sample, ``SAMPLE`` labelled texts of those allowed to teach, half of the places for each
label, by smallest hash of doc_id; the bound is a parameter. Texts are turned into terms where they lie, so what the
driver gets is bounded in bytes too; the projection and the labelled vectors, which are broadcast, take about 2 MB.
Scoring is exact: every document's vector is multiplied with all labelled vectors, a
block of documents at a time, and its ``NEIGHBOURS`` most similar ones vote with their similarity, and so do those
that are as similar as the last of them. The score is the weighted share of label 1. Only text is an input.

Defined cases: a null or empty text has no terms and gets the share of label 1 in the sample; labels
that are null are no labels; several labels of one document count once each; rows of the sample that repeat a doc_id and
its text count once, different texts of one doc_id each count; without any label at all
every score is 0.5; repeated rows score alike; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.llm.common import arrow_pass, keep, text_pass, utf8

CLASSES, BINS, WORDS, RANK, SAMPLE, NEIGHBOURS, BLOCK, THRESHOLD = 32, 32, 2048, 40, 4096, 24, 256, 0.3
FORMS = CLASSES * CLASSES + BINS
TERMS = FORMS + WORDS
#: How much words weigh beside the forms.
WORD_SHARE = 0.5
#: Words whose bins are remembered, and the longest of them in bytes.
REMEMBERED, LONGEST = 150_000, 64


def byte_classes() -> np.ndarray:
    """Class of each byte: marks and spaces first, then letters, capitals, digits, brackets and the rest."""
    out = np.zeros(256, np.int64)
    for i, mark in enumerate(b" \n\t.,;:!?|*#$%&@/\\-_\"'()"):
        out[mark] = i + 1
    for name, group in ((25, b"abcdefghijklmnopqrstuvwxyz"), (26, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (27, b"0123456789"), (28, b"<>=+{}[]~^`")):
        out[list(group)] = name
    out[128:192], out[192:] = 29, 30
    return out


CLASS = byte_classes()


class WordBins(dict):
    """The hash bin of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word) % WORDS
        if len(word) <= LONGEST:
            if len(self) > REMEMBERED:
                self.clear()
            self[word] = found
        return found


_bins = WordBins()


def terms(text: bytes) -> np.ndarray:
    """Log frequencies of the terms of one text, zeros for a text without bytes."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    seen = CLASS[np.frombuffer(text, np.uint8)]
    pairs = np.bincount(seen[:-1] * CLASSES + seen[1:], minlength=CLASSES * CLASSES)
    out[: CLASSES * CLASSES] = np.log1p(pairs * (1000.0 / len(text)))
    words = text.lower().split()  # of bytes: both touch ASCII only
    if words:
        held = np.bincount(np.fromiter(map(_bins.__getitem__, words), np.int64, len(words)), minlength=WORDS)
        out[FORMS:] = WORD_SHARE * np.log1p(held * (100.0 / len(words)))
        beside = sum(map(eq, words, words[1:])) / len(words)
        kept = len(set(words)) / len(words)
        out[CLASSES * CLASSES + min(15, int(np.ceil(beside * 40)))] = 4.0
        out[CLASSES * CLASSES + 16 + min(15, int(kept * 16))] = 2.0
    return out


@dataclass
class Model:
    weights: np.ndarray
    centre: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        """Unit latent vectors; rows without terms are zero."""
        out = (counts * self.weights - self.centre) @ self.axes
        out[~counts.any(axis=1)] = 0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def votes(self, counts: np.ndarray) -> np.ndarray:
        """Scores of a block of documents from its products with all labelled vectors."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        near = self.embed(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        last = np.partition(near, len(self.labels) - k, axis=1)[:, [len(self.labels) - k]]
        weight = np.where(near >= last, np.maximum(near, 0) ** 2, 0)
        score = (weight @ self.labels + 1e-6 * self.prior) / (weight.sum(axis=1) + 1e-6)
        return np.where(counts.any(axis=1), np.clip(score, 0, 1), self.prior)  # sums of rounded weights may end just above 1


def axes_of(rows: np.ndarray) -> np.ndarray:
    """The leading right singular vectors of centred rows, by subspace iteration from a fixed start."""
    basis = np.random.default_rng(3).standard_normal((rows.shape[1], RANK + 24)).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ turn.T)[:, :RANK].astype(np.float32)


def fit(counts: np.ndarray, labels: list[int]) -> Model:
    """Weights, axes and labelled vectors from the terms of the sample's texts."""
    if not len(counts):
        none = np.zeros(TERMS, np.float32)
        return Model(none, none, np.zeros((TERMS, RANK), np.float32), np.zeros((0, RANK), np.float32), np.zeros(0), 0.5)
    weights = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.5)
    scaled = counts * weights
    centre = scaled.mean(axis=0)
    y = np.asarray(labels, np.float64)
    model = Model(weights, centre, axes_of(scaled - centre), None, y, float(y.mean()))
    model.vectors = model.embed(counts).astype(np.float32)
    return model


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Rows that never teach: crc32 of the id as text, mod folds, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[np.ndarray, list[int]]:
    """Terms and labels of at most size texts, half of the places for each label, in an order that only depends on ids and texts.

    Of each label, the ids with the smallest hashes among those that docs has are drawn, and of their rows one for each
    text, so ids and texts are bounded by size before they are looked at; texts become terms on the executors.
    """
    known = labels.where("quality in (0, 1)").where(~held_out()).select("doc_id", "quality").distinct()
    named = keep(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "teachable")
    order = (F.xxhash64("doc_id"), "doc_id")
    sample = None
    for label in (0, 1):
        ids = F.broadcast(named.where(F.col("quality") == label).orderBy(*order).limit(size // 2))  # size rows at most
        rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id")
        texts = rows.groupBy("doc_id", "quality", F.xxhash64("text").alias("text_hash")).agg(F.first("text").alias("text"))
        part = texts.orderBy(*order, "text_hash").limit(size // 2)
        sample = part if sample is None else sample.unionByName(part)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms(t).astype("<f2").tobytes() for t in utf8(b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.binary())], names=["doc_id", "quality", "text_hash", "terms"])

    found = text_pass(sample, "doc_id long, quality int, text_hash long, terms binary", work, "doc_id", "quality", "text_hash", "text").collect()
    found.sort(key=lambda r: (r.quality, r.doc_id, r.text_hash))
    counts = [np.frombuffer(r.terms, "<f2") for r in found]
    return np.array(counts, np.float32).reshape(-1, TERMS), [r.quality for r in found]


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def scores(batch: pa.RecordBatch, model: Model, at: int) -> np.ndarray:
    found = [np.zeros(0)]
    texts = utf8(batch.column(at))
    for i in range(0, len(texts), BLOCK):
        found.append(model.votes(np.stack([terms(t) for t in texts[i : i + BLOCK]])))
    return np.concatenate(found)


def score(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    spark: SparkSession = docs.sparkSession
    sent = spark.sparkContext.broadcast(fit(*labelled_sample(docs, labels, size)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores(b, sent.value, 2)
            cols = [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])

    marked = docs.select("doc_id", held_out().alias("held_out"), "text")
    return text_pass(marked, SCHEMA, work, "doc_id", "held_out", "text")


def accepted(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """The rows of docs that score THRESHOLD or more, with their columns as they are; nothing is shuffled."""
    spark: SparkSession = docs.sparkSession
    sent = spark.sparkContext.broadcast(fit(*labelled_sample(docs, labels, size)))
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).fill_null("")
            s = scores(b.set_column(at, b.schema.field(at), texts), sent.value, at)
            yield b.filter(pa.array(s >= THRESHOLD))
        _bins.clear()  # a worker lives on through stages that need no bins

    return arrow_pass(docs, docs.schema, work)
