"""Text scores of a log-bilinear language model trained with noise-contrastive estimation.

Tokens are runs of bytes without ASCII white space, A-Z lower-cased, and one end per document. A token's
class is itself for the ``SHORTLIST`` most frequent ones and the end; every other token belongs to one of
``TAILS`` classes by its looks: its last character, whether it is all ASCII, its length. The probability of
a token is that of its class after the two classes before it, times that of the token within its class.

*Class given context.* A log-bilinear model: the two context vectors, each scaled by its place's weights,
add up to a prediction; its product with a class's vector, plus the class's bias, is that class's log
weight. Training looks at all training tokens: each task runs minibatches of noise-contrastive estimation
in numpy over its documents, and the parameters of all tasks are averaged, weighted by their tokens, row
by row in a shuffle; the driver gets one row per class. Since the log weight is a sum of one term for each
context place, the normaliser of every pair of context classes comes from a single product of two matrices
of exponentials, so log-probabilities are exactly normalised and a token costs three look-ups.

*Token within class.* Absolute discounting of counts over all training documents, the discount from the
class's tokens seen once and twice; what it frees is the probability of the one unknown token of the class.

Counts come from all training documents. The ``HOT`` most frequent tokens, a bounded table, are broadcast,
so frequent tokens never meet in one task; the remaining tokens of each document are joined with their
counts by a shuffle on the token and summed up by document.

Defined cases: a null or empty text consists of its end alone; rows that repeat are scored, and learnt from,
each by itself; a null doc_id is held out; ties in frequency go to the smaller token; with no training text
every class is as likely as any other; very long texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm.common import arrow_pass, keep, text_pass, utf8
from tallyshelf.llm.ngram_join import word_hashes, word_spans

SHORTLIST, HOT, RANK, EPOCHS = 900, 1 << 18, 16, 2
BATCH, NOISE, RATE = 2048, 48, 0.08
TAILS = 30
#: Tokens counted before a task hands its counts on.
HELD = 400_000
END = b"\n"
#: What a token's last byte says of its looks.
KINDS = np.select([np.arange(256) == 46, np.arange(256) == 44, np.arange(256) > 127, (np.arange(256) > 96) & (np.arange(256) < 123)], [1, 2, 4, 0], 3)
KIND_OF = KINDS.tolist()


def looks(token: bytes) -> int:
    """The tail class of a token."""
    length = len(token)
    return (KIND_OF[token[-1]] * 2 + (not token.isascii())) * 3 + (0 if length < 6 else 1 if length < 11 else 2)


def tokens_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: both touch ASCII only


def held_out(folds: int = 10):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(True))


def token_counts(docs: DataFrame) -> DataFrame:
    """token, tail class and count of every token of docs, ends included."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            words = list(found)
            cols = [pa.array(words, pa.binary()), pa.array([looks(w) for w in words], pa.int32()), pa.array(list(found.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["token", "tail", "n"])

        for b in batches:
            for i in range(0, b.num_rows, 500):
                texts = utf8(b.column(1).slice(i, 500))
                for t in texts:
                    found.update(tokens_of(t))
                found[END] += len(texts)
                if len(found) > HELD:
                    yield rows()
                    found.clear()
        yield rows()

    raw = text_pass(docs, "token binary, tail int, n long", work, "doc_id", "text")
    return keep(raw.groupBy("token").agg(F.first("tail").alias("tail"), F.sum("n").alias("n")), "token-counts")


@dataclass
class Vocabulary:
    """Frequent tokens with their counts, and the sums that cover all tokens."""

    hot: list[tuple[bytes, int, int]]  # token, tail class, count
    least: int  # tokens in the bucket of this count, or above it, are hot
    total: int
    distinct: int
    shortlist: dict[bytes, int]
    tail: np.ndarray  # for each tail class, without the shortlist: tokens, distinct tokens, seen once, seen twice

    @property
    def classes(self) -> int:
        return 1 + SHORTLIST + TAILS

    def prior(self) -> np.ndarray:
        """Smoothed share of each class in the training tokens."""
        n = np.full(self.classes, 0.5)
        for token, _, count in self.hot:
            if token in self.shortlist:
                n[self.shortlist[token]] += count
        n[1 + SHORTLIST :] += self.tail[:, 0]
        return n / n.sum()

    def discounts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each tail class: its size, the discount of a known token, and the unknown token's share."""
        size, distinct, once, twice = self.tail.T.astype(float)
        off = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9)
        return size, off, np.where(size > 0, off * distinct / np.maximum(size, 1), 1.0)


BUCKET = "cast(floor(16 * log2(n)) as int)"


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the counts: a histogram, a row per tail class, and at most HOT tokens reach the driver."""
    sizes = counts.groupBy(F.expr(BUCKET).alias("bucket")).agg(F.count(F.lit(1)).alias("tokens")).collect()
    least, room = 1 << 30, HOT
    for r in sorted(sizes, key=lambda r: -r.bucket):
        if (room := room - r.tokens) < 0:
            break
        least = r.bucket
    hot = [(bytes(r.token), r.tail, r.n) for r in counts.where(F.expr(BUCKET) >= least).collect()]
    hot.sort(key=lambda x: (-x[2], x[0]))
    words = [x for x in hot if x[0] != END][:SHORTLIST]
    per = counts.groupBy("tail").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("v"),
        F.sum((F.col("n") == 1).cast("long")).alias("n1"),
        F.sum((F.col("n") == 2).cast("long")).alias("n2"),
    )
    tail = np.zeros((TAILS, 4), np.int64)
    for r in per.collect():
        tail[r.tail] = r.n, r.v, r.n1, r.n2
    total, distinct = int(tail[:, 0].sum()), int(tail[:, 1].sum())
    ends = [(END, looks(END), n) for t, _, n in hot if t == END] or [
        (END, looks(END), r.n) for r in counts.where(F.col("token") == F.lit(bytearray(END))).collect()
    ]
    for _, c, n in words + ends:
        tail[c] -= n, 1, n == 1, n == 2
    if not any(t == END for t, _, _ in hot):
        hot += ends
    shortlist = {END: 0} | {w: 1 + i for i, (w, _, _) in enumerate(words)}
    return Vocabulary(hot, least, total, distinct, shortlist, tail)


class ClassOf:
    """Classes of words, of many at once: the shortlist by 64-bit hashes, the others by their looks."""

    def __init__(self, shortlist: dict[bytes, int]):
        words = [w for w in shortlist if w != END]
        _, hashes = word_hashes(b"\n".join(words))
        order = np.argsort(hashes)
        self.hashes, self.classes = hashes[order], np.array([shortlist[w] for w in words], np.int64)[order]

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of a text begin, and their classes; its A-Z must be lower-cased."""
        held = np.frombuffer(text, np.uint8)
        starts, ends = word_spans(held)
        _, hashes = word_hashes(text, (starts, ends))
        wide = np.concatenate([[0], np.cumsum(held > 127, dtype=np.int32)])
        odd = wide.take(ends) != wide.take(starts)
        length = ends - starts
        found = 1 + SHORTLIST + (KINDS[held[ends - 1]] * 2 + odd) * 3 + (length > 5) + (length > 10)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            found = np.where(self.hashes.take(at) == hashes, self.classes.take(at), found)
        return starts, found


@dataclass
class Model:
    """Context vectors, place weights, class vectors and biases; ``rows`` and ``of`` turn it into rows and back."""

    context: np.ndarray
    places: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fresh(prior: np.ndarray) -> Model:
        r = np.random.default_rng(7)
        k = len(prior)
        small = lambda: (r.standard_normal((k, RANK)) * 0.1).astype(np.float32)
        return Model(small(), np.array([[0.6], [1.0]], np.float32).repeat(RANK, 1), small(), np.log(prior).astype(np.float32))

    def rows(self) -> np.ndarray:
        """A row per class, and one more with the place weights."""
        places = np.concatenate([self.places.ravel(), [0]]).astype(np.float32)
        return np.concatenate([np.concatenate([self.context, self.target, self.bias[:, None]], 1), places[None]])

    @staticmethod
    def of(rows: np.ndarray) -> Model:
        rows = rows.astype(np.float32)
        own, places = rows[:-1], rows[-1, :-1].reshape(2, RANK)
        return Model(own[:, :RANK].copy(), places.copy(), own[:, RANK : 2 * RANK].copy(), own[:, -1].copy())

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural log weights by (older, next) and (newer, next) class, and log normalisers by (older, newer)."""
        older = (self.context * self.places[0]) @ self.target.T
        newer = (self.context * self.places[1]) @ self.target.T + self.bias
        top_older, top_newer = older.max(axis=1, keepdims=True), newer.max(axis=1, keepdims=True)
        z = np.exp(older - top_older).astype(np.float64) @ np.exp(newer - top_newer).astype(np.float64).T
        return older, newer, np.log(z) + top_older + top_newer.T


def row_sums(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """A table of so many rows to which each of the values is added at its place."""
    width = values.shape[1]
    cells = (at[:, None] * width + np.arange(width)).ravel()
    return np.bincount(cells, values.ravel(), rows * width).astype(np.float32).reshape(rows, width)


class Trainer:
    """Minibatches of noise-contrastive estimation with per-parameter step sizes."""

    def __init__(self, model: Model, prior: np.ndarray, seed: int):
        self.m, self.random, self.seen = model, np.random.default_rng(seed), 0
        self.log_noise = np.log(NOISE * prior).astype(np.float32)
        self.cumulative = np.cumsum(prior)
        self.sums = [np.full_like(x, 1e-3) for x in (model.context, model.places, model.target, model.bias)]

    def step(self, older: np.ndarray, newer: np.ndarray, word: np.ndarray) -> None:
        m = self.m
        noise = np.minimum(np.searchsorted(self.cumulative, self.random.random(NOISE)), len(m.bias) - 1)
        at = (m.context * m.places[0]).take(older, axis=0)
        at += (m.context * m.places[1]).take(newer, axis=0)
        target, other = m.target.take(word, axis=0), m.target.take(noise, axis=0)
        true = np.einsum("ij,ij->i", at, target) + (m.bias - self.log_noise).take(word)
        push = at @ other.T
        push += m.bias[noise] - self.log_noise[noise]
        pull = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        np.clip(push, -30, 30, out=push)  # from here on in place: the noise is the bulk of a step
        np.negative(push, out=push)
        np.exp(push, out=push)
        push += 1
        np.divide(-1, push, out=push)
        move = push @ other
        move += pull[:, None] * target
        k = len(m.bias)
        by_place = np.stack([row_sums(older, move, k), row_sums(newer, move, k)])
        d_target, d_bias = row_sums(word, pull[:, None] * at, k), np.bincount(word, pull, k).astype(np.float32)
        d_target += row_sums(noise, push.T @ at, k)
        np.add.at(d_bias, noise, np.ones(len(push), np.float32) @ push)
        grads = (
            by_place[0] * m.places[0] + by_place[1] * m.places[1],
            (by_place * m.context).sum(axis=1),
            d_target,
            d_bias,
        )
        for x, s, g in zip((m.context, m.places, m.target, m.bias), self.sums, grads, strict=True):
            g /= len(word)
            s += g * g
            x += RATE * g / np.sqrt(s)
        self.seen += len(word)


def class_stream(texts: list[bytes], classes: ClassOf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Older, newer and next class at every token of the texts; before a text there are ends."""
    starts, found = classes.of(b"\n".join(texts).lower())
    sizes = np.diff(np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts]]))) + 1
    word = np.zeros(len(found) + len(texts), np.int64)
    word[np.arange(len(found)) + np.repeat(np.arange(len(texts)), sizes - 1)] = found
    newer, older = np.concatenate([[0], word[:-1]]), np.concatenate([[0, 0], word[:-2]])
    older[np.cumsum(sizes)[:-1]] = 0  # the first token's older place; its newer one is the end of the text before
    return older[: len(word)], newer[: len(word)], word


def trained(docs: DataFrame, vocab: Vocabulary) -> Model:
    """The model after EPOCHS passes over docs, each averaged over its tasks."""
    prior = vocab.prior()
    model = Model.fresh(prior)
    context = docs.sparkSession.sparkContext
    for _ in range(EPOCHS):
        sent = context.broadcast((model, prior, vocab.shortlist))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            start, prior, shortlist = sent.value
            own = Trainer(Model.of(start.rows()), prior, TaskContext.get().partitionId())
            classes = ClassOf(shortlist)
            for b in batches:
                for i in range(0, b.num_rows, 500):
                    older, newer, word = class_stream(utf8(b.column(1).slice(i, 500)), classes)
                    for k in range(0, len(word), BATCH):
                        own.step(older[k : k + BATCH], newer[k : k + BATCH], word[k : k + BATCH])
            rows = own.m.rows().astype(np.float64) * own.seen
            if own.seen:
                cols = [pa.array(np.arange(len(rows))), pa.array([own.seen] * len(rows)), pa.array([x.tobytes() for x in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "seen", "sums"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for b in batches:
                for row, seen, sums in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                    x = total.setdefault(row, [0, 0.0])
                    x[0], x[1] = x[0] + seen, x[1] + np.frombuffer(sums)
            cols = [pa.array(list(total)), pa.array([x[0] for x in total.values()]), pa.array([x[1].tobytes() for x in total.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["row", "seen", "sums"])

        kinds = "row long, seen long, sums binary"
        by_row = text_pass(docs, kinds, work, "doc_id", "text").repartition("row")  # one row of each task meets per class
        found = arrow_pass(by_row, kinds, added).collect()
        if found:
            rows = np.zeros(model.rows().shape)
            for r in found:
                rows[r.row] = np.frombuffer(r.sums) / r.seen
            model = Model.of(rows)
    return model


class Scorer:
    """Log10 probabilities of texts; tokens that are not hot are left to be looked up."""

    def __init__(self, model: Model, vocab: Vocabulary):
        self.older, self.newer, self.norm = model.tables()
        size, off, unknown = vocab.discounts()
        n, first_tail = len(vocab.hot), 1 + SHORTLIST
        self.hot, self.index, self.n_hot = {t: i for i, (t, _, _) in enumerate(vocab.hot)}, {}, n
        tails = np.array([c for _, c, _ in vocab.hot], np.int64)
        counts = np.array([c for _, _, c in vocab.hot], float)
        self.cls = np.concatenate([[vocab.shortlist.get(t, first_tail + c) for t, c, _ in vocab.hot], first_tail + np.arange(TAILS)]).astype(np.int64)
        within = np.where(self.cls[:n] < first_tail, 1.0, (counts - off[tails]) / np.maximum(size[tails], 1)) if n else np.zeros(0)
        base = (counts + 0.1) / (vocab.total + 0.1 * (vocab.distinct + 1))
        self.within = np.concatenate([np.log10(np.maximum(within, 1e-300)), np.zeros(TAILS)])
        self.base = np.concatenate([np.log10(base), np.zeros(TAILS)])
        self.end = self.hot.get(END)

    def scores(self, texts: list[bytes]) -> list[tuple[int, int, float, float, Counter]]:
        """Of each text: tokens, hot tokens, base and model score of what is hot, and the other tokens; class scores cover all."""
        found: list[int | None] = []
        sizes, others = [], []
        for text in texts:
            words = tokens_of(text)
            at = list(map(self.hot.get, words))
            rest: Counter[bytes] = Counter()
            if None in at:
                rest.update([w for w, x in zip(words, at, strict=True) if x is None])
                tails = {w: self.n_hot + looks(w) for w in rest}
                at = [tails[w] if x is None else x for w, x in zip(words, at, strict=True)]
            at.append(self.end if self.end is not None else self.n_hot)
            found += at
            sizes.append(len(at))
            others.append(rest)
        at, ends = np.array(found, np.int64), np.cumsum(sizes)
        cls = self.cls.take(at)
        cls[ends - 1] = 0
        newer, older = np.concatenate([[0], cls[:-1]]), np.concatenate([[0, 0], cls[:-2]])[: len(cls)]
        older[ends[:-1]] = 0
        before, n = older * len(self.older), len(self.older)
        log_p = self.older.ravel().take(before + cls) + self.newer.ravel().take(newer * n + cls) - self.norm.ravel().take(before + newer)
        per_text = lambda x: np.add.reduceat(x, ends - sizes)
        known = per_text((at < self.n_hot).astype(np.int64))
        score = per_text(log_p.astype(np.float64)) / math.log(10) + per_text(self.within.take(at))
        return list(zip(sizes, known.tolist(), per_text(self.base.take(at)).tolist(), score.tolist(), others, strict=True))

    def score(self, text: bytes) -> tuple[int, int, float, float, Counter]:
        return self.scores([text])[0]


ROWS = "row long, doc_id long, held_out boolean, token binary, tail int, times long, n_tokens long, n_known long, base double, score double"


def partial_scores(docs: DataFrame, model: Model, vocab: Vocabulary) -> DataFrame:
    """A row for each document with what its hot tokens give, and one for each other token it has."""
    sent = docs.sparkSession.sparkContext.broadcast((model, vocab))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = Scorer(*sent.value), TaskContext.get().partitionId() << 36
        names = [c.split()[0] for c in ROWS.split(", ")]
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                sizes, known, base, score, others = zip(*own.scores(utf8(part.column(2))), strict=True)
                n = len(sizes)
                ids = row + 1 + np.arange(n)
                row += n
                tokens = list(chain.from_iterable(others))
                k = len(tokens)
                # a document's own row has a token that no text has, so that it meets no other in the join
                columns = [
                    pa.array(np.concatenate([ids, np.repeat(ids, [len(x) for x in others])])),
                    pa.concat_arrays([part.column(0), pa.nulls(k, pa.int64())]),
                    pa.concat_arrays([part.column(1), pa.nulls(k, pa.bool_())]),
                    pa.array([b" %d" % x for x in ids.tolist()] + tokens, pa.binary()),
                    pa.array([0] * n + list(map(looks, tokens)), pa.int32()),
                    pa.array([0] * n + list(chain.from_iterable(x.values() for x in others)), pa.int64()),
                    *[pa.array(np.concatenate([x, np.zeros(k, np.int64)])) for x in (sizes, known)],
                    *[pa.array(np.concatenate([x, np.zeros(k)])) for x in (base, score)],
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    marked = docs.select("doc_id", held_out().alias("held_out"), "text")
    return text_pass(marked, ROWS, work, "doc_id", "held_out", "text")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    training = docs.where(~held_out())
    counts = token_counts(training)
    vocab = vocabulary(counts)
    model = trained(training, vocab)
    size, off, unknown = vocab.discounts()
    per_tail = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("tail") + 1)
    rare = counts.where(F.expr(BUCKET) < vocab.least).where(F.col("token") != F.lit(bytearray(END))).select("token", "n")
    n = F.coalesce("n", F.lit(0))
    base = F.log10((n + 0.1) / F.lit(vocab.total + 0.1 * (vocab.distinct + 1)))
    within = F.log10(F.when(n > 0, (n - per_tail(off)) / per_tail(np.maximum(size, 1))).otherwise(per_tail(unknown)))
    some = F.col("times") > 0
    rows = partial_scores(docs, model, vocab).join(rare, "token", "left")
    parts = rows.select(
        "row",
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.when(n > 0, F.col("times")).otherwise(0)).alias("n_known"),
        (F.col("base") + F.when(some, F.col("times") * base).otherwise(0.0)).alias("base"),
        (F.col("score") + F.when(some, F.col("times") * within).otherwise(0.0)).alias("score"),
    )
    return (
        parts.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum("n_known").alias("n_known"),
            F.sum("base").alias("base_score"),
            F.sum("score").alias("score"),
        )
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score")
    )
