"""Hard-negative mining: exact inner products behind bounds from an orthogonal rotation.

Every row's x = floor(256 c) and every anchor's are turned by one orthogonal matrix, the eigenvectors of the anchors'
second moments, which puts most of a product into the leading components. A task goes through its rows in chunks:
a product's leading part, with the rest bounded by the product of the two residual norms and a slack for rounding,
tells which pairs cannot be among the best found so far; more components are added for those that are left, and what
is left then is multiplied in whole numbers. So results are exact whatever the rotation, which only decides how many pairs
go early. Each task hands on the best of each query, and those of all tasks meet by query.

Anchors are worked through in blocks of up to ``ANCHORS`` or so, which bounds what is broadcast; the rows stay where
they lie and are read twice a block (positives, then negatives), and a block's result is written before the next begins.
The work of a block is its anchors times all rows, so reading them again costs little beside it.

Defined cases: rows with a null label or vector or with entries that are null or not finite take no part, nor do
vectors of another length than most have (of equally frequent ones: the greatest); entries are clipped where scores
would not fit a long (beyond some 370,000 in size at 64 dimensions); rows with a null vec_id are never anchors and come
first among ties; of repeated rows each is a row, so an anchor's own copies are among its positives and a repeated
anchor has its rows as often; a positive without negatives has no rows; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.llm.common import arrow_pass, keep, scratch_folder
from tallyshelf.llm.vectors import dimension, floored, limit_of, matrix

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: Anchors of a block; components after which pairs are looked at; rows of a chunk, from the first to the largest; pairs multiplied at once.
ANCHORS, LEVELS, CHUNKS, PAIRS = 4096, (16, 32), (64, 1024), 1 << 15
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Stands for a null vec_id in arrays: smaller than any other.
NO_ID = -(1 << 63)


def participants(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and embedding; every seventh id has the next label."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), "embedding")
    return rows.where("label IS NOT NULL AND embedding IS NOT NULL")


class Turned:
    """Vectors under a rotation: leading components, norms of what is left behind each level, whole norms."""

    def __init__(self, x: np.ndarray, rotation: np.ndarray, levels: list[int]):
        self.z = x @ rotation
        self.rest = {m: np.sqrt((self.z[:, m:] ** 2).sum(axis=1)) for m in levels}
        self.norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))


class Block:
    """A block of anchors, turned, and the rotation."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, copies: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.copies, self.x = ids, labels, copies, x
        self.d = x.shape[1]
        self.rotation = np.linalg.eigh(x.T.astype(float) @ x / len(x))[1][:, ::-1].copy()
        self.levels = sorted({min(m, self.d) for m in LEVELS})
        self.turned = Turned(x, self.rotation, self.levels)
        #: Relative to both norms, far above what d roundings of a turn and a product amount to.
        self.slack = 64 * self.d * np.finfo(float).eps

    def survivors(self, x: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, score) of the allowed pairs whose score may be from low to high; low and high are per anchor."""
        own, rows = self.turned, Turned(x, self.rotation, self.levels)
        m = self.levels[0]
        part = rows.z[:, :m] @ own.z[:, :m].T
        room = np.outer(rows.rest[m], own.rest[m]) + self.slack * np.outer(rows.norm, own.norm)
        r, a = np.nonzero(allowed & (part + room >= low) & (part - room <= high))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(0, len(r), PAIRS):
            rr, aa = r[i : i + PAIRS], a[i : i + PAIRS]
            total, done = part[rr, aa], m
            for more in self.levels[1:]:
                total = total + np.einsum("ij,ij->i", rows.z[rr, done:more], own.z[aa, done:more])
                left = rows.rest[more][rr] * own.rest[more][aa] + self.slack * rows.norm[rr] * own.norm[aa]
                near = (total + left >= low[aa]) & (total - left <= high[aa])
                rr, aa, total, done = rr[near], aa[near], total[near], more
            found.append((rr, aa, np.einsum("ij,ij->i", x[rr], self.x[aa])))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *c]) for c in zip(*found, strict=True)) if found else (none, none, none)


class Best:
    """The k best (score, id) of each query: higher scores first, ties by smaller id. Rows wait until there are enough to sort."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.least = np.full(queries, -np.inf)
        self.held = [np.zeros(0, np.int64)] * 3
        self.waiting: list[list[np.ndarray]] = []

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append([query, score, ids])
        if sum(len(w[0]) for w in self.waiting) >= max(PAIRS, len(self.held[0]) // 4):
            self.settle()

    def settle(self) -> None:
        query, score, ids = (np.concatenate([h, *[w[i] for w in self.waiting]]) for i, h in enumerate(self.held))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        last = place == self.k - 1
        self.least[query[last]] = score[last]
        self.held = [c[place < self.k] for c in (query, score, ids)]
        self.waiting = []


def chunks(b: pa.RecordBatch, d: int, limit: int, sizes: Iterator[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, x) of the rows of a batch that take part, chunk by chunk."""
    good, vectors = matrix(b.column(2), d)
    ids = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)[good]
    labels, x = b.column(1).to_numpy(zero_copy_only=False)[good], floored(vectors, SCALE, limit)
    at = 0
    while at < len(x):
        to = at + next(sizes)
        yield ids[at:to], labels[at:to], x[at:to]
        at = to


def growing() -> Iterator[int]:
    """Sizes of chunks: small at first, until there is something to measure pairs by."""
    size, most = CHUNKS
    while True:
        yield size
        size = min(2 * size, most)


def mined(rows: DataFrame, block: Block, limit: int, queries: int, k: int, search) -> DataFrame:
    """query, vec_id and score: the k best of each query over all rows; search(block, best, ids, labels, x) adds those of a chunk."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best, sizes = sent.value, Best(queries, k), growing()
        for b in batches:
            for part in chunks(b, own.d, limit, sizes):
                search(own, best, *part)
        best.settle()
        query, score, ids = best.held
        cols = [pa.array(query, pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(score, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["query", "vec_id", "score"])

    found = arrow_pass(rows, "query long, vec_id long, score long", work)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("vec_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def search_positives(block: Block, best: Best, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
    high = np.full(len(block.ids), np.inf)
    r, a, score = block.survivors(x, labels[:, None] == block.labels[None, :], best.least, high)
    near = score >= best.least[a]
    best.add(a[near], score[near], ids[r[near]])


def positives(rows: DataFrame, block: Block, limit: int) -> list[list[tuple[int | None, int]]]:
    """(vec_id, score) of each anchor's positives: one more than wanted are searched for, as the anchor itself may be among them."""
    found: list[list[tuple[int | None, int]]] = [[] for _ in block.ids]
    for r in mined(rows, block, limit, len(block.ids), POSITIVES + 1, search_positives).orderBy("query", "rank").collect():
        found[r["query"]].append((r.vec_id, r.score))
    own = (block.x * block.x).sum(axis=1).tolist()
    for anchor, score, listed in zip(block.ids.tolist(), own, found, strict=True):
        if (anchor, score) in listed:
            listed.remove((anchor, score))
    return [listed[:POSITIVES] for listed in found]


def negatives(rows: DataFrame, block: Block, limit: int, near: list[list[tuple[int | None, int]]]) -> DataFrame:
    """query (anchor times POSITIVES plus the positive's place), vec_id, score and rank of all hard negatives."""
    low, high = np.full((len(near), POSITIVES), np.inf), np.full((len(near), POSITIVES), -np.inf)
    for i, listed in enumerate(near):
        for j, (_, score) in enumerate(listed):
            low[i, j], high[i, j] = -(-3 * score // 10), 9 * score // 10

    def search(own: Block, best: Best, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        least = np.maximum(low, best.least.reshape(low.shape))
        r, a, score = own.survivors(x, labels[:, None] != own.labels[None, :], least.min(axis=1), high.max(axis=1))
        for j in range(POSITIVES):
            fits = (score >= least[a, j]) & (score <= high[a, j])
            best.add(a[fits] * POSITIVES + j, score[fits], ids[r[fits]])

    return mined(rows, block, limit, low.size, NEGATIVES, search)


def blocks(rows: DataFrame, d: int, limit: int) -> Iterator[Block]:
    """The distinct anchors with their numbers of copies, in blocks of bounded size."""
    listed = rows.where(F.col("vec_id") % 100 == 0).groupBy("vec_id", "label", "embedding").agg(F.count(F.lit(1)).alias("copies"))
    listed = keep(listed, "anchors")
    number = -(-listed.count() // ANCHORS)
    for k in range(number):
        part = listed.where(F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(number)) == k).orderBy("vec_id", "label")
        found = part.toArrow().combine_chunks()
        if not len(found):
            continue
        columns = [c.combine_chunks() for c in found.columns]
        good, vectors = matrix(columns[2], d)
        if good.any():
            ids, labels, copies = (columns[i].to_numpy(zero_copy_only=False)[good] for i in (0, 1, 3))
            yield Block(ids, labels, copies, floored(vectors, SCALE, limit))


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """For each anchor and positive the first hard negatives; see SCHEMA."""
    spark, rows = embeddings.sparkSession, participants(embeddings)
    d = dimension(rows)
    limit = limit_of(d, 59)
    path = f"{scratch_folder(spark)}/hard-negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    for block in blocks(rows, d, limit) if d else ():
        near = positives(rows, block, limit)
        pairs = [
            (i * POSITIVES + j, anchor, *positive, copies)
            for i, (anchor, copies, listed) in enumerate(zip(block.ids.tolist(), block.copies.tolist(), near, strict=True))
            for j, positive in enumerate(listed)
        ]
        if not pairs:
            continue
        named = spark.createDataFrame(pairs, "query long, anchor_id long, positive_id long, positive_score long, copies long")
        found = negatives(rows, block, limit, near).join(F.broadcast(named), "query")  # POSITIVES rows for each anchor of the block
        each = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        each.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)
