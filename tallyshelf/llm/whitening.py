"""Embedding whitening: a covariance in tiles, its eigenvectors, and every vector projected on the leading ones.

Each entry c becomes x = floor(1024 c) + 100000. A first pass adds up the entries per dimension. Then vectors are cut
into blocks of rows and each of those into blocks of columns; column blocks meet again by block of rows, every pair
of them is multiplied, and products are added up under the key of their tile, which is the pair. Only one array for
each tile reaches the driver, which puts the matrix together and takes its eigenvectors: what it holds grows with the
square of the dimensions and not with the rows. Entries are whole numbers less the floor of their mean until they are
multiplied, and then less the rest of the mean, so nothing cancels.

Defined cases: null vectors and vectors with entries that are null or not finite take no part and have no rows, and
neither have vectors of another length than most have (of equally frequent lengths: the greatest); entries are
clipped where sums of their squares would not fit a long (beyond some 92,000 in size at 64 dimensions); a deviation
that fits no long is null; repeated rows count and are returned each; null vec_ids are ids like others; components
whose eigenvalue is nothing but rounding have null whitened values and do not count in identity_error, which is null
if there is no other; a table without vectors gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm.common import arrow_pass, keep, ship
from tallyshelf.llm.vectors import dimension, floored, limit_of, matrix

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Dimensions of a tile, and entries of a block of rows.
TILE, BLOCK_ENTRIES = 16, 1 << 18
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their x."""
    good, x = matrix(column, d)
    return good, floored(x, SCALE, limit_of(d, 59)) + SHIFT


class Centre:
    """The number of vectors and the sums of each dimension, exact, and the means in a whole and a broken part."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.floor = np.array([s // n for s in sums], np.int64)
        self.over = [s % n for s in sums]
        self.rest = np.array([r / n for r in self.over])

    def deviations(self, off: np.ndarray) -> list[int | None]:
        """The sums of (n x - S)^2 over the dimensions, for x less the floor of its mean; exact."""
        over = np.array(self.over, np.int64)
        squares, mixed = (off * off).sum(axis=1).tolist(), (off @ over).tolist()
        last = sum(r * r for r in self.over)
        found = (self.n * self.n * s - 2 * self.n * m + last for s, m in zip(squares, mixed, strict=True))
        return [v if v < 1 << 63 else None for v in found]


def centre(vectors: DataFrame, d: int) -> Centre | None:
    """One pass; a task hands on a row for each of its batches, and d + 1 sums reach the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole(b.column(0), d)[1]
            yield pa.RecordBatch.from_arrays([pa.array([[len(x), *x.sum(axis=0).tolist()]], pa.list_(pa.int64()))], names=["sums"])

    rows = arrow_pass(vectors.select("embedding"), "sums array<long>", work).select(F.posexplode("sums").alias("at", "value"))
    found = dict(rows.groupBy("at").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value")).collect())
    n = int(found.get(0, 0))
    return Centre(n, [int(found[i + 1]) for i in range(d)]) if n else None


def column_blocks(vectors: DataFrame, d: int, mid: Centre) -> DataFrame:
    """row_block, column_block, n_rows and entries (x less the floor of its mean) of every block."""
    height = max(1, BLOCK_ENTRIES // d)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            off = whole(b.column(0), d)[1] - mid.floor
            found = []
            for i in range(0, len(off), height):
                part = off[i : i + height]
                found += [(number, j // TILE, len(part), part[:, j : j + TILE].tobytes()) for j in range(0, d, TILE)]
                number += 1
            columns = list(zip(*found, strict=True)) if found else [()] * 4
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row_block", "column_block", "n_rows", "entries"]
            )

    return arrow_pass(vectors.select("embedding"), "row_block long, column_block int, n_rows int, entries binary", work)


def tile_products(blocks: DataFrame, mid: Centre) -> DataFrame:
    """tile_row, tile_column and product: of each block of rows, every pair of its column blocks multiplied."""

    def multiply(block: pa.Table) -> pa.Table:
        parts = {}
        for j, n, entries in zip(*(block.column(c).to_pylist() for c in ("column_block", "n_rows", "entries")), strict=True):
            rest = mid.rest[j * TILE : (j + 1) * TILE]
            parts[j] = np.frombuffer(entries, np.int64).reshape(n, len(rest)) - rest
        pairs = [(i, j) for i in parts for j in parts if i <= j]
        products = [(parts[i].T @ parts[j]).ravel().tolist() for i, j in pairs]
        return pa.table({
            "tile_row": pa.array([i for i, _ in pairs], pa.int32()),
            "tile_column": pa.array([j for _, j in pairs], pa.int32()),
            "product": pa.array(products, pa.list_(pa.float64())),
        })

    return blocks.groupBy("row_block").applyInArrow(multiply, "tile_row int, tile_column int, product array<double>")


def covariance(vectors: DataFrame, d: int, mid: Centre) -> np.ndarray:
    """The covariance of x with divisor n: tiles are added up entry by entry and assembled."""
    cells = tile_products(column_blocks(vectors, d, mid), mid).select("tile_row", "tile_column", F.posexplode("product").alias("at", "value"))
    sums = cells.groupBy("tile_row", "tile_column", "at").agg(F.sum("value").alias("value"))
    tiles = sums.groupBy("tile_row", "tile_column").agg(F.array_sort(F.collect_list(F.struct("at", "value")))["value"].alias("values"))
    out = np.zeros((d, d))
    for r in tiles.toLocalIterator():
        i, j = r.tile_row * TILE, r.tile_column * TILE
        tile = np.array(r["values"]).reshape(min(TILE, d - i), -1) / mid.n
        out[i : i + tile.shape[0], j : j + tile.shape[1]] = tile
        out[j : j + tile.shape[1], i : i + tile.shape[0]] = tile.T
    return out


class Basis:
    """The leading eigenvectors as columns, divided by the roots of their eigenvalues, and their shares of the trace."""

    def __init__(self, cov: np.ndarray, most: int):
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
        self.held = values > len(cov) * np.finfo(float).eps * max(values[0], 0)
        self.columns = vectors / np.sqrt(np.where(self.held, values, 1))
        trace = float(np.trace(cov))
        self.explained = [float(v / trace) if h else 0.0 if trace > 0 else None for v, h in zip(values, self.held, strict=True)]


def projected(vectors: DataFrame, d: int, mid: Centre, basis: Basis) -> DataFrame:
    """vec_id, deviation and the whitened values of every vector."""
    missing = [i for i, h in enumerate(basis.held) if not h]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, x = whole(b.column(1), d)
            off = x - mid.floor
            found = ((off - mid.rest) @ basis.columns).tolist()
            for row in found:
                for i in missing:
                    row[i] = None
            cols = [b.column(0).filter(pa.array(good)), pa.array(mid.deviations(off), pa.int64()), pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "deviation", "whitened"])

    return arrow_pass(vectors, "vec_id long, deviation long, whitened array<double>", work)


def identity_error(rows: DataFrame, basis: Basis) -> float | None:
    """The largest entry in size of the whitened vectors' covariance less the identity, measured on the rows."""
    own = [i for i, h in enumerate(basis.held) if h]
    if not own:
        return None
    means = rows.agg(*[F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in own]).first()
    off = {i: F.col("whitened")[i] - F.lit(means[f"m{i}"]) for i in own}
    found = rows.agg(*[F.avg(off[i] * off[j]).alias(f"c{i}_{j}") for i in own for j in own if i <= j]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i in own for j in own if i <= j)


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component; see SCHEMA."""
    spark = embeddings.sparkSession
    ship(spark)
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("embedding IS NOT NULL")
    d = dimension(vectors)
    mid = centre(vectors, d) if d else None
    if mid is None:
        return spark.createDataFrame([], SCHEMA)
    basis = Basis(covariance(vectors, d, mid), min(components, d))
    rows = keep(projected(vectors, d, mid, basis), "whitened")
    error = identity_error(rows, basis)
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.array(*[F.lit(v).cast("double") for v in basis.explained])
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(mid.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
