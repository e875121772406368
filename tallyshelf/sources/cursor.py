"""A table read in chunks of so many rows by its key, each by a scan of its own key range."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.operators.catalog import numbered
from tallyshelf.sources.shared import written

#: Rows of a chunk.
SIZE = 400


def bounds(rows: DataFrame, key: str, size: int = SIZE) -> DataFrame:
    """SRC12: chunk (from 0) and first, the key of its first row, for chunks of size rows in order of a key that is unique and not null."""
    if rows.where(F.col(key).isNull()).limit(1).count():
        raise ValueError(f"{key} has nulls")
    firsts = numbered(rows.select(key), [key]).where(F.col("row_index") % size == 0)
    return firsts.select(F.floor(F.col("row_index") / size).alias("chunk"), F.col(key).alias("first"))


class Cursor:
    """SRC12: the chunks of a table; any of them, however far back, costs a look at its bounds and a scan with its range as filter.

    The table should lie sorted by the key (see ``laid_out``), so that the range leaves most files unread. New rows
    belong to the chunk whose range they fall into, which may then have more than size rows; a new cursor evens that out.
    """

    def __init__(self, rows: DataFrame, key: str, size: int = SIZE):
        self.rows, self.key = rows, key
        self.bounds = written(bounds(rows, key, size), "chunk-bounds")

    def __len__(self) -> int:
        return self.bounds.count()

    def chunk(self, number: int) -> DataFrame:
        """The rows of one chunk, in order; none beyond the last."""
        ends = {r.chunk: r["first"] for r in self.bounds.where(F.col("chunk").isin(number, number + 1)).collect()}
        if number not in ends:
            return self.rows.where("false")
        found = self.rows.where(F.col(self.key) >= F.lit(ends[number])) if number else self.rows
        found = found.where(F.col(self.key) < F.lit(ends[number + 1])) if number + 1 in ends else found
        return found.orderBy(self.key)

    def __iter__(self) -> Iterator[DataFrame]:
        return (self.chunk(i) for i in range(len(self)))


def laid_out(rows: DataFrame, key: str, path: str) -> DataFrame:
    """rows as a table sorted by key over its files."""
    rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
