"""What the corpus operators share: reading, shared scratch tables and passes over texts."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.sources.tables import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def scratch_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share, below the session's checkpoint folder.

    Where a session on one machine names none, a temporary folder takes its place; elsewhere that is an error, as
    every executor would write to its own disk and reads would miss what the others wrote.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "tallyshelf-scratch")
    return f"{base.rstrip('/')}/tallyshelf/{spark.sparkContext.applicationId}"


def keep(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: its lineage ends there.

    The session's compression of tables holds unless another is named.

    The files outlive any executor, and each later use reads only the columns it needs. What the write has shuffled
    is removed when it ends: left to the driver's garbage collection, files of many steps pile up.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)
    out = spark.read.schema(df.schema).parquet(path)
    _kept[out] = path
    keeps(path)
    return out


def keeps(path: str) -> None:
    """Names a table that goes with the innermost block of passing, if there is one."""
    for own in _passing[-1:]:
        own.append(path)


#: The setting by which a query's shuffle files go when it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The tables of keep's that will be removed, by block of passing.
_passing: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the tables that keep writes inside the block at its end, but for those that are taken from the list."""
    own: list[str] = []
    _passing.append(own)
    try:
        yield own
    finally:
        _passing.remove(own)
        for path in own:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


#: Where the tables lie that keep has written, as long as somebody holds them.
_kept: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def forget(df: DataFrame) -> None:
    """Removes a table of keep's that nothing will read any more: results that still do become unusable."""
    _remove(df.sparkSession, _kept.pop(df))


def clear_scratch(spark: SparkSession) -> None:
    """Removes the scratch tables of this application; results that still read them become unusable."""
    _remove(spark, scratch_folder(spark))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application; they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="tallyshelf-"), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def give_back() -> None:
    """Memory that a pass has freed goes back to the system: workers live on, and others on the machine need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps its own counsel
        pass


#: What modules hold in a Python worker from pass to pass.
_held: dict[str, dict] = {}


def held(module: str) -> dict:
    """A module's own memory in a Python worker; the next pass of another module in that worker empties it."""
    return _held.setdefault(module, {})


def make_room(module: str) -> None:
    """Empties what other modules hold in this process: workers go from stage to stage, and stages need their memory."""
    others = [x for name, x in _held.items() if name != module and x]
    for x in others:
        x.clear()
    if others:
        give_back()


def arrow_pass(df: DataFrame, schema, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Runs work over the Arrow batches of df."""
    ship(df.sparkSession)
    module = work.__module__

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(module)
        yield from work(batches)
        give_back()

    return df.mapInArrow(whole, schema)


def text_pass(
    df: DataFrame, schema: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *columns: str
) -> DataFrame:
    """Runs work over Arrow batches of the named columns; the null text is the empty one."""
    cols = [F.coalesce(F.col("text"), F.lit("")).alias("text") if c == "text" else F.col(c) for c in columns]
    return arrow_pass(df.select(*cols), schema, work)


#: Rows that are turned into Python's objects at once.
ROWS = 500


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ROWS at most: what is made of one is freed before the next."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


#: A-Z to a-z and nothing else; lower() is the same for texts of ASCII only, and faster.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text):
    """The column with A-Z lower-cased and every other character as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
