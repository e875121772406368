"""Sharding by fixed virtual slots under the ``bytes`` law.

Records hash into a fixed number of virtual slots by doc_id and text. Equal records, such as rows without a doc_id that
repeat a text, meet in one; where a slot has ``HOT`` times the mean of bytes or rows, its equal records are counted off
into parts of it, and what is said of slots below holds for parts too. All other records stay in their slot, so
where a record lies does not depend on how the table is cut into tasks. Bytes and rows are added up per slot, and a
versioned map says which shard holds each slot. A map is made by handing the largest slots out
first, each to the shard with the fewest bytes; rebalancing edits a map by moving single slots, so
that most slots, and with them their records, stay where they are. Whatever the number of records,
the driver sees one row per virtual slot.

Defined cases: a null text has no bytes, so its size is 1 and its crc32 that of no bytes (0); null
doc_ids are ids like others; repeated rows are records of their own; an empty table gives no rows; other
columns are ignored. Equal texts need not meet in a shard: the law is about bytes, and a group of copies may be
larger than a shard.
"""

from __future__ import annotations

import heapq
import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyshelf.llm.common import keep, scratch_folder
from tallyshelf.operators.catalog import numbered

N_SLOTS = 4096
#: A slot is divided if it holds so many times the mean, and the places that the parts of a slot have in its number.
HOT, PART_BITS = 4, 16
MAP_SCHEMA = "version int, vslot int, shard int, bytes long, records long"


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, hash, virtual slot and a number of its own for every record."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.xxhash64("doc_id", raw).alias("hash"),
        F.pmod(F.xxhash64("doc_id", raw), F.lit(n_slots)).cast("int").alias("vslot"),
        F.monotonically_increasing_id().alias("record"),
    )


def slot_totals(recs: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and records per virtual slot that has any: at most one row for each slot reaches the driver."""
    found = recs.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records")).collect()
    return {r.vslot: (r.bytes, r.records) for r in found}


def hot_parts(totals: dict[int, tuple[int, int]], n_slots: int) -> dict[int, int]:
    """The slots of several records to divide, and into how many parts: one for each mean of bytes or rows that they hold."""
    out = {}
    for k in (0, 1):
        mean = sum(x[k] for x in totals.values()) / n_slots
        for v, x in totals.items():
            if x[1] > 1 and x[k] > HOT * max(mean, 1):
                out[v] = min(max(out.get(v, 0), math.ceil(x[k] / max(mean, 1))), 1 << PART_BITS)
    return out


def divided(recs: DataFrame, hot: dict[int, int]) -> DataFrame:
    """Equal records of hot slots go to the slot's parts in turn, the first of them to the slot itself; which of them comes first makes no difference."""
    if not hot:
        return recs
    parts = F.broadcast(recs.sparkSession.createDataFrame(list(hot.items()), "vslot int, parts int"))  # n_slots rows at most
    in_hot = recs.join(parts, "vslot")
    equal = keep(in_hot.groupBy("vslot", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "equal-records")
    if equal.isEmpty():
        return recs
    counted = numbered(in_hot.join(equal, ["vslot", "hash"], "left_semi"), ["record"], "vslot", "hash")
    turn = F.col("row_index") % F.col("parts")
    part = F.when(turn == 0, F.col("vslot")).otherwise((F.col("vslot") + 1) * F.lit(1 << PART_BITS) + turn).cast("int")
    return recs.join(equal, ["vslot", "hash"], "left_anti").unionByName(counted.withColumn("vslot", part).select(recs.columns))


def first_map(totals: dict[int, tuple[int, int]], n_shards: int, n_slots: int = N_SLOTS) -> dict[int, int]:
    """Slot to shard: the largest slots first, each to the shard with the fewest bytes (ties: the lowest shard)."""
    load = [(0, s) for s in range(n_shards)]
    out = {}
    for slot in sorted({*range(n_slots), *totals}, key=lambda v: (-totals.get(v, (0, 0))[0], v)):
        size, shard = heapq.heappop(load)
        out[slot] = shard
        heapq.heappush(load, (size + totals.get(slot, (0, 0))[0], shard))
    return out


def rebalanced(old: dict[int, int], totals: dict[int, tuple[int, int]], n_shards: int, slack: float = 0.02) -> dict[int, int]:
    """An edited map: slots of shards that are gone, new slots, and slots above the mean size by more than slack, move to the smallest shard.

    A slot moves only if that narrows the gap between the two shards; every other slot stays.
    """
    size = lambda v: totals.get(v, (0, 0))[0]
    out, load, held = dict(old), dict.fromkeys(range(n_shards), 0), {s: [] for s in range(n_shards)}
    homeless = [v for v in totals if v not in old]
    for slot, shard in sorted(old.items()):
        if shard < n_shards:
            load[shard] += size(slot)
            held[shard].append(slot)
        else:
            homeless.append(slot)
    mean = sum(map(size, {*old, *totals})) / n_shards
    for slot in sorted(homeless, key=lambda v: (-size(v), v)):
        to = min(load, key=lambda s: (load[s], s))
        out[slot], load[to] = to, load[to] + size(slot)
        held[to].append(slot)
    moved = True
    while moved:  # every move evens the shards out, so there is an end, and then nothing is left to move for the same bytes
        moved = False
        for shard in sorted(load, key=lambda s: (-load[s], s)):
            for slot in sorted(held[shard], key=lambda v: (-size(v), v)):
                to = min(load, key=lambda s: (load[s], s))
                if load[shard] <= mean * (1 + slack):
                    break
                if size(slot) and load[to] + size(slot) < load[shard]:
                    out[slot], load[to], load[shard], moved = to, load[to] + size(slot), load[shard] - size(slot), True
                    held[shard].remove(slot)
                    held[to].append(slot)
    return out


def map_frame(spark: SparkSession, slots: dict[int, int], totals: dict[int, tuple[int, int]], version: int) -> DataFrame:
    rows = [(version, v, s, *totals.get(v, (0, 0))) for v, s in sorted(slots.items())]
    return spark.createDataFrame(rows, MAP_SCHEMA)


def store_map(spark: SparkSession, slots: dict[int, int], totals: dict[int, tuple[int, int]], version: int, path: str) -> None:
    """Writes one version of the map; a version that is there already is left alone and is an error."""
    map_frame(spark, slots, totals, version).drop("version").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, int]]:
    """A stored version of the map, the latest unless one is named."""
    stored = spark.read.parquet(path)
    version = stored.agg(F.max("version")).first()[0] if version is None else version
    return version, {r.vslot: r.shard for r in stored.where(F.col("version") == version).collect()}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a folder, by the file system that the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def placed(recs: DataFrame, slots: dict[int, int], totals: dict[int, tuple[int, int]]) -> DataFrame:
    """Adds shard, and slot: the record's place in its shard, without gaps from 0.

    The places of a shard run through its virtual slots in order; a virtual slot starts where those
    before it end, so records are only ranked within one virtual slot.
    """
    start, rows = {}, []
    for v, s in sorted(slots.items()):
        rows.append((v, s, start.get(s, 0)))
        start[s] = start.get(s, 0) + totals.get(v, (0, 0))[1]
    where = recs.sparkSession.createDataFrame(rows, "vslot int, shard int, first long")
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32", "hash"))
    return (
        recs.withColumn("_rank", rank)
        .join(F.broadcast(where), "vslot")  # a row for each virtual slot, whatever the input
        .withColumn("slot", F.col("first") + F.col("_rank") - 1)
        .drop("_rank", "first", "record", "hash")
    )


def shard(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), vslot and map_version.

    With map_path, the latest stored map is edited for today's bytes and stored as the next version;
    without it, a first map is stored in the shared folder.
    """
    spark = docs.sparkSession
    recs = keep(records(docs, n_slots), "records")  # texts are read once, and records keep their numbers
    totals = slot_totals(recs)
    if hot := hot_parts(totals, n_slots):
        recs = divided(recs, hot)
        totals = slot_totals(recs)
    version, slots = 1, first_map(totals, n_shards, n_slots)
    if map_path is None:
        map_path = f"{scratch_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    elif exists(spark, map_path):
        last, old = load_map(spark, map_path)
        version, slots = last + 1, rebalanced(old, totals, n_shards)
    store_map(spark, slots, totals, version, map_path)
    return placed(recs, slots, totals).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        F.lit(version).alias("map_version"),
    )
