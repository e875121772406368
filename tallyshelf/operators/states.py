"""Jobs as state machines: which state each job is in after all that happened to it.

A move takes a job from one state to another and is left out where the table has none; a run of which nothing is heard
for a while has failed. What a stretch of events does depends only on the state before it, so a job's events are cut into
blocks, each block is followed from every state at once, and a job's blocks are put together: an array has a block's events
or a job's blocks, never a job's events. ``streaming.jobs`` is the same as a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.operators.catalog import numbered

# The states of a job, and the legal moves.
STATES = ("pending", "stopping", "running", "success", "failed", "cancelled")
MOVES = {
    ("pending", "start"): "running",
    ("pending", "cancel"): "stopping",
    ("stopping", "start"): "cancelled",
    ("running", "finish"): "success",
    ("running", "fail"): "failed",
    ("running", "cancel"): "cancelled",
    ("success", "create"): "pending",
    ("failed", "create"): "pending",
    ("cancelled", "create"): "pending",
}
FIRST, RUNNING, LOST = "pending", "running", "failed"
#: Events of a block.
BLOCK = 10_000


def after(state: Column, move: Column) -> Column:
    """The state that a move leads to, null if it is not legal."""
    table = F.create_map(*[F.lit(x) for (s, m), to in MOVES.items() for x in (f"{s} {m}", to)])
    return F.try_element_at(table, F.concat(state, F.lit(" "), F.coalesce(move, F.lit(""))))


def followed(events: str, state: Column, heard: Column, limit: int) -> Column:
    """What an array of events (at, move) in order does to a job in a state of which one heard last at a time."""
    none = F.lit(0).cast("long")
    start = F.struct(state.alias("state"), F.lit(None).cast("long").alias("since"), heard.alias("heard"), none.alias("moves"), none.alias("rejected"), none.alias("lost"))

    def step(acc: Column, x: Column) -> Column:
        silent = (acc["state"] == RUNNING) & (x["at"] - acc["heard"] > limit)
        silent = F.coalesce(silent, F.lit(False))
        before = F.when(silent, F.lit(LOST)).otherwise(acc["state"])
        to = after(before, x["move"])
        return F.struct(
            F.coalesce(to, before).alias("state"),
            F.when(to.isNotNull(), x["at"]).when(silent, acc["heard"] + limit).otherwise(acc["since"]).alias("since"),
            F.greatest(acc["heard"], x["at"]).alias("heard"),
            (acc["moves"] + to.isNotNull().cast("long")).alias("moves"),
            (acc["rejected"] + to.isNull().cast("long")).alias("rejected"),
            (acc["lost"] + silent.cast("long")).alias("lost"),
        )

    return F.aggregate(events, start, step)


def job_states(events: DataFrame, job: str, at: str, tie: str, move: str, limit_seconds: int, as_of: Column | None = None, block: int = BLOCK) -> DataFrame:
    """JOB1: job, state, since (null if it never changed), moves, rejected and lost (timed-out runs) after all events in order of at and tie.

    A job begins as pending. Moves that are not legal change nothing but count as rejected. A running job of which nothing, not
    even a rejected move, is heard for more than the limit has failed by then; at the end that holds if as_of is so late.
    Events without a job or time are left out.
    """
    limit = limit_seconds * 1_000_000
    rows = events.select(F.col(job).alias("job"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(tie).alias("tie"), F.col(move).alias("move"))
    rows = numbered(rows.where("job IS NOT NULL AND at IS NOT NULL"), ["at", "tie"], "job")
    rows = rows.select("job", F.floor(F.col("row_index") / block).alias("block"), F.struct("row_index", "at", "move").alias("x"))
    blocks = rows.groupBy("job", "block").agg(F.array_sort(F.collect_list("x")).alias("events"), F.max("x.at").alias("last"))
    heard = F.lag("last").over(Window.partitionBy("job").orderBy("block"))
    from_each = F.create_map(*[x for s in STATES for x in (F.lit(s), followed("events", F.lit(s), F.col("heard"), limit))])
    mapped = blocks.withColumn("heard", heard).select("job", "block", from_each.alias("to"))
    listed = mapped.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("block", F.map_entries("to").alias("to")))).alias("blocks"))
    none = F.lit(0).cast("long")
    start = F.struct(F.lit(FIRST).alias("state"), F.lit(None).cast("long").alias("since"), F.lit(None).cast("long").alias("heard"), none.alias("moves"), none.alias("rejected"), none.alias("lost"))

    def step(acc: Column, b: Column) -> Column:
        own = F.try_element_at(F.map_from_entries(b["to"]), acc["state"])
        return F.struct(
            own["state"].alias("state"), F.coalesce(own["since"], acc["since"]).alias("since"), own["heard"].alias("heard"),
            (acc["moves"] + own["moves"]).alias("moves"), (acc["rejected"] + own["rejected"]).alias("rejected"), (acc["lost"] + own["lost"]).alias("lost"),
        )

    found = listed.select("job", F.aggregate("blocks", start, step).alias("end")).select("job", "end.*")
    late = F.lit(False) if as_of is None else (F.col("state") == RUNNING) & (F.unix_micros(as_of) - F.col("heard") > limit)
    return found.select(
        "job",
        F.when(late, LOST).otherwise(F.col("state")).alias("state"),
        F.timestamp_micros(F.when(late, F.col("heard") + limit).otherwise(F.col("since"))).alias("since"),
        "moves",
        "rejected",
        (F.col("lost") + late.cast("long")).alias("lost"),
    )
