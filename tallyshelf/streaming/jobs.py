"""Job states from a stream of moves: keyed state with timers, and a table with a version for each micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyshelf.operators.states import FIRST, LOST, MOVES, RUNNING

STATE = "job string, state string, since timestamp, moves long, rejected long, lost long"
CHANGED = STATE.replace("timestamp", "long")
HELD = "state string, since long, heard long, moves long, rejected long, lost long"


def job_state_stream(events: DataFrame, job: str, at: str, tie: str, move: str, limit_seconds: int, late: str = "1 hour") -> DataFrame:
    """JOB1: the rows of ``states.job_states`` for jobs that changed, from a stream of events.

    Events count in order within a micro-batch, and otherwise as they come. A run fails when the watermark, ``late`` behind the
    newest event, passes the limit after the last that was heard of it, as for a batch with the watermark as as_of.
    """
    limit, first, running, lost, moves_of = limit_seconds * 1_000_000, FIRST, RUNNING, LOST, dict(MOVES)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, since, heard, moves, rejected, failed = held.get if held.exists else (first, None, None, 0, 0, 0)
        if held.hasTimedOut:
            if state == running:
                state, since, failed = lost, heard + limit, failed + 1
        else:
            rows = sorted((a, t, m) for b in batches for a, t, m in zip(b["at"], b["tie"], b["move"], strict=True))
            for a, _, m in rows:
                if state == running and heard is not None and a - heard > limit:
                    state, since, failed = lost, heard + limit, failed + 1
                to = moves_of.get((state, m))
                state, since = (state, since) if to is None else (to, a)
                moves, rejected = moves + (to is not None), rejected + (to is None)
                heard = a if heard is None else max(heard, a)
        held.update((state, since, heard, moves, rejected, failed))
        if state == running:
            held.setTimeoutTimestamp(max((heard + limit) // 1000, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job": [key[0]], "state": [state], "since": pd.array([since], "Int64"), "moves": [moves], "rejected": [rejected], "lost": [failed]})

    rows = events.where(F.col(job).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late)
    rows = rows.select(F.col(job).cast("string").alias("job"), F.col(at).alias("_time"), F.unix_micros(at).alias("at"), F.col(tie).alias("tie"), F.coalesce(move, F.lit("")).alias("move"))
    changed = rows.groupBy("job").applyInPandasWithState(follow, CHANGED, HELD, "update", GroupStateTimeout.EventTimeTimeout)
    return changed.withColumn("since", F.timestamp_micros("since"))


def kept_states(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's changed jobs as the version named after it; one that runs again overwrites its own. Ends when all that waited is taken."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return states.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def states_at(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The state of every job after a version, the latest unless one is named."""
    rows = spark.read.schema(f"{STATE}, version long").parquet(path)
    rows = rows if version is None else rows.where(F.col("version") <= version)
    return rows.groupBy("job").agg(F.max_by(F.struct("state", "since", "moves", "rejected", "lost"), "version").alias("x")).select("job", "x.*")
