"""Queries on jobs: the users of the events stand for jobs, their events for moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.operators import states
from tallyshelf.plans.registry import register
from tallyshelf.sources.tables import table

MOVE_OF = {"signup": "create", "view": "start", "purchase": "finish", "error": "fail", "click": "cancel"}
#: Seconds after which a silent run has failed.
SILENT = 86_400


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = F.create_map(*[F.lit(x) for pair in MOVE_OF.items() for x in pair])
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("ts").alias("at"), F.col("event_id").alias("tie"), F.try_element_at(of, F.col("event_type")).alias("move"))


LEGAL = " ".join(f"WHEN '{s} {m}' THEN '{to}'" for (s, m), to in states.MOVES.items())
NAMED = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MOVE_OF.items())


@register(f"""
WITH RECURSIVE e AS (SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, ts, CASE event_type {NAMED} END AS move FROM events),
  r AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS i, 'pending' AS state, CAST(NULL AS TIMESTAMP) AS since, CAST(NULL AS TIMESTAMP) AS heard, 0 AS moves, 0 AS rejected, 0 AS lost FROM e
    UNION ALL
    SELECT job, i, coalesce(going, before), CASE WHEN going IS NOT NULL THEN ts WHEN silent THEN heard + INTERVAL {SILENT} SECOND ELSE since END, ts,
      moves + CASE WHEN going IS NULL THEN 0 ELSE 1 END, rejected + CASE WHEN going IS NULL THEN 1 ELSE 0 END, lost + CASE WHEN silent THEN 1 ELSE 0 END
    FROM (SELECT *, CASE before || ' ' || move {LEGAL} END AS going FROM (
      SELECT e.job, e.i, e.ts, e.move, r.since, r.heard, r.moves, r.rejected, r.lost, coalesce(r.state = 'running' AND epoch_us(e.ts) - epoch_us(r.heard) > {SILENT}000000, false) AS silent,
        CASE WHEN r.state = 'running' AND epoch_us(e.ts) - epoch_us(r.heard) > {SILENT}000000 THEN 'failed' ELSE r.state END AS before
      FROM r JOIN e ON e.job = r.job AND e.i = r.i + 1))),
  ends AS (SELECT *, state = 'running' AND epoch_us(TIMESTAMP '2024-01-31') - epoch_us(heard) > {SILENT}000000 AS late FROM r QUALIFY row_number() OVER (PARTITION BY job ORDER BY i DESC) = 1)
SELECT job, CASE WHEN late THEN 'failed' ELSE state END AS state, CASE WHEN late THEN heard + INTERVAL {SILENT} SECOND ELSE since END AS since, CAST(moves AS BIGINT) AS moves,
  CAST(rejected AS BIGINT) AS rejected, CAST(lost + CASE WHEN late THEN 1 ELSE 0 END AS BIGINT) AS lost FROM ends
""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB1: the state of every job after all its moves, with runs that fell silent."""
    return states.job_states(moves(spark, sf_dir), "job", "at", "tie", "move", SILENT, F.lit("2024-01-31 00:00:00").cast("timestamp"))
