"""Job states: blocks against a loop, the stream against the batch."""

import random

import pytest
from pyspark.sql import functions as F

from tallyshelf.operators import states
from tallyshelf.streaming import jobs

EVENTS = "job string, at timestamp, tie long, move string"


def looped(events, limit, as_of=None):
    """job to (state, since, moves, rejected, lost) by one loop over (job, second, tie, move)."""
    held = {}
    for job, at, _, move in sorted(e for e in events if e[0] is not None and e[1] is not None):
        state, since, heard, moves, rejected, lost = held.get(job, ("pending", None, None, 0, 0, 0))
        if state == "running" and at - heard > limit:
            state, since, lost = "failed", heard + limit, lost + 1
        if (state, move) in states.MOVES:
            state, since, moves = states.MOVES[state, move], at, moves + 1
        else:
            rejected += 1
        held[job] = (state, since, at, moves, rejected, lost)
    out = {}
    for job, (state, since, heard, moves, rejected, lost) in held.items():
        if as_of is not None and state == "running" and as_of - heard > limit:
            state, since, lost = "failed", heard + limit, lost + 1
        out[job] = (state, since, moves, rejected, lost)
    return out


def some(n, n_jobs, seed, span=400_000):
    rng = random.Random(seed)
    moves = ["create", "start", "start", "finish", "fail", "cancel", "odd", ""]
    return [(f"j{rng.randrange(n_jobs)}" if rng.random() < 0.6 else "hot", rng.randrange(span), i, rng.choice(moves)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(j, a, t, m) for j, a, t, m in rows], "job string, second long, tie long, move string").select(
        "job", F.timestamp_seconds("second").alias("at"), "tie", "move"
    )


def plain(rows):
    return {r.job: (r.state, None if r.since is None else r.s, r.moves, r.rejected, r.lost) for r in rows.withColumn("s", F.unix_seconds("since")).collect()}


@pytest.mark.parametrize("block", [1, 7, 10_000])
def test_blocks_equal_a_loop(spark, block):
    rows = some(600, 9, 1) + [(None, 5, 1, "start"), ("untimed", None, 2, "start"), ("j1", 9, 3, None)]
    got = plain(states.job_states(frame(spark, rows), "job", "at", "tie", "move", 3000, F.timestamp_seconds(F.lit(410_000)), block))
    assert got == looped([(j, a, t, m or "") for j, a, t, m in rows], 3000, 410_000)
    assert {s for s, *_ in got.values()} <= set(states.STATES) and any(x[4] for x in got.values())
    assert plain(states.job_states(frame(spark, []), "job", "at", "tie", "move", 3000)) == {}


def test_stream_equals_batch(spark, tmp_path):
    """Moves in three files, the later ones at later times; the watermark plays the part of as_of, and a second stream goes on."""
    rows, limit, late = sorted(some(500, 12, 2), key=lambda r: r[1]), 20_000, 3600
    folder, store, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    cut = [rows[:150], rows[150:330], rows[330:]]

    def run():
        events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
        query = jobs.kept_states(jobs.job_state_stream(events, "job", "at", "tie", "move", limit, f"{late} seconds"), store, mark)
        assert query.awaitTermination(240) and query.exception() is None

    frame(spark, cut[0]).coalesce(1).write.parquet(str(folder / "a"))
    frame(spark, cut[1]).coalesce(1).write.parquet(str(folder / "b"))
    run()
    seen = cut[0] + cut[1]
    assert plain(jobs.states_at(spark, store)) == looped(seen, limit, max(r[1] for r in seen) - late)
    first = plain(jobs.states_at(spark, store, 0))
    assert first and set(first) <= {r[0] for r in cut[0] + cut[1]}
    frame(spark, cut[2]).coalesce(1).write.parquet(str(folder / "c"))
    run()
    assert plain(jobs.states_at(spark, store)) == looped(rows, limit, max(r[1] for r in rows) - late)
    assert plain(jobs.states_at(spark, store, 0)) == first
