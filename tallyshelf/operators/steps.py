"""Runs in steps that can be stopped and go on: what is finished is written down step by step."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from tallyshelf.sources.landed import whole_files
from tallyshelf.sources.shared import put_text

#: A file of this name in a run's folder asks it to stop.
STOP = "_stop"


class Stopped(RuntimeError):
    """A run was stopped; finished has the results of the steps that are done, by name."""

    def __init__(self, finished: dict[str, Any]):
        super().__init__(f"stopped after {list(finished)}")
        self.finished = finished


def _at(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def tag_of(folder: str) -> str:
    """The tag that a run's Spark jobs have."""
    return "run " + folder.replace(",", ";")


def stop(spark: SparkSession, folder: str) -> None:
    """UDF2: asks the run with this folder to stop, from any thread or application that sees it; its jobs in this application end at once."""
    mark, files = _at(spark, f"{folder}/{STOP}")
    files.create(mark, True).close()
    spark.sparkContext.cancelJobsWithTag(tag_of(folder))


def asked(spark: SparkSession, folder: str) -> bool:
    mark, files = _at(spark, f"{folder}/{STOP}")
    return files.exists(mark)


def finished(spark: SparkSession, folder: str) -> dict[str, Any]:
    """JOB4: the results of the steps that are done, in their order."""
    rows = whole_files(spark, f"{folder}/step-*.json").collect()
    found = sorted((json.loads(r.body) for r in rows), key=lambda x: x["number"])
    return {x["step"]: x["result"] for x in found}


def run(spark: SparkSession, steps: list[tuple[str, Callable[[], Any]]], folder: str) -> dict[str, Any]:
    """UDF2, JOB4: runs the steps that folder does not name as done, in order, and returns the results of all by name.

    Each step's result (what JSON can hold) is written down when it is done. A step must leave the same behind if it runs again,
    as one that was cut off does. Before each step and when one fails, a request to stop ends the run by Stopped; the next run with the
    folder takes the request away and goes on.
    """
    mark, files = _at(spark, f"{folder}/{STOP}")
    files.delete(mark, False)
    done, tag = finished(spark, folder), tag_of(folder)
    for number, (step, work) in enumerate(steps):
        if step in done:
            continue
        if asked(spark, folder):
            raise Stopped(done)
        spark.sparkContext.addJobTag(tag)
        try:
            result = work()
        except Exception as e:
            if asked(spark, folder):
                raise Stopped(done) from e
            raise
        finally:
            spark.sparkContext.removeJobTag(tag)
        put_text(spark, f"{folder}/step-{number:04d}.json", json.dumps({"number": number, "step": step, "result": result}, ensure_ascii=False))
        done[step] = result
    return {step: done[step] for step, _ in steps}
