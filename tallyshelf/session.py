"""The session used by tests, the bench and scripts; on a cluster the caller brings its own."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: str = "8", app: str = "tallyshelf", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session; its checkpoint folder is local, as only one machine reads it."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", os.path.join(tempfile.gettempdir(), f"tallyshelf-{os.getpid()}"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
