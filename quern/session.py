"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch: 10,000 texts of a crawl can be more than a worker should hold.
BATCH_ROWS, BATCH_BYTES = "2000", str(4 << 20)
#: What a worker allocates for one batch goes back to the system instead of staying with the worker.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}
_ROOT = str(Path(__file__).resolve().parent.parent)


def let_workers_import(spark: SparkSession) -> None:
    """Put the folder that holds the library on the Python path of this session's workers.

    Workers that already have it (an installed package, ``--py-files``) are unaffected.
    """
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *parts])


def bound_batches(spark: SparkSession) -> None:
    """Bounded Arrow batches for this session's workers, so that their memory doesn't follow the input."""
    sc = spark.sparkContext
    sc.environment.update({k: v for k, v in WORKER_ENV.items() if k not in sc.environment})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees: the session's spark.checkpoint.dir; one in /tmp only for local sessions."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor shares")
        folder = f"file:///tmp/quern-checkpoint-{os.getuid()}"
    return folder.rstrip("/")
