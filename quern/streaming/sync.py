"""Keeping an index up to date from a stream of changes.

A change is (op, doc_id, ts, …record columns), op ``upsert`` or ``delete``.  Each micro-batch is reduced to the last
change of each key and merged as one segment of a new index version, which costs what the batch costs, not what the
index does.  The merge is idempotent: a batch that is run again after a failure leaves the same rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.index import latest_changes, rows
from quern.operators.store import IndexStore
from quern.spec import Config, SearchableSpec

#: Tries of a batch while another writer holds the index, with pauses of 1, 2, 4 … seconds.
RETRIES = 5


def last_of(changes: DataFrame, spec: SearchableSpec, config: Config, tenant: str, at: str = "ts", order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Of a batch of changes, the keys that change (doc_id) and the index rows that come in their place."""
    keyed = changes.withColumn("doc_id", F.col("doc_id").cast("string"))
    last = latest_changes(keyed, "doc_id", at, order)
    fresh = last.where(F.col("op") == "upsert")
    if spec.key != "doc_id":
        fresh = fresh.withColumn(spec.key, F.col("doc_id"))
    return last.select("doc_id"), rows(fresh, spec, config, tenant, F.lit(None).cast("timestamp"))


def merged(current: DataFrame, changes: DataFrame, spec: SearchableSpec, config: Config, tenant: str, at: str = "ts", order: str | None = None) -> DataFrame:
    """Index rows after the changes: the old rows of changed keys out, the upserted ones in."""
    keys, fresh = last_of(changes, spec, config, tenant, at, order)
    return current.join(keys, "doc_id", "left_anti").unionByName(fresh)


def start(stream: DataFrame, store: IndexStore, spec: SearchableSpec, checkpoint: str, tenant: str = "default", once: bool = True, on_batch: Callable[[int, int], None] | None = None) -> StreamingQuery:
    """Runs the merge for each micro-batch; ``once`` takes what is there and stops.

    ``on_batch(batch id, version)`` is called after each write, where the application hangs its events.
    """

    def apply(changes: DataFrame, batch: int) -> None:
        if changes.isEmpty():
            return
        keys, fresh = last_of(changes, spec, store.config, tenant)
        for attempt in range(RETRIES):
            try:
                version = store.merge(fresh, keys, spec, tenant)
                break
            except RuntimeError:  # another writer holds the index
                if attempt == RETRIES - 1:
                    raise
                time.sleep(2**attempt)
        if on_batch:
            on_batch(batch, version)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
