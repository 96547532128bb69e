"""Continuous ingest: a stream of (op, id, vector, payload) rows into a collection, exactly once per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.collection import Collection


def apply_batch(collection: Collection, batch: DataFrame, batch_id: int, commit: bool = False) -> None:
    """Deletes, then upserts of one micro-batch; a batch that was applied before is skipped by its id."""
    batch = batch.persist()
    try:
        deletes = batch.where(F.col("op") == "delete").select("id")
        upserts = batch.where(F.col("op") == "upsert").select("vector", "payload")
        collection.write_batch(upserts, deletes, commit=commit, batch_id=batch_id)
    finally:
        batch.unpersist()


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, commit_each: bool = False, **trigger) -> StreamingQuery:
    """Start the stream; trigger: the arguments of DataStreamWriter.trigger (default availableNow)."""
    writer = stream.writeStream.foreachBatch(lambda b, i: apply_batch(collection, b, i, commit_each)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
