"""Snapshots from a stream: each micro-batch is merged into a table's latest version and captured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.diff import apply_changes
from ..sources.store import Store


def merge_batch(store: Store, name: str, batch: DataFrame, keys: list[str], order: str) -> str | None:
    """Upsert a batch's last row for each key (by order) into the latest version, and capture that table; others stay as they are. Merging the same
    batch again changes nothing, so a retried batch does no harm."""
    if batch.isEmpty():
        return None
    rest = [c for c in batch.columns if c not in keys]
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")
    if not store.exists():
        return store.create({name: last}, {name: keys}, message="stream")
    there = store.find()["tables"]
    merged = apply_changes(store.table(name), last.withColumn("op", F.lit("U")), keys) if name in there else last
    return store.snapshot({name: merged}, {name: keys}, message="stream", keep_others=True)


def capture(stream: DataFrame, store: Store, name: str, keys: list[str], order: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that captures every micro-batch."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: merge_batch(store, name, batch, keys, order) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
