"""Streams of operations: micro-batches into a store's log, scheduled folds, and the latest version of each id.

A micro-batch is one epoch. Writing its folder replaces an earlier try of the same batch, so each counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def into_log(ops: DataFrame, store: Store, checkpoint: str, fold_every: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Write a stream of operations (id, op, fields, attributes) to the store, folding after every ``fold_every``
    batches."""

    def batch(rows: DataFrame, number: int) -> None:
        epoch = number + 1
        if epoch <= store.epoch:
            return  # folded before a restart
        store.append(epoch, rows)
        if fold_every and epoch % fold_every == 0:
            store.fold(epoch)

    out = ops.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime="10 seconds")).start()


def latest_by_key(events: DataFrame, key: str, at: str, values: Sequence[str]) -> DataFrame:
    """The latest values of each key as a streaming aggregate, whose state is one row a key."""
    newest = F.max_by(F.struct(*values), at)
    return events.groupBy(key).agg(newest.alias("v"), F.max(at).alias(at)).select(key, at, *[F.col(f"v.{v}") for v in values])


def windowed(events: DataFrame, at: str, width: str, late: str, keys: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Aggregates by windows of event time; events later than ``late`` are left out and their state is dropped."""
    out = events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(*[m.alias(n) for n, m in measures.items()])
    return out.select(F.col("window.start").alias("window_start"), *keys, *measures)


def deduplicated(events: DataFrame, keys: Sequence[str], at: str, late: str) -> DataFrame:
    """Each key once within the watermark: retries of a writer count once."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))
