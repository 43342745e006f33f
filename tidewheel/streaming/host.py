"""Circuits inside Structured Streaming, and native streaming windows for append-only sources."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewheel.session import delete_path, list_names
from tidewheel.streaming.circuit import Circuit


def drive(
    circuit: Circuit, source: DataFrame, name: str, sink: Callable[[dict[str, Any], int], None], checkpoint: str, trigger: dict[str, Any] | None = None, state: str | None = None,
) -> StreamingQuery:
    """Steps the circuit once per micro-batch of a streaming source; the batch id is the tick.

    After each batch the circuit is saved under ``state`` (beside the checkpoint
    unless given) and the save before the last one removed.  A query that starts
    again loads the last complete save and passes over batches that it contains.  A
    batch whose save was not reached is stepped again from the state before it, and
    the sink gets its id again, by which it can tell.
    """
    spark, folder = circuit.spark, state or checkpoint.rstrip("/") + "-circuit"
    saved = sorted(int(n) for n in list_names(spark, folder) if n.isdigit() and "_SUCCESS" in list_names(spark, f"{folder}/{n}/kept"))
    if saved:
        circuit.load(f"{folder}/{saved[-1]}")
    applied = {"last": saved[-1] if saved else -1}

    def tick(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= applied["last"]:
            return
        sink(circuit.step(**{name: batch}), batch_id)
        circuit.save(f"{folder}/{batch_id}")
        for n in list_names(spark, folder):
            if n.isdigit() and int(n) < applied["last"]:
                delete_path(spark, f"{folder}/{n}")
        applied["last"] = batch_id

    return source.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, ts: str, delay: str, width: str, step: str | None, keys: list[str], **aggs: Column) -> DataFrame:
    """Event-time windows with a watermark, emitted once when closed (append mode); append-only sources."""
    window = F.window(ts, width, step) if step else F.window(ts, width)
    return stream.withWatermark(ts, delay).groupBy(window.alias("w"), *keys).agg(*[c.alias(n) for n, c in aggs.items()]).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggs)


def first_seen(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Distinct records of an append-only stream, state bounded by the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
