"""Registries and telemetry kept up incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.sources.sinks import write_registry


def upsert_stream(records: DataFrame, path: str, key: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Upserts a stream of records into a registry; a batch that is tried again leaves the same table. Ends with the input at hand."""

    def put(batch: DataFrame, _: int) -> None:
        write_registry(batch, path, key, order)

    return records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_calls(events: DataFrame, time: str, late: str, width: str) -> DataFrame:
    """Counts and sums of events in windows of event time; what is later than ``late`` is left out once its window closed."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("window"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def running_totals(events: DataFrame) -> DataFrame:
    """Cumulative counters by kind, for output mode complete or update."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("ts").alias("last"))
