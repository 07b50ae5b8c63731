"""Extensions: continuous transfers and live throughput with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowferry.operators.analytics import DIRECTIONS
from rowferry.operators.combine import Combined
from rowferry.operators.fanout import fanout_rows
from rowferry.plans.spec import DestinationSpec, Mapping


def stream_fanout(stream: DataFrame, mappings: Sequence[Mapping],
                  destinations: Sequence[DestinationSpec], out: str, checkpoint: str,
                  available_now: bool = True) -> StreamingQuery:
    """Fan each micro-batch out to ``out/batch=<n>/destination_id=<id>`` as Parquet.

    One pass and one write per batch. A batch owns its folder and overwrites it
    when repeated after a failure, so every row arrives exactly once. Reading
    ``out`` with a filter on ``destination_id`` opens only that destination.
    """
    def load(batch: DataFrame, number: int) -> None:
        rows = fanout_rows(Combined(batch), mappings, destinations)
        # Whatever the session's mode is, a repeated batch leaves nothing of the first attempt.
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("destination_id").parquet(
            f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def hourly_by_direction(stream: DataFrame, ts: str = "started_at",
                        delay: str = "10 minutes") -> DataFrame:
    """Records per hour and direction; rows later than ``delay`` are not counted.

    In append mode an hour appears once the watermark has passed its end.
    """
    sums = [
        F.coalesce(F.sum(F.when(F.col("direction") == d, F.coalesce("records", F.lit(0)))), F.lit(0))
        .cast("bigint").alias(d)
        for d in DIRECTIONS
    ]
    return (
        stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 hour").alias("w")).agg(*sums)
        .select(F.col("w.start").alias("hour"), *DIRECTIONS)
    )


def write_stream(df: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to Parquet files."""
    writer = df.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(out)
