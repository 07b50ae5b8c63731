"""Reports that read the run log once: partial states per day, merged when asked.

A batch of ended runs is folded to one row per day, pipeline and direction:
counts, sums and the latest start, all of which merge by addition or maximum.
Each batch keeps its states in a folder of its own, so late runs of an old day
are one more state of that day, and a repeated batch replaces what it wrote.
Together with :func:`rowferry.operators.incremental.incremental_copy`, whose
``load`` :func:`fold` can be, every run counts once.

Reports are those of :mod:`rowferry.operators.analytics`, equal to a
computation over the whole log. The 24 hours before a moment begin anywhere in
an hour, so that one report reads the log, by a range of time its scan skips by.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.functions.coerce import day_key, elapsed_ms, round_half_up
from rowferry.operators import analytics as A

KEYS = ("date", "pipeline_id", "direction")
SUMS = ("runs", "completed", "failed", "records", "completed_ms", "completed_timed", "ended_ms", "ended_timed")


def daily_parts(runs: DataFrame) -> DataFrame:
    """The states of some runs. A run without a start has a NULL day; no runs, no states."""
    took, done = elapsed_ms(F.col("started_at"), F.col("completed_at")), F.col("status") == "completed"

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")

    return runs.groupBy(day_key(F.col("started_at")).alias("date"), "pipeline_id", "direction").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(done).alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"), total(F.col("records")).alias("records"),
        total(F.when(done, took)).alias("completed_ms"), F.count(F.when(done, took)).alias("completed_timed"),
        total(took).alias("ended_ms"), F.count(took).alias("ended_timed"),
        F.max("started_at").alias("last_started"))


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """States merged to one per combination of ``keys``; none gives one row of totals."""
    return parts.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in SUMS],
                                    F.max("last_started").alias("last_started"))


def fold(runs: DataFrame, state: str, batch: int) -> None:
    """Write the states of one batch, in place of what an earlier try of it wrote."""
    daily_parts(runs).write.mode("overwrite").parquet(f"{state}/batch={batch}")


def folded(spark: SparkSession, state: str) -> DataFrame:
    """One state per day, pipeline and direction over all batches."""
    return merged(spark.read.parquet(state), *KEYS)


def _mean(total: str, count: str) -> Column:
    return F.coalesce(F.when(F.col(count) > 0, round_half_up(F.col(total) / F.col(count))), F.lit(0.0)).cast("bigint")


def overview(parts: DataFrame, pipelines: DataFrame) -> DataFrame:
    counts = pipelines.agg(F.struct(
        F.count_if(F.col("status") == "active").alias("active"), F.count(F.lit(1)).alias("total"))).scalar()
    return merged(parts).select(
        F.col("runs").alias("total_syncs"), F.col("records").alias("total_records"),
        _mean("completed_ms", "completed_timed").alias("avg_latency_ms"),
        A._success_pct(F.col("completed"), F.col("runs")).alias("success_rate"),
        counts["active"].alias("active_pipelines"), counts["total"].alias("total_pipelines"))


def daily_stats(parts: DataFrame) -> DataFrame:
    return merged(parts, "date").select(
        "date", F.col("runs").alias("total_syncs"), F.col("completed").alias("success_count"),
        F.col("failed").alias("fail_count"), F.col("records").alias("total_records"),
        _mean("ended_ms", "ended_timed").alias("avg_latency_ms")).orderBy("date")


def per_pipeline(parts: DataFrame) -> DataFrame:
    """What ``runs_per_pipeline`` gives for the log."""
    return merged(parts, "pipeline_id").select(
        "pipeline_id", F.col("runs").alias("total_syncs"), "records", "completed",
        _mean("completed_ms", "completed_timed").alias("avg_latency_ms"), "last_started")


def direction_split(parts: DataFrame) -> DataFrame:
    return A.direction_split(merged(parts, "direction"))


def analytics(parts: DataFrame, runs: DataFrame, pipelines: DataFrame, connectors: DataFrame, now: datetime) -> A.Analytics:
    """Every report of the analytics page from ``folded`` states; ``runs`` is read for the last 24 hours only."""
    per = per_pipeline(parts)
    return A.Analytics(
        overview(parts, pipelines), A.last_days(daily_stats(parts)), A.connector_usage(None, pipelines, connectors, per),
        direction_split(parts), A.pipeline_leaderboard(None, pipelines, per), A.hourly_throughput(runs, now))
