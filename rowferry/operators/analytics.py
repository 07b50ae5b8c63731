"""Reports over the run log.

The run log is the large table. Each report scans it once and aggregates before
anything is joined, so partial sums leave the scan stage, and a connector or a
transfer with most of the runs costs no more than any other.

Expected columns: runs (id, pipeline_id, direction, status, records, started_at,
completed_at), pipelines (id, name, source_id, target_id, direction, status),
connectors (id, name, type).
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.functions.coerce import day_key, elapsed_ms, epoch_ms, round_half_up
from rowferry.session import stage

# The three directions a transfer can have.
DIRECTIONS = ("cloud_bound", "on_prem_bound", "bidirectional")
HOUR_MS = 3_600_000
HOURS = 24


def _records() -> Column:
    return F.coalesce(F.col("records"), F.lit(0))


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def _latency(only_completed: bool) -> Column:
    took = elapsed_ms(F.col("started_at"), F.col("completed_at"))
    if only_completed:
        took = F.when(F.col("status") == "completed", took)
    return F.coalesce(round_half_up(F.avg(took)), F.lit(0.0)).cast("bigint")


def _success_pct(completed: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(completed / total * F.lit(1000.0) + F.lit(0.5)) / F.lit(10.0))


def overview(runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """One row of totals; success is NULL where there are no runs."""
    counts = pipelines.agg(F.struct(
        F.count_if(F.col("status") == "active").alias("active"), F.count(F.lit(1)).alias("total")
    )).scalar()
    done = F.count_if(F.col("status") == "completed")
    return runs.agg(
        F.count(F.lit(1)).alias("total_syncs"),
        _sum(_records()).alias("total_records"),
        _latency(only_completed=True).alias("avg_latency_ms"),
        _success_pct(done, F.count(F.lit(1))).alias("success_rate"),
    ).select(
        "*", counts["active"].alias("active_pipelines"), counts["total"].alias("total_pipelines")
    )


def daily_stats(runs: DataFrame) -> DataFrame:
    """Per UTC day; here latency covers every run that has ended."""
    return (
        runs.groupBy(day_key(F.col("started_at")).alias("date"))
        .agg(
            F.count(F.lit(1)).alias("total_syncs"),
            F.count_if(F.col("status") == "completed").alias("success_count"),
            F.count_if(F.col("status") == "failed").alias("fail_count"),
            _sum(_records()).alias("total_records"),
            _latency(only_completed=False).alias("avg_latency_ms"),
        )
        .orderBy("date")
    )


def last_days(daily: DataFrame, n: int = 15) -> DataFrame:
    """The latest ``n`` days, oldest first."""
    return daily.orderBy(F.desc("date")).limit(n).orderBy("date")


def runs_per_pipeline(runs: DataFrame) -> DataFrame:
    """The run log folded to one row per pipeline; shared by several reports."""
    return runs.groupBy("pipeline_id").agg(
        F.count(F.lit(1)).alias("total_syncs"),
        _sum(_records()).alias("records"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        _latency(only_completed=True).alias("avg_latency_ms"),
        F.max("started_at").alias("last_started"),
    )


def connector_usage(runs: DataFrame | None, pipelines: DataFrame, connectors: DataFrame,
                    per: DataFrame | None = None) -> DataFrame:
    """Connectors with runs, busiest first; a pipeline from a connector to itself counts once.

    ``per``, if given, is the log already folded (:func:`runs_per_pipeline`).
    """
    ends = pipelines.select(
        F.col("id").alias("pid"),
        F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("connector_id"),
    )
    per_pipeline = runs_per_pipeline(runs) if per is None else per
    usage = (
        ends.join(per_pipeline, ends.pid == per_pipeline.pipeline_id, "left")
        .groupBy("connector_id")
        .agg(
            F.count(F.lit(1)).alias("total_pipelines"),
            _sum(F.col("total_syncs")).alias("total_syncs"),
            _sum(F.col("records")).alias("total_records"),
            F.max("last_started").alias("last_used"),
        )
        .filter(F.col("total_syncs") > 0)
    )
    names = connectors.select(
        F.col("id").alias("cid"), F.col("name").alias("connector_name"),
        F.col("type").alias("connector_type"),
    )
    return (
        usage.join(names, usage.connector_id == names.cid, "inner")
        .select("connector_id", "connector_name", "connector_type", "total_pipelines",
                "total_syncs", "total_records", "last_used")
        .orderBy(F.desc("total_records"), "connector_id")
    )


def direction_split(runs: DataFrame) -> DataFrame:
    """Records per direction; other directions are not counted."""
    return runs.agg(*[
        _sum(F.when(F.col("direction") == d, _records())).alias(f"{d}_records")
        for d in DIRECTIONS
    ])


def pipeline_leaderboard(runs: DataFrame | None, pipelines: DataFrame, per: DataFrame | None = None) -> DataFrame:
    """Pipelines with runs, most records first; ``per`` as for :func:`connector_usage`."""
    per = runs_per_pipeline(runs) if per is None else per
    named = pipelines.select("id", "name")
    return (
        per.join(named, per.pipeline_id == named.id, "inner")
        .select(
            F.col("id").alias("pipeline_id"), "name", "total_syncs", "records", "avg_latency_ms",
            F.coalesce(_success_pct(F.col("completed"), F.col("total_syncs")), F.lit(0.0))
            .alias("success_rate"),
        )
        .orderBy(F.desc("records"), "pipeline_id")
    )


def hourly_throughput(runs: DataFrame, now: datetime) -> DataFrame:
    """24 buckets of an hour that end at ``now`` (UTC), empty ones as zero.

    The time range is a plain comparison with the stored column, so the scan
    skips everything older.
    """
    started = runs.schema["started_at"].dataType
    end = F.lit(now.isoformat(sep=" ")).cast(started)
    start = end - F.expr(f"INTERVAL {HOURS} HOURS")
    bucket = F.floor((epoch_ms(F.col("started_at")) - epoch_ms(start)) / F.lit(float(HOUR_MS)))
    sums = (
        runs.filter((F.col("started_at") >= start) & (F.col("started_at") < end))
        .groupBy(bucket.cast("bigint").alias("bucket"))
        .agg(*[_sum(F.when(F.col("direction") == d, _records())).alias(d) for d in DIRECTIONS])
    )
    hours = runs.sparkSession.range(HOURS).withColumnRenamed("id", "hour_no")
    begins = F.timestamp_millis(epoch_ms(start) + F.col("hour_no") * F.lit(HOUR_MS))
    return hours.join(sums, F.col("hour_no") == F.col("bucket"), "left").select(
        F.date_format(begins, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("hour"),
        *[F.coalesce(F.col(d), F.lit(0)).alias(d) for d in DIRECTIONS],
    ).orderBy("hour")


def day_totals(hourly: DataFrame) -> DataFrame:
    """All records of the 24 hours."""
    return hourly.agg(
        F.sum(sum((F.col(d) for d in DIRECTIONS[1:]), F.col(DIRECTIONS[0]))).alias("records_24h")
    )


def active_ratio(over: DataFrame) -> DataFrame:
    """Active pipelines over all pipelines, in percent."""
    share = F.col("active_pipelines") * F.lit(100.0) / F.col("total_pipelines")
    return over.select(
        "active_pipelines", "total_pipelines",
        F.when(F.col("total_pipelines") > 0, round_half_up(share)).otherwise(F.lit(0.0))
        .alias("active_pct"),
    )


def pipeline_listing(runs: DataFrame, pipelines: DataFrame, connectors: DataFrame) -> DataFrame:
    """Every pipeline with its connectors, records so far and last start, newest first."""
    per = runs_per_pipeline(runs).select("pipeline_id", "records", "last_started")

    def names(role: str) -> DataFrame:
        return connectors.select(F.col("id").alias(f"{role}_cid"),
                                 F.col("name").alias(f"{role}_name"),
                                 F.col("type").alias(f"{role}_type"))

    return (
        pipelines.join(per, pipelines.id == per.pipeline_id, "left")
        .join(names("source"), F.col("source_id") == F.col("source_cid"), "left")
        .join(names("target"), F.col("target_id") == F.col("target_cid"), "left")
        .select(
            "id", "name", "source_id", "source_name", "source_type", "target_id", "target_name",
            "target_type", "direction", "status",
            F.coalesce("sync_mode", F.lit("append")).alias("sync_mode"),
            F.coalesce("records", F.lit(0)).alias("records_synced"),
            F.col("last_started").alias("last_sync"), "created_at",
        )
        .orderBy(F.desc_nulls_last("created_at"), "id")
    )


def category_counts(connectors: DataFrame) -> DataFrame:
    """Connectors per category, with an ``all`` line."""
    return (
        connectors.select(F.coalesce("category", F.lit("")).alias("category"))
        .rollup("category").agg(F.count(F.lit(1)).alias("connectors"))
        .select(F.coalesce("category", F.lit("all")).alias("category"), "connectors")
    )


def shares(df: DataFrame, value: str, places: int = 0) -> DataFrame:
    """Adds each row's percentage of the column total; 0 where the total is not positive.

    The total is a scalar subquery: no window gathers the rows into one task.
    """
    total = df.agg(F.sum(value)).scalar()
    pct = round_half_up(F.col(value) * F.lit(100.0) / total, places)
    return df.withColumn("share_pct", F.when(total > 0, pct).otherwise(F.lit(0.0)))


def heights(daily: DataFrame, value: str) -> DataFrame:
    """Adds each row's percentage of the column maximum, which counts as at least 1."""
    top = F.greatest(daily.agg(F.max(value)).scalar(), F.lit(1))
    return daily.withColumn("height_pct", F.col(value) * F.lit(100.0) / top)


def throughput(runs: DataFrame) -> DataFrame:
    """Rows per second of ended runs; NULL for a run that took no time. (extension)"""
    seconds = elapsed_ms(F.col("started_at"), F.col("completed_at")) / F.lit(1000.0)
    return runs.filter(F.col("completed_at").isNotNull()).select(
        "id", "pipeline_id", "records",
        F.when(seconds > 0, _records() / seconds).alias("rows_per_sec"),
    )


class Analytics(NamedTuple):
    """All reports over one copy of the run log."""

    overview: DataFrame
    daily: DataFrame
    connectors: DataFrame
    directions: DataFrame
    leaderboard: DataFrame
    hourly: DataFrame


def analytics(runs: DataFrame, pipelines: DataFrame, connectors: DataFrame, now: datetime) -> Analytics:
    """Every report of the analytics page as of ``now``.

    The log is scanned once: the columns that reports use are staged, and all of them read that.
    """
    log = stage(runs.select("id", "pipeline_id", "direction", "status", "records", "started_at", "completed_at"), "run-log")
    return Analytics(
        overview(log, pipelines), last_days(daily_stats(log)), connector_usage(log, pipelines, connectors),
        direction_split(log), pipeline_leaderboard(log, pipelines), hourly_throughput(log, now))
