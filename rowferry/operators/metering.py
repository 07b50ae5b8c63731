"""Usage and cost reports over the metering log.

Expected columns: events (id, pipeline_id, direction, records, bytes,
compute_ms, cost_usd, ts), pipelines (id, name, direction).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.functions.coerce import day_key, elapsed_ms, or_default
from rowferry.functions.pricing import monthly_charge, run_cost, usage_gb
from rowferry.operators.analytics import DIRECTIONS
from rowferry.session import stage


def _total(c) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def _cost_where(test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, F.col("cost_usd"))), F.lit(0.0))


def metering_summary(events: DataFrame) -> DataFrame:
    """Totals, and cost per direction (exact matches only)."""
    return events.agg(
        _total("cost_usd").alias("total_cost"),
        _total("records").cast("bigint").alias("total_records"),
        _total("bytes").cast("bigint").alias("total_bytes"),
        *[_cost_where(F.col("direction") == d).alias(f"{d}_cost") for d in DIRECTIONS],
    )


def daily_costs(events: DataFrame) -> DataFrame:
    """Cost per UTC day; whatever is neither cloud nor on-prem goes to ``bi``."""
    d = F.col("direction")
    known = F.coalesce(d.isin("cloud_bound", "on_prem_bound"), F.lit(False))
    return (
        events.groupBy(day_key(F.col("ts")).alias("date"))
        .agg(
            _cost_where(d == "cloud_bound").alias("cloud"),
            _cost_where(d == "on_prem_bound").alias("on_prem"),
            _cost_where(~known).alias("bi"),
        )
        .orderBy("date")
    )


def pipeline_costs(events: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Usage and cost per pipeline, dearest first; NULL is a group of its own."""
    per = events.groupBy("pipeline_id").agg(
        _total("records").cast("bigint").alias("records"),
        _total("bytes").cast("bigint").alias("bytes"),
        _total("compute_ms").cast("bigint").alias("compute_ms"),
        _total("cost_usd").alias("cost"),
    )
    named = pipelines.select("id", "name", "direction")
    return (
        per.join(named, per.pipeline_id == named.id, "left")
        .select("pipeline_id",
                or_default(F.col("name"), F.col("pipeline_id")).alias("pipeline_name"),
                "direction", "records", "bytes", "compute_ms", "cost")
        .orderBy(F.desc("cost"), "pipeline_id")
    )


def meter_runs(runs: DataFrame, bytes_col: str = "bytes") -> DataFrame:
    """Metering rows for the completed runs of a run log; other runs have none."""
    took = elapsed_ms(F.col("started_at"), F.col("completed_at"))
    return runs.filter(F.col("status") == "completed").select(
        "id", "pipeline_id", "direction", "records", F.col(bytes_col).alias("bytes"),
        took.alias("compute_ms"),
        run_cost(F.col("direction"), F.col("records"), took).alias("cost_usd"),
        F.col("completed_at").alias("ts"),
    )


def billable_usage(events: DataFrame) -> DataFrame:
    """Billable gigabytes per metering row; rows with nothing to bill are left out."""
    gb = usage_gb(F.col("bytes"))
    return events.select("id", gb.alias("gb")).filter(F.col("gb").isNotNull())


def monthly_charges(events: DataFrame, connectors: DataFrame) -> DataFrame:
    """Projected charge of each month from its bytes and the number of connectors."""
    count = connectors.agg(F.count(F.lit(1))).scalar()
    per = events.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(
        _total("bytes").cast("bigint").alias("bytes")
    )
    return per.select(
        "month", "bytes", count.alias("connectors"),
        monthly_charge(count, F.col("bytes")).alias("charge_usd"),
    )


def usage_throughput(events: DataFrame) -> DataFrame:
    """Rows and bytes per second of metered runs; NULL where no time passed. (extension)"""
    seconds = F.col("compute_ms") / F.lit(1000.0)
    return events.select("id", *[
        F.when(seconds > 0, F.col(c) / seconds).alias(name)
        for c, name in (("records", "rows_per_sec"), ("bytes", "bytes_per_sec"))
    ])


class Metering(NamedTuple):
    """All reports over one copy of the usage log."""

    summary: DataFrame
    daily: DataFrame
    pipelines: DataFrame


def metering(events: DataFrame, pipelines: DataFrame) -> Metering:
    """Every report of the usage page; the columns they use are staged and read from there."""
    log = stage(events.select("pipeline_id", "direction", "records", "bytes", "compute_ms", "cost_usd", "ts"), "usage-log")
    return Metering(metering_summary(log), daily_costs(log), pipeline_costs(log, pipelines))
