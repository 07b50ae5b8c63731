"""Recent, enriched and filtered listings over the configuration and log tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowferry.functions.coerce import or_default
from rowferry.operators.sizing import broadcast_if_small

# Lengths of the listings.
RECENT_RUNS = 50
AUDIT_MAX = 200
NOTIFICATIONS = 10
UNREAD = 3
SEARCH_HITS = 5
SEARCH_MIN_CHARS = 2


def audit_limit(requested: object) -> int:
    """A requested number of log entries, or 200 where it is not 1 to 200."""
    try:
        n = float(requested)
    except (TypeError, ValueError):
        return AUDIT_MAX
    if not math.isfinite(n) or n <= 0:
        return AUDIT_MAX
    return max(1, int(min(n, AUDIT_MAX)))


def latest(df: DataFrame, ts: str, n: int) -> DataFrame:
    """The ``n`` newest rows; ties by id. Each task keeps ``n`` rows, no full sort."""
    return df.orderBy(F.desc_nulls_last(ts), "id").limit(n)


def _with_pipeline(df: DataFrame, pipelines: DataFrame) -> DataFrame:
    dim = pipelines.select(
        F.col("id").alias("__pid"), F.col("name").alias("pipeline_name"),
        F.col("direction").alias("pipeline_direction"),
    )
    return df.join(dim, df.pipeline_id == F.col("__pid"), "left").drop("__pid")


def recent_runs(runs: DataFrame, pipelines: DataFrame, n: int = RECENT_RUNS) -> DataFrame:
    """Newest runs with the name and direction of their pipeline."""
    return _with_pipeline(latest(runs, "started_at", n), pipelines)


def audit_entries(log: DataFrame, pipelines: DataFrame, limit: object = AUDIT_MAX) -> DataFrame:
    """Newest log entries; a missing direction is taken from the pipeline."""
    joined = _with_pipeline(latest(log, "ts", audit_limit(limit)), pipelines)
    own = F.col("direction") if "direction" in log.columns else F.lit(None)
    return joined.withColumn("direction", F.coalesce(own, "pipeline_direction")).drop(
        "pipeline_direction"
    )


def search_log(entries: DataFrame, text: str = "", status: str = "all") -> DataFrame:
    """Entries whose action, pipeline name or details contain ``text``, and of a status."""
    out = entries
    if text:
        needle = text.lower()
        hits = [F.lower(F.col(c)).contains(needle) for c in ("action", "pipeline_name", "details")]
        out = out.filter(F.coalesce(hits[0], F.lit(False)) | F.coalesce(hits[1], F.lit(False))
                         | F.coalesce(hits[2], F.lit(False)))
    return out if status == "all" else out.filter(F.col("status") == status)


def notifications(log: DataFrame, n: int = NOTIFICATIONS, unread: int = UNREAD) -> DataFrame:
    """The newest entries by position; the first three are unread.

    The ranking sees only the ``n`` rows left after the limit.
    """
    position = F.row_number().over(Window.orderBy(F.desc_nulls_last("ts"), "id"))
    summary = F.concat_ws(" — ", "actor", "status")
    return latest(log, "ts", n).select(
        "id", "action", or_default(F.col("details"), summary).alias("detail"),
        position.alias("position"), (position > unread).alias("read"),
    )


def search(connectors: DataFrame, pipelines: DataFrame, query: str,
           hits: int = SEARCH_HITS) -> DataFrame:
    """Connectors by name and pipelines by name or table, a few of each."""
    q = query.strip().lower()
    c = connectors.select(F.lit("connector").alias("entity"), "id", "name",
                          F.col("type").alias("info"))
    p_tables = ("source_table", "target_table")
    p = pipelines.select(F.lit("pipeline").alias("entity"), "id", "name", *p_tables)
    if len(q) < SEARCH_MIN_CHARS:
        c, p = c.filter(F.lit(False)), p.filter(F.lit(False))
    in_name = F.lower(F.coalesce("name", F.lit(""))).contains(q)
    in_tables = [F.lower(F.coalesce(t, F.lit(""))).contains(q) for t in p_tables]
    found_c = c.filter(in_name).orderBy("id").limit(hits)
    found_p = p.filter(in_name | in_tables[0] | in_tables[1]).orderBy("id").limit(hits)
    return found_c.unionByName(found_p.select(
        "entity", "id", "name",
        F.concat_ws(" → ", *p_tables).alias("info"),
    ))


def by_created(df: DataFrame, newest_first: bool = False) -> DataFrame:
    """Sorted by creation; rows without a time count as earliest. Ties by id."""
    c = F.col("created_at")
    return df.orderBy(c.desc_nulls_last() if newest_first else c.asc_nulls_first(), "id")


def latest_account(accounts: DataFrame, require: str | None = None) -> DataFrame:
    """The account updated last, optionally among those that have ``require``.

    An aggregate rather than a sort: each task keeps one row.
    """
    df = accounts
    if require:
        df = df.filter(F.col(require).isNotNull() & (F.col(require) != ""))
    order = F.struct(
        F.coalesce(-F.unix_micros(F.col("updated_at").cast("timestamp")),
                   F.lit(2**63 - 1)).alias("age"),
        F.col("id"),
    )
    found = df.agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), order).alias("a"))
    return found.filter(F.col("a").isNotNull()).select("a.*")


def for_role(connectors: DataFrame, role: str) -> DataFrame:
    """Connectors usable as ``source`` or ``target``: all but those only for the other."""
    other = {"source": "target", "target": "source"}[role]
    return connectors.filter(F.coalesce(F.col("role") != other, F.lit(True)))


def matching(df: DataFrame, **equal: str) -> DataFrame:
    """Rows whose columns equal the given values; ``all`` does not restrict."""
    for name, value in equal.items():
        if value != "all":
            df = df.filter(F.col(name) == value)
    return df


# Columns of a configuration and the values they take where nothing is stored.
DEFAULTS = {"sync_mode": "append", "match_mode": "all", "combine_mode": "union",
            "join_type": "inner", "role": "both", "direction": "cloud_bound"}


def with_defaults(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill unset configuration columns with their defaults."""
    names = [c for c in (columns or DEFAULTS) if c in df.columns]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(DEFAULTS[c])) for c in names})


def redacted(connectors: DataFrame) -> DataFrame:
    """Connectors as shown to users: no password, settings flattened."""
    config = F.col("config").dropFields("password")
    used = or_default(F.col("last_accessed"), F.col("created_at"))
    return connectors.select(
        "id", "name", "type", "category", "role", config["host"].alias("host"),
        config["port"].alias("port"), config["database"].alias("database"), "status",
        F.coalesce("tables_count", F.lit(0)).alias("tables_count"),
        used.alias("last_accessed"), "created_at",
    )


def without_secret(connectors: DataFrame) -> DataFrame:
    """Connectors with the password taken out of the nested settings."""
    return connectors.withColumn("config", F.col("config").dropFields("password"))


def with_connector(df: DataFrame, connectors: DataFrame, key: str) -> DataFrame:
    """Add the connector a row refers to by ``key``; unknown ids leave NULLs."""
    dim = connectors.select(
        F.col("id").alias("__cid"), F.col("name").alias("connector_name"),
        F.col("type").alias("connector_type"), F.col("category").alias("connector_category"),
    )
    return df.join(dim, F.col(key) == F.col("__cid"), "left").drop("__cid")


def destination_conditions(destinations: DataFrame, conditions: DataFrame) -> DataFrame:
    """Each destination with its conditions, one line per condition.

    A destination without conditions has one line with NULLs. Lines rather than
    an array per destination: nothing gathers a group in one task.
    """
    c = conditions.select(
        F.col("destination_id").alias("__did"), F.col("id").alias("condition_id"),
        "filter_column", "filter_operator", "filter_value",
    )
    return destinations.join(c, destinations.id == F.col("__did"), "left").drop("__did")


def distinct_ids(df: DataFrame, column: str) -> DataFrame:
    """Distinct ids in use, unset ones left out."""
    return df.filter(F.col(column).isNotNull() & (F.col(column) != "")).select(column).distinct()


def unresolved(df: DataFrame, connectors: DataFrame, key: str) -> DataFrame:
    """Rows referring to a connector that does not exist."""
    known = broadcast_if_small(connectors.select(F.col("id").alias("__cid")))
    return df.join(known, F.col(key) == F.col("__cid"), "left_anti")


