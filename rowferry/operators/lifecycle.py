"""Deletes, updates and replacements over the configuration tables.

Lists of ids are measured first: a small one is broadcast, so that the tables
and logs it applies to are scanned without a shuffle; a large one is joined.

Each takes frames and returns frames; write the result back with
:func:`rowferry.sources.writers.rewrite_table`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowferry.functions.coerce import key_part
from rowferry.operators.sizing import broadcast_if_small

# Tables whose rows go with their pipeline, and logs that stay
# with the reference cleared.
CHILD_TABLES = ("pipeline_nodes", "pipeline_edges", "schema_mappings", "pipeline_sources",
                "pipeline_destinations", "sync_runs")
KEPT_LOGS = ("metering_events", "audit_logs")
CONDITIONS = "pipeline_destination_conditions"


def delete_pipelines(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the pipelines listed in ``ids`` (one column ``id``).

    Children go too, conditions through their destination; log entries stay and
    lose the reference. Tables not passed in are ignored.
    """
    doomed = _gone(ids, "id")
    out = dict(tables)
    if "pipelines" in tables:
        out["pipelines"] = _without(tables["pipelines"], doomed, "id")
    for name in CHILD_TABLES:
        if name in tables:
            out[name] = _without(tables[name], doomed, "pipeline_id")
    if CONDITIONS in tables and "pipeline_destinations" in tables:
        dead = tables["pipeline_destinations"].join(
            doomed, F.col("pipeline_id") == F.col("__gone"), "left_semi"
        ).select("id")
        out[CONDITIONS] = delete_children(tables[CONDITIONS], dead, "destination_id")
    for name in KEPT_LOGS:
        if name in tables:
            out[name] = _clear(tables[name], doomed, "pipeline_id")
    return out


def _gone(ids: DataFrame, column: str) -> DataFrame:
    """Distinct ids as ``__gone``, broadcast if there are few."""
    return broadcast_if_small(ids.select(F.col(column).alias("__gone")).distinct())


def _without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone, F.col(key) == F.col("__gone"), "left_anti")


def _clear(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    joined = df.join(gone, F.col(key) == F.col("__gone"), "left")
    cleared = F.when(F.col("__gone").isNull(), F.col(key))
    return joined.select(*[cleared.alias(c) if c == key else F.col(c) for c in df.columns])


def delete_children(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is not among ``ids``; rows without a key stay."""
    return _without(df, _gone(ids, "id"), key)


def delete_destinations(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Destinations and their conditions without the ones listed in ``ids``."""
    out = dict(tables)
    doomed = _gone(ids, "id")
    out["pipeline_destinations"] = _without(tables["pipeline_destinations"], doomed, "id")
    out[CONDITIONS] = _without(tables[CONDITIONS], doomed, "destination_id")
    return out


def clear_reference(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Keep every row, with ``key`` set to NULL where it is among ``ids``."""
    return _clear(df, _gone(ids, "id"), key)


def referenced_connectors(tables: dict[str, DataFrame]) -> DataFrame:
    """Connectors in use as source or target, of a pipeline or of its extras."""
    uses = [
        tables["pipelines"].select(F.col("source_id").alias("__cid")),
        tables["pipelines"].select(F.col("target_id").alias("__cid")),
        tables["pipeline_sources"].select(F.col("source_id").alias("__cid")),
        tables["pipeline_destinations"].select(F.col("target_id").alias("__cid")),
    ]
    # Distinct first: partial aggregation shrinks the four lists before they move.
    used = reduce(DataFrame.unionAll, uses).distinct()
    return tables["connectors"].join(used, F.col("id") == F.col("__cid"), "left_semi")


def apply_updates(df: DataFrame, updates: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Overwrite ``columns`` with the non-NULL values of ``updates`` (unique by ``key``)."""
    new = updates.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = df.join(new, F.col(key) == F.col("__key"), "left")
    return joined.select(*[
        F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
        for c in df.columns
    ])


def replace_by_key(df: DataFrame, snapshot: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Drop all rows of the given ``keys``, then add the snapshot.

    The keys are listed apart from the snapshot, so an empty snapshot clears.
    """
    kept = _without(df, _gone(keys, key), key)
    return kept.unionByName(snapshot.select(*df.columns))


def upsert(df: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``changes`` (unique by ``keys``) replace those with the same keys."""
    new_keys = changes.select(*[F.col(k).alias(f"__k_{k}") for k in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return df.join(new_keys, on, "left_anti").unionByName(changes.select(*df.columns))


def composed_id(pipeline_id, part):
    """Stored id of a graph node or edge, from its pipeline and its own id."""
    return F.concat(F.lit("p_"), key_part(pipeline_id), F.lit("_"), key_part(part))
