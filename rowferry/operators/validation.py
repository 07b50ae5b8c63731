"""Configuration rules as scans that report what breaks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.plans.spec import (
    COMBINE_MODES, CONNECTOR_ROLES, JOIN_TYPES, MATCH_MODES, OPERATORS, SYNC_MODES,
)

# Messages of the rules.
MESSAGES = {
    "pipeline_required": "name, source/target connector, and source/target table are required",
    "sync_mode": 'sync_mode must be "append" or "truncate_reload"',
    "source_required": "source_id and source_table are required",
    "combine_mode": 'combine_mode must be "union" or "join"',
    "join_columns": 'join_column and primary_join_column are required for combine_mode "join"',
    "join_type": 'join_type must be "inner" or "left"',
    "destination_required": "target_id, target_table, filter_column, filter_operator, and filter_value are required",
    "condition_required": "filter_column, filter_operator, and filter_value are required",
    "filter_operator": "filter_operator must be one of: " + ", ".join(OPERATORS),
    "match_mode": 'match_mode must be "all" or "any"',
    "connector_required": "name, type, and category are required",
    "role": 'role must be "source", "target", or "both"',
}


def _unset(*columns: str) -> Column:
    test = F.lit(False)
    for c in columns:
        test = test | F.col(c).isNull() | (F.col(c) == "")
    return test


def _not_among(column: str, allowed) -> Column:
    """Set to something else; unset is fine."""
    c = F.col(column)
    return c.isNotNull() & (c != "") & ~c.isin(*allowed)


def _rules(kind: str) -> dict[str, Column]:
    if kind == "pipelines":
        return {
            "pipeline_required": _unset("name", "source_id", "target_id", "source_table", "target_table"),
            "sync_mode": _not_among("sync_mode", SYNC_MODES),
        }
    if kind == "pipeline_sources":
        return {
            "source_required": _unset("source_id", "source_table"),
            "combine_mode": _not_among("combine_mode", COMBINE_MODES),
            "join_columns": (F.col("combine_mode") == "join") & _unset("join_column", "primary_join_column"),
            "join_type": _not_among("join_type", JOIN_TYPES),
        }
    if kind == "pipeline_destinations":
        return {
            "destination_required": _unset("target_id", "target_table", "filter_column",
                                           "filter_operator", "filter_value"),
            "filter_operator": _not_among("filter_operator", OPERATORS),
            "match_mode": _not_among("match_mode", MATCH_MODES),
        }
    if kind == "pipeline_destination_conditions":
        return {
            "condition_required": _unset("filter_column", "filter_operator", "filter_value"),
            "filter_operator": _not_among("filter_operator", OPERATORS),
        }
    if kind == "connectors":
        return {
            "connector_required": _unset("name", "type", "category"),
            "role": _not_among("role", CONNECTOR_ROLES),
        }
    raise ValueError(f"no rules for {kind}")


def violations(df: DataFrame, kind: str) -> DataFrame:
    """One line per row and broken rule: table, id, rule, message."""
    found = F.array_compact(F.array(*[
        F.when(bad, F.struct(F.lit(rule).alias("rule"), F.lit(MESSAGES[rule]).alias("message")))
        for rule, bad in _rules(kind).items()
    ]))
    return df.select(F.lit(kind).alias("table"), F.col("id").cast("string").alias("id"),
                     F.inline(found))


def all_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations over several configuration tables."""
    frames = [violations(df, kind) for kind, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
