"""Column mapping: rename, reorder, drop, optionally convert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.plans.spec import Mapping


def _winners(mappings: Sequence[Mapping]) -> list[Mapping]:
    """One mapping per target: the last one wins, at the place of the first."""
    by_target: dict[str, Mapping] = {}
    for m in mappings:
        by_target[m.target_col] = m
    return list(by_target.values())


def mapping_columns(df: DataFrame, mappings: Sequence[Mapping]) -> list[Column]:
    """The select list of a mapping; an unknown source column is NULL."""
    have = set(df.columns)
    out = []
    for m in _winners(mappings):
        c = F.col(f"`{m.source_col}`") if m.source_col in have else F.lit(None).cast("string")
        out.append((c.try_cast(m.cast_to) if m.cast_to else c).alias(m.target_col))
    return out


def remap(df: DataFrame, mappings: Sequence[Mapping]) -> DataFrame:
    """Rows under their target names."""
    return df.select(*mapping_columns(df, mappings))


def remap_present(present: dict[str, Column], columns: Sequence[str],
                  mappings: Sequence[Mapping]) -> dict[str, Column]:
    """Presence of each *target* column, given that of the source columns."""
    out = {}
    for m in _winners(mappings):
        if m.source_col not in columns:
            out[m.target_col] = F.lit(False)
        elif m.source_col in present:
            out[m.target_col] = present[m.source_col]
    return out


def cast_failures(df: DataFrame, mappings: Sequence[Mapping]) -> DataFrame:
    """Values per converted column that could not be converted, in one pass."""
    casts = [m for m in _winners(mappings) if m.cast_to and m.source_col in df.columns]
    counts = df.agg(*[
        F.count_if(F.col(f"`{m.source_col}`").isNotNull()
                   & F.col(f"`{m.source_col}`").try_cast(m.cast_to).isNull()).alias(m.target_col)
        for m in casts
    ])
    entries = F.array(*[
        F.struct(F.lit(m.target_col).alias("target_col"), F.lit(m.cast_to).alias("cast_to"),
                 F.col(f"`{m.target_col}`").alias("failed"))
        for m in casts
    ])
    return counts.select(F.inline(entries))
