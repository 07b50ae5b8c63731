"""Which destination gets which rows, and how much that is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.functions.coerce import row_bytes
from rowferry.operators.combine import Combined
from rowferry.operators.predicates import conditions
from rowferry.operators.remap import mapping_columns, remap, remap_present
from rowferry.plans.spec import DestinationSpec, Mapping

PRIMARY = "primary"


def destination_filter(combined: Combined, dest: DestinationSpec, compare: str = "loose") -> Column:
    """Rows a destination wants. Conditions see source columns, before mapping."""
    return conditions(combined.df.schema, dest.conditions, dest.match_mode, compare,
                      combined.present)


def destination_rows(combined: Combined, dest: DestinationSpec, mappings: Sequence[Mapping],
                     compare: str = "loose") -> DataFrame:
    """The mapped rows of one destination; its filter can reach the source scan."""
    return remap(combined.df.filter(destination_filter(combined, dest, compare)), mappings)


def fanout_rows(combined: Combined, mappings: Sequence[Mapping],
                destinations: Sequence[DestinationSpec] = (), compare: str = "loose",
                carry: Sequence[Column] = ()) -> DataFrame:
    """Every mapped row once for the primary target and once per destination it meets.

    ``destination_id`` says for whom. One pass whatever the number of
    destinations; rows are repeated where they are, nothing is shuffled.
    """
    wanted = F.array_compact(F.array(F.lit(PRIMARY), *[
        F.when(destination_filter(combined, d, compare), F.lit(d.id)) for d in destinations
    ]))
    return combined.df.select(F.explode(wanted).alias("destination_id"),
                              *mapping_columns(combined.df, mappings), *carry)


def mapped_with_bytes(combined: Combined, mappings: Sequence[Mapping],
                      carry: Sequence[Column] = ()) -> DataFrame:
    """Mapped rows with ``__bytes``, the serialized size of each, and ``carry``.

    The carried expressions are evaluated on the source columns.
    """
    mapped = remap(combined.df, mappings)
    present = remap_present(combined.present, combined.df.columns, mappings)
    # Source and target may share names, so presence travels beside the mapped
    # columns until the size is known.
    flags = {c: f"__has_target.{c}" for c in present}
    rows = combined.df.select(*mapping_columns(combined.df, mappings),
                              *[p.alias(flags[c]) for c, p in present.items()], *carry)
    size = row_bytes(mapped.schema, {c: F.col(f"`{f}`") for c, f in flags.items()})
    return rows.withColumn("__bytes", size).drop(*flags.values())


def fanout_summary(combined: Combined, mappings: Sequence[Mapping],
                   destinations: Sequence[DestinationSpec] = (),
                   compare: str = "loose") -> DataFrame:
    """Rows and bytes for the primary target and each destination, in one pass.

    Every destination is a pair of conditional aggregates over the same scan, so
    neither caching nor a second read is needed, and each task sends one row.
    """
    wants = [destination_filter(combined, d, compare).alias(f"__d{i}")
             for i, d in enumerate(destinations)]
    rows = mapped_with_bytes(combined, mappings, wants)
    size = F.col("__bytes")
    totals = [F.count(F.lit(1)).alias("r"), F.coalesce(F.sum(size), F.lit(0)).alias("b")]
    for i in range(len(destinations)):
        hit = F.col(f"__d{i}")
        totals += [
            F.count_if(hit).alias(f"r{i}"),
            F.coalesce(F.sum(F.when(hit, size)), F.lit(0)).alias(f"b{i}"),
        ]
    names = [PRIMARY, *[d.id for d in destinations]]
    suffixes = ["", *map(str, range(len(destinations)))]
    entries = F.array(*[
        F.struct(F.lit(n).alias("destination_id"), F.col("r" + s).alias("records"),
                 F.col("b" + s).alias("bytes"))
        for n, s in zip(names, suffixes)
    ])
    return rows.agg(*totals).select(F.inline(entries))


def run_totals(summary: DataFrame) -> DataFrame:
    """Records and bytes over the primary target and all destinations."""
    return summary.agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("total_records"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
    )
