"""Run a transfer: combine, map, load the primary target, fan out, account."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rowferry.operators.combine import Combined, combine
from rowferry.operators.fanout import (
    PRIMARY, destination_filter, fanout_rows, mapped_with_bytes,
)
from rowferry.plans.spec import SYNC_MODES, DestinationSpec, Mapping, SourceSpec, Target
from rowferry.session import discard, scratch_path, stage
from rowferry.sources.writers import write

RESULT_SCHEMA = "destination_id string, records bigint, bytes bigint"


@dataclass(frozen=True)
class Loaded:
    """What one target received."""

    destination_id: str
    records: int
    bytes: int


def needed_columns(mappings: Sequence[Mapping], destinations: Sequence[DestinationSpec]) -> list[str]:
    """Source columns that a mapping or a condition refers to."""
    names = [m.source_col for m in mappings]
    names += [c.column for d in destinations for c in d.conditions]
    return list(dict.fromkeys(names))


def can_change(df: DataFrame) -> bool:
    """Whether reading ``df`` twice may give different rows: anything but a scan of files."""
    return not df.inputFiles()


def stage_combined(combined: Combined, needed: Sequence[str], path: str | None = None) -> Combined:
    """Materialise just the needed columns once, in files every target then scans."""
    keep = [c for c in needed if c in combined.df.columns]
    flags = {c: p for c, p in combined.present.items() if c in keep}
    columns = [*[F.col(f"`{c}`") for c in keep], *[p.alias(f"__has.{c}") for c, p in flags.items()]]
    # Files need a column, and rows count also where no column of theirs is wanted.
    df = combined.df.select(*columns or [F.lit(True).alias("__row")])
    return Combined(stage(df, "combined", path), {c: F.col(f"`__has.{c}`") for c in flags})


def _load(combined: Combined, where, mappings, target: Target, mode: str, name: str,
          align_policy: str) -> Loaded:
    """Write one target, counting rows and bytes as they pass by."""
    part = combined if where is None else Combined(combined.df.filter(where), combined.present)
    seen = Observation()
    rows = mapped_with_bytes(part, mappings).observe(
        seen, F.count(F.lit(1)).alias("records"), F.sum("__bytes").alias("bytes")
    ).drop("__bytes")
    write(rows, target, mode, align_policy)
    got = seen.get
    return Loaded(name, got["records"] or 0, got["bytes"] or 0)


def run_sync(primary: DataFrame, mappings: Sequence[Mapping], target: Target,
             mode: str = "append", sources: Sequence[SourceSpec] = (),
             destinations: Sequence[DestinationSpec] = (), row_cap: int | None = None,
             compare: str = "loose", align_policy: str = "strict",
             staging: str = "auto", parallel: int = 1) -> list[Loaded]:
    """Move ``primary`` and its extra sources into ``target`` and the destinations.

    Returns one :class:`Loaded` per target, the primary one first.

    ``truncate_reload`` empties the primary target only, and only once all input
    has been read; the other destinations are always appended to. Staging writes
    the combined rows (needed columns only) to the scratch folder. ``auto`` does
    that where it pays or is required: before emptying a target, when joins
    would otherwise run again for each destination, and when several targets
    are to get the same rows of a source that can change. Without it every
    target scans the sources itself, its own filter pushed down. The staged rows
    are removed when the run ends.

    ``parallel`` loads that many destinations at the same time.
    """
    if mode not in SYNC_MODES:
        raise ValueError(f"mode must be one of {SYNC_MODES}")
    if not mappings:
        raise ValueError("a run needs at least one column mapping")
    if staging not in ("auto", "always", "never"):
        raise ValueError("staging must be 'auto', 'always' or 'never'")
    combined = combine(primary, sources, [m.source_col for m in mappings], row_cap)
    joined = any(s.mode == "join" for s in sources) or row_cap is not None
    required = mode == "truncate_reload"
    pays = destinations and (joined or any(map(can_change, [primary, *(s.df for s in sources)])))
    staged = None
    if required or staging == "always" or (staging == "auto" and pays):
        staged = scratch_path(primary.sparkSession, "combined")
    try:
        if staged:
            combined = stage_combined(combined, needed_columns(mappings, destinations), staged)
        return _load_all(combined, mappings, target, mode, destinations, compare, align_policy, parallel)
    finally:
        if staged:
            discard(primary.sparkSession, staged)


def _load_all(combined, mappings, target, mode, destinations, compare, align_policy, parallel) -> list[Loaded]:
    done = [_load(combined, None, mappings, target, mode, PRIMARY, align_policy)]

    def load(dest: DestinationSpec) -> Loaded:
        return _load(combined, destination_filter(combined, dest, compare), mappings,
                     dest.target, "append", dest.id, align_policy)

    if parallel > 1 and len(destinations) > 1:
        with ThreadPoolExecutor(parallel) as pool:
            done += pool.map(load, destinations)
    else:
        done += [load(d) for d in destinations]
    return done


def run_partitioned(primary: DataFrame, mappings: Sequence[Mapping], path: str,
                    sources: Sequence[SourceSpec] = (), destinations: Sequence[DestinationSpec] = (),
                    mode: str = "append", compare: str = "loose") -> DataFrame:
    """Load all destinations in one pass into one Parquet folder, partitioned by them.

    For many destinations on the same storage: the sources are read and joined
    once, nothing is staged, and ``path/destination_id=<id>`` holds the rows of a
    destination. ``truncate_reload`` replaces the whole folder, which must not be
    among the sources. Returns a scan of the folder.
    """
    if mode not in SYNC_MODES:
        raise ValueError(f"mode must be one of {SYNC_MODES}")
    combined = combine(primary, sources, [m.source_col for m in mappings])
    rows = fanout_rows(combined, mappings, destinations, compare)
    save_mode = "overwrite" if mode == "truncate_reload" else "append"
    rows.write.mode(save_mode).partitionBy("destination_id").parquet(path)
    # With the schema given, an id that looks like a number stays text.
    return primary.sparkSession.read.schema(rows.schema).parquet(path)


def result_frame(spark, loaded: Sequence[Loaded]) -> DataFrame:
    """One row per target."""
    return spark.createDataFrame([(x.destination_id, x.records, x.bytes) for x in loaded],
                                 RESULT_SCHEMA)
