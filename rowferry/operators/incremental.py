"""Extensions: incremental copies, upserts by latest change, value conflicts.

These are described as goals of such a tool but have no established results to
match; the definitions are this library's own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.functions.coerce import text_or_null
from rowferry.operators.lifecycle import upsert

POLICIES = ("keep_source", "keep_target", "merge", "skip")


def incremental(df: DataFrame, column: str, high_watermark) -> DataFrame:
    """Rows beyond the mark, a comparison the scan can use; all rows without one."""
    if high_watermark is None:
        return df
    return df.filter(F.col(column) > F.lit(high_watermark).cast(df.schema[column].dataType))


def next_watermark(df: DataFrame, column: str) -> DataFrame:
    """The mark to keep after loading ``df``, as text; NULL if nothing was loaded."""
    return df.agg(F.max(column).cast("string").alias("watermark"))


def _exists(spark, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def incremental_copy(df: DataFrame, column: str, keys: Sequence[str], place: str,
                     load: Callable[[DataFrame, int], None]) -> int:
    """Copy the rows of ``df`` that no earlier call has copied; returns how many batches there are now.

    The mark kept below the folder ``place`` is the largest value of ``column``
    copied so far together with the keys seen at that value, so a row that
    arrives later with the mark's own value is copied once. Rows behind the mark
    are taken as known; rows where ``column`` is NULL are never copied.

    ``load(rows, batch)`` gets the rows of one batch and its number. Rows are
    written down before they are loaded and the mark after that. If a call ends
    in between, the next one first loads the very same rows again under the same
    number, so a load that replaces what an earlier one of that number left
    behind gives every row exactly once. Without new rows nothing is loaded.
    """
    spark, number = df.sparkSession, 0
    while _exists(spark, f"{place}/batch={number + 1}/mark"):
        number += 1
    known = spark.read.parquet(f"{place}/batch={number}/mark") if number else None
    rows = f"{place}/batch={number + 1}/rows"
    if not _exists(spark, rows):
        new = df.where(F.col(column).isNotNull())
        if known is not None:
            at = known.agg(F.max("value")).first()[0]
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
            seen = known.select(F.col("value").alias("__value"), *[F.col(k).alias(f"__k_{k}") for k in keys])
            new = new.where(F.col(column) >= F.lit(at)).join(seen, (F.col(column) == F.col("__value")) & same, "left_anti")
        if new.limit(1).count() == 0:
            return number
        new.write.mode("overwrite").parquet(rows)
    batch = spark.read.parquet(rows)
    load(batch, number + 1)
    top = batch.agg(F.max(column)).first()[0]
    mark = batch.where(F.col(column) == F.lit(top)).select(F.col(column).alias("value"), *keys)
    if known is not None:
        mark = mark.union(known.where(F.col("value") == F.lit(top)).select("value", *keys))
    mark.write.mode("overwrite").parquet(f"{place}/batch={number + 1}/mark")
    return number + 1


def latest_changes(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last change per key. An aggregate, so a key with many changes folds map-side."""
    newest = F.max_by(F.struct(*[F.col(c) for c in changes.columns]),
                      F.struct(*[F.col(c) for c in order]))
    return changes.groupBy(*[F.col(k).alias(f"__g_{k}") for k in keys]).agg(
        newest.alias("row")).select("row.*")


def upsert_latest(current: DataFrame, changes: DataFrame, keys: Sequence[str],
                  order: Sequence[str]) -> DataFrame:
    """``current`` with the last change of each key applied."""
    return upsert(current, latest_changes(changes, keys, order), keys)


def conflicts(source: DataFrame, target: DataFrame, keys: Sequence[str], table: str,
              policy: str = "keep_source", one_sided: bool = False) -> DataFrame:
    """Values that differ between rows present on both sides, with their resolution.

    With ``one_sided`` rows that only one side has count too, each of their
    values against NULL. ``merge`` takes the source value where there is one; ``skip`` resolves
    nothing. Keys must be unique on either side.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    values = [c for c in source.columns if c not in keys and c in target.columns]
    other = target.select(*[F.col(c).alias(f"__t_{c}") for c in [*keys, *values]])
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__t_{k}") for k in keys])
    joined = source.join(other, on, "full" if one_sided else "inner")
    names = [F.coalesce(F.col(k), F.col(f"__t_{k}")).alias(k) if one_sided else F.col(k) for k in keys]

    def entry(c: str) -> Column:
        s = text_or_null(F.col(c), source.schema[c].dataType)
        t = text_or_null(F.col(f"__t_{c}"), target.schema[c].dataType)
        resolved = {"keep_source": s, "keep_target": t, "merge": F.coalesce(s, t),
                    "skip": F.lit(None).cast("string")}[policy]
        return F.when(~s.eqNullSafe(t), F.struct(
            F.lit(c).alias("column_name"), s.alias("source_value"), t.alias("target_value"),
            resolved.alias("resolved_value")))

    found = F.array_compact(F.array(*[entry(c) for c in values]))
    return joined.select(F.lit(table).alias("table_name"), *names, F.inline(found)).withColumn(
        "resolution", F.lit(policy))
