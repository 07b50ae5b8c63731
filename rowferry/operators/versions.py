"""Replacing the rows of keys without rewriting a table.

A replacement writes the new rows and the list of replaced keys as a version of
its own and then commits it by a file with one row. The current table is, for
each key, the rows of the version committed last; nothing written earlier is
touched. So readers see a replacement as a whole or not at all, replacements of
different keys at the same time both hold, and one that fails leaves no trace.

Below a place are ``rows`` and ``keys``, partitioned by version, and ``commits``.
Commits are ordered by their time; clocks of the writers should agree for
replacements of the same key.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.operators.sizing import broadcast_if_small

# ``folded`` is 1 for versions made by compact().
_COMMITS = "version string, at timestamp, folded int"


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def exists(spark: SparkSession, place: str) -> bool:
    """Whether anything was committed at ``place``."""
    return _there(spark, f"{place}/commits")


def replace_keys(rows: DataFrame, keys: DataFrame, key: str, place: str) -> str:
    """Replace all rows of the given ``keys`` by those of ``rows``; returns the version.

    Keys are listed apart from the rows, so a key without rows is cleared. Rows
    of keys that are not listed are not seen by readers. NULL is a key like others.
    """
    return _commit(rows, keys.select(key).distinct(), place, datetime.now(timezone.utc), 0)


def _commit(rows: DataFrame, keys: DataFrame, place: str, at: datetime | None, folded: int) -> str:
    # A letter in front, so that a name is never read as a number.
    version = f"v{uuid.uuid4().hex}"
    rows.write.parquet(f"{place}/rows/version={version}")
    keys.write.parquet(f"{place}/keys/version={version}")
    spark = rows.sparkSession
    at = at or datetime.now(timezone.utc)
    spark.createDataFrame([(version, at, folded)], _COMMITS).coalesce(1).write.mode("append").parquet(f"{place}/commits")
    return version


def _live(spark: SparkSession, place: str, key: str) -> DataFrame:
    """``__key, version`` of every key: the version that holds its rows."""
    # Commits are listed first: what they name is complete when it is listed after them.
    commits = spark.read.schema(_COMMITS).parquet(f"{place}/commits")
    keys = spark.read.parquet(f"{place}/keys")
    last = F.max_by("version", F.struct("at", "folded", "version"))
    return keys.join(broadcast_if_small(commits), "version").groupBy(F.col(key).alias("__key")).agg(last.alias("version"))


def current(spark: SparkSession, place: str, key: str, base: DataFrame | None = None) -> DataFrame:
    """The rows of every key's last version.

    ``base`` is a table from before the first version: its rows count for keys
    that no version has replaced. Columns are those of ``base`` and of the
    versions together; rows without one hold NULL there.
    """
    live = broadcast_if_small(_live(spark, place, key))
    rows = spark.read.option("mergeSchema", "true").parquet(f"{place}/rows").withColumnRenamed("version", "__version")
    held = rows.join(live, (F.col("__version") == F.col("version")) & F.col(key).eqNullSafe(F.col("__key")),
                     "left_semi").drop("__version")
    if base is None:
        return held
    untouched = base.join(live, F.col(key).eqNullSafe(F.col("__key")), "left_anti")
    return untouched.unionByName(held, allowMissingColumns=True)


def compact(spark: SparkSession, place: str, key: str) -> str:
    """Bring the rows of all keys into one version.

    It counts as old as the newest version it folds, so a replacement that is
    committed meanwhile still wins. A table nobody committed to raises.
    """
    commits = spark.read.schema(_COMMITS).parquet(f"{place}/commits")
    # As text: the session's time zone must not shift it.
    newest = commits.agg(F.unix_micros(F.max("at"))).first()[0]
    at = datetime.fromtimestamp(newest // 1_000_000, timezone.utc).replace(microsecond=newest % 1_000_000)
    keys = _live(spark, place, key).select(F.col("__key").alias(key))
    return _commit(current(spark, place, key), keys, place, at, 1)


def forget(spark: SparkSession, place: str, key: str, before: datetime) -> int:
    """Remove the files of versions that hold no key's rows any more; returns how many.

    Only those committed before ``before`` go: choose a time by which every
    reader of an older state has ended.
    """
    old = spark.read.schema(_COMMITS).parquet(f"{place}/commits").where(F.col("at") < F.lit(before))
    dead = old.join(_live(spark, place, key).select("version").distinct(), "version", "left_anti")
    removed = 0
    for row in dead.select("version").toLocalIterator():
        found = False
        # Keys last: while they are there, so are the rows they may name.
        for part in ("rows", "keys"):
            path = f"{place}/{part}/version={row.version}"
            if _there(spark, path):
                target = spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
                found = True
        removed += found
    return removed
