"""Loads: append, truncate-and-reload, and rewriting a table in place."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.plans.spec import SYNC_MODES, Target
from rowferry.session import discard, scratch_path, stage
from rowferry.sources.readers import (
    file_format, file_uri, is_relational, jdbc_options, json_names, read, require_supported, store_options,
)

#: Rows sent to a database per statement batch.
JDBC_BATCH_ROWS = "5000"


#: Types that a column may be widened to without losing a value.
_WIDER = {"tinyint": ("smallint", "int", "bigint", "double"), "smallint": ("int", "bigint", "double"),
          "int": ("bigint", "double"), "float": ("double",), "date": ("timestamp", "timestamp_ntz")}


def align(df: DataFrame, existing: T.StructType | list[str], policy: str = "strict") -> DataFrame:
    """Put ``df`` into a file table's existing columns.

    Missing columns become NULL of the table's type. A column the table does not
    have raises under ``'strict'`` and is dropped under ``'existing'``. Where
    types are given, one that differs is widened if that keeps every value and
    raises otherwise: a file with another type makes the table unreadable.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    fields = existing.fields if isinstance(existing, T.StructType) else [
        T.StructField(c, have.get(c, T.StringType())) for c in existing]
    surplus = [c for c in df.columns if c not in {f.name for f in fields}]
    if surplus and policy == "strict":
        raise ValueError(f"columns {surplus} are not in the target; use align='existing' to drop them")
    columns = []
    for f in fields:
        if f.name not in have:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        mine, want = have[f.name].simpleString(), f.dataType.simpleString()
        if mine not in (want, "void") and want not in _WIDER.get(mine, ()):
            raise ValueError(f"column {f.name} is {mine}, in the target it is {want}")
        column = F.col(f"`{f.name}`")
        columns.append(column if mine == want else column.cast(f.dataType).alias(f.name))
    return df.select(*columns)


def existing_columns(spark: SparkSession, target: Target) -> T.StructType | list[str] | None:
    """What a file target's columns are, or ``None`` where nothing was written yet.

    Parquet gives types, from a footer; of CSV a header and of JSON the first
    record are read, and give names, since any value can be written there.
    """
    fmt = file_format(target.table)
    try:
        if fmt == "parquet":
            return read(spark, target.connector, target.table).schema
        if fmt == "csv":
            return read(spark, target.connector, target.table, multi_line=False).columns or None
        return json_names(spark, file_uri(target.connector, target.table),
                          {**store_options(target.connector), **target.options}) or None
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def folder_of(spark: SparkSession, path: str) -> None:
    """Turn a single file at ``path`` into a folder that holds it, so that part files can be added.

    The file is moved aside, the folder made, and the file moved in; a failure
    between leaves it whole beside the folder, under a name that says so.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place) or not fs.getFileStatus(place).isFile():
        return
    suffix = path.rpartition(".")[2]
    aside = hadoop.Path(f"{path}.moving-{uuid.uuid4().hex}.{suffix}")
    if not (fs.rename(place, aside) and fs.mkdirs(place)
            and fs.rename(aside, hadoop.Path(place, f"part-00000-first.{suffix}"))):
        raise OSError(f"{path} could not be made a folder; its content is in {aside.toString()}")


def _flatten_for_csv(df: DataFrame) -> DataFrame:
    """CSV holds text only; nested values are written as JSON."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[
        F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested)
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def write(df: DataFrame, target: Target, mode: str = "append", align_policy: str = "strict",
          existing: T.StructType | list[str] | None = None) -> None:
    """Load ``df``.

    ``append`` adds rows without looking at keys; ``truncate_reload`` empties
    the target first. ``df`` must not read the target itself: stage it first.
    Appending to files adds part files and never rewrites what is there; a single
    file becomes the first part of a folder. ``existing`` gives the target's
    columns where they are known, so that they need not be looked up.
    """
    if mode not in SYNC_MODES:
        raise ValueError(f"mode must be one of {SYNC_MODES}")
    require_supported(target.connector)
    save_mode = "overwrite" if mode == "truncate_reload" else "append"
    if is_relational(target.connector):
        (
            df.write.format("jdbc")
            .options(**jdbc_options(target.connector, target.table, **target.options))
            .option("batchsize", JDBC_BATCH_ROWS).option("truncate", "true")
            .mode(save_mode).save()
        )
        return
    spark = df.sparkSession
    path, fmt = file_uri(target.connector, target.table), file_format(target.table)
    if mode == "append":
        columns = existing if existing is not None else existing_columns(spark, target)
        if existing is None and columns and fmt in ("json", "jsonl") and set(df.columns) - set(columns):
            # Later records may have columns that the first one lacks.
            columns = read(spark, target.connector, target.table, **target.options).columns
        if columns is not None:
            df = align(df, columns, align_policy)
        folder_of(spark, path)
    writer_options = {**store_options(target.connector), **target.options}
    if fmt == "csv":
        (
            _flatten_for_csv(df).write.options(**writer_options)
            .option("header", "true").option("escape", '"').mode(save_mode).csv(path)
        )
    elif fmt in ("json", "jsonl"):
        (
            df.write.options(**writer_options)
            .option("ignoreNullFields", "false").mode(save_mode).json(path)
        )
    else:
        df.write.options(**writer_options).mode(save_mode).parquet(path)


def truncate(spark: SparkSession, target: Target, schema: T.StructType) -> None:
    """Empty a target; one that is absent becomes an empty table."""
    write(spark.createDataFrame([], schema), target, "truncate_reload")


def rewrite_table(df: DataFrame, path: str) -> DataFrame:
    """Replace the Parquet table at ``path`` by ``df``, which may read it.

    The new rows are complete in the scratch folder before the old files go, so
    a failure while computing them leaves the table as it was.
    """
    spark = df.sparkSession
    place = scratch_path(spark, "rewrite")
    stage(df, "rewrite", place).write.mode("overwrite").parquet(path)
    discard(spark, place)
    return df.sparkSession.read.parquet(path)


def replace_partitions(snapshot: DataFrame, path: str, key: str) -> None:
    """Swap whole ``key`` partitions of a table partitioned by ``key``.

    Only partitions with rows in ``snapshot`` change; to clear one use
    :func:`rowferry.operators.lifecycle.replace_by_key`.
    """
    (
        snapshot.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(key).parquet(path)
    )


def scratch_target(spark: SparkSession, name: str) -> Target:
    """A file target in the scratch folder, for trials."""
    from rowferry.plans.spec import Connector

    return Target(Connector("file", scratch_path(spark, "target")), name)
