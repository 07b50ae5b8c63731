"""Extension: the latest change of each key from a stream whose changes arrive out of order.

The state of a key is the place in order of its newest change, not the change
itself. Keys are held in buckets, so that Python is called per bucket and works
on whole columns, not per key. A timer drops a key once every older change would
be late.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rowferry.operators.incremental import latest_changes, upsert

#: Keys are dealt to this many buckets by their hash; it stays as it is for the life of a checkpoint.
BUCKETS = 1024

# All six digits, so that a time comes back as it was.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _place(c: str, kind: T.DataType) -> tuple[Column, str]:
    """A column as a value that Python compares as Spark does, and its type."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(c).cast("timestamp")), "long"
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long"), "long"
    if isinstance(kind, T.IntegralType):
        return F.col(c).cast("long"), "long"
    raise ValueError(f"changes cannot be ordered by {c}, which is neither a time, a date nor a whole number")


def stream_latest(stream: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, checkpoint: str,
                  delay: timedelta, available_now: bool = True) -> StreamingQuery:
    """Write the changes that are the newest of their key so far to ``out/batch=<n>``.

    ``order`` begins with a time or date; further columns, whole numbers or
    times, settle ties, and together they should differ between changes of a
    key. Changes older than the newest time of all by more than ``delay`` are
    late and left out, as are those where a column of ``order`` is NULL; NULL
    keys are keys. A batch repeated after a failure overwrites its own folder.
    """
    kinds = [stream.schema[c].dataType for c in order]
    if not isinstance(kinds[0], (T.TimestampType, T.TimestampNTZType, T.DateType)):
        raise ValueError(f"{order[0]} must be a time or a date")
    places = [_place(c, k) for c, k in zip(order, kinds, strict=True)]
    names = [f"o{i}" for i in range(len(order))]
    key = F.to_json(F.struct(*[F.col(c) for c in keys]), {**_JSON, "ignoreNullFields": "false"})
    # A file may be one task to read; its changes are spread before any work on them, those of a hot key too.
    spread = stream.dropna(subset=list(order)).repartition(key, *[F.col(c) for c in order])
    changes = spread.select(
        key.alias("key"), F.col(order[0]).cast("timestamp").alias("at"),
        *[p.alias(n) for (p, _), n in zip(places, names, strict=True)],
        F.to_json(F.struct(*[F.col(c) for c in stream.columns]), _JSON).alias("change")).withColumn(
        "bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))

    def latest(pdf: pd.DataFrame) -> pd.DataFrame:
        # Of equal places the last one counts.
        return pdf.sort_values(names, kind="stable").drop_duplicates("key", keep="last")

    def fold(batches):
        # Before the shuffle, so that a key with many changes sends few.
        for pdf in batches:
            yield latest(pdf)

    folded = changes.mapInPandas(fold, changes.schema)
    wait = int(delay.total_seconds() * 1000)

    def newest(bucket, batches, state: GroupState):
        held, now = (_unpacked(state.get[0]) if state.exists else None), state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for pdf in batches:
                fresh = pdf[["key", *names, "change"]]
                # What is held comes last, so that a change has to be newer than it.
                held = latest(fresh if held is None else pd.concat([fresh, held], ignore_index=True))
            changed = held["change"].notna()
            if changed.any():
                yield held.loc[changed, ["change"]]
        # A key's time is up when the watermark has passed it, and a timer lasts for one call only.
        ends = _millis(held[names[0]], kinds[0]) + wait
        left = ends > now
        if not left.any():
            state.remove()
            return
        state.update((_packed(held.loc[left, ["key", *names]]),))
        state.setTimeoutTimestamp(max(int(ends[left].min()), now + 1))

    held = folded.withWatermark("at", f"{wait} milliseconds").groupBy("bucket").applyInPandasWithState(
        newest, "change string", "held binary", "update", GroupStateTimeout.EventTimeTimeout)
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.from_json("change", schema, _JSON).alias("c")).select("c.*").write.mode("overwrite").option(
            "partitionOverwriteMode", "static").parquet(f"{out}/batch={number}")

    writer = held.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _millis(place: pd.Series, kind: T.DataType) -> pd.Series:
    return place * 86_400_000 if isinstance(kind, T.DateType) else place // 1000


def _packed(held: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(held, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(held)).read_pandas().assign(change=None)


def apply_stream(spark: SparkSession, current: DataFrame, out: str, changes_schema: T.StructType,
                 keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``current`` with the latest change of each key that :func:`stream_latest` has written to ``out``."""
    written = spark.read.schema(changes_schema).parquet(f"{out}/batch=*")
    return upsert(current, latest_changes(written, keys, order), keys)
