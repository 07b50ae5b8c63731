from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rowferry.operators.incremental import latest_changes, upsert_latest
from rowferry.streaming.latest import apply_stream, stream_latest

CHANGES = "k long, at timestamp, no int, v string, big long, x double"


def lot(spark, folder, rows):
    spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out, offsets, delay):
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(folder)
    q = stream_latest(stream, ["k"], ["at", "no"], out, offsets, delay)
    q.awaitTermination()
    return q


def test_shuffled_arrival_equals_the_batch(spark, tmp_path):
    folder, out, offsets = (str(tmp_path / x) for x in ("in", "out", "offsets"))
    start = datetime(2024, 1, 1)
    rows = [(None if i % 11 == 0 else i % 7, start + timedelta(microseconds=i * 12_345_678 % 9_999_991), i,
             None if i % 4 == 0 else f"v{i}", 2**62 + i, float("nan") if i % 9 == 0 else i / 3) for i in range(300)]
    rows += [(3, start + timedelta(seconds=9, microseconds=999_999), n, f"tie {n}", n, 0.1) for n in range(3)]
    rows.append((1, None, 1, "no time", 1, 1.0))
    for i in range(0, 300, 100):  # restarted from its checkpoint with each lot
        lot(spark, folder, rows[::-1][i:i + 100] if i else rows[-104:])
        run(spark, folder, out, offsets, timedelta(days=1))
    lot(spark, folder, rows[:200])
    run(spark, folder, out, offsets, timedelta(days=1))
    every = spark.read.schema(CHANGES).parquet(folder).where("at is not null")
    current = spark.createDataFrame([(99, start, 0, "kept", 0, 0.0), (3, start, 0, "old", 0, 0.0)], CHANGES)
    got = apply_stream(spark, current, out, every.schema, ["k"], ["at", "no"])
    want = upsert_latest(current, every.dropDuplicates(["k", "at", "no"]), ["k"], ["at", "no"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    # Only what is newer than all before it of its key was written.
    written = spark.read.schema(CHANGES).parquet(f"{out}/batch=*")
    assert written.groupBy("k", "at", "no").count().where("count > 1").count() == 0
    assert latest_changes(written, ["k"], ["at", "no"]).where("v = 'tie 2'").count() == 1


def test_state_expires_and_late_changes_stay_out(spark, tmp_path):
    folder, out, offsets = (str(tmp_path / x) for x in ("in", "out", "offsets"))
    day = [datetime(2024, 1, d) for d in range(1, 29)]
    for rows in ([(1, day[0], 1, "first", 0, 0.0)], [(2, day[9], 1, "later", 0, 0.0)], [(2, day[10], 1, "later still", 0, 0.0)],
                 [(1, day[1], 1, "late", 0, 0.0), (3, day[10], 1, "in time", 0, 0.0)]):
        lot(spark, folder, rows)
        q = run(spark, folder, out, offsets, timedelta(days=2))
    left = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert left[-1] == 2  # key 1 is gone
    got = latest_changes(spark.read.schema(CHANGES).parquet(f"{out}/batch=*"), ["k"], ["at", "no"])
    assert {(r.k, r.v) for r in got.collect()} == {(1, "first"), (2, "later still"), (3, "in time")}


def test_order_must_be_comparable(spark, tmp_path):
    stream = spark.readStream.schema(CHANGES).parquet(str(tmp_path))
    for order in (["no"], ["at", "v"]):
        with pytest.raises(ValueError):
            stream_latest(stream.withColumn("n", F.lit(1)), ["k"], order, "x", "y", timedelta(1))


def test_many_keys_share_few_states(spark, tmp_path, monkeypatch):
    """Python is called per bucket of keys, not per key, and a bucket drops only those of its keys whose time is up."""
    monkeypatch.setattr("rowferry.streaming.latest.BUCKETS", 2)
    folder, out, offsets = (str(tmp_path / x) for x in ("in", "out", "offsets"))
    day = [datetime(2024, 1, d) for d in range(1, 29)]
    for rows in ([(k, day[0], k, "first", 0, 0.0) for k in range(500)], [(k, day[9], 1, "later", 0, 0.0) for k in range(0, 500, 2)],
                 [(1000, day[10], 1, "moves the watermark", 0, 0.0)],
                 [(1, day[1], 1, "late", 0, 0.0), (2, day[9], 1, "again", 0, 0.0), (4, day[9], 2, "newer", 0, 0.0)]):
        lot(spark, folder, rows)
        q = run(spark, folder, out, offsets, timedelta(days=2))
    left = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert left[-1] == 2
    written = spark.read.schema(CHANGES).parquet(f"{out}/batch=*")
    assert written.groupBy("v").count().rdd.map(tuple).collectAsMap() == {
        "first": 500, "later": 250, "moves the watermark": 1, "newer": 1}
