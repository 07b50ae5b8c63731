"""Copies that lose nothing at the mark and repeat nothing after a failure; appends to JSON; repeated stream batches."""

import json

import pytest
from pyspark.sql import functions as F

from rowferry.operators.incremental import incremental_copy
from rowferry.plans.spec import Connector, Target
from rowferry.sources.readers import read
from rowferry.sources.writers import write


@pytest.fixture
def copy(spark, tmp_path):
    def run(rows, fail=False):
        df = spark.createDataFrame(rows, "id long, at long, v string")

        def load(batch, number):
            batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={number}"))
            if fail:
                raise OSError("lost")

        return incremental_copy(df, "at", ["id"], str(tmp_path / "mark"), load)

    run.rows = lambda: sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "at").collect())
    return run


def test_late_rows_with_the_marks_value_arrive_once(copy):
    assert copy([(1, 5, "a"), (2, 7, "b")]) == 1
    assert copy([(1, 5, "a"), (2, 7, "b"), (3, 7, "late")]) == 2
    assert copy([(1, 5, "a"), (2, 7, "b"), (3, 7, "late"), (4, 7, "later")]) == 3
    assert copy([(1, 5, "a"), (2, 7, "b"), (3, 7, "late"), (4, 7, "later")]) == 3
    assert copy([(2, 7, "b"), (5, 9, "new"), (6, None, "no value")]) == 4
    assert copy.rows() == [(1, 5), (2, 7), (3, 7), (4, 7), (5, 9)]


def test_a_failed_load_is_repeated_with_the_same_rows(copy):
    copy([(1, 5, "a")])
    with pytest.raises(OSError):
        copy([(1, 5, "a"), (2, 6, "b")], fail=True)
    # What has come meanwhile waits for the next batch.
    assert copy([(1, 5, "a"), (2, 6, "b"), (3, 6, "c")]) == 2
    assert copy.rows() == [(1, 5), (2, 6)]
    assert copy([(1, 5, "a"), (2, 6, "b"), (3, 6, "c")]) == 3
    assert copy.rows() == [(1, 5), (2, 6), (3, 6)]


def test_null_keys_at_the_mark(copy):
    assert copy([(None, 1, "a")]) == 1 and copy([(None, 1, "a")]) == 1


@pytest.mark.parametrize("policy", ["strict", "existing"])
def test_json_appends_keep_columns_that_later_records_have(spark, tmp_path, policy):
    (tmp_path / "t.json").write_text(json.dumps({"a": 1}) + "\n" + json.dumps({"a": 2, "b": "x"}) + "\n")
    target = Target(Connector("file", str(tmp_path)), "t.json")
    write(spark.createDataFrame([(3, "y")], "a long, b string"), target, align_policy=policy)
    found = read(spark, target.connector, target.table).select("a", "b").collect()
    assert sorted(map(tuple, found)) == [(1, None), (2, "x"), (3, "y")]
    if policy == "strict":
        with pytest.raises(ValueError, match="not in the target"):
            write(spark.createDataFrame([(3, "y")], "a long, c string"), target)


def test_a_repeated_batch_leaves_nothing_behind_in_dynamic_mode(spark, tmp_path):
    from rowferry.plans.spec import Mapping
    from rowferry.streaming.live import stream_fanout

    spark.range(4).withColumn("kind", F.lit("a")).write.parquet(str(tmp_path / "in"))
    stale = tmp_path / "out/batch=0/destination_id=gone"
    spark.range(1).write.parquet(str(stale))
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        stream = spark.readStream.schema("id long, kind string").parquet(str(tmp_path / "in"))
        stream_fanout(stream, [Mapping("id", "id")], [], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert not stale.exists() and spark.read.parquet(str(tmp_path / "out")).count() == 4
