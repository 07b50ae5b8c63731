from datetime import datetime, timezone

from pyspark.sql import functions as F

from rowferry.operators import versions

ROWS = "k string, v int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_last_commit_of_a_key_counts(spark, tmp_path):
    place = str(tmp_path / "t")
    base = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), (None, 1)], ROWS)
    assert not versions.exists(spark, place)

    def put(data, keys):
        versions.replace_keys(spark.createDataFrame(data, ROWS), spark.createDataFrame([(k,) for k in keys], "k string"), "k", place)

    put([("a", 2), ("a", 3)], ["a"])
    put([("b", 9), ("z", 9)], ["b", "b"])  # z is not listed, so it is not seen
    assert rows(versions.current(spark, place, "k", base)) == [("a", 2), ("a", 3), ("b", 9), ("c", 1), (None, 1)]
    put([], ["a"])
    put([(None, 5)], [None])
    assert rows(versions.current(spark, place, "k", base)) == [("b", 9), ("c", 1), (None, 5)]
    assert rows(versions.current(spark, place, "k")) == [("b", 9), (None, 5)]


def test_uncommitted_rows_are_not_seen(spark, tmp_path):
    place = str(tmp_path / "t")
    versions.replace_keys(spark.createDataFrame([("a", 1)], ROWS), spark.createDataFrame([("a",)], "k string"), "k", place)
    spark.createDataFrame([("a", 7)], ROWS).write.parquet(f"{place}/rows/version=vbroken")
    spark.createDataFrame([("a",)], "k string").write.parquet(f"{place}/keys/version=vbroken")
    assert rows(versions.current(spark, place, "k")) == [("a", 1)]


def test_a_reader_sees_the_state_it_began_with(spark, tmp_path):
    place = str(tmp_path / "t")
    one = spark.createDataFrame([("a",)], "k string")
    versions.replace_keys(spark.createDataFrame([("a", 1)], ROWS), one, "k", place)
    before = versions.current(spark, place, "k")
    versions.replace_keys(spark.createDataFrame([("a", 2)], ROWS), one, "k", place)
    assert rows(before) == [("a", 1)] and rows(versions.current(spark, place, "k")) == [("a", 2)]


def test_compact_and_forget(spark, tmp_path):
    place = str(tmp_path / "t")
    for i in range(3):
        for k in ("a", "b"):
            versions.replace_keys(spark.createDataFrame([(k, i)], ROWS), spark.createDataFrame([(k,)], "k string"), "k", place)
    folded = versions.compact(spark, place, "k")
    assert rows(versions.current(spark, place, "k")) == [("a", 2), ("b", 2)]
    assert {r.version for r in versions._live(spark, place, "k").collect()} == {folded}
    far = datetime(2999, 1, 1, tzinfo=timezone.utc)
    assert versions.forget(spark, place, "k", far) == 6 and versions.forget(spark, place, "k", far) == 0
    assert rows(versions.current(spark, place, "k")) == [("a", 2), ("b", 2)]
    # What is committed after the newest folded version wins over the fold, also if it came before the fold ended.
    versions.replace_keys(spark.createDataFrame([("a", 8)], ROWS), spark.createDataFrame([("a",)], "k string"), "k", place)
    assert rows(versions.current(spark, place, "k")) == [("a", 8), ("b", 2)]


def test_later_columns(spark, tmp_path):
    place = str(tmp_path / "t")
    versions.replace_keys(spark.createDataFrame([("a", 1)], ROWS), spark.createDataFrame([("a",)], "k string"), "k", place)
    versions.replace_keys(spark.createDataFrame([("b", 1, 2)], ROWS + ", w int"), spark.createDataFrame([("b",)], "k string"), "k", place)
    found = versions.current(spark, place, "k").select("k", "v", "w")
    assert rows(found) == [("a", 1, None), ("b", 1, 2)] and found.where(F.col("w").isNull()).count() == 1
