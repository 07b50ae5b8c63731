import base64

import pytest
from pyspark.sql import functions as F

from rowferry.operators.secure import KeyRing, encrypt
from rowferry.session import stage

ONE, TWO = (base64.b64encode(bytes([i]) * 32).decode() for i in (7, 9))


def test_two_keys_in_one_table(spark):
    old, new = KeyRing(spark, {"k1": ONE}, "k1"), KeyRing(spark, {"": ONE, "k1": ONE, "k2": TWO}, "k2")
    texts = spark.createDataFrame([("a",), ("",), (None,), ("ä.b.c.d",)], "t string")
    texts = texts.withColumn("v", F.col("t"))
    sealed = stage(old.seal(texts, "v").union(new.seal(texts, "v")).union(texts.withColumn("v", encrypt(F.col("v"), ONE))))
    moved = stage(new.reseal(sealed, "v"))
    assert sealed.where("v is not null").select(F.size(F.split("v", "[.]")).alias("n")).groupBy("n").count().count() == 2
    back = new.open(sealed, "v").collect() + new.open(moved, "v").collect()
    assert len(back) == 24 and all(r.v == r.t for r in back)
    assert {r.id for r in moved.select(F.substring_index("v", ".", 1).alias("id")).collect()} == {None, "k2"}


def test_values_under_the_current_key_stay(spark):
    ring = KeyRing(spark, {"k1": ONE}, "k1")
    row = ring.seal(spark.createDataFrame([("x",)], "v string"), "v").first().v
    kept = ring.reseal(spark.createDataFrame([(row,)], "v string"), "v").first().v
    assert kept == row


def test_no_key_in_a_plan(spark):
    ring = KeyRing(spark, {"k1": ONE, "k2": TWO}, "k2")
    df = ring.open(ring.reseal(ring.seal(spark.createDataFrame([("a",)], "v string"), "v"), "v"), "v")
    df.collect()
    plan = df._jdf.queryExecution().toString() + df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended"))
    for key in (ONE, TWO):
        raw = base64.b64decode(key)
        assert key not in plan and raw.hex().upper() not in plan.upper()


def test_wrong_rings(spark):
    sealed = KeyRing(spark, {"k1": ONE}, "k1").seal(spark.createDataFrame([("x",)], "v string"), "v")
    with pytest.raises(Exception, match="no key of id k1"):
        KeyRing(spark, {"k2": TWO}, "k2").open(sealed, "v").collect()
    for keys, current in (({"k1": ONE}, "k2"), ({"": ONE}, ""), ({"a.b": ONE}, "a.b"), ({"k": "c2hvcnQ="}, "k")):
        with pytest.raises(ValueError):
            KeyRing(spark, keys, current)
