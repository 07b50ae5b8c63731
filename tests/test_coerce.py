import json
import math

import pytest
from pyspark.sql import functions as F

from rowferry.functions.coerce import (
    fixed_text, key_part, literal_number, number_of, round_half_up, row_bytes, text_of,
)
from rowferry.functions.pricing import run_cost, usage_gb


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", fn(F.col("v"), df.schema["v"].dataType).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


NUMBERS = [("12", 12.0), (" 7.5 ", 7.5), ("abc", None), ("", 0.0), (None, 0.0), ("1e3", 1000.0),
           ("12d", None), (".5", 0.5), ("5.", 5.0), ("\t\n", 0.0), ("-3", -3.0), ("+4", 4.0)]


def test_numbers_from_text(spark):
    assert column(spark, [v for v, _ in NUMBERS], "string", number_of) == [r for _, r in NUMBERS]


def test_literal_numbers_follow_the_same_rule():
    for text, want in NUMBERS:
        if text is not None:
            assert literal_number(text) == want


def test_numbers_from_other_types(spark):
    assert column(spark, [True, False, None], "boolean", number_of) == [1.0, 0.0, 0.0]
    assert column(spark, [5, None], "bigint", number_of) == [5.0, 0.0]
    assert column(spark, [1.5, math.nan, None], "double", number_of) == [1.5, None, 0.0]


def test_text_of_doubles_is_plain(spark):
    got = column(spark, [100.0, 0.1, 12345678.9, 1e-5, -0.0, 309974.59, 1e16, None, -2.5], "double", text_of)
    assert got == ["100", "0.1", "12345678.9", "0.00001", "0", "309974.59", "10000000000000000", "", "-2.5"]


def test_text_of_other_types(spark):
    assert column(spark, [True, None], "boolean", text_of) == ["true", ""]
    assert column(spark, [7, None], "int", text_of) == ["7", ""]


def test_halves_round_up(spark):
    got = column(spark, [-2.5, 2.5, 0.5, -0.5, 1.4], "double", lambda c, _: round_half_up(c))
    assert got == [-2.0, 3.0, 1.0, 0.0, 1.0]
    assert column(spark, [1.25, 98.765], "double", lambda c, _: round_half_up(c, 1)) == [1.3, 98.8]


TEXTS = ['plain', 'quote " and \\ slash', 'line\nbreak\ttab', 'bell\x07 null\x00', 'ünïcode 😀 →', '', None]


def test_row_bytes_equal_json(spark):
    rows = [(i, t, i / 4, i % 2 == 0, None) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id int, `na\"me` string, x double, ok boolean, nothing string")
    got = [r.n for r in df.select("id", row_bytes(df.schema).alias("n")).orderBy("id").collect()]

    def compact(r):
        record = dict(zip(df.columns, r))
        x = record["x"]
        record["x"] = int(x) if x == int(x) else x
        return len(json.dumps(record, separators=(",", ":"), ensure_ascii=False).encode())

    # The standard escapes \\b and \\f are two bytes in both; controls six.
    assert got == [compact(r) for r in rows]


def test_row_bytes_leave_out_absent_columns(spark):
    df = spark.createDataFrame([(1, "a", True), (2, None, False)], "id int, v string, has boolean")
    size = row_bytes(df.select("id", "v").schema, {"v": F.col("has")})
    got = [r.n for r in df.select("id", size.alias("n")).orderBy("id").collect()]
    assert got == [len('{"id":1,"v":"a"}'), len('{"id":2}')]
    only = row_bytes(df.select("v").schema, {"v": F.col("has")})
    assert [r.n for r in df.select("id", only.alias("n")).orderBy("id").collect()] == [len('{"v":"a"}'), 2]


def test_usage_of_the_measured_transfer(spark):
    df = spark.createDataFrame([(24209,), (0,), (None,)], "b bigint")
    assert [str(r.g) if r.g is not None else None for r in df.select(usage_gb(F.col("b")).alias("g")).collect()] == [
        "0.000022546388", None, None]


def test_cost_defaults_to_the_cloud_rate(spark):
    df = spark.createDataFrame([("on_prem_bound",), ("unknown",), (None,)], "d string")
    got = [r.c for r in df.select(run_cost(F.col("d"), F.lit(20000), F.lit(30000)).alias("c")).collect()]
    assert got == [pytest.approx(0.525), pytest.approx(0.21), pytest.approx(0.21)]


def test_fixed_text_and_key_part(spark):
    r = spark.range(1).select(fixed_text(F.lit(1.005), 1).alias("t"), key_part(F.lit("a b/ü")).alias("k")).first()
    assert (r.t, r.k) == ("1.0", "a%20b%2F%C3%BC")
