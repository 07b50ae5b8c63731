import itertools

import pytest
from pyspark.sql import functions as F

from rowferry.functions.coerce import literal_number
from rowferry.operators.predicates import condition, conditions, flag
from rowferry.plans.spec import Condition


def expected(value, kind, op, text):
    """Loose comparison, row by row."""
    if value is None:
        shown, number = "", 0.0
    elif kind == "boolean":
        shown, number = str(value).lower(), float(value)
    elif kind == "string":
        shown, number = value, literal_number(value)
    else:
        number = float(value)
        shown = str(int(value)) if float(value).is_integer() else repr(float(value))
    if op == "=":
        return shown == text
    if op == "!=":
        return shown != text
    if op == "contains":
        return text.lower() in shown.lower()
    bound = literal_number(text)
    if number is None or bound is None:
        return False
    return {">": number > bound, "<": number < bound, ">=": number >= bound, "<=": number <= bound}[op]


VALUES = {
    "string": ["", None, "5", "5.0", " 7 ", "APAC", "apac", "x5y", "1e2"],
    "int": [0, 5, -3, None, 100],
    "bigint": [0, 5, None, 2**53],
    "double": [0.0, 5.0, 5.5, -0.25, None, 100.0, 1234567.125],
    "boolean": [True, False, None],
    "decimal(10,2)": [],
}
TEXTS = ["", "5", "5.0", "05", "-3", "0", "100", "apac", "true", "1e2", "5.5", " 5 ", "-0.25", "a"]
OPS = ["=", "!=", ">", "<", ">=", "<=", "contains"]


@pytest.mark.parametrize("kind", ["string", "int", "bigint", "double", "boolean"])
def test_every_operator_on_every_type(spark, kind):
    values = VALUES[kind]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    cases = list(itertools.product(OPS, TEXTS))
    columns = [flag(condition(df.schema, Condition("v", op, t))).alias(f"c{n}") for n, (op, t) in enumerate(cases)]
    for row in df.select("i", *columns).collect():
        for n, (op, text) in enumerate(cases):
            want = expected(values[row.i], kind, op, text)
            assert row[f"c{n}"] == want, (kind, values[row.i], op, text)


def test_decimal_text(spark):
    df = spark.sql("select cast(5.50 as decimal(10,2)) v union all select cast(7.00 as decimal(10,2))")
    assert df.filter(condition(df.schema, Condition("v", "=", "5.5"))).count() == 1
    assert df.filter(condition(df.schema, Condition("v", "=", "7"))).count() == 1


G_FILTER = [("APAC", 100), ("APAC", 80), ("EMEA", 40), ("US", 95), (None, None)]


def test_all_and_any(spark):
    df = spark.createDataFrame(G_FILTER, "region string, amount int")
    apac, big = Condition("region", "=", "APAC"), Condition("amount", ">", "90")
    emea = Condition("region", "=", "EMEA")
    assert [tuple(r) for r in df.filter(conditions(df.schema, [apac, big])).collect()] == [("APAC", 100)]
    either = df.filter(conditions(df.schema, [emea, big], "any")).collect()
    assert sorted(tuple(r) for r in either) == [("APAC", 100), ("EMEA", 40), ("US", 95)]
    assert df.filter(conditions(df.schema, [])).count() == 5


def test_any_contains_all(spark):
    df = spark.createDataFrame(G_FILTER, "region string, amount int")
    conds = [Condition("region", "!=", "US"), Condition("amount", "<=", "90")]
    both = df.select(flag(conditions(df.schema, conds)).alias("a"), flag(conditions(df.schema, conds, "any")).alias("o"))
    assert both.filter("a and not o").count() == 0


def test_absent_columns_and_unknown_operators(spark):
    df = spark.createDataFrame([(1,)], "v int")

    def holds(*c):
        return df.filter(condition(df.schema, Condition(*c))).count() == 1

    assert holds("nope", "!=", "x") and holds("nope", "=", "") and holds("nope", "contains", "")
    assert not holds("nope", "=", "x") and not holds("nope", ">", "-1") and not holds("v", "like", "1")


def test_dates_compare_as_epoch_unless_typed(spark):
    df = spark.sql("select timestamp '2024-01-01 00:00:00' as ts")
    assert df.filter(condition(df.schema, Condition("ts", ">", "2023-01-01"))).count() == 0
    assert df.filter(condition(df.schema, Condition("ts", ">=", "1704067200000"))).count() == 1
    assert df.filter(condition(df.schema, Condition("ts", ">", "2023-01-01"), "typed")).count() == 1


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 2.0)], "k bigint, s string, d double").write.parquet(path)
    df = spark.read.parquet(path)
    for cond, pushed in [
        (Condition("k", ">", "5"), "GreaterThan(k,5)"), (Condition("k", "=", "5"), "EqualTo(k,5)"),
        (Condition("s", "=", "a"), "EqualTo(s,a)"), (Condition("d", "<=", "-1.5"), "LessThanOrEqual(d,-1.5)"),
        (Condition("d", ">=", "-1"), "Or(And(GreaterThanOrEqual(d,-1.0),LessThanOrEqual(d,Infinity)),IsNull(d))"),
        (Condition("s", "!=", "a"), "Or(IsNull(s),Not(EqualTo(s,a)))"),
    ]:
        plan = df.filter(condition(df.schema, cond))._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan, (cond, plan)
