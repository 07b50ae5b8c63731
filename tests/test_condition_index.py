import itertools
import random

from pyspark.sql import functions as F

from rowferry.operators.combine import Combined, combine
from rowferry.operators.condition_index import condition_index, condition_lines, indexed_rows, indexed_summary
from rowferry.operators.fanout import fanout_rows, fanout_summary
from rowferry.plans.spec import Condition, DestinationSpec, Mapping, SourceSpec

ROWS = [(i, t, d, b) for i, (t, d, b) in enumerate(itertools.product(
    ["", None, "5", "5.0", " 7 ", "APAC", "apac-2"], [0.0, None, 5.0, -0.25, 100.0, 1e8], [True, None]))]
MAPPINGS = [Mapping("id", "id"), Mapping("t", "name"), Mapping("absent", "gone")]


def table(spark):
    return Combined(spark.createDataFrame(ROWS, "id int, t string, d double, b boolean"))


def same(spark, combined, destinations):
    index = condition_index(combined, condition_lines(spark, destinations))
    rows = lambda df: sorted((r.destination_id, r.id) for r in df.select("destination_id", "id").collect())
    every = fanout_rows(combined, MAPPINGS, destinations).where("destination_id <> 'primary'")
    assert rows(indexed_rows(combined, MAPPINGS, index)) == rows(every)
    totals = lambda df: sorted(map(tuple, df.collect()))
    assert totals(indexed_summary(combined, MAPPINGS, index)) == totals(fanout_summary(combined, MAPPINGS, destinations))


def test_each_single_condition(spark):
    ops = ["=", "!=", ">", "<", ">=", "<=", "contains", "like"]
    values = ["", "5", "APAC", "0", "x", "1e2", "true"]
    same(spark, table(spark), [
        DestinationSpec(f"{c}{o}{v}{m}", None, (Condition(c, o, v),), m)
        for c, o, v, m in itertools.product(["t", "d", "b", "absent"], ops, values, ["all", "any"])][::5])


def test_random_sets_of_conditions(spark):
    rng = random.Random(3)
    values = ["", "5", "APAC", "apac", "0", "-1", "100", "7", "true", "word"]
    ops = ["=", "=", "!=", ">", "<", ">=", "<=", "contains"]
    same(spark, table(spark), [
        DestinationSpec(str(i), None, tuple(
            Condition(rng.choice(["t", "d", "b", "id", "absent"]), rng.choice(ops), rng.choice(values))
            for _ in range(rng.randrange(5))), rng.choice(["all", "any"])) for i in range(60)])


def test_ranges_over_many_bounds(spark):
    df = Combined(spark.range(500).select(F.col("id").cast("int").alias("id"), (F.col("id") * 0.5).alias("d"), F.lit("t").alias("t")))
    same(spark, df, [DestinationSpec(f"{lo}", None, (Condition("d", ">=", str(lo)), Condition("d", "<", str(lo + 9))))
                     for lo in range(-5, 260, 4)] + [DestinationSpec("empty", None, (Condition("d", ">", "9"), Condition("d", "<", "2")))])


def test_absent_is_not_zero(spark):
    left = spark.createDataFrame([(1, "a")], "id int, t string")
    right = spark.createDataFrame([(2, None)], "id int, d double")
    both = combine(left, [SourceSpec(right)])
    same(spark, both, [DestinationSpec(o, None, (Condition("d", o, "0"),)) for o in (">=", "<=", "=", "!=")]
         + [DestinationSpec("or", None, (Condition("d", ">=", "0"), Condition("t", "=", "a")), "any")])


def test_nothing_to_send(spark):
    rows = table(spark)
    same(spark, rows, [])
    same(spark, Combined(rows.df.limit(0)), [DestinationSpec("all"), DestinationSpec("five", None, (Condition("t", "=", "5"),))])
    lines = condition_lines(spark, [DestinationSpec("five", None, (Condition("t", "=", "5"),))]).withColumn(
        "destination_id", F.lit(None).cast("string"))
    assert indexed_rows(rows, MAPPINGS, condition_index(rows, lines)).count() == 0


def test_five_thousand_destinations(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    segments = ["F", "O", "P"]
    destinations = [DestinationSpec(f"d{i}", None, (
        (Condition("o_custkey", "=", str(i % 200)), Condition("o_totalprice", ">", str(i * 30))) if i % 3 else
        (Condition("o_totalprice", ">=", str(i * 60)), Condition("o_totalprice", "<", str(i * 60 + 5000)),
         Condition("o_orderstatus", "=" if i % 2 else "!=", segments[i % 3]))), "all") for i in range(5000)]
    combined = Combined(orders)
    index = condition_index(combined, condition_lines(spark, destinations))
    got = {r.destination_id: r.n for r in indexed_rows(combined, [Mapping("o_orderkey", "id")], index)
           .groupBy("destination_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = [(str(r.o_custkey), r.o_totalprice, r.o_orderstatus) for r in orders.collect()]
    want = {}
    for i in range(5000):
        if i % 3:
            n = sum(c == str(i % 200) and p > i * 30 for c, p, _ in rows)
        else:
            s = segments[i % 3]
            n = sum(i * 60 <= p < i * 60 + 5000 and (st == s if i % 2 else st != s) for _, p, st in rows)
        if n:
            want[f"d{i}"] = n
    assert got == want


def test_totals_of_intervals_meet_no_rows(spark, monkeypatch):
    """Intervals are settled by sums along their column; only what is found by value is still paired."""
    from rowferry.operators import condition_index as C

    met, real = [], C._met

    def counted(rows, entries):
        met.append(sorted({r.key.split(":")[0] for r in entries.select("key").distinct().collect()}))
        return real(rows, entries)

    monkeypatch.setattr(C, "_met", counted)
    rows = Combined(spark.createDataFrame(
        [(i, None if i % 9 == 0 else float("nan") if i % 8 == 0 else -0.0 if i % 7 == 0 else i % 40 / 4, f"t{i % 5}") for i in range(200)],
        "id int, d double, t string"))
    above, below = (lambda v: Condition("d", ">", v)), (lambda v: Condition("d", "<=", v))
    destinations = [DestinationSpec("all"), DestinationSpec("empty", None, (above("7"), below("3")))]
    destinations += [DestinationSpec(f"in{i}", None, (Condition("d", ">=", str(i / 2)), Condition("d", "<", str(i / 2 + 2)))) for i in range(-2, 20)]
    destinations += [DestinationSpec(f"or{i}", None, (Condition("t", "=", f"t{i}"), above(str(i)), below("0"), above("9")), "any") for i in range(8)]
    index = condition_index(rows, condition_lines(spark, destinations))
    got = sorted(map(tuple, indexed_summary(rows, MAPPINGS[:1], index).collect()))
    assert got == sorted(map(tuple, fanout_summary(rows, MAPPINGS[:1], destinations).collect()))
    assert met == [["e1"]]
