import pytest
from pyspark.sql import functions as F

from rowferry.operators import combine as combine_module
from rowferry.operators.combine import combine, hot_keys
from rowferry.operators.predicates import conditions
from rowferry.operators.remap import cast_failures, remap
from rowferry.plans.spec import Condition, Mapping, SourceSpec


@pytest.fixture
def orders(spark):
    return spark.createDataFrame([(1, 10, 100.0), (2, 20, 50.0), (3, 99, 80.0)], "id int, customer_id int, amount double")


@pytest.fixture
def customers(spark):
    return spark.createDataFrame([(10, "Ann", "gold", "APAC"), (20, "Bob", "silver", "EMEA")],
                                 "id int, name string, tier string, region string")


@pytest.fixture
def regions(spark):
    return spark.createDataFrame([("APAC", "Asia Pacific")], "code string, region_name string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_left_join_keeps_the_unmatched_row(orders, customers):
    c = combine(orders, [SourceSpec(customers, "join", "left", (("customer_id", "id"),))])
    got = remap(c.df, [Mapping("id", "id"), Mapping("name", "name"), Mapping("tier", "tier")])
    assert rows(got) == [(1, "Ann", "gold"), (2, "Bob", "silver"), (3, None, None)]


def test_inner_join_drops_it(orders, customers):
    c = combine(orders, [SourceSpec(customers, "join", "inner", (("customer_id", "id"),))])
    assert rows(c.df.select("id", "name")) == [(1, "Ann"), (2, "Bob")]
    assert c.present == {}


def test_chained_join_uses_the_joined_row(orders, customers, regions):
    c = combine(orders, [
        SourceSpec(customers, "join", "left", (("customer_id", "id"),)),
        SourceSpec(regions, "join", "left", (("region", "code"),)),
    ])
    assert rows(c.df.select("id", "region_name")) == [(1, "Asia Pacific"), (2, None), (3, None)]


LEFT_KEYS = [(0, "1"), (1, None), (2, ""), (3, "x"), (4, "zz")]
RIGHT_KEYS = [("1", "a"), (None, "b"), ("x", "c"), ("x", "d")]


def brute_force(left, right, how, text=lambda v: "" if v is None else str(v)):
    out = []
    for i, k in left:
        hits = [v for rk, v in right if text(rk) == text(k)]
        out += [(i, v) for v in hits]
        if not hits and how == "left":
            out.append((i, None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_null_and_empty_keys_match(spark, how):
    left = spark.createDataFrame(LEFT_KEYS, "i int, k string")
    right = spark.createDataFrame(RIGHT_KEYS, "k2 string, v string")
    c = combine(left, [SourceSpec(right, "join", how, (("k", "k2"),))])
    assert rows(c.df.select("i", "v")) == brute_force(LEFT_KEYS, RIGHT_KEYS, how)


def test_null_keys_never(spark):
    left = spark.createDataFrame(LEFT_KEYS, "i int, k string")
    right = spark.createDataFrame(RIGHT_KEYS, "k2 string, v string")
    c = combine(left, [SourceSpec(right, "join", "left", (("k", "k2"),), null_keys="never")])
    assert rows(c.df.select("i", "v")) == [(0, "a"), (1, None), (2, None), (3, "c"), (3, "d"), (4, None)]


def test_numbers_match_their_text(spark):
    left = spark.createDataFrame([(1, 5.0), (2, 5.5), (3, None)], "i int, k double")
    right = spark.createDataFrame([("5", "five"), ("5.5", "half"), ("", "none")], "k2 string, v string")
    c = combine(left, [SourceSpec(right, "join", "inner", (("k", "k2"),))])
    assert rows(c.df.select("i", "v")) == [(1, "five"), (2, "half"), (3, "none")]


def test_equal_integer_types_join_uncast_with_nulls(spark):
    left = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "i int, k bigint")
    right = spark.createDataFrame([(5, "five"), (None, "none")], "k2 bigint, v string")
    c = combine(left, [SourceSpec(right, "join", "left", (("k", "k2"),))])
    assert rows(c.df.select("i", "v")) == [(1, "five"), (2, "none"), (3, None)]
    assert "cast(k" not in c.df._jdf.queryExecution().executedPlan().toString()


def test_left_columns_win_even_when_null(spark):
    a = spark.createDataFrame([(1, None), (2, "own")], "id int, name string")
    b = spark.createDataFrame([(1, "other", "c1"), (2, "other", "c2")], "id int, name string, c string")
    c = combine(a, [SourceSpec(b, "join", "left", (("id", "id"),))])
    assert rows(c.df.select("id", "name", "c")) == [(1, None, "c1"), (2, "own", "c2")]


def test_a_missed_column_is_filled_by_a_later_join(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    b = spark.createDataFrame([(1, "b1"), (3, None)], "bid int, c string")
    d = spark.createDataFrame([(1, "d1"), (2, "d2"), (3, "d3")], "did int, c string")
    c = combine(a, [SourceSpec(b, "join", "left", (("id", "bid"),)),
                    SourceSpec(d, "join", "left", (("id", "did"),))])
    # 1 has it from b, 2 was missed by b, 3 got a stored NULL from b.
    assert rows(c.df.select("id", "c")) == [(1, "b1"), (2, "d2"), (3, None)]
    assert c.df.filter(~c.present["c"]).count() == 0


def test_absent_is_not_zero(orders, customers, spark):
    stored = spark.createDataFrame([(10, None), (20, 5)], "id int, score int")
    c = combine(orders, [SourceSpec(stored, "join", "left", (("customer_id", "id"),))])
    keep = conditions(c.df.schema, [Condition("score", "<", "3")], present=c.present)
    assert [r.id for r in c.df.filter(keep).collect()] == [1]


def test_union_keeps_copies_and_aligns_by_name(spark):
    a = spark.createDataFrame([(1, "x", 0)], "id int, name string, other int")
    b = spark.createDataFrame([("x", 1), ("y", 2)], "name string, id int")
    c = combine(a, [SourceSpec(b), SourceSpec(a)], ["id", "name"])
    assert c.df.columns == ["id", "name"]
    assert rows(c.df) == [(1, "x"), (1, "x"), (1, "x"), (2, "y")]


def test_union_of_numbers_and_text_becomes_text(spark):
    a = spark.createDataFrame([(1.0,), (None,)], "v double")
    b = spark.createDataFrame([("z",)], "v string")
    assert rows(combine(a, [SourceSpec(b)], ["v"]).df) == [("1",), ("z",), (None,)]


def test_unions_follow_joins_whatever_the_order(orders, customers):
    more = orders.withColumn("id", F.col("id") + 100)
    joins = SourceSpec(customers, "join", "inner", (("customer_id", "id"),))
    c = combine(orders, [SourceSpec(more), joins], ["id", "name"])
    flat = c.df.select("id", "name", *[p.alias(f"p_{k}") for k, p in c.present.items() if k == "name"])
    assert sorted((r.id, r.name) for r in flat.collect()) == [(1, "Ann"), (2, "Bob"), (101, None), (102, None), (103, None)]
    assert sorted((r.id, r.p_name) for r in flat.collect())[2:] == [(101, False), (102, False), (103, False)]


def test_condition_on_an_unmapped_column_without_joins(spark):
    df = spark.createDataFrame([(1, "APAC")], "id int, region string")
    c = combine(df, [], ["id"])
    assert c.df.columns == ["id"]
    assert c.df.filter(conditions(c.df.schema, [Condition("region", "=", "APAC")])).count() == 0


def test_row_cap_per_source_and_in_total(spark):
    a, b = spark.range(10), spark.range(100, 110)
    c = combine(a, [SourceSpec(b)], ["id"], row_cap=4)
    assert [r.id for r in c.df.orderBy("id").collect()] == [0, 1, 2, 3]


def test_two_column_keys_do_not_run_together(spark):
    a = spark.createDataFrame([(1, "a", "bc"), (2, "ab", "c")], "i int, x string, y string")
    b = spark.createDataFrame([("ab", "c", "hit")], "p string, q string, v string")
    c = combine(a, [SourceSpec(b, "join", "left", (("x", "p"), ("y", "q")))])
    assert rows(c.df.select("i", "v")) == [(1, None), (2, "hit")]


@pytest.mark.parametrize("typed", [True, False])
def test_hot_right_keys_are_split_and_whole(spark, monkeypatch, typed):
    """A third of the right rows share one key, and many are copies of one row."""
    monkeypatch.setattr(combine_module, "HOT_KEY_MIN_ROWS", 50)
    kind = "bigint" if typed else "string"
    right = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast(kind).alias("k2"),
        F.when(F.col("id") % 6 == 0, -1).otherwise(F.col("id")).alias("v"))
    left = spark.createDataFrame([(i, k) for i, k in enumerate([7, 7, 1, 2, 3, 99999, None])], "i int, k bigint")
    left = left.withColumn("k", F.col("k").cast(kind))
    assert hot_keys({3: (right, F.col("k2").cast("string"))}) == {3: ["7"]}
    split = combine(left, [SourceSpec(right, "join", "left", (("k", "k2"),))])
    plain = combine(left, [SourceSpec(right, "join", "left", (("k", "k2"),), split_hot_keys=0)])
    assert "rand(17)" in split.df._jdf.queryExecution().optimizedPlan().toString()
    want = brute_force([(r.i, r.k) for r in left.collect()], [(r.k2, r.v) for r in right.collect()], "left")
    assert rows(split.df.select("i", "v")) == rows(plain.df.select("i", "v")) == want
    assert split.df.filter(~split.present["v"]).count() == 3


def test_no_hot_keys_no_split(orders, customers):
    c = combine(orders, [SourceSpec(customers, "join", "left", (("customer_id", "id"),))])
    assert "rand" not in c.df._jdf.queryExecution().optimizedPlan().toString()


def test_mapping_last_wins_and_unknown_is_null(orders):
    got = remap(orders, [Mapping("id", "a"), Mapping("amount", "b"), Mapping("customer_id", "a"), Mapping("zip", "c")])
    assert got.columns == ["a", "b", "c"]
    assert rows(got)[0] == (10, 100.0, None)


def test_failed_casts_are_counted(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "v string")
    m = [Mapping("v", "n", "int")]
    assert sorted(r.n for r in remap(df, m).collect() if r.n) == [1]
    assert rows(cast_failures(df, m)) == [("n", "int", 1)]


def test_only_needed_columns_are_read(spark, tmp_path):
    for name, cols in (("a", "id bigint, k bigint, x string, y string"), ("b", "k bigint, v string, w string")):
        spark.createDataFrame([], cols).write.parquet(str(tmp_path / name))
    a, b = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b"))
    c = combine(a, [SourceSpec(b, "join", "left", (("k", "k"),))])
    plan = remap(c.df, [Mapping("id", "id"), Mapping("v", "v")])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,k:bigint>" in plan and "ReadSchema: struct<k:bigint,v:string>" in plan


def test_integers_of_different_widths_join_as_numbers(spark):
    a = spark.createDataFrame([(1, 5, "x"), (2, None, "y"), (3, 7, None)], "i int, k int, s string")
    b = spark.createDataFrame([(5, "x", "hit"), (None, "y", "null"), (7, "", "blank")], "k2 bigint, s2 string, v string")
    c = combine(a, [SourceSpec(b, "join", "inner", (("k", "k2"), ("s", "s2")))])
    assert rows(c.df.select("i", "v")) == [(1, "hit"), (2, "null"), (3, "blank")]
    assert "as string" not in c.df._jdf.queryExecution().executedPlan().toString()


def test_a_key_column_nobody_has_is_empty_text(spark):
    a = spark.createDataFrame([(1, 5), (2, None)], "i int, k int")
    b = spark.createDataFrame([("v",)], "v string")
    c = combine(a, [SourceSpec(b, "join", "left", (("k", "nope"),))])
    assert rows(c.df.select("i", "v")) == [(1, None), (2, "v")]


@pytest.mark.parametrize("keys", [(("k", "k2"),), (("k", "k2"), ("g", "g2"))])
@pytest.mark.parametrize("nulls", ["never", "match"])
def test_split_hot_keys_lose_no_row(spark, keys, nulls):
    left = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a", 1), (4, "b", None), (5, "zz", 1)],
                                 "i int, k string, g int")
    right = spark.createDataFrame([(None, 1, "n")] * 40 + [("", 1, "e")] * 40 + [("a", 1, "v")] * 40 + [("b", None, "w")] * 40,
                                  "k2 string, g2 int, v string")
    spec = SourceSpec(right, "join", "left", keys, null_keys=nulls)
    plain = combine(left, [SourceSpec(right, "join", "left", keys, null_keys=nulls, split_hot_keys=0)])
    split = combine(left, [spec], hot_key_min_rows=10)
    assert rows(split.df.select("i", "v")) == rows(plain.df.select("i", "v"))
    assert {r.i for r in split.df.collect()} == {1, 2, 3, 4, 5}


def test_a_hot_key_that_left_the_source_loses_no_row(spark):
    from rowferry.operators import combine as module

    left = spark.createDataFrame([(1, "a"), (2, "gone")], "i int, k string")
    right = spark.createDataFrame([("a", "v")] * 5, "k2 string, v string")
    spec, keys = module._fixed(SourceSpec(right, "join", "left", (("k", "k2"),)), ["a", "gone"])
    assert keys == ["a"]
    state = module._join(module.Combined(left), spec, 0, keys)
    assert rows(state.df.select("i", "v")) == [(1, "v")] * 5 + [(2, None)]
