from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rowferry.functions import labels
from rowferry.operators import analytics as A
from rowferry.operators import listings as L
from rowferry.operators import metering as M
from rowferry.operators import incremental as I
from rowferry.operators import lifecycle as C
from rowferry.operators import validation as V

RUNS = "id string, pipeline_id string, direction string, status string, records int, started_at timestamp, completed_at timestamp"


@pytest.fixture
def runs(spark):
    t = datetime
    return spark.createDataFrame([
        ("1", "a", "cloud_bound", "completed", 10, t(2024, 1, 1, 23, 59, 59), t(2024, 1, 2, 0, 0, 0)),
        ("2", "a", "on_prem_bound", "failed", None, t(2024, 1, 2, 1), t(2024, 1, 2, 1, 0, 3)),
        ("3", "b", "other", "running", None, t(2024, 1, 2, 5), None),
        ("4", "gone", "bidirectional", "completed", 5, t(2024, 1, 2, 6), t(2024, 1, 2, 6, 0, 2)),
    ], RUNS)


@pytest.fixture
def pipelines(spark):
    return spark.createDataFrame([
        ("a", "Alpha", "c1", "c1", "cloud_bound", "active"), ("b", "Beta", "c1", "c2", "cloud_bound", "draft"),
        ("z", "Idle", "c2", "c3", "cloud_bound", "draft")],
        "id string, name string, source_id string, target_id string, direction string, status string")


@pytest.fixture
def connectors(spark):
    return spark.createDataFrame([("c1", "One", "s3"), ("c2", "Two", "gcs"), ("c3", "Three", "mysql")],
                                 "id string, name string, type string")


def test_overview(spark, runs, pipelines):
    assert tuple(A.overview(runs, pipelines).first()) == (4, 15, 1500, 50.0, 1, 3)
    assert tuple(A.overview(runs.limit(0), pipelines).first()) == (0, 0, 0, None, 1, 3)


def test_daily(runs):
    assert [tuple(r) for r in A.daily_stats(runs).collect()] == [
        ("2024-01-01", 1, 1, 0, 10, 1000), ("2024-01-02", 3, 1, 1, 5, 2500)]


def test_a_self_loop_counts_once(runs, pipelines, connectors):
    got = [tuple(r)[:6] for r in A.connector_usage(runs, pipelines, connectors).collect()]
    assert got == [("c1", "One", "s3", 2, 3, 10), ("c2", "Two", "gcs", 2, 1, 0)]


def test_leaderboard_and_split(runs, pipelines):
    assert [tuple(r) for r in A.pipeline_leaderboard(runs, pipelines).collect()] == [
        ("a", "Alpha", 2, 10, 1000, 50.0), ("b", "Beta", 1, 0, 0, 0.0)]
    assert tuple(A.direction_split(runs).first()) == (10, 0, 5)


def test_hours_cover_the_day(runs):
    now = datetime(2024, 1, 2, 6, 30)
    hourly = A.hourly_throughput(runs, now)
    rows = hourly.collect()
    assert len(rows) == 24 and rows[0].hour == "2024-01-01T06:30:00.000Z"
    assert A.day_totals(hourly).first()[0] == 15
    assert [r.hour for r in rows if r.bidirectional] == ["2024-01-02T05:30:00.000Z"]


def test_shares_of_nothing_are_zero(spark):
    df = spark.createDataFrame([(0,), (0,)], "v int")
    assert [r.share_pct for r in A.shares(df, "v").collect()] == [0.0, 0.0]
    plan = A.shares(df, "v")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_metering(spark, pipelines):
    e = spark.createDataFrame([("1", "a", "cloud_bound", 10, 100, 5, 1.5), ("2", None, "odd", 1, 1, 1, 2.0)],
                              "id string, pipeline_id string, direction string, records int, bytes int, compute_ms int, cost_usd double")
    e = e.withColumn("ts", F.lit("2024-03-01 00:00:00").cast("timestamp"))
    assert tuple(M.metering_summary(e).first()) == (3.5, 11, 101, 1.5, 0.0, 0.0)
    assert tuple(M.daily_costs(e).first()) == ("2024-03-01", 1.5, 0.0, 2.0)
    assert [(r.pipeline_id, r.pipeline_name) for r in M.pipeline_costs(e, pipelines).collect()] == [(None, None), ("a", "Alpha")]
    assert M.metering_summary(e.limit(0)).first().total_records == 0


@pytest.mark.parametrize("given,want", [("10", 10), (None, 200), ("x", 200), (-1, 200), (0, 200), (500, 200), (7.9, 7), ("inf", 200)])
def test_audit_limit(given, want):
    assert L.audit_limit(given) == want


def test_notifications(spark):
    log = spark.range(30).selectExpr("id", "'run' action", "'me' actor", "'info' status",
                                     "if(id % 2 = 0, '', concat('d', id)) details", "timestamp_seconds(id) ts")
    got = L.notifications(log).orderBy("position").collect()
    assert [(r.id, r.read) for r in got][:5] == [(29, False), (28, False), (27, False), (26, True), (25, True)]
    assert len(got) == 10 and got[1].detail == "me — info" and got[0].detail == "d29"


def test_search_needs_two_characters(spark, pipelines, connectors):
    p = pipelines.selectExpr("id", "name", "'orders' source_table", "cast(null as string) target_table")
    assert L.search(connectors, p, " a ").count() == 0
    assert sorted((r.entity, r.id) for r in L.search(connectors, p, "ORD").collect()) == [
        ("pipeline", "a"), ("pipeline", "b"), ("pipeline", "z")]
    assert [(r.entity, r.id) for r in L.search(connectors, p, "thr").collect()] == [("connector", "c3")]


def test_latest_account(spark):
    df = spark.sql("""select * from values ('b', timestamp'2024-01-02', 'x'), ('a', timestamp'2024-01-02', 'y'),
        ('c', timestamp'2024-05-01', null), ('d', null, 'z') as t(id, updated_at, item)""")
    assert L.latest_account(df).first().id == "c"
    assert L.latest_account(df, "item").first().id == "a"
    assert L.latest_account(df.filter("id = 'zz'")).count() == 0


def test_redaction(spark):
    df = spark.sql("""select 'c' id, 'n' name, 's3' type, 'cloud' category, 'both' role, 'connected' status,
        cast(null as int) tables_count, '' last_accessed, '2024' created_at,
        named_struct('host', 'h', 'port', 1, 'database', 'd', 'username', 'u', 'password', 'p') config""")
    r = L.redacted(df).first()
    assert (r.host, r.tables_count, r.last_accessed) == ("h", 0, "2024")
    assert "password" not in L.without_secret(df).schema["config"].dataType.names


def test_display_forms(spark):
    cases = [(999, "999", "999 B", "999ms"), (1500, "1.5K", "1.46 KB", "1s"),
             (3_661_000, "3.7M", "3.49 MB", "1h 1m"), (185_000, "185.0K", "180.66 KB", "3m 5s"),
             (5 * 1024**4, "5497.6B", "5.00 TB", None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "v bigint")
    got = df.select(labels.short_count(F.col("v")), labels.short_bytes(F.col("v")), labels.short_duration(F.col("v"))).collect()
    for g, (_, n, b, d) in zip(got, cases):
        assert (g[0], g[1]) == (n, b) and (d is None or g[2] == d)


# -- lifecycle ---------------------------------------------------------------

def test_cascade(spark):
    f = spark.createDataFrame
    tables = {
        "pipelines": f([("a",), ("b",)], "id string"),
        "pipeline_nodes": f([("n1", "a"), ("n2", None)], "id string, pipeline_id string"),
        "pipeline_destinations": f([("d1", "a"), ("d2", "b")], "id string, pipeline_id string"),
        C.CONDITIONS: f([("k1", "d1"), ("k2", "d2"), ("k3", None)], "id string, destination_id string"),
        "metering_events": f([("m1", "a", 1), ("m2", "b", 2), ("m3", None, 3)], "id string, pipeline_id string, v int"),
    }
    left = C.delete_pipelines(tables, f([("a",), ("a",)], "id string"))

    def ids(name):
        return sorted(r.id for r in left[name].collect())

    assert ids("pipelines") == ["b"] and ids("pipeline_nodes") == ["n2"]
    assert ids("pipeline_destinations") == ["d2"] and ids(C.CONDITIONS) == ["k2", "k3"]
    assert sorted(tuple(r) for r in left["metering_events"].collect()) == [("m1", None, 1), ("m2", "b", 2), ("m3", None, 3)] or \
        {(r.id, r.pipeline_id) for r in left["metering_events"].collect()} == {("m1", None), ("m2", "b"), ("m3", None)}


def test_empty_snapshot_clears(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    got = C.replace_by_key(df, df.limit(0), spark.createDataFrame([("a",)], "k string"), "k")
    assert [tuple(r) for r in got.collect()] == [(2, "b")]


def test_updates_and_upserts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    up = spark.createDataFrame([(2, "B"), (9, "no")], "id int, v string")
    assert sorted(tuple(r) for r in C.apply_updates(df, up, "id", ["v"]).collect()) == [(1, "a"), (2, "B")]
    assert sorted(tuple(r) for r in C.upsert(df, up, ["id"]).collect()) == [(1, "a"), (2, "B"), (9, "no")]


def test_violations_carry_messages(spark):
    df = spark.createDataFrame([("s", "", "t", "join", None, "outer", "x")],
                               "id string, source_id string, source_table string, combine_mode string, join_column string, join_type string, primary_join_column string")
    got = {r.rule: r.message for r in V.violations(df, "pipeline_sources").collect()}
    assert set(got) == {"source_required", "join_columns", "join_type"}
    assert got["join_type"] == 'join_type must be "inner" or "left"'


# -- extensions --------------------------------------------------------------

def test_incremental(spark):
    df = spark.range(5)
    assert I.incremental(df, "id", None).count() == 5
    assert I.incremental(df, "id", "2").count() == 2
    assert I.next_watermark(df, "id").first()[0] == "4"


def test_latest_change_wins(spark):
    cur = spark.createDataFrame([(1, "old"), (3, "keep")], "id int, v string")
    ch = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "n", 1)], "id int, v string, seq int")
    got = I.upsert_latest(cur, ch, ["id"], ["seq"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "y"), (2, "n"), (3, "keep")]


@pytest.mark.parametrize("policy,want", [("keep_source", "a"), ("keep_target", "b"), ("merge", "a"), ("skip", None)])
def test_conflict_policies(spark, policy, want):
    s = spark.createDataFrame([(1, "a", 5), (2, "s", 1)], "id int, v string, n int")
    t = spark.createDataFrame([(1, "b", 5), (3, "s", 1)], "id int, v string, n int")
    rows = I.conflicts(s, t, ["id"], "t", policy).collect()
    assert [(r.column_name, r.source_value, r.target_value, r.resolved_value) for r in rows] == [("v", "a", "b", want)]


def test_conflicts_of_one_sided_rows(spark):
    s = spark.createDataFrame([(1, "a"), (2, "s"), (4, None)], "id int, v string")
    t = spark.createDataFrame([(1, "a"), (3, "t")], "id int, v string")
    rows = I.conflicts(s, t, ["id"], "t", "merge", one_sided=True).collect()
    assert sorted((r.id, r.source_value, r.target_value, r.resolved_value) for r in rows) == [
        (2, "s", None, "s"), (3, None, "t", "t")]


# -- sizes -------------------------------------------------------------------

def test_broadcast_only_below_the_bounds(spark, monkeypatch):
    from rowferry.operators import sizing

    log = spark.range(100).selectExpr("id", "concat('k', id % 10) as pipeline_id")
    ids = spark.createDataFrame([("k1",), ("k2",), ("k2",)], "id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def plan(df):
            return df._jdf.queryExecution().executedPlan().toString()

        small = C.delete_children(log, ids, "pipeline_id")
        assert "BroadcastHashJoin" in plan(small) and small.count() == 80
        for name in ("BROADCAST_ROWS", "BROADCAST_BYTES"):
            with monkeypatch.context() as m:
                m.setattr(sizing, name, 1)
                large = C.delete_children(log, ids, "pipeline_id")
                assert "SortMergeJoin" in plan(large) and large.count() == 80
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_all_reports_at_once(spark, runs, pipelines, connectors):
    from rowferry.operators import metering as M

    now = datetime(2024, 1, 2, 12)
    every = A.analytics(runs, pipelines, connectors, now)
    alone = (A.overview(runs, pipelines), A.last_days(A.daily_stats(runs)), A.connector_usage(runs, pipelines, connectors),
             A.direction_split(runs), A.pipeline_leaderboard(runs, pipelines), A.hourly_throughput(runs, now))
    for a, b in zip(every, alone, strict=True):
        assert a.columns == b.columns and a.collect() == b.collect()
    assert set(every.overview.inputFiles()) == set(every.daily.inputFiles()) | set(every.overview.inputFiles())
    events = spark.sql("""select 'p1' pipeline_id, 'cloud_bound' direction, 10L records, 20L bytes, 30L compute_ms,
        0.5d cost_usd, timestamp'2024-01-01 10:00:00' ts""")
    both = M.metering(events, pipelines)
    for a, b in zip(both, (M.metering_summary(events), M.daily_costs(events), M.pipeline_costs(events, pipelines)),
                    strict=True):
        assert a.collect() == b.collect()


def test_success_is_rounded_in_the_order_of_division(spark):
    total = spark.range(1).select(A._success_pct(F.lit(201), F.lit(400)).alias("pct"))
    assert total.first().pct == 50.2
