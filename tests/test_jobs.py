import json

import pytest
from pyspark.sql import functions as F

from rowferry.operators.secure import decrypt, encrypt
from rowferry.plans.jobs import JobError, Store, map_job, run_job
from rowferry.plans.run import run_partitioned, run_sync, stage_combined
from rowferry.plans.spec import Condition, Connector, DestinationSpec, Mapping, SourceSpec, Target
from rowferry.operators.combine import combine
from rowferry.operators.fanout import fanout_summary, run_totals
from rowferry.sources.readers import read

KEY = "MDEyMzQ1Njc4OWFiY2RlZjAxMjM0NTY3ODlhYmNkZWY="
CONNECTORS = "id string, name string, type string, config struct<host:string,port:int,database:string,username:string,password:string>"
PIPELINES = ("id string, name string, source_id string, target_id string, source_table string, "
             "target_table string, direction string, status string, sync_mode string, created_at string")
SOURCES = ("id string, pipeline_id string, source_id string, source_table string, combine_mode string, "
           "join_type string, join_column string, primary_join_column string, created_at string")
DESTINATIONS = ("id string, pipeline_id string, target_id string, target_table string, filter_column string, "
                "filter_operator string, filter_value string, match_mode string, created_at string")
CONDITIONS = "id string, destination_id string, filter_column string, filter_operator string, filter_value string, created_at string"


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "meta"), KEY)
    files = tmp_path / "files"
    files.mkdir()
    (files / "orders.csv").write_text("id,customer_id,amount\n1,10,100\n2,20,50\n3,99,80\n")
    (files / "customers.csv").write_text("id,name,region\n10,Ann,APAC\n20,Bob,EMEA\n")
    cfg = spark.createDataFrame(
        [("c1", "files", "file", (None, None, str(files), None, "pw")),
         ("c2", "broken", "snowflake", (None, None, "x", None, None))], CONNECTORS)
    sealed = cfg.withColumn("config", F.col("config").withField("password", encrypt(F.col("config.password"), KEY)))
    s.append("connectors", sealed)
    s.append("pipelines", spark.createDataFrame(
        [("p1", "Orders", "c1", "c1", "orders.csv", "out.csv", "on_prem_bound", "draft", None, "2024"),
         ("p2", "Broken", "c2", "c1", "t", "o.csv", "cloud_bound", "draft", None, "2024"),
         ("p3", "No table", "c1", "c1", "orders.csv", None, "cloud_bound", "draft", None, "2024"),
         ("p4", "No mapping", "c1", "c1", "orders.csv", "o4.csv", "cloud_bound", "draft", None, "2024")], PIPELINES))
    s.append("pipeline_sources", spark.createDataFrame(
        [("s1", "p1", "c1", "customers.csv", "join", "left", "id", "customer_id", "2024")], SOURCES))
    s.append("pipeline_destinations", spark.createDataFrame(
        [("d1", "p1", "c1", "apac.csv", "region", "=", "APAC", None, "1"),
         ("d2", "p1", "c1", "either.csv", "region", "=", "EMEA", "any", "2")], DESTINATIONS))
    s.append("pipeline_destination_conditions", spark.createDataFrame(
        [("k1", "d2", "amount", ">", "90", "1")], CONDITIONS))
    return s


def test_map_then_run(spark, store):
    mapped = map_job(store, "p1", "me")
    assert sorted((r.source_col, r.target_col) for r in mapped.collect()) == [
        ("amount", "amount"), ("customer_id", "customer_id"), ("id", "id")]
    # the target has no columns yet, so the mapping mirrors the source; add a joined column
    extra = mapped.limit(1).withColumn("source_col", F.lit("name")).withColumn("target_col", F.lit("name"))
    extra.write.mode("append").parquet(store.path("schema_mappings"))
    report = run_job(store, "p1", "me")
    assert report.error is None, report.error
    assert [(x.destination_id, x.records) for x in report.loaded] == [("primary", 3), ("d1", 1), ("d2", 2)]
    assert report.loaded[1].bytes == len(json.dumps(
        {"id": "1", "customer_id": "10", "amount": "100", "name": "Ann"}, separators=(",", ":")))
    out = read(spark, store.connector("c1"), "out.csv")
    assert sorted((r.id, r.name) for r in out.collect()) == [("1", "Ann"), ("2", "Bob"), ("3", None)]
    run = store.table("sync_runs").first()
    assert (run.status, run.records, run.error) == ("completed", 3, None)
    meter = store.table("metering_events").first()
    assert meter.records == 6 and meter.bytes == sum(x.bytes for x in report.loaded)
    assert meter.cost_usd == pytest.approx(6 / 10000 * 0.25 + meter.compute_ms / 60000 * 0.05)
    assert store.table("pipelines").filter("id = 'p1'").first().status == "active"
    audit = {r.action: r for r in store.table("audit_logs").collect()}
    assert audit["pipeline.run"].details == 'Synced 3 rows for pipeline "Orders" + 3 rows across 2 additional destination(s)'
    assert audit["schema.map"].details == 'Mapped 3 columns for pipeline "Orders"'
    again = map_job(store, "p1", "me")  # replaces, does not add
    assert again.count() == 4  # the target now has the column name too


def test_failed_run_is_recorded_without_usage(spark, store):
    store.append("schema_mappings", spark.createDataFrame(
        [("p2", "a", "b", "text", "text", 0.9, None)],
        "pipeline_id string, source_col string, target_col string, source_type string, target_type string, confidence double, warning string"))
    report = run_job(store, "p2", "me")
    assert report.status == "failed" and "not supported" in report.error and report.records == 0
    assert store.table("sync_runs").filter("pipeline_id = 'p2'").first().status == "failed"
    assert store.rows("metering_events", pipeline_id="p2") == []
    assert store.table("pipelines").filter("id = 'p2'").first().status == "error"
    assert store.rows("audit_logs", pipeline_id="p2")[0].status == "error"


def test_preconditions(store):
    for pid, text in [("nope", "not found"), ("p3", "missing a source or target"), ("p4", "No schema mapping")]:
        with pytest.raises(JobError, match=text):
            run_job(store, pid, "me")
    with pytest.raises(JobError, match="Connector c9"):
        store.connector("c9")
    assert store.connector("c1").password == "pw"


def test_encryption(spark):
    df = spark.createDataFrame([(1, "secret ü"), (2, ""), (3, None)], "i int, v string")
    sealed = df.select("i", encrypt(F.col("v"), KEY).alias("e")).persist()
    rows = sealed.orderBy("i").collect()
    assert rows[2].e is None and [len(x) for x in rows[0].e.split(".")][:2] == [16, 24]
    back = sealed.select("i", decrypt(F.col("e"), KEY).alias("v")).orderBy("i").collect()
    assert [r.v for r in back] == ["secret ü", "", None]
    same = spark.range(50).selectExpr("concat('x', substr(id, 1, 0)) as v").select(encrypt(F.col("v"), KEY).alias("e"))
    assert len({r.e for r in same.collect()}) == 50  # a new IV per row
    with pytest.raises(ValueError):
        encrypt(F.col("v"), "c2hvcnQ=")


def test_written_counts_equal_the_summary(spark, tmp_path):
    folder = Connector("file", str(tmp_path))
    left = spark.range(200).selectExpr("id", "id % 7 as k", "cast(id as double) / 4 as amount")
    right = spark.range(5).selectExpr("id as k2", "concat('n', id) as name")
    sources = [SourceSpec(right, "join", "left", (("k", "k2"),))]
    m = [Mapping("id", "id"), Mapping("name", "name"), Mapping("amount", "amount")]
    dests = [DestinationSpec("a", Target(folder, "a.parquet"), (Condition("amount", ">", "20"),)),
             DestinationSpec("b", Target(folder, "b.parquet"), (Condition("name", "=", ""), Condition("id", "<", "10")), "any")]
    for staging, parallel in (("auto", 1), ("never", 2)):
        loaded = run_sync(left, m, Target(folder, "p.parquet"), "truncate_reload" if staging == "auto" else "append",
                          sources, dests, staging=staging, parallel=parallel)
        summary = fanout_summary(combine(left, sources, [x.source_col for x in m]), m, dests)
        assert sorted((r.destination_id, r.records, r.bytes) for r in summary.collect()) == sorted(
            (x.destination_id, x.records, x.bytes) for x in loaded)
    assert tuple(run_totals(summary).first()) == (sum(x.records for x in loaded), sum(x.bytes for x in loaded))


def test_partitioned_loads_equal_separate_ones(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "id % 5 as k")
    m = [Mapping("id", "n")]
    dests = [DestinationSpec("7", None, (Condition("id", ">=", "90"),)),
             DestinationSpec("none", None, (Condition("id", "<", "0"),))]
    for mode, times in (("truncate_reload", 1), ("append", 2), ("truncate_reload", 1)):
        got = run_partitioned(rows, [*m, Mapping("k", "k")], str(tmp_path / "o"), (), dests, mode)
        counts = {r.destination_id: r["count"] for r in got.groupBy("destination_id").count().collect()}
        assert counts == {"primary": 100 * times, "7": 10 * times}
    assert sorted(r.n for r in got.filter("destination_id = '7'").collect()) == list(range(90, 100))


def test_scratch_is_the_checkpoint_folder():
    from rowferry.session import scratch_path

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf({"spark.checkpoint.dir": "hdfs://shared/ck/"})

    path = scratch_path(Session(), "x")
    assert path.startswith("hdfs://shared/ck/rowferry/x-")


def test_staging_keeps_presence(spark):
    left = spark.createDataFrame([(1,), (2,)], "id int")
    right = spark.createDataFrame([(1, None)], "rid int, v int")
    c = combine(left, [SourceSpec(right, "join", "left", (("id", "rid"),))])
    staged = stage_combined(c, ["id", "v"])
    assert sorted((r.id, r.h) for r in staged.df.select("id", staged.present["v"].alias("h")).collect()) == [(1, True), (2, False)]


def test_source_spec_checks(spark):
    with pytest.raises(ValueError):
        SourceSpec(spark.range(1), "join")
    with pytest.raises(ValueError):
        SourceSpec(spark.range(1), "cross")
    with pytest.raises(ValueError):
        run_sync(spark.range(1), [], None)


def test_interleaved_status_updates_both_survive(spark, store):
    from rowferry.plans.jobs import set_status

    before = spark.read.parquet(store.path("pipelines")).count()
    stale = store.table("pipelines")  # another run's view, taken before
    set_status(store, "p1", "active")
    stale.count()
    set_status(store, "p2", "error")
    set_status(store, "p1", "paused")
    got = {r.id: r.status for r in store.table("pipelines").collect()}
    assert (got["p1"], got["p2"], got["p3"]) == ("paused", "error", "draft") and len(got) == before


def test_read_options_of_a_stored_source_reach_the_reader(spark, store):
    seen = {}

    def reader(spark, connector, table, **options):
        seen[table] = options
        return read(spark, connector, table)

    pipelines = spark.read.parquet(store.path("pipelines")).withColumn(
        "read_options", F.create_map(F.lit("partitionColumn"), F.lit("id"), F.lit("numPartitions"), F.lit("8")))
    pipelines.write.mode("overwrite").parquet(store.path("pipelines-new"))
    s = type(store)(spark, store.root)
    s.path = lambda name: f"{store.root}/{'pipelines-new' if name == 'pipelines' else name}"
    map_job(s, "p1", "me")
    report = run_job(s, "p1", "me", reader)
    assert report.error is None, report.error
    assert seen["orders.csv"] == {"partitionColumn": "id", "numPartitions": "8"} and seen["customers.csv"] == {}


def test_mappings_come_back_in_order(spark, store):
    mapped = map_job(store, "p1", "me")
    from rowferry.plans.jobs import _place

    assert [m.source_col for m in sorted(mapped.collect(), key=_place)] == ["id", "customer_id", "amount"]


def test_mappings_kept_as_versions(spark, store):
    versioned = Store(spark, store.root, KEY, versioned=True)
    store.append("schema_mappings", spark.createDataFrame(
        [("p1", "old", "old", "text", "text", 0.9, None), ("p9", "a", "b", "text", "text", 0.9, None)],
        "pipeline_id string, source_col string, target_col string, source_type string, target_type string, confidence double, warning string"))
    before = store.table("schema_mappings").inputFiles()
    mapped = map_job(versioned, "p1", "me")
    assert sorted(r.source_col for r in mapped.collect()) == ["amount", "customer_id", "id"]
    assert sorted(r.source_col for r in versioned.rows("schema_mappings")) == ["a", "amount", "customer_id", "id"]
    assert store.table("schema_mappings").inputFiles() == before
    assert run_job(versioned, "p1", "me").error is None
