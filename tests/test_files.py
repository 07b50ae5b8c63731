import pytest

from rowferry.plans.spec import Connector, Mapping, Target
from rowferry.plans.run import run_sync
from rowferry.sources import readers as R
from rowferry.sources.identifiers import split_identifier
from rowferry.sources.writers import align, rewrite_table, truncate, write


@pytest.fixture
def folder(tmp_path):
    return Connector("file", str(tmp_path))


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)


def rows(df):
    return [tuple(r) for r in df.collect()]


CSV = 'id, name ,z\n1, a"b ,\n2,x\n\n3,p,q,EXTRA\n'


def test_csv_rules(spark, folder, tmp_path):
    put(tmp_path, "t.csv", CSV)
    df = R.read(spark, folder, "t.csv", quoting="none")
    assert df.columns == ["id", "name", "z"]
    assert rows(df) == [("1", 'a"b', None), ("2", "x", None), ("3", "p", "q")]
    assert {f.dataType.simpleString() for f in df.schema} == {"string"}


def test_csv_quotes_are_honoured_by_default(spark, folder, tmp_path):
    put(tmp_path, "q.csv", 'a,b\n"x, y","say ""hi"""\n')
    assert rows(R.read(spark, folder, "q.csv")) == [("x, y", 'say "hi"')]


def test_header_only_csv(spark, folder, tmp_path):
    put(tmp_path, "e.csv", "id, name\n")
    assert rows(R.read(spark, folder, "e.csv")) == []
    got = [(r.ordinal, r.name, r.type) for r in R.file_columns(spark, folder, "e.csv").collect()]
    assert got == [(0, "id", "text"), (1, "name", "text")]


def test_json_forms(spark, folder, tmp_path):
    put(tmp_path, "a.json", '[\n {"k": 1, "ok": true},\n {"k": 2.5, "s": "x"}\n]')
    put(tmp_path, "o.json", '{\n "k": 1\n}')
    put(tmp_path, "l.json", '{"k": 1}\n{"k": 2}\n')
    put(tmp_path, "blank.json", "  \n")
    assert [r.k for r in R.read(spark, folder, "a.json").collect()] == [1.0, 2.5]
    assert rows(R.read(spark, folder, "o.json")) == [(1,)]
    assert rows(R.read(spark, folder, "l.json")) == [(1,), (2,)]
    assert rows(R.read(spark, folder, "blank.json", ["k"])) == []
    kinds = {r.name: r.type for r in R.file_columns(spark, folder, "a.json").collect()}
    assert kinds == {"k": "numeric", "ok": "boolean", "s": "text"}


def test_absent_file_has_no_columns(spark, folder):
    assert R.file_columns(spark, folder, "none.csv").count() == 0


def test_projection_of_a_missing_column(spark, folder, tmp_path):
    put(tmp_path, "t.csv", "a,b\n1,2\n")
    assert rows(R.read(spark, folder, "t.csv", ["b", "zz"])) == [("2", None)]


def test_listing(spark, folder, tmp_path):
    for name in ("b.CSV", "a.json", "c.txt"):
        put(tmp_path, name, "x\n")
    got = [r.name for r in R.list_tables(spark, folder).collect()]
    assert got == ["a.json", "b.CSV"]


def test_previews_and_extract_limits(spark):
    df = spark.range(20_000)
    assert R.preview(df).count() == 25
    assert [R.extract(df, n).count() for n in (0, 2.9, 10_001, 50)] == [1, 2, 10_000, 50]
    assert R.extract(df).count() == 100
    assert R.preview(df.filter("false")).columns == ["id"]


def test_catalog_of_frames(spark):
    a = spark.sql("select 1 as x, cast(null as string) as y")
    got = [tuple(r) for r in R.list_columns({"a": a, "b": spark.range(1)}).collect()]
    assert got == [("a", 0, "x", "int", False), ("a", 1, "y", "string", True), ("b", 0, "id", "bigint", False)]


def test_identifiers():
    assert split_identifier("dbo.orders") == ["dbo", "orders"]
    for bad in ("a.b.c", "a b", "1a", "x;drop", "", "a.", "a\n"):
        with pytest.raises(ValueError):
            split_identifier(bad)


@pytest.mark.parametrize("kind,url,table,query", [
    ("mssql", "jdbc:sqlserver://h:1433;databaseName=d", "[dbo].[t]", "SELECT TOP (5) * FROM [dbo].[t]"),
    ("postgresql", "jdbc:postgresql://h:5432/d", '"dbo"."t"', 'SELECT * FROM "dbo"."t" LIMIT 5'),
    ("supabase", "jdbc:postgresql://h:5432/d?sslmode=require", '"dbo"."t"', 'SELECT * FROM "dbo"."t" LIMIT 5'),
    ("mysql", "jdbc:mysql://h:3306/d", "`dbo`.`t`", "SELECT * FROM `dbo`.`t` LIMIT 5"),
    ("oracle", "jdbc:oracle:thin:@//h:1521/d", "dbo.t", "SELECT * FROM dbo.t FETCH FIRST 5 ROWS ONLY"),
])
def test_database_options(kind, url, table, query):
    c = Connector(kind, "d", "h", None, "u", "secret")
    o = R.jdbc_options(c, "dbo.t", numPartitions=8)
    assert (o["url"], o["dbtable"], o["user"], o["numPartitions"]) == (url, table, "u", "8")
    assert R.first_rows_query(c, "dbo.t", 5) == query
    assert "secret" not in repr(c)


INFO = "table_schema string, table_name string, table_type string"
COLS = "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string"


@pytest.mark.parametrize("kind,want", [
    ("mssql", ["a", "z", "pg_catalog.t", "sales.b"]), ("postgresql", ["dbo.a", "dbo.z", "sales.b"]), ("mysql", ["b"])])
def test_tables_of_a_catalog(spark, kind, want):
    info = spark.createDataFrame([("sales", "b", "BASE TABLE"), ("dbo", "z", "BASE TABLE"), ("dbo", "a", "BASE TABLE"),
                                  ("dbo", "v", "VIEW"), ("pg_catalog", "t", "BASE TABLE")], INFO)
    assert [r.name for r in R.tables_in(info, Connector(kind, "sales")).collect()] == want


def test_columns_of_a_catalog(spark):
    info = spark.createDataFrame([("dbo", "t", "b", 2, "varchar", "YES"), ("dbo", "t", "a", 1, "int", "NO"),
                                  ("s", "t", "x", 1, "int", "NO")], COLS)
    want = [(0, "a", "int", False), (1, "b", "varchar", True)]
    for table in ("t", "dbo.t"):
        got = R.columns_in(info, Connector("mssql", "d"), table).collect()
        assert [tuple(r)[1:] for r in got] == want
    assert [r.name for r in R.columns_in(info, Connector("mysql", "s"), "t").collect()] == ["x"]
    oracle = spark.createDataFrame([("T", "A", 1, "NUMBER", "N")], "table_name string, column_name string, column_id int, data_type string, nullable string")
    assert tuple(R.columns_in(oracle, Connector("oracle", "d"), "me.t").first())[1:] == (0, "A", "NUMBER", False)


def test_store_uris():
    assert R.file_uri(Connector("s3", "bucket"), "x/y.csv") == "s3a://bucket/x/y.csv"
    assert R.file_uri(Connector("azure_blob", "box", username="acct"), "y.json") == "abfss://box@acct.dfs.core.windows.net/y.json"
    assert R.file_uri(Connector("gcs", "b"), "y.json") == "gs://b/y.json"
    assert R.store_options(Connector("s3", "b", "http://host:1", username="u", password="p"))["fs.s3a.endpoint"]


def test_unsupported_type_is_refused(spark):
    with pytest.raises(ValueError, match="not supported"):
        R.read(spark, Connector("snowflake"), "t")


@pytest.mark.parametrize("name", ["t.csv", "t.json", "t.jsonl", "t.parquet"])
def test_append_and_reload(spark, folder, name):
    df = spark.createDataFrame([(1, "a,b"), (2, 'q"x'), (3, None)], "id int, name string")
    target = Target(folder, name)
    m = [Mapping("id", "id"), Mapping("name", "name")]
    for want in (3, 6):
        assert run_sync(df, m, target)[0].records == 3
        assert R.read(spark, folder, name).count() == want
    for _ in range(2):
        run_sync(df, m, target, "truncate_reload")
        got = R.read(spark, folder, name, ["id", "name"])
        assert sorted((str(r.id), r.name) for r in got.collect()) == [("1", "a,b"), ("2", 'q"x'), ("3", None)]


def test_reload_with_no_rows_still_empties(spark, folder):
    df = spark.createDataFrame([(1,)], "id int")
    target = Target(folder, "t.parquet")
    run_sync(df, [Mapping("id", "id")], target)
    run_sync(df.filter("id > 5"), [Mapping("id", "id")], target, "truncate_reload")
    assert R.read(spark, folder, "t.parquet").count() == 0
    truncate(spark, Target(folder, "new.parquet"), df.schema)
    assert R.read(spark, folder, "new.parquet").count() == 0


def test_alignment(spark, folder):
    old = spark.createDataFrame([(1, "a")], "id int, name string")
    target = Target(folder, "t.csv")
    write(old, target)
    write(spark.createDataFrame([(2,)], "id int"), target)
    wider = spark.createDataFrame([("n", 3, 9)], "name string, id int, extra int")
    with pytest.raises(ValueError, match="extra"):
        write(wider, target)
    write(wider, target, align_policy="existing")
    got = sorted(tuple(r) for r in R.read(spark, folder, "t.csv", ["id", "name"]).collect())
    assert got == [("1", "a"), ("2", None), ("3", "n")]
    assert align(wider, ["id", "zz"], "existing").columns == ["id", "zz"]


def test_failing_source_leaves_the_target(spark, folder):
    target = Target(folder, "t.parquet")
    good = spark.createDataFrame([(1,)], "id int")
    run_sync(good, [Mapping("id", "id")], target)
    bad = spark.range(3).selectExpr("cast(raise_error('source broke') as int) as id")
    with pytest.raises(Exception, match="source broke"):
        run_sync(bad, [Mapping("id", "id")], target, "truncate_reload")
    assert rows(R.read(spark, folder, "t.parquet")) == [(1,)]


def test_target_may_be_a_source(spark, folder):
    target = Target(folder, "t.parquet")
    run_sync(spark.range(5).selectExpr("id", "id * 2 as v"), [Mapping("id", "id"), Mapping("v", "v")], target)
    own = R.read(spark, folder, "t.parquet")
    run_sync(own.filter("id > 2"), [Mapping("id", "id"), Mapping("v", "v")], target, "truncate_reload")
    assert sorted(rows(R.read(spark, folder, "t.parquet"))) == [(3, 6), (4, 8)]


def test_rewrite_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4).write.parquet(path)
    assert rewrite_table(spark.read.parquet(path).filter("id < 2"), path).count() == 2


def test_append_without_a_typed_column_keeps_parquet_readable(spark, folder):
    target = Target(folder, "t.parquet")
    write(spark.sql("select 1 as i, 'x' as s, cast(2 as bigint) as n"), target)
    write(spark.sql("select 'y' as s, 3 as n"), target)  # no i, and a narrower n
    assert sorted(rows(R.read(spark, folder, "t.parquet")), key=repr) == [(1, "x", 2), (None, "y", 3)]
    with pytest.raises(ValueError, match="column i is string"):
        write(spark.sql("select 'oops' as i, 's' as s, cast(1 as bigint) as n"), target)
    assert R.read(spark, folder, "t.parquet").count() == 2


@pytest.mark.parametrize("name, text, want", [
    ("one.csv", "a,b\n1,x\n", [("1", "x"), ("2", "y")]),
    ("one.jsonl", '{"a": "1", "b": "x"}\n', [("1", "x"), ("2", "y")]),
    ("one.json", '[{"a": "1", "b": "x"}]', [("1", "x"), ("2", "y")]),
])
def test_append_to_a_single_object(spark, folder, tmp_path, name, text, want):
    put(tmp_path, name, text)
    write(spark.sql("select '2' as a, 'y' as b"), Target(folder, name))
    assert sorted(rows(R.read(spark, folder, name, ["a", "b"]))) == want


def test_csv_with_line_breaks_comes_back(spark, folder):
    texts = ["a\nb", 'quote " and\r\nbreak', "comma, x", "é\n\né"]
    write(spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1), Target(folder, "t.csv"))
    assert sorted(rows(R.read(spark, folder, "t.csv"))) == [(str(i), t) for i, t in enumerate(texts)]


def test_csv_files_with_swapped_headers_raise(spark, folder, tmp_path):
    (tmp_path / "d.csv").mkdir()
    put(tmp_path, "d.csv/1.csv", "a,b\n1,2\n")
    put(tmp_path, "d.csv/2.csv", "b,a\n3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        R.read(spark, folder, "d.csv").collect()


def test_json_folder_with_both_layouts_is_complete(spark, folder, tmp_path):
    (tmp_path / "d.json").mkdir()
    put(tmp_path, "d.json/1.json", '{"k": 1}\n{"k": 2}\n')
    put(tmp_path, "d.json/2.json", '[\n{"k": 3},\n{"k": 4}]')
    put(tmp_path, "d.json/3.json", '{\n "k": 5, "o": {"x": 1}}')
    assert sorted(r.k for r in R.read(spark, folder, "d.json").collect()) == [1, 2, 3, 4, 5]
    assert R.read(spark, folder, "d.json", schema="k int").columns == ["k"]


def test_broken_json_raises(spark, folder, tmp_path):
    put(tmp_path, "b.jsonl", '{"k": 1}\n{"k": \n')
    with pytest.raises(Exception):
        R.read(spark, folder, "b.jsonl").collect()


def test_json_append_reads_one_record(spark, folder, tmp_path, monkeypatch):
    from rowferry.sources import writers

    write(spark.sql("select 1 as a, 'x' as b"), Target(folder, "t.jsonl"))
    monkeypatch.setattr(writers, "read", lambda *a, **k: pytest.fail("the target was read"))
    write(spark.sql("select 'y' as b"), Target(folder, "t.jsonl"))
    assert sorted(rows(R.read(spark, folder, "t.jsonl", ["a", "b"])), key=repr) == [(1, "x"), (None, "y")]


def test_listed_names_can_be_read(spark, folder, tmp_path):
    (tmp_path / "sub").mkdir()
    put(tmp_path, "sub/a b.csv", "a\n1\n")
    write(spark.sql("select 1 as i"), Target(folder, "t.parquet"))
    names = [r.name for r in R.list_tables(spark, folder).collect()]
    assert names == ["sub/a b.csv", "t.parquet"]
    assert [R.read(spark, folder, n).count() for n in names] == [1, 1]


@pytest.mark.parametrize("kind, option, value", [
    ("postgresql", "connectTimeout", "15"), ("mysql", "connectTimeout", "15000"), ("mssql", "loginTimeout", "15"),
    ("oracle", "oracle.net.CONNECT_TIMEOUT", "15000"), ("mysql", "useCursorFetch", "true")])
def test_only_connecting_is_timed(kind, option, value):
    options = R.jdbc_options(Connector(kind, "d", "h"), "t")
    assert options[option] == value and "queryTimeout" not in options
    assert R.jdbc_options(Connector(kind, "d", "h"), "t", queryTimeout=60)["queryTimeout"] == "60"


def test_several_targets_get_one_read_of_a_changing_source(spark, folder):
    from pyspark.sql import functions as F
    from rowferry.plans.spec import DestinationSpec

    changing = spark.range(20).select("id", F.rand().alias("r"))
    ends = [DestinationSpec(n, Target(folder, f"{n}.parquet")) for n in ("b", "c")]
    run_sync(changing, [Mapping("id", "id"), Mapping("r", "r")], Target(folder, "a.parquet"), destinations=ends)
    a, b, c = (sorted(rows(R.read(spark, folder, f"{n}.parquet"))) for n in "abc")
    assert a == b == c


def test_staged_rows_go_and_unknown_columns_load(spark, folder):
    import os
    from rowferry.session import scratch_root

    def staged():
        top = f"{scratch_root(spark)}/rowferry"
        return {x for x in os.listdir(top) if x.startswith("combined")} if os.path.isdir(top) else set()

    before = staged()
    run_sync(spark.range(3), [Mapping("nope", "x")], Target(folder, "t.parquet"), "truncate_reload")
    assert rows(R.read(spark, folder, "t.parquet")) == [(None,)] * 3 and staged() == before


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace
    from rowferry.session import scratch_root

    conf = SimpleNamespace(get=lambda key, default=None: default, set=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local-cluster[3,2,1024]"))
    with pytest.raises(ValueError, match="share"):
        scratch_root(cluster)
