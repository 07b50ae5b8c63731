import pytest

from rowferry.operators.listings import search_log
from rowferry.operators.text_index import index_batch, search_index

COLUMNS = "id long, ts timestamp_ntz, action string, pipeline_name string, details string, status string"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    words = ["Running", "string", "ERROR", "naïve Straße", "a.b%c_d", "😀 smile 😀x", "x", ""]
    lines = [(i, None if i % 50 == 0 else f"2024-01-{1 + i % 9:02d} 10:00:00", words[i % 8],
              None if i % 3 else f"Pipe {i}", f"moved {i * 37} rows" if i % 5 else None, "success" if i % 2 else "error")
             for i in range(1, 400)]
    lines.append((400, "2024-02-01 00:00:00", "rare needle", None, None, "success"))
    df = spark.createDataFrame(lines, "id long, t string, action string, pipeline_name string, details string, status string")
    df = df.selectExpr("id", "cast(t AS timestamp_ntz) AS ts", "action", "pipeline_name", "details", "status")
    place = str(tmp_path_factory.mktemp("index"))
    for n in range(2):
        index_batch(df.where(f"id % 2 = {n}"), place, n)
    index_batch(df.where("id % 2 = 1"), place, 1)  # repeated: replaces itself
    return df, place


@pytest.mark.parametrize("text", ["ring", "RING", "", "x", "pi", "pipe 3", "moved 37", "straße", "a.b%c_d", "😀 s", "not there",
                                  "rare needle", "error\nmoved"])
@pytest.mark.parametrize("status", ["all", "success"])
def test_same_rows_as_the_scan(spark, log, text, status):
    df, place = log
    found = search_index(spark, place, text, status)
    assert found.columns == df.columns
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in search_log(df, text, status).collect())


def test_only_days_with_hits_are_opened(spark, log):
    plan = search_index(spark, log[1], "rare needle")._jdf.queryExecution().executedPlan().toString()
    scan = [x for x in plan.splitlines() if "FileScan" in x and "details" in x]
    assert scan and all("2024-02-01" in x and "PartitionFilters: [" in x for x in scan)
    assert not any("2024-01-0" in x for x in scan)


def test_empty_batch(spark, log, tmp_path):
    df, _ = log
    place = str(tmp_path)
    index_batch(df.limit(0), place, 1)
    assert search_index(spark, place, "needle").collect() == [] == search_index(spark, place, "").collect()
    index_batch(df.where("id = 400"), place, 0)
    index_batch(df.limit(0), place, 1)
    assert [r.id for r in search_index(spark, place, "needle").collect()] == [400]


@pytest.mark.parametrize("held", [1, 40, 4_000_000])
def test_bitmaps_are_made_from_columns(monkeypatch, held):
    """Every trigram's entries, whatever a task holds at once; none runs over the border of two texts."""
    import pyarrow as pa

    from rowferry.operators import text_index as X

    monkeypatch.setattr(X, "HELD", held)
    monkeypatch.setattr(X, "AT_ONCE", 2)
    texts = ["", "ab", "abc", "😀bcabc", "aaaa", "ß\nabc"] * 7
    rows = [("d1" if i < 20 else "d2", 32_760 + i, t) for i, t in enumerate(texts)]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))]
    batch = pa.RecordBatch.from_arrays(columns, ["log_day", "log_no", "text"])
    got = {}
    for out in X._posted([batch.slice(0, 13), batch.slice(13), batch.slice(0, 0)]):
        for r in out.to_pylist():
            bits = {8 * i + k for i, b in enumerate(r["bits"]) for k in range(8) if b >> k & 1}
            got.setdefault((r["log_day"], r["gram"], r["bucket"]), set()).update(bits)
    want = {}
    for day, no, t in rows:
        for i in range(len(t) - 2):
            want.setdefault((day, t[i:i + 3], 1 + (no - 1) // 32_768), set()).add((no - 1) % 32_768)
    assert got == want
