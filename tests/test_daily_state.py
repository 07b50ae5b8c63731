from datetime import datetime

from pyspark.sql import functions as F

from rowferry.operators import analytics as A
from rowferry.operators import daily_state as D
from rowferry.session import scratch_path

SCHEMA = "id int, pipeline_id string, direction string, status string, records bigint, started_at timestamp, completed_at timestamp"


def at(day, second=0):
    return datetime(2024, 1, day, 10, 0, second)


RUNS = [
    (1, "p", "cloud_bound", "completed", 5, at(1), at(1, 3)), (2, "p", "cloud_bound", "failed", None, at(2), at(2, 1)),
    (3, "q", None, "completed", 7, at(1), None), (4, None, "other", "running", 1, at(3), None),
    (5, "q", "bidirectional", "completed", 2, None, at(3)), (6, "p", "cloud_bound", "completed", 9, at(1, 1), at(1, 9)),
]


def rows(df):
    return sorted(map(str, df.collect()))


def test_late_runs_and_repeated_batches(spark):
    runs = spark.createDataFrame(RUNS, SCHEMA)
    pipelines = spark.createDataFrame([("p", "P", "a", "b", "active"), ("q", "Q", "b", "b", "draft")],
                                      "id string, name string, source_id string, target_id string, status string")
    connectors = spark.createDataFrame([("a", "A", "csv"), ("b", "B", "csv")], "id string, name string, type string")
    state = scratch_path(spark, "state")
    # Run 6 is late: its day was folded with the first batch.
    for batch, ids in ((1, [1, 2]), (2, [3, 4, 5]), (2, [3, 4, 5]), (3, [6])):
        D.fold(runs.where(F.col("id").isin(ids)), state, batch)
    parts = D.folded(spark, state)
    assert parts.where("date = '2024-01-01' and pipeline_id = 'p'").first().runs == 2
    now = datetime(2024, 1, 2, 12)
    for mine, whole in zip(D.analytics(parts, runs, pipelines, connectors, now), A.analytics(runs, pipelines, connectors, now)):
        assert mine.columns == whole.columns and rows(mine) == rows(whole)


def test_no_runs(spark):
    state = scratch_path(spark, "state")
    none = spark.createDataFrame([], SCHEMA)
    D.fold(none, state, 1)
    parts = D.folded(spark, state)
    pipelines = spark.createDataFrame([], "id string, status string")
    assert rows(D.overview(parts, pipelines)) == rows(A.overview(none, pipelines))
    assert rows(D.daily_stats(parts)) == [] and rows(D.direction_split(parts)) == rows(A.direction_split(none))
