"""Queries over the extensions: incremental copies, upserts, conflicts, streams."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from checks.registry import query
from rowferry.operators import incremental as I
from rowferry.operators.metering import usage_throughput as throughput_of_usage
from rowferry.plans.spec import Condition, DestinationSpec, Mapping
from rowferry.session import scratch_path
from rowferry.streaming.latest import apply_stream, stream_latest
from rowferry.streaming.live import hourly_by_direction, stream_fanout, write_stream


@query("SELECT event_id, event_type FROM events WHERE ts > timestamp '2024-01-20 06:00:00'")
def incremental_watermark(t):
    return I.incremental(t.events, "ts", "2024-01-20 06:00:00").select("event_id", "event_type")


@query("""
    SELECT event_id, cast(ts AS date) AS day, case when cast(ts AS date) > date '2024-01-20' then 3
      when cast(ts AS date) < date '2024-01-15' or (cast(ts AS date) = date '2024-01-15' and event_id % 2 = 0) then 1
      else 2 end AS batch FROM events""")
def incremental_at_the_mark(t):
    """Four copies by day: half of a day arrives after the mark has reached it, and the last call finds nothing new."""
    rows = t.events.select("event_id", F.to_date("ts").alias("day"))
    place, out = scratch_path(t.spark, "mark"), scratch_path(t.spark, "copied")
    first = rows.where("day < '2024-01-15' or (day = '2024-01-15' and event_id % 2 = 0)")

    def load(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    for some in (first, rows.where("day <= '2024-01-20'"), rows, rows):
        I.incremental_copy(some, "day", ["event_id"], place, load)
    return t.spark.read.parquet(out).select("event_id", "day", "batch")


@query("SELECT cast(max(event_id) AS varchar) AS watermark FROM events")
def watermark_after_load(t):
    return I.next_watermark(t.events, "event_id")


_LATEST = """
    WITH c AS (SELECT o_custkey, arg_max(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) AS price FROM orders GROUP BY 1)
    SELECT c_custkey, coalesce(price, c_acctbal) AS balance FROM customer LEFT JOIN c ON c_custkey = o_custkey
    UNION ALL SELECT o_custkey, price FROM c WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"""


@query(_LATEST)
def upsert_latest(t):
    """Each customer's balance replaced by their newest order's price."""
    current = t.customer.select("c_custkey", F.col("c_acctbal").alias("balance"))
    changes = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("balance"),
                              "o_orderdate", "o_orderkey")
    return I.upsert_latest(current, changes, ["c_custkey"], ["o_orderdate", "o_orderkey"])


@query(_LATEST)
def stream_upsert_latest(t):
    """The same from a stream whose changes arrive in four lots that are in no order."""
    spark, order = t.spark, ["o_orderdate", "o_orderkey"]
    current = t.customer.select("c_custkey", F.col("c_acctbal").alias("balance"))
    lots, out = scratch_path(spark, "changes"), scratch_path(spark, "latest")
    changes = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("balance"), *order)
    changes.repartition(4, F.xxhash64("o_orderkey")).write.parquet(lots)
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(lots)
    stream_latest(stream, ["c_custkey"], order, out, scratch_path(spark, "offsets"), timedelta(days=3650)).awaitTermination()
    return apply_stream(spark, current, out, changes.schema, ["c_custkey"], order)


@query("""
    WITH b AS (SELECT c_custkey, c_name, case when c_custkey % 5 = 0 then lower(c_mktsegment) else c_mktsegment end AS seg,
      case when c_custkey % 7 <> 0 then c_nationkey end AS nat FROM customer)
    SELECT 'customer' AS table_name, a.c_custkey, 'c_mktsegment' AS column_name, a.c_mktsegment AS source_value, seg AS target_value,
      a.c_mktsegment AS resolved_value, 'merge' AS resolution FROM customer a JOIN b USING (c_custkey) WHERE a.c_mktsegment <> seg
    UNION ALL SELECT 'customer', a.c_custkey, 'c_nationkey', cast(a.c_nationkey AS varchar), cast(nat AS varchar), cast(a.c_nationkey AS varchar), 'merge'
      FROM customer a JOIN b USING (c_custkey) WHERE a.c_nationkey IS DISTINCT FROM nat""")
def conflicts(t):
    a = t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    b = a.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, F.lower("c_mktsegment"))
                     .otherwise(F.col("c_mktsegment")))
    b = b.withColumn("c_nationkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")))
    return I.conflicts(a, b, ["c_custkey"], "customer", "merge")


@query("""
    WITH a AS (SELECT c_custkey, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0),
      b AS (SELECT c_custkey, case when c_custkey % 5 = 0 then lower(c_mktsegment) else c_mktsegment end AS seg FROM customer WHERE c_custkey % 4 <> 0)
    SELECT 'customer' AS table_name, coalesce(a.c_custkey, b.c_custkey) AS c_custkey, 'seg' AS column_name, a.seg AS source_value,
      b.seg AS target_value, coalesce(a.seg, b.seg) AS resolved_value, 'merge' AS resolution
    FROM a FULL JOIN b ON a.c_custkey = b.c_custkey WHERE a.seg IS DISTINCT FROM b.seg""")
def conflicts_one_sided(t):
    """Rows of either side alone are conflicts too."""
    seg = F.col("c_mktsegment")
    a = t.customer.filter("c_custkey % 3 <> 0").select("c_custkey", seg.alias("seg"))
    b = t.customer.filter("c_custkey % 4 <> 0").select(
        "c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.lower(seg)).otherwise(seg).alias("seg"))
    return I.conflicts(a, b, ["c_custkey"], "customer", "merge", one_sided=True)


def _event_stream(t):
    # A pattern, because the table may be one file or a folder of files.
    return t.spark.readStream.schema(t.events.schema).parquet(t.path("events") + "*")


@query("""
    SELECT 'primary' AS destination_id, event_id AS id, event_type AS kind FROM events
    UNION ALL SELECT 'purchases', event_id, event_type FROM events WHERE event_type = 'purchase'
    UNION ALL SELECT 'valuable', event_id, event_type FROM events WHERE value > 10 OR event_type = 'error'""")
def stream_fanout_all(t):
    """The files of the event table as a stream, fanned out per micro-batch."""
    out = scratch_path(t.spark, "fanout")
    dests = [
        DestinationSpec("purchases", None, (Condition("event_type", "=", "purchase"),)),
        DestinationSpec("valuable", None, (Condition("value", ">", "10"), Condition("event_type", "=", "error")), "any"),
    ]
    q = stream_fanout(_event_stream(t), [Mapping("event_id", "id"), Mapping("event_type", "kind")], dests,
                      out, scratch_path(t.spark, "offsets"))
    q.awaitTermination()
    return t.spark.read.parquet(out).select(
        F.col("destination_id").cast("string").alias("destination_id"), "id", "kind")


@query("""
    WITH w AS (SELECT date_trunc('hour', started_at) AS h, direction, records FROM sync_runs)
    SELECT strftime(h, '%Y-%m-%dT%H:%M:%S.000Z') AS hour,
      cast(coalesce(sum(records) FILTER (WHERE direction = 'cloud_bound'), 0) AS bigint) AS cloud_bound,
      cast(coalesce(sum(records) FILTER (WHERE direction = 'on_prem_bound'), 0) AS bigint) AS on_prem_bound,
      cast(coalesce(sum(records) FILTER (WHERE direction = 'bidirectional'), 0) AS bigint) AS bidirectional
    FROM w WHERE h + interval 1 hour <= (SELECT max(started_at) FROM sync_runs) - interval 10 minutes GROUP BY h""")
def stream_hourly(t):
    """Hours the watermark has closed once all files are read."""
    e = _event_stream(t)
    runs = e.select(
        F.expr("case user_id % 3 when 0 then 'cloud_bound' when 1 then 'on_prem_bound' else 'bidirectional' end").alias("direction"),
        F.expr("case when event_type = 'view' then null else cast(get_json_object(props, '$.k') as int) end").alias("records"),
        F.col("ts").cast("timestamp").alias("started_at"))
    out = scratch_path(t.spark, "hourly")
    hourly = hourly_by_direction(runs).select(
        F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("hour"),
        "cloud_bound", "on_prem_bound", "bidirectional")
    write_stream(hourly, out, scratch_path(t.spark, "offsets")).awaitTermination()
    return t.spark.read.schema(hourly.schema).parquet(out)


@query("""
    SELECT id, case when compute_ms > 0 then round(records / (compute_ms / 1000.0e0), 8) end AS rows_per_sec,
      case when compute_ms > 0 then round(bytes / (compute_ms / 1000.0e0), 8) end AS bytes_per_sec FROM metering_events""")
def usage_throughput(t):
    rates = throughput_of_usage(t.metering_events)
    return rates.select("id", *[F.round(c, 8).alias(c) for c in ("rows_per_sec", "bytes_per_sec")])
