"""Queries over the logs: analytics, metering, listings, display forms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from checks.registry import query
from rowferry.functions import labels
from rowferry.functions.coerce import elapsed_ms, iso_text, round_half_up
from rowferry.functions.pricing import run_cost
from rowferry.operators import analytics as A
from rowferry.operators import daily_state as D
from rowferry.operators import incremental as I
from rowferry.operators import listings as L
from rowferry.operators import metering as M
from rowferry.operators import text_index as X
from rowferry.session import scratch_path

NOW = datetime(2024, 1, 15, 12, 0, 0)


def rounded(df, *names):
    """Sums of doubles depend on their order in the last digits; compare ten places."""
    return df.withColumns({n: F.round(F.col(n), 8) for n in names})


_LAT = "epoch_ms(completed_at) - epoch_ms(started_at)"
_PER = f"""per AS (SELECT pipeline_id, count(*) AS n, cast(coalesce(sum(records), 0) AS bigint) AS recs,
      count(*) FILTER (WHERE status = 'completed') AS ok, max(started_at) AS last_at,
      coalesce(cast(floor(avg({_LAT}) FILTER (WHERE status = 'completed') + 0.5) AS bigint), 0) AS lat
      FROM sync_runs GROUP BY pipeline_id)"""


@query(f"""
    SELECT count(*) AS total_syncs, cast(sum(coalesce(records, 0)) AS bigint) AS total_records,
      coalesce(cast(floor(avg({_LAT}) FILTER (WHERE status = 'completed') + 0.5) AS bigint), 0) AS avg_latency_ms,
      floor(count(*) FILTER (WHERE status = 'completed') / cast(count(*) AS double) * 1000.0e0 + 0.5e0) / 10.0e0 AS success_rate,
      (SELECT count(*) FROM pipelines WHERE status = 'active') AS active_pipelines,
      (SELECT count(*) FROM pipelines) AS total_pipelines FROM sync_runs""")
def overview(t):
    return A.overview(t.sync_runs, t.pipelines)


_DAILY = f"""
    SELECT strftime(started_at, '%Y-%m-%d') AS date, count(*) AS total_syncs,
      count(*) FILTER (WHERE status = 'completed') AS success_count,
      count(*) FILTER (WHERE status = 'failed') AS fail_count,
      cast(coalesce(sum(records), 0) AS bigint) AS total_records,
      coalesce(cast(floor(avg({_LAT}) + 0.5) AS bigint), 0) AS avg_latency_ms
    FROM sync_runs GROUP BY 1"""


@query(_DAILY)
def daily_stats(t):
    return A.daily_stats(t.sync_runs)


@query(f"WITH d AS ({_DAILY}) SELECT * FROM d ORDER BY date DESC LIMIT 15")
def last_15_days(t):
    return A.last_days(A.daily_stats(t.sync_runs))


_USAGE = f"""
    WITH {_PER}, ends AS (SELECT id AS pid, source_id AS cid FROM pipelines
      UNION SELECT id, target_id FROM pipelines)
    SELECT c.id AS connector_id, c.name AS connector_name, c.type AS connector_type,
      count(*) AS total_pipelines, cast(coalesce(sum(n), 0) AS bigint) AS total_syncs,
      cast(coalesce(sum(recs), 0) AS bigint) AS total_records,
      strftime(max(last_at), '%Y-%m-%dT%H:%M:%S.%gZ') AS last_used
    FROM ends JOIN connectors c ON cid = c.id LEFT JOIN per ON pid = pipeline_id
    GROUP BY c.id, c.name, c.type HAVING coalesce(sum(n), 0) > 0"""


@query(_USAGE)
def connector_usage(t):
    return A.connector_usage(t.sync_runs, t.pipelines, t.connectors).withColumn(
        "last_used", iso_text(F.col("last_used")))


@query("""
    SELECT cast(coalesce(sum(records) FILTER (WHERE direction = 'cloud_bound'), 0) AS bigint) AS cloud_bound_records,
      cast(coalesce(sum(records) FILTER (WHERE direction = 'on_prem_bound'), 0) AS bigint) AS on_prem_bound_records,
      cast(coalesce(sum(records) FILTER (WHERE direction = 'bidirectional'), 0) AS bigint) AS bidirectional_records
    FROM sync_runs""")
def direction_split(t):
    return A.direction_split(t.sync_runs)


@query(f"""
    WITH {_PER} SELECT p.id AS pipeline_id, p.name, n AS total_syncs, recs AS records, lat AS avg_latency_ms,
      floor(ok / cast(n AS double) * 1000.0e0 + 0.5e0) / 10.0e0 AS success_rate
    FROM per JOIN pipelines p ON pipeline_id = p.id""")
def leaderboard(t):
    return A.pipeline_leaderboard(t.sync_runs, t.pipelines)


@query(f"""
    WITH {_PER}, b AS (SELECT floor(ok / cast(n AS double) * 1000.0e0 + 0.5e0) / 10.0e0 AS rate FROM per JOIN pipelines p ON pipeline_id = p.id)
    SELECT rate >= 98 AS reliable, count(*) AS pipelines FROM b GROUP BY 1""")
def reliability(t):
    board = A.pipeline_leaderboard(t.sync_runs, t.pipelines)
    return board.groupBy(labels.reliable(F.col("success_rate")).alias("reliable")).agg(
        F.count(F.lit(1)).alias("pipelines"))


_HOURLY = """
    WITH h AS (SELECT unnest(range(24)) AS n),
    r AS (SELECT cast(floor((epoch_ms(started_at) - epoch_ms(timestamp '2024-01-14 12:00:00')) / 3600000.0) AS bigint) AS b,
      direction, records FROM sync_runs
      WHERE started_at >= timestamp '2024-01-14 12:00:00' AND started_at < timestamp '2024-01-15 12:00:00')
    SELECT strftime(timestamp '2024-01-14 12:00:00' + to_hours(n), '%Y-%m-%dT%H:%M:%S.000Z') AS hour,
      cast(coalesce(sum(records) FILTER (WHERE direction = 'cloud_bound'), 0) AS bigint) AS cloud_bound,
      cast(coalesce(sum(records) FILTER (WHERE direction = 'on_prem_bound'), 0) AS bigint) AS on_prem_bound,
      cast(coalesce(sum(records) FILTER (WHERE direction = 'bidirectional'), 0) AS bigint) AS bidirectional
    FROM h LEFT JOIN r ON n = b GROUP BY n"""


@query(_HOURLY)
def hourly_throughput(t):
    return A.hourly_throughput(t.sync_runs, NOW)


_PAGE = f"""
    WITH {_PER}, daily AS ({_DAILY}), used AS ({_USAGE}), hourly AS ({_HOURLY}), lines AS (
    SELECT 'overview' AS report, 'all' AS line, count(*) AS a, cast(coalesce(sum(records), 0) AS bigint) AS b,
      coalesce(cast(floor(avg({_LAT}) FILTER (WHERE status = 'completed') + 0.5) AS bigint), 0) AS c FROM sync_runs
    UNION ALL (SELECT 'daily', date, total_syncs, total_records, avg_latency_ms FROM daily ORDER BY date DESC LIMIT 15)
    UNION ALL SELECT 'connectors', connector_id, total_syncs, total_records, total_pipelines FROM used
    UNION ALL SELECT 'directions', 'all', coalesce(sum(records) FILTER (WHERE direction = 'cloud_bound'), 0),
      coalesce(sum(records) FILTER (WHERE direction = 'on_prem_bound'), 0),
      coalesce(sum(records) FILTER (WHERE direction = 'bidirectional'), 0) FROM sync_runs
    UNION ALL SELECT 'leaderboard', p.id, n, recs, lat FROM per JOIN pipelines p ON pipeline_id = p.id
    UNION ALL SELECT 'hourly', hour, cloud_bound, on_prem_bound, bidirectional FROM hourly)
    SELECT report, line, cast(a AS bigint) AS a, cast(b AS bigint) AS b, cast(c AS bigint) AS c FROM lines"""


def _page_lines(page):
    """All reports of the page under common names."""
    def lines(report, df, line, *values):
        key = F.lit("all") if line is None else F.col(line).cast("string")
        return df.select(F.lit(report).alias("report"), key.alias("line"),
                         *[F.col(v).alias(n) for v, n in zip(values, "abc")])

    out = lines("overview", page.overview, None, "total_syncs", "total_records", "avg_latency_ms")
    for more in (
        lines("daily", page.daily, "date", "total_syncs", "total_records", "avg_latency_ms"),
        lines("connectors", page.connectors, "connector_id", "total_syncs", "total_records", "total_pipelines"),
        lines("directions", page.directions, None, *[f"{d}_records" for d in A.DIRECTIONS]),
        lines("leaderboard", page.leaderboard, "pipeline_id", "total_syncs", "records", "avg_latency_ms"),
        lines("hourly", page.hourly, "hour", *A.DIRECTIONS),
    ):
        out = out.unionByName(more)
    return out


@query(_PAGE)
def analytics_page(t):
    """All reports over one staged copy of the log."""
    return _page_lines(A.analytics(t.sync_runs, t.pipelines, t.connectors, NOW))


@query(_PAGE)
def analytics_folded(t):
    """The same from daily states: three batches, each with late runs of every day, the last batch folded twice."""
    runs = t.sync_runs.withColumn("arrived", F.pmod(F.xxhash64("id"), F.lit(3)))
    mark, state = scratch_path(t.spark, "runs-mark"), scratch_path(t.spark, "runs-state")
    for seen in range(3):
        I.incremental_copy(runs.where(F.col("arrived") <= seen), "arrived", ["id"], mark, lambda b, n: D.fold(b, state, n))
    D.fold(runs.where("arrived = 2"), state, 3)
    return _page_lines(D.analytics(D.folded(t.spark, state), t.sync_runs, t.pipelines, t.connectors, NOW))


@query("""
    WITH m AS (SELECT pipeline_id, cast(sum(records) AS bigint) AS records, cast(sum(bytes) AS bigint) AS bytes,
      sum(cost_usd) AS cost FROM metering_events GROUP BY 1)
    SELECT 'summary' AS report, 'all' AS line, cast(sum(records) AS bigint) AS records, cast(sum(bytes) AS bigint) AS bytes,
      round(sum(cost_usd), 8) AS cost FROM metering_events
    UNION ALL SELECT 'daily', strftime(ts, '%Y-%m-%d'), NULL, NULL,
      round(coalesce(sum(cost_usd) FILTER (WHERE direction = 'cloud_bound'), 0)
        + coalesce(sum(cost_usd) FILTER (WHERE direction = 'on_prem_bound'), 0)
        + coalesce(sum(cost_usd) FILTER (WHERE direction NOT IN ('cloud_bound', 'on_prem_bound')), 0), 8) FROM metering_events GROUP BY 2
    UNION ALL SELECT 'pipelines', pipeline_id, records, bytes, round(cost, 8) FROM m""")
def metering_page(t):
    """All reports over one staged copy of the usage log."""
    page, no = M.metering(t.metering_events, t.pipelines), F.lit(None).cast("bigint")
    out = page.summary.select(F.lit("summary").alias("report"), F.lit("all").alias("line"), F.col("total_records").alias("records"),
                              F.col("total_bytes").alias("bytes"), F.col("total_cost").alias("cost"))
    out = out.union(page.daily.select(F.lit("daily"), "date", no, no, F.col("cloud") + F.col("on_prem") + F.col("bi")))
    out = out.union(page.pipelines.select(F.lit("pipelines"), "pipeline_id", "records", "bytes", "cost"))
    return rounded(out, "cost")


@query("""
    SELECT cast(coalesce(sum(records), 0) AS bigint) AS records_24h FROM sync_runs
    WHERE started_at >= timestamp '2024-01-14 12:00:00' AND started_at < timestamp '2024-01-15 12:00:00'""")
def day_total(t):
    return A.day_totals(A.hourly_throughput(t.sync_runs, NOW))


@query("""
    SELECT count(*) FILTER (WHERE status = 'active') AS active_pipelines, count(*) AS total_pipelines,
      floor(count(*) FILTER (WHERE status = 'active') * 100.0e0 / count(*) + 0.5e0) AS active_pct FROM pipelines""")
def active_share(t):
    return A.active_ratio(A.overview(t.sync_runs, t.pipelines))


@query(f"""
    WITH {_PER} SELECT p.id, p.name, p.source_id, s.name AS source_name, s.type AS source_type,
      p.target_id, g.name AS target_name, g.type AS target_type, p.direction, p.status,
      coalesce(p.sync_mode, 'append') AS sync_mode, coalesce(recs, 0) AS records_synced,
      strftime(last_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS last_sync, p.created_at
    FROM pipelines p LEFT JOIN per ON p.id = pipeline_id
    LEFT JOIN connectors s ON p.source_id = s.id LEFT JOIN connectors g ON p.target_id = g.id""")
def transfer_listing(t):
    return A.pipeline_listing(t.sync_runs, t.pipelines, t.connectors).withColumn(
        "last_sync", iso_text(F.col("last_sync")))


@query("""
    SELECT coalesce(category, 'none') AS category, count(*) AS connectors FROM connectors GROUP BY 1
    UNION ALL SELECT 'all', count(*) FROM connectors""")
def category_counts(t):
    named = t.connectors.withColumn("category", F.coalesce("category", F.lit("none")))
    return A.category_counts(named)


@query(f"""
    WITH {_PER} SELECT id, pipeline_id, records,
      case when {_LAT} > 0 then round(coalesce(records, 0) / (({_LAT}) / 1000.0e0), 8) end AS rows_per_sec
    FROM sync_runs WHERE completed_at IS NOT NULL""")
def run_throughput(t):
    """Extension."""
    return rounded(A.throughput(t.sync_runs), "rows_per_sec")


# -- shares ------------------------------------------------------------------

@query(f"""
    WITH u AS ({_USAGE})
    SELECT connector_id, total_records, floor(total_records * 100.0e0 / (SELECT sum(total_records) FROM u) + 0.5e0) AS share_pct FROM u""")
def connector_shares(t):
    usage = A.connector_usage(t.sync_runs, t.pipelines, t.connectors)
    return A.shares(usage.select("connector_id", "total_records"), "total_records")


@query(f"""
    WITH d AS ({_DAILY}) SELECT date, total_records,
      round(total_records * 100.0e0 / greatest((SELECT max(total_records) FROM d), 1), 8) AS height_pct FROM d""")
def daily_heights(t):
    daily = A.daily_stats(t.sync_runs).select("date", "total_records")
    return rounded(A.heights(daily, "total_records"), "height_pct")


@query("""
    WITH d AS (SELECT direction, round(sum(cost_usd), 8) AS cost FROM metering_events GROUP BY direction)
    SELECT direction, cost, floor(cost * 100.0e0 / (SELECT sum(cost) FROM d) + 0.5e0) AS share_pct FROM d""")
def cost_shares(t):
    per = t.metering_events.groupBy("direction").agg(F.round(F.sum("cost_usd"), 8).alias("cost"))
    return A.shares(per, "cost")


# -- metering ----------------------------------------------------------------

@query("""
    SELECT round(sum(cost_usd), 8) AS total_cost, cast(sum(records) AS bigint) AS total_records,
      cast(sum(bytes) AS bigint) AS total_bytes,
      round(sum(cost_usd) FILTER (WHERE direction = 'cloud_bound'), 8) AS cloud_bound_cost,
      round(sum(cost_usd) FILTER (WHERE direction = 'on_prem_bound'), 8) AS on_prem_bound_cost,
      round(sum(cost_usd) FILTER (WHERE direction = 'bidirectional'), 8) AS bidirectional_cost FROM metering_events""")
def metering_summary(t):
    return rounded(M.metering_summary(t.metering_events), "total_cost", "cloud_bound_cost",
                   "on_prem_bound_cost", "bidirectional_cost")


@query("""
    SELECT strftime(ts, '%Y-%m-%d') AS date,
      round(coalesce(sum(cost_usd) FILTER (WHERE direction = 'cloud_bound'), 0), 8) AS cloud,
      round(coalesce(sum(cost_usd) FILTER (WHERE direction = 'on_prem_bound'), 0), 8) AS on_prem,
      round(coalesce(sum(cost_usd) FILTER (WHERE direction NOT IN ('cloud_bound', 'on_prem_bound')), 0), 8) AS bi
    FROM metering_events GROUP BY 1""")
def daily_costs(t):
    return rounded(M.daily_costs(t.metering_events), "cloud", "on_prem", "bi")


@query("""
    WITH m AS (SELECT pipeline_id, cast(sum(records) AS bigint) AS records, cast(sum(bytes) AS bigint) AS bytes,
      cast(sum(compute_ms) AS bigint) AS compute_ms, round(sum(cost_usd), 8) AS cost FROM metering_events GROUP BY 1)
    SELECT m.pipeline_id, coalesce(nullif(p.name, ''), m.pipeline_id) AS pipeline_name, p.direction,
      m.records, m.bytes, m.compute_ms, m.cost FROM m LEFT JOIN pipelines p ON m.pipeline_id = p.id""")
def transfer_costs(t):
    return rounded(M.pipeline_costs(t.metering_events, t.pipelines), "cost")


@query("""
    SELECT id, round(records / 10000.0e0 * case direction when 'on_prem_bound' then 0.25e0
        when 'bidirectional' then 0.30e0 else 0.10e0 end
      + compute_ms / 60000.0e0 * case direction when 'on_prem_bound' then 0.05e0
        when 'bidirectional' then 0.06e0 else 0.02e0 end, 8) AS cost FROM metering_events""")
def cost_per_run(t):
    return rounded(t.metering_events.select(
        "id", run_cost(F.col("direction"), F.col("records"), F.col("compute_ms")).alias("cost")), "cost")


@query(f"""
    SELECT id, pipeline_id, direction, records, cast(records * 137 AS bigint) AS bytes, {_LAT} AS compute_ms,
      round(records / 10000.0e0 * case direction when 'on_prem_bound' then 0.25e0
        when 'bidirectional' then 0.30e0 else 0.10e0 end
      + ({_LAT}) / 60000.0e0 * case direction when 'on_prem_bound' then 0.05e0
        when 'bidirectional' then 0.06e0 else 0.02e0 end, 8) AS cost_usd,
      strftime(completed_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts
    FROM sync_runs WHERE status = 'completed'""")
def ledger_from_runs(t):
    """Metering rows follow from completed runs only."""
    runs = t.sync_runs.withColumn("bytes", (F.col("records") * 137).cast("bigint"))
    return rounded(M.meter_runs(runs), "cost_usd").withColumn("ts", iso_text(F.col("ts")))


@query("""
    SELECT id, printf('%.12f', round(bytes / 1073741824.0e0, 12)) AS gb_text FROM metering_events
    WHERE bytes > 0 AND round(bytes / 1073741824.0e0, 12) > 0""")
def usage_volume(t):
    return M.billable_usage(t.metering_events).select("id", F.col("gb").cast("string").alias("gb_text"))


@query("""
    WITH m AS (SELECT strftime(ts, '%Y-%m') AS month, cast(sum(bytes) AS bigint) AS bytes FROM metering_events GROUP BY 1),
    n AS (SELECT count(*) AS connectors FROM connectors)
    SELECT month, bytes, connectors,
      round(connectors * 25.0e0 + greatest(bytes / 1073741824.0e0 - 10.0e0, 0.0e0) * 0.5e0, 8) AS charge_usd FROM m, n""")
def monthly_charge(t):
    return rounded(M.monthly_charges(t.metering_events, t.connectors), "charge_usd")


# -- listings ----------------------------------------------------------------

@query("""
    WITH r AS (SELECT * FROM sync_runs ORDER BY started_at DESC, id LIMIT 50)
    SELECT r.id, r.pipeline_id, r.status, r.records, strftime(r.started_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS started,
      p.name AS pipeline_name, p.direction AS pipeline_direction FROM r LEFT JOIN pipelines p ON r.pipeline_id = p.id""")
def recent_runs(t):
    return L.recent_runs(t.sync_runs, t.pipelines).select(
        "id", "pipeline_id", "status", "records", iso_text(F.col("started_at")).alias("started"),
        "pipeline_name", "pipeline_direction")


@query("""
    WITH a AS (SELECT * FROM audit_logs ORDER BY ts DESC, id LIMIT 200)
    SELECT a.id, a.actor, a.action, a.status, a.pipeline_id, a.details, p.name AS pipeline_name, p.direction
    FROM a LEFT JOIN pipelines p ON a.pipeline_id = p.id""")
def audit_enriched(t):
    return L.audit_entries(t.audit_logs, t.pipelines, "1000").select(
        "id", "actor", "action", "status", "pipeline_id", "details", "pipeline_name", "direction")


_SEARCH = """
    SELECT a.id, a.action, a.status, p.name AS pipeline_name, a.details FROM audit_logs a
    LEFT JOIN pipelines p ON a.pipeline_id = p.id
    WHERE a.status = 'success' AND (contains(lower(a.action), 'ring') OR coalesce(contains(lower(p.name), 'ring'), false)
      OR coalesce(contains(lower(a.details), 'ring'), false))"""


@query(_SEARCH)
def log_search(t):
    """Search over the whole log, not only its newest entries."""
    entries = L._with_pipeline(t.audit_logs, t.pipelines)
    return L.search_log(entries, "RING", "success").select("id", "action", "status", "pipeline_name", "details")


@query(_SEARCH)
def log_search_indexed(t):
    """The same search through trigrams of a log indexed in two batches."""
    place = scratch_path(t.spark, "trigrams")
    entries = L._with_pipeline(t.audit_logs, t.pipelines)
    half = F.pmod(F.xxhash64("id"), F.lit(2))
    for n in (0, 1):
        X.index_batch(entries.where(half == n), place, n)
    return X.search_index(t.spark, place, "RING", "success").select("id", "action", "status", "pipeline_name", "details")


@query("""
    WITH a AS (SELECT *, row_number() OVER (ORDER BY ts DESC, id) AS n FROM audit_logs)
    SELECT id, action, coalesce(nullif(details, ''), concat(actor, ' — ', status)) AS detail, cast(n AS integer) AS position,
      n > 3 AS "read" FROM a WHERE n <= 10""")
def read_flags(t):
    return L.notifications(t.audit_logs)


@query("""
    SELECT * FROM (SELECT 'connector' AS entity, id, name, type AS info FROM connectors
      WHERE contains(lower(coalesce(name, '')), 'small') ORDER BY id LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'pipeline', id, name, concat_ws(' → ', source_table, target_table) FROM pipelines
      WHERE contains(lower(name), 'small') OR contains(lower(source_table), 'small')
        OR contains(lower(coalesce(target_table, '')), 'small') ORDER BY id LIMIT 5)""")
def global_search(t):
    return L.search(t.connectors, t.pipelines, "  SMALL ")


@query("""
    SELECT id, stripe_customer_id, usage_item_id FROM billing_accounts WHERE usage_item_id IS NOT NULL
    ORDER BY updated_at DESC, id LIMIT 1""")
def latest_billing(t):
    return L.latest_account(t.billing_accounts, "usage_item_id").select(
        "id", "stripe_customer_id", "usage_item_id")


@query("""
    SELECT d.id, d.pipeline_id, coalesce(d.match_mode, 'all') AS match_mode, k.id AS condition_id,
      k.filter_column AS extra_column, k.filter_operator AS extra_operator, k.filter_value AS extra_value
    FROM destinations d LEFT JOIN conditions k ON k.destination_id = d.id""")
def destination_lines(t):
    d = L.with_defaults(t.destinations.select("id", "pipeline_id", "match_mode"), ["match_mode"])
    return L.destination_conditions(d, t.conditions).select(
        "id", "pipeline_id", "match_mode", "condition_id", F.col("filter_column").alias("extra_column"),
        F.col("filter_operator").alias("extra_operator"), F.col("filter_value").alias("extra_value"))


@query("""
    SELECT s.id, s.source_id, c.name AS connector_name, c.type AS connector_type, c.category AS connector_category
    FROM extra_sources s LEFT JOIN connectors c ON s.source_id = c.id""")
def source_connectors(t):
    return L.with_connector(t.extra_sources, t.connectors, "source_id").select(
        "id", "source_id", "connector_name", "connector_type", "connector_category")


@query("SELECT DISTINCT target_id FROM destinations WHERE target_id <> ''")
def distinct_targets(t):
    return L.distinct_ids(t.destinations, "target_id")


@query("SELECT s.id, s.source_id FROM extra_sources s WHERE s.source_id NOT IN (SELECT id FROM connectors WHERE category = 'cloud')")
def unresolved_sources(t):
    """Extra sources that the cloud connectors don't cover."""
    return L.unresolved(t.extra_sources, t.connectors.filter(F.col("category") == "cloud"), "source_id").select("id", "source_id")


@query("""
    SELECT id, coalesce(combine_mode, 'union') AS combine_mode, coalesce(join_type, 'inner') AS join_type FROM extra_sources""")
def source_defaults(t):
    return L.with_defaults(t.extra_sources).select("id", "combine_mode", "join_type")


@query("SELECT id, name FROM connectors WHERE role <> 'target' AND status = 'connected'")
def source_picker(t):
    return L.matching(L.for_role(t.connectors, "source"), status="connected", category="all").select("id", "name")


@query("""
    SELECT id, name, type, category, role, host, port, database, status, coalesce(tables_count, 0) AS tables_count,
      coalesce(nullif(last_accessed, ''), created_at) AS last_accessed, created_at FROM connectors""")
def redacted_connectors(t):
    flat = t.connectors
    nested = flat.withColumn("config", F.struct("host", "port", "database", "username", "password"))
    return L.redacted(nested.drop("host", "port", "database", "username", "password"))


@query("SELECT id, created_at FROM extra_sources ORDER BY created_at, id")
def sources_by_created(t):
    return L.by_created(t.extra_sources.select("id", "created_at"))


# -- display forms -----------------------------------------------------------

@query("""
    SELECT event_id, case when b >= 1073741824 then concat(printf('%.2f', round(b / 1073741824.0e0, 2)), ' GB')
        when b >= 1048576 then concat(printf('%.2f', round(b / 1048576.0e0, 2)), ' MB')
        when b >= 1024 then concat(printf('%.2f', round(b / 1024.0e0, 2)), ' KB') else concat(b, ' B') end AS size,
      case when n >= 1000000 then concat(printf('%.1f', round(n / 1000000.0e0, 1)), 'M')
        when n >= 1000 then concat(printf('%.1f', round(n / 1000.0e0, 1)), 'K') else cast(n AS varchar) end AS number,
      case when ms < 1000 then concat(ms, 'ms') when ms < 60000 then concat(ms // 1000, 's')
        when ms < 3600000 then concat(ms // 60000, 'm ', ms // 1000 % 60, 's')
        else concat(ms // 3600000, 'h ', ms // 60000 % 60, 'm') end AS took,
      case when age < 60 then 'just now' when age < 3600 then concat(age // 60, 'm ago')
        when age < 86400 then concat(age // 3600, 'h ago') when age < 604800 then concat(age // 86400, 'd ago')
        else strftime(ts, '%b %-d, %Y') end AS since
    FROM (SELECT event_id, ts, event_id * 130 AS b, event_id * 7 AS n, event_id * 977 AS ms,
      cast(floor((epoch_ms(timestamp '2024-02-01 00:00:00') - epoch_ms(ts)) / 1000.0) AS bigint) AS age FROM events)""")
def humanize(t):
    e, now = F.col("event_id"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return t.events.select(
        "event_id", labels.short_bytes(e * 130).alias("size"), labels.short_count(e * 7).alias("number"),
        labels.short_duration(e * 977).alias("took"), labels.age(F.col("ts"), now).alias("since"))


@query("""
    SELECT id, case direction when 'cloud_bound' then '↑ Cloud' when 'on_prem_bound' then '↓ On-Prem'
      when 'bidirectional' then '↕ Bidirectional' else direction end AS label FROM metering_events""")
def direction_labels(t):
    return t.metering_events.select("id", labels.direction_label(F.col("direction")).alias("label"))


@query("""
    SELECT id, case type when 'postgresql' then 'PostgreSQL' when 'mysql' then 'MySQL' when 'mssql' then 'MS SQL Server'
      when 'oracle' then 'Oracle DB' when 'supabase' then 'Supabase' when 's3' then 'Amazon S3'
      when 'azure_blob' then 'Azure Blob Storage' when 'gcs' then 'Google Cloud Storage' end AS label FROM connectors""")
def connector_labels(t):
    return t.connectors.select("id", labels.connector_label(F.col("type")).alias("label"))


@query("""
    SELECT kind, count(*) AS entries FROM (SELECT case when status = 'error' then 'error'
      when starts_with(action, 'schema.') then 'schema' when contains(action, 'delete') then 'delete'
      when contains(action, 'create') then 'create' when contains(action, 'run') then 'run'
      when contains(action, 'test') then 'test' else 'other' end AS kind FROM audit_logs) GROUP BY kind""")
def activity_class(t):
    kind = labels.activity_class(F.col("action"), F.col("status")).alias("kind")
    return t.audit_logs.groupBy(kind).agg(F.count(F.lit(1)).alias("entries"))


@query("""
    SELECT id, case when confidence >= 0.9 then 'high' when confidence >= 0.7 then 'medium' else 'low' end AS band
    FROM schema_mappings""")
def confidence_bands(t):
    return t.schema_mappings.select("id", labels.confidence_band(F.col("confidence")).alias("band"))


@query(f"""
    SELECT id, {_LAT} AS took_ms, floor(value2 * 10.0e0 + 0.5e0) / 10.0e0 AS rounded, strftime(started_at, '%Y-%m-%d') AS day
    FROM (SELECT *, ({_LAT}) / 777.0e0 - 2.5e0 AS value2 FROM sync_runs)""")
def scalar_forms(t):
    took = elapsed_ms(F.col("started_at"), F.col("completed_at"))
    return t.sync_runs.select(
        "id", took.alias("took_ms"), round_half_up(took / F.lit(777.0) - F.lit(2.5), 1).alias("rounded"),
        F.date_format("started_at", "yyyy-MM-dd").alias("day"))
