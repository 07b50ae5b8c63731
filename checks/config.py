"""Queries over the configuration tables: matching, validation, lifecycle, secrets."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from rowferry.functions.coerce import key_part
from rowferry.operators import lifecycle as C
from rowferry.operators import versions
from rowferry.operators import matching as S
from rowferry.operators import validation as V
from rowferry.operators.secure import KeyRing, decrypt, encrypt
from rowferry.session import scratch_path, stage
from rowferry.sources.identifiers import schema_and_table, valid_identifier
from rowferry.sources.readers import extract, preview
from rowferry.sources.writers import rewrite_table

# -- schema matching ---------------------------------------------------------

_CLASS = """case when regexp_matches(lower({0}), 'int|numeric|decimal|float|double|real|number') then 'numeric'
    when regexp_matches(lower({0}), 'char|text|string|clob') then 'string'
    when regexp_matches(lower({0}), 'date|time') then 'date'
    when regexp_matches(lower({0}), 'bool') then 'boolean' else 'other' end"""


def _side(view: str) -> str:
    return f"""(SELECT pair, name, type, regexp_replace(lower(name), '[_\\s-]+', '', 'g') AS norm,
      {_CLASS.format('type')} AS cls, row_number() OVER (PARTITION BY pair ORDER BY ordinal, name) - 1 AS pos
      FROM (SELECT *, row_number() OVER (PARTITION BY pair, name ORDER BY ordinal, type) AS k FROM {view}) WHERE k = 1)"""


_SCORE = """case when s.norm = t.norm then 1.0e0
    else 1.0e0 - levenshtein(s.norm, t.norm) / cast(greatest(length(s.norm), length(t.norm)) AS double) end * 0.75e0
    + case when s.cls = t.cls then 0.25e0 else 0.0e0 end"""

_MATCH = f"""
    WITH RECURSIVE s AS {_side('source_columns')}, t AS {_side('target_columns')},
    sr AS (SELECT *, row_number() OVER (PARTITION BY pair, norm ORDER BY pos) AS k FROM s),
    tr AS (SELECT *, row_number() OVER (PARTITION BY pair, norm ORDER BY pos) AS k FROM t),
    exact AS (SELECT s.pair, s.pos AS spos, t.pos AS tpos, case when s.cls = t.cls then 1.0e0 else 0.75e0 end AS score
      FROM sr s JOIN tr t ON s.pair = t.pair AND s.norm = t.norm AND s.k = t.k),
    rs AS (SELECT s.*, row_number() OVER (PARTITION BY pair ORDER BY pos) AS n FROM s
      WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.pair = s.pair AND e.spos = s.pos)),
    rt AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.pair = t.pair AND e.tpos = t.pos)),
    sc AS (SELECT s.pair, s.n, s.pos AS spos, t.pos AS tpos, {_SCORE} AS score FROM rs s JOIN rt t ON s.pair = t.pair),
    g(pair, n, used, tpos, score) AS (
      SELECT DISTINCT pair, cast(0 AS bigint), cast([] AS bigint[]), cast(null AS bigint), cast(null AS double) FROM rs
      UNION ALL
      SELECT pair, n + 1, case when b.score > 0.35 then list_append(used, b.tpos) else used end,
        case when b.score > 0.35 then b.tpos end, b.score
      FROM (SELECT g.pair, g.n, g.used, (SELECT max(struct_pack(score := sc.score, neg := -sc.tpos, tpos := sc.tpos))
          FROM sc WHERE sc.pair = g.pair AND sc.n = g.n + 1 AND NOT list_contains(g.used, sc.tpos)) AS b
        FROM g WHERE EXISTS (SELECT 1 FROM rs WHERE rs.pair = g.pair AND rs.n = g.n + 1))),
    found AS (SELECT pair, spos, tpos, score FROM exact
      UNION ALL SELECT g.pair, rs.pos, g.tpos, g.score FROM g JOIN rs ON rs.pair = g.pair AND rs.n = g.n WHERE g.tpos IS NOT NULL),
    m AS (SELECT f.pair, s.name AS source_col, t.name AS target_col, s.type AS source_type, t.type AS target_type,
      floor(least(0.99e0, score) * 100.0e0 + 0.5e0) / 100.0e0 AS confidence,
      case when s.cls <> t.cls then concat('Type mismatch: source is ', s.type, ', target is ', t.type,
        '. Verify conversion is safe before running.') end AS warning
      FROM found f JOIN s ON s.pair = f.pair AND s.pos = f.spos JOIN t ON t.pair = f.pair AND t.pos = f.tpos)"""


def _matched(t):
    return S.match_schemas(S.listed_columns(t.source_columns), S.listed_columns(t.target_columns))


@query(f"{_MATCH} SELECT * FROM m")
def schema_match(t):
    """Every order's lines matched to the next order's lines, as columns of two tables."""
    return _matched(t).drop("source_ordinal")


@query(f"""{_MATCH} SELECT pair, count(*) AS columns,
      cast(floor(sum(cast(round(confidence * 100.0e0) AS bigint)) / cast(count(*) AS double) + 0.5e0) AS bigint) AS avg_confidence_pct,
      count(warning) AS warnings, count(*) FILTER (WHERE confidence >= 0.9) AS high_confidence FROM m GROUP BY pair""")
def mapping_quality(t):
    return S.mapping_quality(_matched(t))


@query(f"""
    WITH s AS {_side('source_columns')}, t AS {_side('target_columns')},
    sc AS (SELECT s.pair, s.name AS source_col, t.name AS target_col, {_SCORE} AS score,
      row_number() OVER (PARTITION BY s.pair, s.pos ORDER BY {_SCORE} DESC, t.pos) AS k
      FROM s JOIN t ON s.pair = t.pair)
    SELECT pair, source_col, target_col, round(score, 8) AS score FROM sc WHERE k = 1""")
def best_candidates(t):
    best = S.best_candidates(S.listed_columns(t.source_columns), S.listed_columns(t.target_columns))
    return best.withColumn("score", F.round("score", 8))


@query(f"""
    SELECT type, {_CLASS.format('type')} AS cls, count(*) AS columns FROM (
      SELECT type FROM source_columns UNION ALL SELECT type FROM target_columns) GROUP BY 1, 2""")
def type_class(t):
    types = t.source_columns.select("type").unionByName(t.target_columns.select("type"))
    return types.groupBy("type", S.type_class(F.col("type")).alias("cls")).agg(F.count(F.lit(1)).alias("columns"))


@query("""
    SELECT pair, name, type FROM (SELECT *, row_number() OVER (PARTITION BY pair, name ORDER BY no, ordinal, type) AS k FROM (
      SELECT pair, ordinal, name, type, 0 AS no FROM source_columns
      UNION ALL SELECT pair, ordinal, name, type, 1 AS no FROM target_columns)) WHERE k = 1""")
def candidate_columns(t):
    """Columns of a primary and a joined table; the first of equal names stays."""
    joined = t.target_columns.withColumn("source_no", F.lit(1))
    return S.candidate_columns(t.source_columns, joined).select("pair", "name", "type")


@query("""
    SELECT pair, ordinal, name, type FROM target_columns
    UNION ALL SELECT pair, ordinal, name, type FROM source_columns
      WHERE pair NOT IN (SELECT pair FROM target_columns)""")
def target_fallback(t):
    return S.targets_or_sources(t.target_columns, t.source_columns)


@query("""
    SELECT name, regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*(\\.[A-Za-z_][A-Za-z0-9_]*)?') AS valid, count(*) AS columns
    FROM source_columns GROUP BY name""")
def identifier_audit(t):
    return t.source_columns.groupBy("name").agg(F.count(F.lit(1)).alias("columns")).withColumn(
        "valid", valid_identifier(F.col("name")))


@query("""
    SELECT id, case when contains(path, '.') then split_part(path, '.', 1) else 'public' end AS schema_name,
      case when contains(path, '.') then split_part(path, '.', 2) else path end AS table_name
    FROM (SELECT id, case when id % 2 = 0 then action else actor end AS path FROM audit_logs)""")
def schema_split(t):
    path = F.when(F.col("id") % 2 == 0, F.col("action")).otherwise(F.col("actor"))
    s, n = schema_and_table(path, "public")
    return t.audit_logs.select("id", s.alias("schema_name"), n.alias("table_name"))


# -- validation --------------------------------------------------------------

_VIOLATIONS = """
    SELECT 'pipelines' AS "table", id, 'pipeline_required' AS rule FROM pipelines WHERE target_table IS NULL
    UNION ALL SELECT 'pipelines', id, 'sync_mode' FROM pipelines WHERE sync_mode NOT IN ('append', 'truncate_reload')
    UNION ALL SELECT 'pipeline_sources', id, 'combine_mode' FROM extra_sources WHERE combine_mode NOT IN ('union', 'join')
    UNION ALL SELECT 'pipeline_sources', id, 'join_columns' FROM extra_sources
      WHERE combine_mode = 'join' AND (join_column IS NULL OR primary_join_column IS NULL)
    UNION ALL SELECT 'pipeline_sources', id, 'join_type' FROM extra_sources WHERE join_type NOT IN ('inner', 'left')
    UNION ALL SELECT 'pipeline_destinations', id, 'destination_required' FROM destinations WHERE filter_value = ''
    UNION ALL SELECT 'pipeline_destinations', id, 'filter_operator' FROM destinations
      WHERE filter_operator NOT IN ('=', '!=', '>', '<', '>=', '<=', 'contains')
    UNION ALL SELECT 'pipeline_destinations', id, 'match_mode' FROM destinations WHERE match_mode NOT IN ('all', 'any')
    UNION ALL SELECT 'pipeline_destination_conditions', id, 'condition_required' FROM conditions WHERE filter_operator IS NULL
    UNION ALL SELECT 'connectors', id, 'connector_required' FROM connectors WHERE category IS NULL
    UNION ALL SELECT 'connectors', id, 'role' FROM connectors WHERE role NOT IN ('source', 'target', 'both')"""


@query(_VIOLATIONS)
def config_violations(t):
    return V.all_violations({
        "pipelines": t.pipelines, "pipeline_sources": t.extra_sources,
        "pipeline_destinations": t.destinations,
        "pipeline_destination_conditions": t.conditions, "connectors": t.connectors,
    }).drop("message")


# -- lifecycle ---------------------------------------------------------------

def _tables(t):
    return {
        "pipelines": t.pipelines, "pipeline_nodes": t.nodes, "schema_mappings": t.schema_mappings,
        "pipeline_sources": t.extra_sources, "pipeline_destinations": t.destinations,
        C.CONDITIONS: t.conditions, "sync_runs": t.sync_runs, "metering_events": t.metering_events,
        "audit_logs": t.audit_logs, "connectors": t.connectors,
    }


@query("""
    WITH gone AS (SELECT id FROM pipelines WHERE status = 'draft')
    SELECT 'pipelines' AS tbl, cast(id AS varchar) AS id FROM pipelines WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'nodes', id FROM nodes WHERE pipeline_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'mappings', id FROM schema_mappings WHERE pipeline_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'sources', id FROM extra_sources WHERE pipeline_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'destinations', id FROM destinations WHERE pipeline_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'conditions', id FROM conditions WHERE destination_id NOT IN (
      SELECT id FROM destinations WHERE pipeline_id IN (SELECT id FROM gone))
    UNION ALL SELECT 'runs', cast(id AS varchar) FROM sync_runs WHERE pipeline_id NOT IN (SELECT id FROM gone)""")
def cascade_delete(t):
    """All draft transfers deleted together with what belongs to them."""
    doomed = t.pipelines.filter(F.col("status") == "draft").select("id")
    left = C.delete_pipelines(_tables(t), doomed)
    names = {"pipelines": "pipelines", "pipeline_nodes": "nodes", "schema_mappings": "mappings",
             "pipeline_sources": "sources", "pipeline_destinations": "destinations",
             C.CONDITIONS: "conditions", "sync_runs": "runs"}
    out = None
    for table, shown in names.items():
        part = left[table].select(F.lit(shown).alias("tbl"), F.col("id").cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""
    SELECT id, case when pipeline_id IN (SELECT id FROM pipelines WHERE status = 'draft') then null
      else pipeline_id end AS pipeline_id FROM metering_events""")
def null_out_fk(t):
    doomed = t.pipelines.filter(F.col("status") == "draft").select("id")
    return C.clear_reference(t.metering_events, doomed, "pipeline_id").select("id", "pipeline_id")


@query("""
    SELECT id FROM conditions WHERE destination_id NOT IN (SELECT id FROM destinations WHERE filter_operator = 'like')""")
def destination_delete(t):
    doomed = t.destinations.filter(F.col("filter_operator") == "like").select("id")
    return C.delete_destinations(_tables(t), doomed)[C.CONDITIONS].select("id")


@query("""
    SELECT id FROM connectors WHERE id IN (SELECT source_id FROM pipelines UNION SELECT target_id FROM pipelines
      UNION SELECT source_id FROM extra_sources UNION SELECT target_id FROM destinations)""")
def referenced_connectors(t):
    return C.referenced_connectors(_tables(t)).select("id")


@query("""
    SELECT p.id, coalesce(u.status, p.status) AS status FROM pipelines p LEFT JOIN (
      SELECT pipeline_id, case when arg_max(status, struct_pack(a := started_at, b := id)) = 'failed' then 'error' else 'active' end AS status
      FROM sync_runs WHERE status <> 'running' GROUP BY pipeline_id) u ON p.id = u.pipeline_id""")
def status_update(t):
    """A transfer's status follows its last ended run."""
    ended = t.sync_runs.filter(F.col("status") != "running")
    last = ended.groupBy(F.col("pipeline_id").alias("id")).agg(
        F.max_by("status", F.struct("started_at", F.col("id"))).alias("last"))
    new = last.select("id", F.when(F.col("last") == "failed", "error").otherwise("active").alias("status"))
    return C.apply_updates(t.pipelines, new, "id", ["status"]).select("id", "status")


@query("""
    SELECT id, pipeline_id, position_x FROM nodes WHERE pipeline_id NOT IN (SELECT id FROM pipelines WHERE status IN ('active', 'draft'))
    UNION ALL SELECT concat('new', id), id, 0 FROM pipelines WHERE status = 'active'""")
def replace_all(t):
    """New snapshots for active transfers, empty ones for drafts; others keep their rows."""
    keys = t.pipelines.filter(F.col("status").isin("active", "draft")).select(F.col("id").alias("pipeline_id"))
    new = t.pipelines.filter(F.col("status") == "active").select(
        F.concat(F.lit("new"), "id").alias("id"), F.col("id").alias("pipeline_id"),
        F.lit(0).alias("position_x"))
    return C.replace_by_key(t.nodes.select("id", "pipeline_id", "position_x"), new, keys, "pipeline_id")


@query("""
    SELECT id, pipeline_id, position_x FROM nodes WHERE pipeline_id NOT IN (SELECT id FROM pipelines WHERE status IN ('active', 'draft'))
    UNION ALL SELECT concat('new', id), id, 1 FROM pipelines WHERE status = 'active'""")
def replace_versions(t):
    """Active transfers replaced twice and drafts cleared as versions over an untouched table, which are then folded."""
    place = scratch_path(t.spark, "versions")
    ids = t.pipelines.select(F.col("id").alias("pipeline_id"), "status")
    active = ids.filter("status = 'active'")
    for x in (0, 1):
        new = active.select(F.concat(F.lit("new"), "pipeline_id").alias("id"), "pipeline_id", F.lit(x).alias("position_x"))
        versions.replace_keys(new, active, "pipeline_id", place)
    versions.replace_keys(new.limit(0), ids.filter("status = 'draft'"), "pipeline_id", place)
    versions.compact(t.spark, place, "pipeline_id")
    return versions.current(t.spark, place, "pipeline_id", t.nodes.select("id", "pipeline_id", "position_x"))


@query("""
    SELECT concat('p_', replace(n.pipeline_id, ' ', '%20'), '_', replace(label, ' ', '%20')) AS doc_id, count(*) AS n
    FROM nodes n GROUP BY 1""")
def composed_ids(t):
    doc = C.composed_id(F.col("pipeline_id"), F.col("label"))
    return t.nodes.groupBy(doc.alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT id, case when position_x > 200 then 'moved' else type end AS type FROM nodes
    UNION ALL SELECT concat('x', p_partkey), 'added' FROM part""")
def upsert_by_id(t):
    changed = t.nodes.filter(F.col("position_x") > 200).select("id", F.lit("moved").alias("type"))
    added = t.part.select(F.concat(F.lit("x"), "p_partkey").alias("id"), F.lit("added").alias("type"))
    return C.upsert(t.nodes.select("id", "type"), changed.unionByName(added), ["id"])


@query("SELECT c_custkey, case when c_acctbal < 0 then 'debt' else c_mktsegment end AS c_mktsegment FROM customer")
def rewrite_in_place(t):
    """A table replaced by a query over itself."""
    path = scratch_path(t.spark, "table")
    t.customer.select("c_custkey", "c_mktsegment", "c_acctbal").write.parquet(path)
    own = t.spark.read.parquet(path)
    new = own.withColumn("c_mktsegment", F.when(F.col("c_acctbal") < 0, "debt").otherwise(F.col("c_mktsegment")))
    return rewrite_table(new, path).select("c_custkey", "c_mktsegment")


# -- secrets, previews -------------------------------------------------------

#: A key for trials only.
TRIAL_KEY = "MDEyMzQ1Njc4OWFiY2RlZjAxMjM0NTY3ODlhYmNkZWY="


@query("SELECT c_custkey, c_name FROM customer")
def encrypt_roundtrip(t):
    sealed = t.customer.select("c_custkey", encrypt(F.col("c_name"), TRIAL_KEY).alias("sealed"))
    return sealed.select("c_custkey", decrypt(F.col("sealed"), TRIAL_KEY).alias("c_name"))


#: Another one, for trials of replacing the first.
NEXT_KEY = "ZmVkY2JhOTg3NjU0MzIxMGZlZGNiYTk4NzY1NDMyMTA="


@query("SELECT c_custkey, c_name, case when c_custkey % 3 = 0 then 'new' else 'old' end AS was, 'new' AS now FROM customer")
def key_rotation(t):
    """A table under two keys, read, brought under the newer one, stored and read again."""
    old = KeyRing(t.spark, {"old": TRIAL_KEY}, "old")
    ring = KeyRing(t.spark, {"old": TRIAL_KEY, "new": NEXT_KEY}, "new")
    names = t.customer.select("c_custkey", "c_name")
    mixed = ring.seal(names.where("c_custkey % 3 = 0"), "c_name").union(old.seal(names.where("c_custkey % 3 <> 0"), "c_name"))
    mixed = stage(mixed, "sealed").withColumn("was", F.substring_index("c_name", ".", 1))
    moved = stage(ring.reseal(mixed, "c_name"), "resealed").withColumn("now", F.substring_index("c_name", ".", 1))
    return KeyRing(t.spark, {"new": NEXT_KEY}, "new").open(moved, "c_name")


@query("""
    SELECT c_custkey, 16 AS iv_chars, 24 AS tag_chars, cast(4 * ceil(strlen(c_name) / 3.0) AS integer) AS data_chars FROM customer""")
def encrypt_layout(t):
    parts = F.split(encrypt(F.col("c_name"), TRIAL_KEY), "[.]")
    # One array of lengths, so that all three come from one drawing of the IV.
    shaped = t.customer.select("c_custkey", F.transform(parts, lambda p: F.length(p)).alias("n"))
    return shaped.select("c_custkey", F.col("n")[0].alias("iv_chars"), F.col("n")[1].alias("tag_chars"),
                         F.col("n")[2].alias("data_chars"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def preview_rows(t):
    return preview(t.orders.select("o_orderkey", "o_totalprice"),
                   order_by=[F.desc("o_totalprice"), "o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 10000")
def extract_clamped(t):
    """A request for more than the largest extract gets that many rows."""
    return extract(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), 25000.9,
                   ["l_extendedprice", "l_orderkey", "l_linenumber"])


@query("""SELECT id, replace(name, ' ', '%20') AS part_text FROM pipelines""")
def key_encoding(t):
    return t.pipelines.select("id", key_part(F.col("name")).alias("part_text"))
