"""Queries over the run path: joins, unions, filters, mapping, sizes, loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.derived import Tables
from checks.registry import query
from rowferry.functions.coerce import number_of, row_bytes, text_of
from rowferry.operators.combine import Combined, combine
from rowferry.operators.condition_index import LINES, condition_index, indexed_summary
from rowferry.operators.fanout import fanout_summary, run_totals
from rowferry.operators.predicates import condition, conditions, flag
from rowferry.operators.remap import cast_failures, remap
from rowferry.plans.jobs import Store, map_job, run_job
from rowferry.plans.run import result_frame, run_partitioned, run_sync
from rowferry.plans.spec import Condition, DestinationSpec, Mapping, SourceSpec, Target
from rowferry.session import scratch_path
from rowferry.sources.ranges import csv_table, json_array_lines
from rowferry.sources.readers import file_uri, read, read_json
from rowferry.sources.writers import scratch_target, write

ORDER_MAPPINGS = [
    Mapping("o_orderkey", "order_id"), Mapping("c_name", "customer"), Mapping("n_name", "nation"),
    Mapping("o_totalprice", "amount"), Mapping("o_orderpriority", "priority"),
]
ORDER_DESTINATIONS = [
    DestinationSpec("large_building", None, (
        Condition("c_mktsegment", "=", "BUILDING"), Condition("o_totalprice", ">", "200000"))),
    DestinationSpec("final_or_urgent", None, (
        Condition("o_orderstatus", "=", "F"), Condition("o_orderpriority", "contains", "urgent")), "any"),
]


def orders_with_customer(t: Tables, join_type: str = "left"):
    return combine(t.orders, [
        SourceSpec(t.customer, "join", join_type, (("o_custkey", "c_custkey"),)),
        SourceSpec(t.nation, "join", join_type, (("c_nationkey", "n_nationkey"),)),
    ], [m.source_col for m in ORDER_MAPPINGS])


# JSON size of a mapped order; NULL joined columns are absent.
_ORDER_ROW = """
    strlen(concat('{"order_id":', o_orderkey,
      case when c_custkey is not null then concat(',"customer":"', c_name, '"') else '' end,
      case when n_nationkey is not null then concat(',"nation":"', n_name, '"') else '' end,
      ',"amount":', case when o_totalprice = floor(o_totalprice)
        then cast(cast(o_totalprice as bigint) as varchar) else cast(o_totalprice as varchar) end,
      ',"priority":"', o_orderpriority, '"}'))"""
_FANOUT_SQL = f"""
    WITH r AS (
      SELECT *, {_ORDER_ROW} AS nbytes FROM orders
      LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
    d AS (
      SELECT 'primary' AS destination_id, nbytes FROM r
      UNION ALL SELECT 'large_building', nbytes FROM r
        WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000
      UNION ALL SELECT 'final_or_urgent', nbytes FROM r
        WHERE o_orderstatus = 'F' OR lower(o_orderpriority) LIKE '%urgent%')
    SELECT destination_id, count(*) AS records, cast(sum(nbytes) AS bigint) AS bytes
    FROM d GROUP BY destination_id"""


@query(_FANOUT_SQL)
def run_fanout_summary(t):
    return fanout_summary(orders_with_customer(t), ORDER_MAPPINGS, ORDER_DESTINATIONS)


@query(f"""
    WITH s AS ({_FANOUT_SQL})
    SELECT cast(sum(records) AS bigint) AS total_records, cast(sum(bytes) AS bigint) AS total_bytes FROM s""")
def run_totals_all(t):
    return run_totals(run_fanout_summary(t))


@query(_FANOUT_SQL)
def run_loads(t):
    """The same run with its loads carried out, counts taken while writing."""
    from dataclasses import replace

    dests = [replace(d, target=scratch_target(t.spark, f"{d.id}.parquet")) for d in ORDER_DESTINATIONS]
    loaded = run_sync(
        t.orders, ORDER_MAPPINGS, scratch_target(t.spark, "orders.parquet"), "truncate_reload",
        [SourceSpec(t.customer, "join", "left", (("o_custkey", "c_custkey"),)),
         SourceSpec(t.nation, "join", "left", (("c_nationkey", "n_nationkey"),))], dests)
    return result_frame(t.spark, loaded)


@query("""
    WITH r AS (SELECT * FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)
    SELECT destination_id, o_orderkey AS order_id, c_name AS customer, n_name AS nation, o_totalprice AS amount,
      o_orderpriority AS priority FROM (
      SELECT 'primary' AS destination_id, * FROM r
      UNION ALL SELECT 'large_building', * FROM r WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000
      UNION ALL SELECT 'final_or_urgent', * FROM r WHERE o_orderstatus = 'F' OR lower(o_orderpriority) LIKE '%urgent%')""")
def run_partitioned_loads(t):
    """All destinations loaded in one pass, then read back."""
    return run_partitioned(
        t.orders, ORDER_MAPPINGS, scratch_path(t.spark, "partitioned"),
        [SourceSpec(t.customer, "join", "left", (("o_custkey", "c_custkey"),)),
         SourceSpec(t.nation, "join", "left", (("c_nationkey", "n_nationkey"),))], ORDER_DESTINATIONS)


@query("""
    WITH o AS (SELECT *, strlen(concat('{"order_id":', o_orderkey, ',"priority":"', o_orderpriority, '"}')) AS nbytes FROM orders),
    d AS (
      SELECT 'primary' AS id, nbytes FROM o
      UNION ALL SELECT concat('customer-', c_custkey), nbytes FROM o JOIN customer ON o_custkey = c_custkey
        AND o_totalprice > cast(floor(c_acctbal) AS bigint) * 20
      UNION ALL SELECT concat('part-', p_partkey), nbytes FROM o JOIN part
        ON o_totalprice >= cast(floor(p_retailprice) AS bigint) * 100 AND o_totalprice < cast(floor(p_retailprice) AS bigint) * 100 + 50
      UNION ALL SELECT concat('supplier-', s_suppkey), nbytes FROM o JOIN supplier
        ON o_custkey = s_suppkey OR o_totalprice > 300000 + cast(floor(s_acctbal) AS bigint) * 20),
    n AS (SELECT 'primary' AS id UNION ALL SELECT concat('customer-', c_custkey) FROM customer
      UNION ALL SELECT concat('part-', p_partkey) FROM part UNION ALL SELECT concat('supplier-', s_suppkey) FROM supplier)
    SELECT id AS destination_id, count(nbytes) AS records, cast(coalesce(sum(nbytes), 0) AS bigint) AS bytes
    FROM n LEFT JOIN d USING (id) GROUP BY id""")
def fanout_indexed(t):
    """A destination for each customer (value and bound), part (interval) and supplier (either of two conditions)."""
    def lines(df, kind, key, mode, *conditions):
        each = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(op).alias("operator"),
                                  v.cast("string").alias("value")) for i, (c, op, v) in enumerate(conditions)])
        return df.select(F.concat(F.lit(f"{kind}-"), F.col(key).cast("string")).alias("destination_id"),
                         F.lit(mode).alias("match_mode"), F.inline(each)).select(LINES.names)

    def whole(name):
        return F.floor(F.col(name)).cast("bigint")

    price = whole("p_retailprice") * 100
    wanted = lines(t.customer, "customer", "c_custkey", "all", ("o_custkey", "=", F.col("c_custkey")),
                   ("o_totalprice", ">", whole("c_acctbal") * 20))
    wanted = wanted.union(lines(t.part, "part", "p_partkey", "all", ("o_totalprice", ">=", price), ("o_totalprice", "<", price + 50)))
    wanted = wanted.union(lines(t.supplier, "supplier", "s_suppkey", "any", ("o_custkey", "=", F.col("s_suppkey")),
                                ("o_totalprice", ">", whole("s_acctbal") * 20 + 300000)))
    orders = Combined(t.orders)
    return indexed_summary(orders, [Mapping("o_orderkey", "order_id"), Mapping("o_orderpriority", "priority")],
                           condition_index(orders, wanted))


# -- joins -------------------------------------------------------------------

@query("""
    SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer
    ON cast(o_custkey AS varchar) = cast(c_custkey AS varchar)""")
def join_inner_string_key(t):
    text_keys = t.customer.withColumn("c_custkey", F.col("c_custkey").cast("string"))
    c = combine(t.orders, [SourceSpec(text_keys, "join", "inner", (("o_custkey", "c_custkey"),))])
    return c.df.select("o_orderkey", "c_name", "c_mktsegment")


@query("""
    SELECT e.event_id, e.user_id, s.s_name FROM events e LEFT JOIN supplier s ON e.user_id = s.s_suppkey""")
def join_left_unmatched(t):
    c = combine(t.events, [SourceSpec(t.supplier, "join", "left", (("user_id", "s_suppkey"),))])
    return c.df.select("event_id", "user_id", "s_name")


@query("""
    SELECT o_orderkey, c_name, n_name, r_name FROM orders
    LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey""")
def join_chain3(t):
    c = combine(t.orders, [
        SourceSpec(t.customer, "join", "left", (("o_custkey", "c_custkey"),)),
        SourceSpec(t.nation, "join", "left", (("c_nationkey", "n_nationkey"),)),
        SourceSpec(t.region, "join", "left", (("n_regionkey", "r_regionkey"),)),
    ])
    return c.df.select("o_orderkey", "c_name", "n_name", "r_name")


@query("""
    WITH a AS (SELECT coalesce(pipeline_id, '') AS k, count(*) AS n FROM metering_events GROUP BY 1),
    l AS (SELECT p_partkey, case when p_partkey = 0 then null when p_partkey = 1 then ''
            else concat('p', p_partkey) end AS k FROM part)
    SELECT l.p_partkey, a.n FROM l JOIN a ON coalesce(l.k, '') = a.k""")
def join_null_key_match(t):
    """NULL and '' keys meet: both sides have them."""
    per = t.metering_events.groupBy("pipeline_id").agg(F.count(F.lit(1)).alias("n"))
    keys = t.part.select("p_partkey", F.when(F.col("p_partkey") == 1, "").when(
        F.col("p_partkey") > 1, F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).alias("k"))
    return combine(keys, [SourceSpec(per, "join", "inner", (("k", "pipeline_id"),))]).df.select(
        "p_partkey", "n")


@query("""
    SELECT s_suppkey AS id, s_name AS name, n_name AS other FROM supplier
    JOIN nation ON s_nationkey = n_nationkey""")
def join_collision_primary_wins(t):
    left = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_nationkey")
    right = t.nation.select(F.col("n_nationkey").alias("nid"), F.col("n_name").alias("name"),
                            F.col("n_name").alias("other"))
    c = combine(left, [SourceSpec(right, "join", "inner", (("s_nationkey", "nid"),))])
    return c.df.select("id", "name", "other")


@query("""
    SELECT e.event_id, case when s.s_suppkey is not null then s.s_name
      when c.c_custkey is not null then c.c_name end AS label
    FROM events e LEFT JOIN supplier s ON e.user_id = s.s_suppkey
    LEFT JOIN customer c ON e.user_id = c.c_custkey""")
def join_collision_fill_later(t):
    """A column missed by one left join is filled by the next that has it."""
    c = combine(t.events, [
        SourceSpec(t.supplier.select("s_suppkey", F.col("s_name").alias("label")), "join", "left",
                   (("user_id", "s_suppkey"),)),
        SourceSpec(t.customer.select("c_custkey", F.col("c_name").alias("label")), "join", "left",
                   (("user_id", "c_custkey"),)),
    ])
    return c.df.select("event_id", "label")


@query("""
    SELECT l_orderkey, l_linenumber, l_quantity, o.o_orderpriority
    FROM lineitem JOIN (SELECT o_orderkey, 1 + o_custkey % 7 AS line, o_orderpriority FROM orders) o
    ON l_orderkey = o_orderkey AND l_linenumber = line""")
def join_two_columns(t):
    """Extension: several key columns, all of which must match."""
    right = t.orders.select("o_orderkey", (F.lit(1) + F.col("o_custkey") % 7).alias("line"), "o_orderpriority")
    c = combine(t.lineitem, [SourceSpec(right, "join", "inner", (
        ("l_orderkey", "o_orderkey"), ("l_linenumber", "line")))])
    return c.df.select("l_orderkey", "l_linenumber", "l_quantity", "o_orderpriority")


# -- unions ------------------------------------------------------------------

@query("""
    SELECT cast(c_custkey AS varchar) AS id, c_name AS name, c_acctbal AS balance FROM customer
    UNION ALL SELECT concat('S', s_suppkey), s_name, s_acctbal FROM supplier
    UNION ALL SELECT cast(c_custkey AS varchar), c_name, c_acctbal FROM customer""")
def union_all_by_name(t):
    """Different key types become text; the repeated source keeps its copies."""
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                          F.col("c_acctbal").alias("balance"))
    b = t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"),
                          F.concat(F.lit("S"), F.col("s_suppkey")).alias("id"))
    return combine(a, [SourceSpec(b), SourceSpec(a)], ["id", "name", "balance"]).df


@query("""
    WITH a AS (SELECT c_name AS name, c_acctbal AS balance FROM customer ORDER BY c_acctbal, c_name LIMIT 1000),
    b AS (SELECT s_name AS name, s_acctbal AS balance FROM supplier ORDER BY s_acctbal, s_name LIMIT 1000),
    u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
    SELECT name, balance FROM u ORDER BY balance, name LIMIT 1000""")
def union_cap_ordered(t):
    """The optional cap of a run: 1000 rows per source and in total, by order."""
    a = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return combine(a, [SourceSpec(b)], ["name", "balance"], 1000, ["balance", "name"]).df


# -- mapping -----------------------------------------------------------------

@query("""
    SELECT o_totalprice AS amount, o_orderkey AS id, cast(null AS varchar) AS note FROM orders""")
def remap_projection(t):
    return remap(t.orders, [Mapping("o_totalprice", "amount"), Mapping("o_orderkey", "id"),
                            Mapping("no_such_column", "note")])


@query("SELECT o_orderpriority AS label, o_orderkey AS id FROM orders")
def remap_last_wins(t):
    return remap(t.orders, [Mapping("o_orderstatus", "label"), Mapping("o_orderkey", "id"),
                            Mapping("o_orderpriority", "label")])


@query("""
    SELECT o_orderkey, try_cast(o_orderpriority AS integer) AS priority_no,
      cast(o_orderkey AS varchar) AS key_text FROM orders""")
def remap_cast(t):
    """Extension: converted columns, NULL where the value does not convert."""
    return remap(t.orders, [Mapping("o_orderkey", "o_orderkey"),
                            Mapping("o_orderpriority", "priority_no", "int"),
                            Mapping("o_orderkey", "key_text", "string")])


@query("""
    SELECT 'priority_no' AS target_col, 'int' AS cast_to,
      count(*) FILTER (WHERE try_cast(o_orderpriority AS integer) IS NULL) AS failed FROM orders
    UNION ALL SELECT 'status_no', 'double', count(*) FILTER (WHERE try_cast(o_orderstatus AS double) IS NULL) FROM orders""")
def remap_cast_failures(t):
    return cast_failures(t.orders, [Mapping("o_orderpriority", "priority_no", "int"),
                                    Mapping("o_orderstatus", "status_no", "double")])


# -- filters -----------------------------------------------------------------

def _filtered(df, conds, mode="all", cols=("id",), compare="loose"):
    return df.filter(conditions(df.schema, conds, mode, compare)).select(*cols)


@query("SELECT id, status FROM sync_runs WHERE status = 'completed'")
def filter_eq(t):
    return _filtered(t.sync_runs, [Condition("status", "=", "completed")], cols=("id", "status"))


@query("SELECT id, records FROM sync_runs WHERE coalesce(cast(records AS varchar), '') = ''")
def filter_eq_empty(t):
    return _filtered(t.sync_runs, [Condition("records", "=", "")], cols=("id", "records"))


@query("SELECT id, records FROM sync_runs WHERE coalesce(cast(records AS varchar), '') <> '50'")
def filter_ne_nulls(t):
    return _filtered(t.sync_runs, [Condition("records", "!=", "50")], cols=("id", "records"))


@query("SELECT id, records FROM sync_runs WHERE coalesce(records, 0) > -1 AND coalesce(records, 0) <= 40")
def filter_gt_null_zero(t):
    return _filtered(t.sync_runs, [Condition("records", ">", "-1"), Condition("records", "<=", "40")],
                     cols=("id", "records"))


@query("""
    SELECT id, filter_value FROM destinations WHERE
      (case when trim(coalesce(filter_value, '')) = '' then 0.0e0
       when regexp_matches(trim(filter_value), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')
       then try_cast(trim(filter_value) AS double) end) < 2.5e4""")
def filter_numeric_text(t):
    return _filtered(t.destinations, [Condition("filter_value", "<", "2.5e4")], cols=("id", "filter_value"))


@query("SELECT id, details FROM audit_logs WHERE contains(lower(coalesce(details, '')), 'by user 1')")
def filter_contains(t):
    return _filtered(t.audit_logs, [Condition("details", "contains", "BY User 1")], cols=("id", "details"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 90000")
def filter_all(t):
    return _filtered(t.orders, [Condition("o_orderstatus", "=", "F"), Condition("o_totalprice", ">", "90000")],
                     cols=("o_orderkey",))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR o_totalprice > 90000")
def filter_any(t):
    return _filtered(t.orders, [Condition("o_orderstatus", "=", "O"), Condition("o_totalprice", ">", "90000")],
                     "any", ("o_orderkey",))


@query("SELECT event_id FROM events WHERE epoch_ms(ts) >= 1705320000000")
def filter_date_epoch(t):
    return _filtered(t.events, [Condition("ts", ">=", "1705320000000")], cols=("event_id",))


@query("SELECT event_id FROM events WHERE ts >= timestamp '2024-01-15 12:00:00'")
def filter_date_typed(t):
    """SQL comparison on request; the loose rule finds no number in a date."""
    return _filtered(t.events, [Condition("ts", ">=", "2024-01-15 12:00:00")], cols=("event_id",), compare="typed")


@query("""
    SELECT id, false AS unknown_op, true AS missing_ne, false AS missing_gt, status = 'failed' AS is_failed,
      coalesce(records, 0) >= 0 AS at_least_0 FROM sync_runs""")
def filter_edge_rules(t):
    """Operators and columns that do not exist, and answers as columns."""
    df = t.sync_runs

    def f(*c):
        return flag(condition(df.schema, Condition(*c)))

    return df.select(
        "id", f("status", "like", "x").alias("unknown_op"), f("nope", "!=", "x").alias("missing_ne"),
        f("nope", ">", "-1").alias("missing_gt"), f("status", "=", "failed").alias("is_failed"),
        f("records", ">=", "0").alias("at_least_0"))


@query("""
    SELECT e.event_id FROM events e LEFT JOIN supplier s ON e.user_id = s.s_suppkey
    WHERE s.s_suppkey IS NOT NULL AND s.s_acctbal <= 5000""")
def filter_absent_not_zero(t):
    """A column a left join did not supply is not 0, unlike a stored NULL."""
    c = combine(t.events, [SourceSpec(t.supplier, "join", "left", (("user_id", "s_suppkey"),))])
    keep = conditions(c.df.schema, [Condition("s_acctbal", "<=", "5000")], present=c.present)
    return c.df.filter(keep).select("event_id")


# -- coercions and sizes -----------------------------------------------------

@query("""
    SELECT o_orderkey, case when o_totalprice = floor(o_totalprice) then cast(cast(o_totalprice AS bigint) AS varchar)
      else cast(o_totalprice AS varchar) end AS price_text, cast(o_custkey AS varchar) AS cust_text FROM orders""")
def text_forms(t):
    s = t.orders.schema
    return t.orders.select("o_orderkey", text_of(F.col("o_totalprice"), s["o_totalprice"].dataType).alias("price_text"),
                           text_of(F.col("o_custkey"), s["o_custkey"].dataType).alias("cust_text"))


@query("""
    SELECT id, case when trim(coalesce(v, '')) = '' then 0.0e0
      when regexp_matches(trim(v), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')
      then try_cast(trim(v) AS double) end AS number
    FROM (SELECT id, case when id % 5 = 0 then details when id % 5 = 1 then cast(id AS varchar)
      when id % 5 = 2 then concat(' ', id, '.5 ') when id % 5 = 3 then concat(id, 'd') else '' end AS v FROM audit_logs)""")
def number_forms(t):
    v = F.expr("""case when id % 5 = 0 then details when id % 5 = 1 then cast(id as string)
      when id % 5 = 2 then concat(' ', id, '.5 ') when id % 5 = 3 then concat(id, 'd') else '' end""")
    df = t.audit_logs.select("id", v.alias("v"))
    return df.select("id", number_of(F.col("v"), df.schema["v"].dataType).alias("number"))


@query("""
    SELECT c_custkey, cast(strlen(concat('{"c_custkey":', c_custkey, ',"c_name":"', c_name, '","c_nationkey":', c_nationkey,
      ',"c_acctbal":', case when c_acctbal = floor(c_acctbal) then cast(cast(c_acctbal AS bigint) AS varchar)
        else cast(c_acctbal AS varchar) end, ',"c_mktsegment":"', c_mktsegment, '"}')) AS bigint) AS nbytes FROM customer""",
       name="row_bytes")
def row_bytes_customer(t):
    return t.customer.select("c_custkey", row_bytes(t.customer.schema).alias("nbytes"))


@query("""
    SELECT doc_id, cast(strlen(concat('{"doc_id":', doc_id, ',"text":', cast(to_json(text) AS varchar), '}')) AS bigint) AS nbytes FROM documents""")
def row_bytes_text(t):
    """Whole texts: quotes, line breaks and letters of several bytes."""
    df = t.documents.select("doc_id", "text")
    return df.select("doc_id", row_bytes(df.schema).alias("nbytes"))


# -- loads -------------------------------------------------------------------

@query("""
    SELECT cast(c_custkey AS varchar) AS c_custkey, c_name, cast(c_nationkey AS varchar) AS c_nationkey,
      c_mktsegment FROM customer""")
def csv_roundtrip(t):
    target = scratch_target(t.spark, "customers.csv")
    cols = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    run_sync(t.customer, [Mapping(c, c) for c in cols], target)
    return read(t.spark, target.connector, target.table, cols)


@query("SELECT doc_id, text, lang FROM documents")
def json_roundtrip(t):
    target = scratch_target(t.spark, "documents.jsonl")
    cols = ["doc_id", "text", "lang"]
    run_sync(t.documents, [Mapping(c, c) for c in cols], target)
    return read(t.spark, target.connector, target.table, cols)


@query("""
    SELECT 'append' AS mode, 2 * count(*) AS rows_after FROM orders
    UNION ALL SELECT 'truncate_reload', count(*) FROM orders""")
def append_and_reload(t):
    """Loading twice doubles an appended table and leaves a reloaded one as it was."""
    out = None
    for mode in ("append", "truncate_reload"):
        target: Target = scratch_target(t.spark, "orders.parquet")
        for _ in range(2):
            run_sync(t.orders, [Mapping("o_orderkey", "id")], target, mode)
        n = read(t.spark, target.connector, target.table).agg(
            F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("rows_after"))
        out = n if out is None else out.unionByName(n)
    return out


@query("""
    WITH r AS (SELECT case when l_linenumber = 1 then NULL else l_orderkey end AS k, l_linenumber AS n FROM lineitem),
      l AS (SELECT o_orderkey AS id, case when o_orderkey % 5 = 0 then NULL else o_orderkey end AS k FROM orders)
    SELECT id, count(n) AS lines, count(*) AS rows_out FROM l LEFT JOIN r ON l.k = r.k GROUP BY id""")
def join_left_never_hot(t):
    """Empty keys hold a quarter of the right rows, above the size from which a key is hot; no left row is lost."""
    right = t.lineitem.select(F.when(F.col("l_linenumber") > 1, F.col("l_orderkey")).alias("rk"),
                              F.col("l_linenumber").alias("n"))
    left = t.orders.select(F.col("o_orderkey").alias("id"),
                           F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey")).alias("k"))
    spec = SourceSpec(right, "join", "left", (("k", "rk"),), null_keys="never")
    joined = combine(left, [spec], hot_key_min_rows=100).df
    return joined.groupBy("id").agg(F.count("n").alias("lines"), F.count(F.lit(1)).alias("rows_out"))


@query("""
    SELECT o_orderkey, cast(NULL AS VARCHAR) AS o_orderstatus, cast(o_custkey AS BIGINT) AS o_custkey FROM orders
    UNION ALL SELECT o_orderkey, o_orderstatus, cast(o_custkey AS BIGINT) FROM orders""")
def append_missing_column(t):
    """A load without one of the target's columns, then one with all."""
    target = scratch_target(t.spark, "orders.parquet")
    df = t.orders.select("o_orderkey", "o_orderstatus", F.col("o_custkey").cast("bigint").alias("o_custkey"))
    write(df, target)
    write(df.drop("o_orderstatus"), target)
    return read(t.spark, target.connector, target.table)


@query("SELECT c_name AS name, cast(c_nationkey AS VARCHAR) AS nation FROM customer UNION ALL SELECT n_name, cast(n_nationkey AS VARCHAR) FROM nation")
def append_single_object(t):
    """Customers appended to one CSV object that holds the nations."""
    import uuid

    target = scratch_target(t.spark, "names.csv")
    parts = scratch_target(t.spark, f"parts-{uuid.uuid4().hex}.csv")
    write(t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation")).coalesce(1), parts)
    hadoop = t.spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(file_uri(parts.connector, parts.table))
    fs = folder.getFileSystem(t.spark._jsc.hadoopConfiguration())
    [part] = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
    single = hadoop.Path(file_uri(target.connector, target.table))
    fs.mkdirs(single.getParent())
    fs.rename(part, single)
    write(t.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")), target)
    return read(t.spark, target.connector, target.table)


@query(r"SELECT cast(doc_id AS VARCHAR) AS doc_id, regexp_replace(regexp_replace(text, '^[\x00-\x20]+', ''), '[\x00-\x20]+$', '') AS text, lang, source FROM documents")
def csv_text_roundtrip(t):
    """Whole texts with line breaks, quotes and commas; cells come back trimmed."""
    target = scratch_target(t.spark, "documents.csv")
    cols = ["doc_id", "text", "lang", "source"]
    run_sync(t.documents, [Mapping(c, c) for c in cols], target)
    return read(t.spark, target.connector, target.table, cols)


@query(r"SELECT cast(doc_id AS VARCHAR) AS doc_id, regexp_replace(regexp_replace(text, '^[\x00-\x20]+', ''), '[\x00-\x20]+$', '') AS text, lang, source FROM documents")
def csv_ranges(t):
    """CSV files of whole texts, each read by a task per megabyte; cells with line breaks cross the borders."""
    target = scratch_target(t.spark, "documents.csv")
    texts = t.documents.select("doc_id", "text", "lang", "source")
    write(_dealt(texts, _files_for(texts), "doc_id").drop("part"), target)
    return csv_table(t.spark, file_uri(target.connector, target.table), range_bytes=1 << 20)


#: A file is written by one task, so whole tables become files of about this size.
FILE_BYTES = 64 << 20


def _files_for(rows) -> int:
    """How many files of :data:`FILE_BYTES` the values of ``rows`` fill."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in rows.columns), F.lit(0))
    return 1 + (rows.agg(F.sum(width).alias("n")).first().n or 0) // FILE_BYTES


def _dealt(rows, files: int, key: str):
    """``rows`` with the number of the file (``part``) that each is dealt to, one task a file."""
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(files)).cast("int")
    return rows.withColumn("part", part).repartitionById(files, "part").sortWithinPartitions(key)


def _array_files(records, key: str, glue: str = ""):
    """The lines of files with one array each from ``records`` (``key``, ``value``): what stands before a record opens
    the array or parts it from the one before, the last line of a file ends it."""
    files = _files_for(records)
    part = F.pmod(F.xxhash64(key, "value"), F.lit(files)).cast("int")
    ends = records.sparkSession.range(files).select(
        F.lit(1).alias("end"), F.lit(None).cast("bigint").alias(key), F.lit("]").alias("value"), F.col("id").cast("int").alias("part"))
    lines = records.select(F.lit(0).alias("end"), key, "value", part.alias("part")).union(ends)
    lines = lines.repartitionById(files, "part").sortWithinPartitions("end", key)
    # Numbers of rows begin anew, from 0 in their lower 33 bits, in each task and so in each file.
    opens = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    before = F.when(opens, F.lit("[" + glue)).when(F.col("end") == 0, F.lit("," + glue)).otherwise(F.lit(""))
    return lines.select(F.concat(before, "value").alias("value"))


@query("SELECT doc_id, text, lang FROM documents")
def json_array_ranges(t):
    """Arrays that each stand in one line of one file, their elements cut out by a task per megabyte."""
    place = scratch_path(t.spark, "array") + ".json"
    records = t.documents.select("doc_id", F.to_json(F.struct("doc_id", "text", "lang")).alias("value"))
    _array_files(records, "doc_id").write.option("lineSep", " ").text(place)
    return read_json(t.spark, json_array_lines(t.spark, place, range_bytes=1 << 20), lines=True)


@query("SELECT doc_id, text, lang FROM documents UNION ALL SELECT doc_id, text, lang FROM documents")
def json_array_roundtrip(t):
    """Files of one array each beside JSON Lines parts in a folder; all are read whole."""
    target = scratch_target(t.spark, "documents.json")
    cols = ["doc_id", "text", "lang"]
    run_sync(t.documents, [Mapping(c, c) for c in cols], target)
    records = t.documents.select("doc_id", F.to_json(F.struct(*cols)).alias("value"))
    # Arrays over many lines.
    _array_files(records, "doc_id", "\n").write.mode("append").text(file_uri(target.connector, target.table))
    return read(t.spark, target.connector, target.table, cols)


@query("""
    SELECT 'sync_runs' AS ledger, 'completed' AS status, 2 AS entries, cast(2 * count(*) AS BIGINT) AS records FROM orders
    UNION ALL SELECT 'audit_logs', 'success', 3, cast(2 * count(*) AS BIGINT) FROM orders
    UNION ALL SELECT 'metering_events', NULL, 2, cast(2 * count(*) AS BIGINT) FROM orders""")
def stored_job_ledger(t):
    """What a stored transfer of all orders, mapped once and run twice, leaves in the ledgers."""
    store = Store(t.spark, scratch_path(t.spark, "store"))
    place = scratch_target(t.spark, "orders.parquet").connector
    write(t.orders, Target(place, "orders.parquet"))
    store.append("connectors", t.spark.sql(f"select 'c1' id, 'file' type, named_struct('database', '{place.database}', "
                                           "'host', '', 'port', cast(null as int), 'username', '', 'password', '') config"))
    store.append("pipelines", t.spark.sql(
        "select 'p1' id, 'All orders' name, 'c1' source_id, 'c1' target_id, 'orders.parquet' source_table, "
        "'copy.parquet' target_table, 'cloud_bound' direction, 'draft' status, 'append' sync_mode, '2024' created_at"))
    map_job(store, "p1", "check")
    for _ in range(2):
        report = run_job(store, "p1", "check")
        if report.error:
            raise ValueError(report.error)

    def ledger(name, records, status="status"):
        return store.table(name).groupBy(F.expr(status).alias("status")).agg(
            F.count(F.lit(1)).cast("int").alias("entries"), F.sum(records).alias("records")).select(
            F.lit(name).alias("ledger"), "status", "entries", "records")

    return ledger("sync_runs", "records").union(ledger("audit_logs", "records_affected")).union(
        ledger("metering_events", "records", "cast(null as string)"))
