"""Configuration and log tables derived from the test tables.

Each view is one SELECT that Spark and DuckDB both run; the few expressions that
differ between them are named in ``DIALECTS``. Every view covers its whole base
table. A third of all runs belongs to one pipeline, as a hot key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

DIALECTS = {
    "spark": {
        "[k]": "cast(get_json_object(props, '$.k') as int)",
        "[done]": "timestampadd(MILLISECOND, cast(floor(value * 100) as int), ts)",
        "[day_of_year]": "date_add(date'2024-01-01', cast(c_custkey % 28 as int))",
    },
    "duckdb": {
        "[k]": "cast(props->>'$.k' as int)",
        "[done]": "ts + to_milliseconds(cast(floor(value * 100) as bigint))",
        "[day_of_year]": "cast(date'2024-01-01' + cast(c_custkey % 28 as int) as date)",
    },
}

DIRECTION = "case {} % 3 when 0 then 'cloud_bound' when 1 then 'on_prem_bound' else 'bidirectional' end"

VIEWS = {
    "connectors": """
        select concat('c', s_suppkey) as id, s_name as name,
          case s_suppkey % 8 when 0 then 'postgresql' when 1 then 'mysql' when 2 then 'mssql'
            when 3 then 'oracle' when 4 then 'supabase' when 5 then 's3' when 6 then 'azure_blob'
            else 'gcs' end as type,
          case when s_suppkey % 7 = 6 then null when s_suppkey % 3 = 0 then 'on_prem'
            when s_suppkey % 3 = 1 then 'cloud' else 'saas' end as category,
          case when s_suppkey % 11 = 5 then 'owner' when s_suppkey % 3 = 0 then 'source'
            when s_suppkey % 3 = 1 then 'target' else 'both' end as role,
          case when s_acctbal < 0 then 'error' else 'connected' end as status,
          case when s_suppkey % 5 = 0 then null else s_suppkey % 40 end as tables_count,
          case when s_suppkey % 4 = 0 then null else concat('2024-02-', 10 + s_suppkey % 19) end as last_accessed,
          concat('2024-01-', 10 + s_suppkey % 20) as created_at,
          concat('db', s_nationkey, '.internal') as host, 5000 + s_nationkey as port,
          concat('main', s_suppkey % 9) as database, concat('user', s_suppkey) as username,
          concat('secret', s_suppkey) as password
        from {supplier}""",
    "pipelines": f"""
        select concat('p', p_partkey) as id, concat(p_name, ' ', p_partkey) as name,
          concat('c', p_partkey % 10) as source_id, concat('c', (p_partkey * 3) % 10) as target_id,
          lower(p_type) as source_table,
          case when p_partkey % 11 = 0 then null else concat('t_', lower(p_type)) end as target_table,
          {DIRECTION.format('p_size')} as direction,
          case p_partkey % 4 when 0 then 'active' when 1 then 'paused' when 2 then 'error'
            else 'draft' end as status,
          case p_partkey % 5 when 0 then 'truncate_reload' when 1 then null when 2 then 'replace'
            else 'append' end as sync_mode,
          concat('2024-01-', 10 + p_partkey % 20) as created_at
        from {{part}}""",
    "sync_runs": f"""
        select event_id as id,
          case when event_id % 3 = 0 then 'p7' else concat('p', (user_id * 13 + event_id) % 150) end as pipeline_id,
          {DIRECTION.format('user_id')} as direction,
          case event_type when 'error' then 'failed' when 'view' then 'running' else 'completed' end as status,
          case when event_type = 'view' then null else [k] end as records,
          ts as started_at,
          case when event_type = 'view' then null else [done] end as completed_at
        from {{events}}""",
    "metering_events": f"""
        select event_id as id,
          case when event_id % 17 = 0 then null when event_id % 3 = 0 then 'p7'
            else concat('p', (user_id * 13 + event_id) % 150) end as pipeline_id,
          case when event_id % 23 = 0 then 'sideways' else {DIRECTION.format('user_id')} end as direction,
          [k] as records, [k] * 137 as bytes,
          cast(floor(value * 100) as int) as compute_ms,
          round([k] / 10000.0e0 * case user_id % 3 when 0 then 0.10e0 when 1 then 0.25e0 else 0.30e0 end
            + floor(value * 100) / 60000.0e0 * case user_id % 3 when 0 then 0.02e0 when 1 then 0.05e0
            else 0.06e0 end, 10) as cost_usd,
          [done] as ts
        from {{events}} where event_type not in ('view', 'error')""",
    "audit_logs": """
        select event_id as id, concat('user', user_id) as actor, ts,
          case event_type when 'signup' then 'connector.create' when 'purchase' then 'pipeline.run'
            when 'click' then 'schema.map' when 'error' then 'pipeline.run'
            else 'connector.test' end as action,
          case event_type when 'error' then 'error' when 'view' then 'info' else 'success' end as status,
          case when event_type in ('purchase', 'error', 'click') then concat('p', event_id % 250) end as pipeline_id,
          case when user_id % 4 = 0 then null else concat('event ', event_id, ' by user ', user_id) end as details
        from {events}""",
    "destinations": """
        select concat('d', p_partkey) as id, concat('p', cast(floor(p_partkey / 2.0e0) as bigint)) as pipeline_id,
          concat('c', p_partkey % 12) as target_id, concat('t_', lower(p_type)) as target_table,
          'o_totalprice' as filter_column,
          case when p_partkey % 19 = 0 then 'like' when p_partkey % 2 = 0 then '>' else '<=' end as filter_operator,
          case when p_partkey % 23 = 0 then '' else cast(p_size * 1000 as string) end as filter_value,
          case p_partkey % 4 when 0 then 'any' when 1 then 'all' when 2 then 'some' end as match_mode
        from {part}""",
    "conditions": """
        select concat('k', o_orderkey) as id, concat('d', o_custkey) as destination_id,
          case when o_orderkey % 2 = 0 then 'o_totalprice' else 'o_orderstatus' end as filter_column,
          case when o_orderkey % 29 = 0 then null when o_orderkey % 2 = 0 then '>' else '=' end as filter_operator,
          case when o_orderkey % 2 = 0 then '200000' else 'F' end as filter_value
        from {orders}""",
    "extra_sources": """
        select concat('s', c_custkey) as id, concat('p', cast(floor(c_custkey / 3.0e0) as bigint)) as pipeline_id,
          concat('c', c_custkey % 15) as source_id, lower(c_mktsegment) as source_table,
          case when c_custkey % 13 = 0 then 'merge' when c_custkey % 3 = 0 then 'join'
            when c_custkey % 3 = 1 then null else 'union' end as combine_mode,
          case c_custkey % 4 when 0 then 'inner' when 1 then 'left' when 2 then 'outer' end as join_type,
          case when c_custkey % 6 = 0 then 'id' end as join_column,
          case when c_custkey % 6 = 0 then 'c_id' end as primary_join_column,
          concat('2024-01-', 10 + c_custkey % 20) as created_at
        from {customer}""",
    "schema_mappings": """
        select concat('m', c_custkey) as id, concat('p', cast(floor(c_custkey / 5.0e0) as bigint)) as pipeline_id,
          lower(c_mktsegment) as source_col, c_mktsegment as target_col,
          c_nationkey / 25.0e0 as confidence
        from {customer}""",
    "nodes": """
        select concat('n', p_partkey) as id, concat('p', cast(floor(p_partkey / 2.0e0) as bigint)) as pipeline_id,
          case when p_partkey % 2 = 0 then 'source' else 'target' end as type, p_name as label,
          p_size * 10 as position_x, p_partkey % 600 as position_y
        from {part}""",
    "billing_accounts": """
        select concat('b', c_custkey) as id, concat('cus_', c_custkey) as stripe_customer_id,
          case when c_custkey % 3 = 0 then null else concat('si_', c_custkey) end as usage_item_id,
          cast([day_of_year] as timestamp) as updated_at
        from {customer}""",
    # Catalogs: the lines of an order are the source columns of a pair, those of
    # the next order its target columns. Names come from the parts.
    "source_columns": """
        select l_orderkey as pair, l_linenumber as ordinal,
          case l_linenumber % 3 when 0 then replace(p_name, ' ', '_') when 1 then upper(p_name) else p_name end as name,
          case p_size % 6 when 0 then 'INT' when 1 then 'varchar(20)' when 2 then 'timestamp'
            when 3 then 'boolean' when 4 then 'uuid' else 'decimal(10,2)' end as type
        from {lineitem} join {part} on l_partkey = p_partkey""",
    "target_columns": """
        select l_orderkey - 1 as pair, l_linenumber as ordinal,
          case when l_linenumber % 2 = 0 then concat(p_name, ' ', lower(p_type)) else p_name end as name,
          case p_size % 5 when 0 then 'bigint' when 1 then 'text' when 2 then 'date'
            when 3 then 'bool' else 'interval' end as type
        from {lineitem} join {part} on l_partkey = p_partkey""",
}


def _dialect(sql: str, name: str) -> str:
    for token, text in DIALECTS[name].items():
        sql = sql.replace(token, text)
    return sql


class Tables:
    """The test tables of one folder and the views over them, all lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(self.path(name))
        if name in VIEWS:
            sql = _dialect(VIEWS[name], "spark")
            used = {t: getattr(self, t) for t in set(re.findall(r"\{(\w+)\}", sql))}
            return self.spark.sql(sql, **used)
        raise AttributeError(name)


def with_views(body: str) -> str:
    """``body`` for DuckDB, preceded by the views it mentions."""
    ctes = [
        f"{name} AS ({re.sub(r'[{}]', '', _dialect(sql, 'duckdb')).strip()})"
        for name, sql in VIEWS.items() if re.search(rf"\b{name}\b", body)
    ]
    body = _dialect(body, "duckdb").strip()
    head = "WITH "
    if body.upper().startswith("WITH RECURSIVE "):
        head, body = "WITH RECURSIVE ", body[len("WITH RECURSIVE "):]
        return head + ",\n".join([*ctes, body])
    if body.upper().startswith("WITH "):
        return head + ",\n".join([*ctes, body[len("WITH "):]])
    return (head + ",\n".join(ctes) + "\n" if ctes else "") + body
