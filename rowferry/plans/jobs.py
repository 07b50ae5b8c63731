"""Stored transfers: load a configuration, run it, and keep the books.

The driver reads the configuration of the one transfer it runs, a handful of
rows; all table data stays in Spark.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rowferry.functions.pricing import run_cost
from rowferry.operators import versions
from rowferry.operators.lifecycle import apply_updates, replace_by_key
from rowferry.operators.matching import listed_columns, match_schemas, targets_or_sources
from rowferry.operators.secure import KeyRing
from rowferry.plans.run import Loaded, run_sync
from rowferry.plans.spec import (
    Condition, Connector, DestinationSpec, Mapping, SourceSpec, Target,
)
from rowferry.sources.readers import read, table_columns
from rowferry.sources.writers import rewrite_table

RUN_SCHEMA = ("id string, pipeline_id string, direction string, status string, records bigint, "
              "started_at timestamp, completed_at timestamp, error string, day string")
METER_SCHEMA = ("id string, pipeline_id string, direction string, records bigint, bytes bigint, "
                "compute_ms bigint, ts timestamp")
AUDIT_SCHEMA = ("id string, action string, actor string, status string, details string, "
                "pipeline_id string, records_affected bigint, ts timestamp, day string")

STATUS_SCHEMA = "id string, status string, at timestamp, entry string, day string"

# Messages shown to users and kept in the audit log.
NOT_FOUND = "Pipeline not found"
NO_TABLES = "Pipeline is missing a source or target table"
NO_MAPPING = "No schema mapping exists for this pipeline yet. Map the schema before running."
RUN_FAILED = 'Sync failed for pipeline "{name}": {error}'
RUN_DONE = 'Synced {rows} rows for pipeline "{name}"'
RUN_ALSO = " + {rows} rows across {targets} additional destination(s)"
RUN_CAPPED = " (capped at {cap})"
MAP_DONE = 'Mapped {columns} columns for pipeline "{name}"'


class JobError(Exception):
    """A transfer that cannot start as configured."""


class Store:
    """Configuration and log tables as Parquet folders below ``root``.

    Logs are partitioned by day and only ever appended to, so each run adds one
    small file; compact old days from time to time. With ``versioned``, mappings
    are replaced as versions beside the table, which is not rewritten then, so
    jobs that map different transfers at the same time lose nothing.
    """

    def __init__(self, spark: SparkSession, root: str, key_b64: str | KeyRing | None = None, versioned: bool = False):
        self.spark, self.root, self.versioned = spark, root.rstrip("/"), versioned
        # One key without a ring opens values that do not name their key.
        self.keys = KeyRing(spark, {"": key_b64, "one": key_b64}, "one") if isinstance(key_b64, str) and key_b64 else key_b64

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str) -> DataFrame:
        """A table as it stands; transfers with the last status that was logged for each."""
        place = self.path(f"{name}_versions")
        if self.versioned and name == "schema_mappings" and versions.exists(self.spark, place):
            try:
                base = self.spark.read.parquet(self.path(name))
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                base = None
            return versions.current(self.spark, place, "pipeline_id", base)
        df = self.spark.read.parquet(self.path(name))
        return self._with_status(df) if name == "pipelines" else df

    def _with_status(self, pipelines: DataFrame) -> DataFrame:
        try:
            log = self.spark.read.schema(STATUS_SCHEMA).parquet(self.path("pipeline_status"))
            log.inputFiles()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return pipelines
            raise
        last = log.groupBy("id").agg(F.max_by("status", F.struct("at", "entry")).alias("status"))
        return apply_updates(pipelines, last, "id", ["status"])

    def rows(self, name: str, **equal: str | list[str]) -> list[Row]:
        """The rows of one transfer; none where the table does not exist yet. A list means any of its values."""
        try:
            df = self.table(name)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        for column, value in equal.items():
            df = df.filter(F.col(column).isin(value) if isinstance(value, list) else F.col(column) == value)
        return df.collect()

    def append(self, name: str, df: DataFrame, by: str | None = None) -> None:
        writer = df.write.mode("append")
        (writer.partitionBy(by) if by else writer).parquet(self.path(name))

    def connector(self, connector_id: str) -> Connector:
        """Settings of a connector, its password decrypted where a key is given."""
        df = self.table("connectors").filter(F.col("id") == connector_id)
        if self.keys:
            df = self.keys.open(df.withColumn("__password", F.col("config.password")), "__password")
            df = df.withColumn("config", F.col("config").withField("password", F.col("__password")))
        found = df.take(1)
        if not found:
            raise JobError(f"Connector {connector_id} not found")
        c = found[0].config.asDict()
        return Connector(found[0].type, c.get("database") or "", c.get("host") or "", c.get("port"),
                         c.get("username") or "", c.get("password") or "", connector_id)

    def audit(self, action: str, actor: str, status: str, details: str | None = None,
              pipeline_id: str | None = None, records: int | None = None,
              at: datetime | None = None) -> None:
        at = at or now_utc()
        row = (uuid.uuid4().hex, action, actor, status, details, pipeline_id, records, at, at.date().isoformat())
        self.append("audit_logs", self.spark.createDataFrame([row], AUDIT_SCHEMA), "day")


@dataclass(frozen=True)
class JobReport:
    run_id: str
    status: str
    records: int
    loaded: tuple[Loaded, ...]
    error: str | None


def now_utc() -> datetime:
    return datetime.now(timezone.utc)


def _pipeline(store: Store, pipeline_id: str) -> Row:
    found = store.rows("pipelines", id=pipeline_id)
    if not found:
        raise JobError(NOT_FOUND)
    if not found[0].source_table or not found[0].target_table:
        raise JobError(NO_TABLES)
    return found[0]


def _place(mapping: Row) -> tuple:
    """Mappings follow their source columns; those stored without a place come last, by name."""
    no = mapping["source_ordinal"] if "source_ordinal" in mapping else None
    return no is None, no or 0, mapping.source_col, mapping.target_col


def _in_order(rows: list[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r.created_at or "", r.id))


def _value(row: Row, name: str, default: str) -> str:
    return (row[name] if name in row else None) or default


def _options(row: Row) -> dict[str, str]:
    """Read options of a stored source, such as a partition column with its bounds."""
    given = row["read_options"] if "read_options" in row else None
    return {k: str(v) for k, v in (given.asDict() if isinstance(given, Row) else given or {}).items() if v is not None}


def load_sources(store: Store, pipeline_id: str, reader: Callable) -> list[SourceSpec]:
    """Extra sources in the order they were added."""
    out = []
    for s in _in_order(store.rows("pipeline_sources", pipeline_id=pipeline_id)):
        df = reader(store.spark, store.connector(s.source_id), s.source_table, **_options(s))
        if _value(s, "combine_mode", "union") == "join":
            out.append(SourceSpec(df, "join", _value(s, "join_type", "inner"),
                                  ((s.primary_join_column, s.join_column),)))
        else:
            out.append(SourceSpec(df))
    return out


def load_destinations(store: Store, pipeline_id: str) -> list[DestinationSpec]:
    """Destinations, each with its own condition first and then the added ones."""
    out = []
    found = _in_order(store.rows("pipeline_destinations", pipeline_id=pipeline_id))
    added: dict[str, list[Row]] = {}
    for c in _in_order(store.rows("pipeline_destination_conditions", destination_id=[d.id for d in found]) if found else []):
        added.setdefault(c.destination_id, []).append(c)
    for d in found:
        extra = added.get(d.id, [])
        conds = tuple(Condition(c.filter_column, c.filter_operator, c.filter_value) for c in [d, *extra])
        out.append(DestinationSpec(d.id, Target(store.connector(d.target_id), d.target_table),
                                   conds, _value(d, "match_mode", "all")))
    return out


def run_job(store: Store, pipeline_id: str, actor: str, reader: Callable = read,
            row_cap: int | None = None, **run_options) -> JobReport:
    """Run a stored transfer and record run, status, usage and audit entry.

    Missing configuration raises :class:`JobError`. A failure while moving data
    is recorded as a failed run with no records and no usage.
    """
    p = _pipeline(store, pipeline_id)
    mappings = [Mapping(m.source_col, m.target_col)
                for m in sorted(store.rows("schema_mappings", pipeline_id=pipeline_id), key=_place)]
    if not mappings:
        raise JobError(NO_MAPPING)
    started = now_utc()
    loaded: list[Loaded] = []
    error = None
    try:
        primary = reader(store.spark, store.connector(p.source_id), p.source_table, **_options(p))
        loaded = run_sync(
            primary, mappings, Target(store.connector(p.target_id), p.target_table),
            _value(p, "sync_mode", "append"), load_sources(store, pipeline_id, reader),
            load_destinations(store, pipeline_id), row_cap, **run_options)
    except Exception as e:  # whatever a source, a target or a bad setting raised
        error = str(e) or "Sync failed"
    completed = now_utc()
    records = loaded[0].records if loaded else 0
    status = "failed" if error else "completed"
    run_id = uuid.uuid4().hex
    spark = store.spark
    run = spark.createDataFrame(
        [(run_id, pipeline_id, p.direction, status, records, started, completed, error,
          started.date().isoformat())], RUN_SCHEMA)
    store.append("sync_runs", run, "day")
    set_status(store, pipeline_id, "error" if error else "active")
    if not error:
        ms = int((completed - started).total_seconds() * 1000)
        meter = spark.createDataFrame(
            [(run_id, pipeline_id, p.direction, sum(x.records for x in loaded),
              sum(x.bytes for x in loaded), ms, completed)], METER_SCHEMA)
        cost = run_cost(F.col("direction"), F.col("records"), F.col("compute_ms"))
        meter = meter.withColumn("day", F.lit(completed.date().isoformat()))
        store.append("metering_events", meter.withColumn("cost_usd", cost), "day")
    store.audit("pipeline.run", actor, "error" if error else "success",
                _run_details(p.name, loaded, error, row_cap), pipeline_id,
                None if error else records, completed)
    return JobReport(run_id, status, records, tuple(loaded), error)


def _run_details(name: str, loaded: list[Loaded], error: str | None, row_cap: int | None) -> str:
    if error:
        return RUN_FAILED.format(name=name, error=error)
    text = RUN_DONE.format(rows=loaded[0].records, name=name)
    if len(loaded) > 1:
        text += RUN_ALSO.format(rows=sum(x.records for x in loaded[1:]), targets=len(loaded) - 1)
    return text if row_cap is None else text + RUN_CAPPED.format(cap=row_cap)


def set_status(store: Store, pipeline_id: str, status: str) -> None:
    """Log a new status. The table of transfers is not rewritten, so runs at the same time lose no update."""
    at = now_utc()
    row = (pipeline_id, status, at, uuid.uuid4().hex, at.date().isoformat())
    store.append("pipeline_status", store.spark.createDataFrame([row], STATUS_SCHEMA), "day")


def _catalog(store: Store, connector_id: str, table: str, pair: str) -> DataFrame:
    columns = table_columns(store.spark, store.connector(connector_id), table)
    return columns.select(F.lit(pair).alias("pair"), "ordinal", "name", "type")


def map_job(store: Store, pipeline_id: str, actor: str) -> DataFrame:
    """Propose the mapping of a stored transfer and keep it in place of the old one."""
    p = _pipeline(store, pipeline_id)
    primary = _catalog(store, p.source_id, p.source_table, pipeline_id)
    target = _catalog(store, p.target_id, p.target_table, pipeline_id)
    joined = None
    joins = [s for s in _in_order(store.rows("pipeline_sources", pipeline_id=pipeline_id))
             if s.combine_mode == "join"]
    for no, s in enumerate(joins, 1):
        part = _catalog(store, s.source_id, s.source_table, pipeline_id).withColumn("source_no", F.lit(no))
        joined = part if joined is None else joined.unionByName(part)
    found = match_schemas(listed_columns(primary, joined), targets_or_sources(target, primary))
    new = found.select(
        F.col("pair").alias("pipeline_id"), "source_ordinal", "source_col", "target_col", "source_type",
        "target_type", "confidence", "warning")
    keys = store.spark.createDataFrame([(pipeline_id,)], "pipeline_id string")
    if store.versioned:
        versions.replace_keys(new, keys, "pipeline_id", store.path("schema_mappings_versions"))
        mine = store.table("schema_mappings").filter(F.col("pipeline_id") == pipeline_id)
        store.audit("schema.map", actor, "success", MAP_DONE.format(columns=mine.count(), name=p.name), pipeline_id)
        return mine
    try:
        current = store.table("schema_mappings")
        if "source_ordinal" not in current.columns:
            current = current.withColumn("source_ordinal", F.lit(None).cast("int"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        current = new.limit(0)
    kept = rewrite_table(replace_by_key(current, new, keys, "pipeline_id"), store.path("schema_mappings"))
    mine = kept.filter(F.col("pipeline_id") == pipeline_id)
    store.audit("schema.map", actor, "success",
                MAP_DONE.format(columns=mine.count(), name=p.name), pipeline_id)
    return mine
