"""Display forms of counts, sizes, durations, ages, codes and actions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowferry.functions.coerce import fixed_text

# Display names shown for stored codes, and unit steps.
DIRECTION_LABELS = {
    "cloud_bound": "↑ Cloud",
    "on_prem_bound": "↓ On-Prem",
    "bidirectional": "↕ Bidirectional",
}
CONNECTOR_LABELS = {
    "mssql": "MS SQL Server",
    "oracle": "Oracle DB",
    "db2": "IBM DB2",
    "postgresql": "PostgreSQL",
    "mysql": "MySQL",
    "supabase": "Supabase",
    "s3": "Amazon S3",
    "azure_blob": "Azure Blob Storage",
    "gcs": "Google Cloud Storage",
    "snowflake": "Snowflake",
    "databricks": "Databricks",
    "iceberg": "Apache Iceberg",
    "salesforce": "Salesforce",
    "hubspot": "HubSpot",
    "stripe": "Stripe",
}
COUNT_UNITS = [(10**9, "B"), (10**6, "M"), (10**3, "K")]
BYTE_UNITS = [(1024**4, " TB"), (1024**3, " GB"), (1024**2, " MB"), (1024, " KB")]


def _scaled(c: Column, units: list[tuple[int, str]], places: int, rest: Column) -> Column:
    chain = None
    for step, unit in units:
        shown = F.concat(fixed_text(c / F.lit(float(step)), places), F.lit(unit))
        chain = F.when(c >= step, shown) if chain is None else chain.when(c >= step, shown)
    return chain.otherwise(rest)


def short_count(c: Column) -> Column:
    """``1500`` becomes ``1.5K``."""
    return _scaled(c, COUNT_UNITS, 1, c.cast("string"))


def short_bytes(c: Column) -> Column:
    """``1536`` becomes ``1.50 KB``."""
    return _scaled(c, BYTE_UNITS, 2, F.concat(c.cast("string"), F.lit(" B")))


def short_duration(ms: Column) -> Column:
    """Milliseconds as ``250ms``, ``12s``, ``3m 5s`` or ``2h 7m``."""
    s = F.floor(ms / F.lit(1000.0))
    m = F.floor(s / F.lit(60.0))
    h = F.floor(m / F.lit(60.0))
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(m < 60, F.format_string("%dm %ds", m, s - m * 60))
        .otherwise(F.format_string("%dh %dm", h, m - h * 60))
    )


def age(ts: Column, now: Column) -> Column:
    """How long before ``now``: minutes, hours, days, then the date."""
    s = F.floor(
        (F.unix_millis(now.cast("timestamp")) - F.unix_millis(ts.cast("timestamp")))
        / F.lit(1000.0)
    )
    m = F.floor(s / F.lit(60.0))
    h = F.floor(m / F.lit(60.0))
    d = F.floor(h / F.lit(24.0))
    return (
        F.when(s < 60, F.lit("just now"))
        .when(m < 60, F.concat(m.cast("string"), F.lit("m ago")))
        .when(h < 24, F.concat(h.cast("string"), F.lit("h ago")))
        .when(d < 7, F.concat(d.cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(ts, "MMM d, yyyy"))
    )


def label(c: Column, labels: dict[str, str]) -> Column:
    """Display name of a code, or the code itself."""
    chain = None
    for code, shown in labels.items():
        test = c == code
        chain = F.when(test, F.lit(shown)) if chain is None else chain.when(test, F.lit(shown))
    return chain.otherwise(c)


def direction_label(c: Column) -> Column:
    return label(c, DIRECTION_LABELS)


def connector_label(c: Column) -> Column:
    return label(c, CONNECTOR_LABELS)


def activity_class(action: Column, status: Column) -> Column:
    """Kind of a log entry; errors first, then schema work, then the verb."""
    chain = F.when(status == "error", F.lit("error")).when(
        action.startswith("schema."), F.lit("schema")
    )
    for verb in ("delete", "create", "run", "test"):
        chain = chain.when(action.contains(verb), F.lit(verb))
    return chain.otherwise(F.lit("other"))


def confidence_band(c: Column) -> Column:
    """``high`` from 0.9, ``medium`` from 0.7, else ``low``."""
    return F.when(c >= 0.9, "high").when(c >= 0.7, "medium").otherwise("low")


def reliable(success_rate: Column) -> Column:
    """Whether a success percentage counts as reliable."""
    return success_rate >= 98
