"""Run cost, billable volume and the monthly charge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# US dollars per 10,000 rows and per minute, by direction.
# A direction not listed is charged as cloud_bound.
RATES = {
    "cloud_bound": (0.10, 0.02),
    "on_prem_bound": (0.25, 0.05),
    "bidirectional": (0.30, 0.06),
}
DEFAULT_RATE = "cloud_bound"
# Monthly price per connector, free volume, price beyond it.
USD_PER_CONNECTOR = 25.0
FREE_GB = 10.0
USD_PER_GB = 0.50
BYTES_PER_GB = 1024**3


def _rate(direction: Column, which: int) -> Column:
    chain = None
    for name, rate in RATES.items():
        if name == DEFAULT_RATE:
            continue
        hit, value = direction == name, F.lit(rate[which])
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain.otherwise(F.lit(RATES[DEFAULT_RATE][which]))


def run_cost(direction: Column, records: Column, compute_ms: Column) -> Column:
    """Cost of one run from its rows and its milliseconds."""
    rows = records / F.lit(10000.0) * _rate(direction, 0)
    time = compute_ms / F.lit(60000.0) * _rate(direction, 1)
    return rows + time


def usage_gb(nbytes: Column) -> Column:
    """Billable gigabytes with 12 decimals; NULL where nothing is billable."""
    gb = F.round(nbytes / F.lit(float(BYTES_PER_GB)), 12).cast("decimal(38,12)")
    return F.when((nbytes > 0) & (gb > 0), gb)


def monthly_charge(connectors: Column, nbytes: Column) -> Column:
    """Projected charge: connectors plus the volume above the free part."""
    over = F.greatest(nbytes / F.lit(float(BYTES_PER_GB)) - F.lit(FREE_GB), F.lit(0.0))
    return connectors * F.lit(USD_PER_CONNECTOR) + over * F.lit(USD_PER_GB)
