"""Broadcasts behind a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A list of keys is broadcast up to this many rows and bytes of text.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


def broadcast_by_size(df: DataFrame, most: int) -> bool:
    """Whether the optimizer estimates ``df`` at no more than ``most`` bytes and at what makes a join broadcast it."""
    limit = int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 <= size <= min(limit, most)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if measuring it shows that it is small.

    Meant for key lists joined to large tables, which then need no shuffle: one
    pass counts rows and bytes. Beyond the bounds ``df`` comes back unmarked and
    the join is an ordinary shuffled one.
    """
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0))
                 for c in df.columns), F.lit(0))
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df
