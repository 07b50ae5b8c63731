"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Runtime settings every job relies on. All can be changed on a live session.
RUNTIME_CONF = {
    # Instants are written and compared as UTC.
    "spark.sql.session.timeZone": "UTC",
    # AQE sizes shuffle partitions, turns joins into broadcasts from measured
    # sizes and splits partitions that one hot key makes too large.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

CHECKPOINT_CONF = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`RUNTIME_CONF` to ``spark`` and return it."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def is_local(master: str) -> bool:
    """Whether driver and executors are one process, hence see one disk."""
    return master == "local" or master.startswith("local[")


def scratch_root(spark: SparkSession) -> str:
    """Folder for staged tables, reachable from every executor.

    It is the folder the cluster names in ``spark.checkpoint.dir``. Only on a
    local master, as in tests, may that be unset: a temporary folder is chosen
    then and remembered on the session, so that later calls agree. Anywhere else
    each executor would write to a disk of its own, so that raises.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        root = spark.conf.get("rowferry.scratch", None)
    if not root:
        if not is_local(spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="rowferry-")
        spark.conf.set("rowferry.scratch", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the scratch folder that nothing else uses."""
    return f"{scratch_root(spark)}/rowferry/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a staged table that nothing reads any more; only below the scratch folder."""
    if not path.startswith(f"{scratch_root(spark)}/rowferry/"):
        raise ValueError(f"{path} is not a staged table")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stage(df, label: str = "stage", path: str | None = None):
    """Write ``df`` to the scratch folder and return a scan of what was written.

    This cuts the lineage with files that outlive any executor, and fixes the
    rows before a target that is also a source gets overwritten. A caller that
    wants to :func:`discard` the table passes its ``path``.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
