"""Gives executors this package, as ``spark-submit --py-files`` would."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import SparkSession

import rowferry
from rowferry.llm.files import create
from rowferry.session import scratch_path

_SHIPPED: set[str] = set()
#: Rows that go to a Python worker, or come from it, at once. A batch is held several times over on its way, and rows here
#: are whole texts.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Add the package's sources, as a file in the shared folder, to the running application, once.

    Also bounds the batches exchanged with Python workers.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(rowferry.__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("rowferry", os.path.relpath(full, top)))
    target = f"{scratch_path(spark, 'sources')}/rowferry.zip"
    with create(target) as f:
        f.write(held.getvalue())
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
