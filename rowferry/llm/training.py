"""Labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowferry.operators.sizing import broadcast_if_small

#: Labelled rows used for fitting, at most; the rest of the labels is not needed for a few hundred thousand weights.
MAX_ROWS = 6_000
#: Rows with this remainder of crc32(doc_id) are never learned from.
FOLDS, HELD_OUT = 5, 0


def held_out(doc_id):
    """Whether a document is kept for evaluation; a null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``doc_id, text, label, weight`` of at most ``max_rows`` labelled rows that may be learned from.

    The rows are those with the smallest hashes of their ids, half of the bound
    for each label, so that the rarer label is well represented. ``weight`` is
    how many labels of its kind each row stands for: all that may be learned
    from are counted, so a model fitted with it doesn't lean to the rarer label
    as tables grow. Only the labels are ranked; their texts are picked
    afterwards, one text of each id however often it is repeated. Null labels, ids and texts are left out, and so are labels other
    than 0 and 1.
    """
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).where(~held_out(F.col("doc_id"))).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    half = max_rows // 2
    weights = marks.groupBy("label").agg(F.greatest(F.lit(1.0), F.count(F.lit(1)) / half).alias("weight"))
    picked = marks.where("label = 1").orderBy(*order).limit(half).union(
        marks.where("label = 0").orderBy(*order).limit(half)).join(F.broadcast(weights), "label")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return texts.where("text is not null").join(broadcast_if_small(picked), "doc_id").groupBy("doc_id", "label").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"), F.max("weight").alias("weight")).select(
        "doc_id", "text", "label", "weight")
