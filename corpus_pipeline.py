"""From raw documents to token ids in five stages.

``STAGES`` lists the stages; each takes (spark, docs, folder of tables) and
returns a DataFrame that is written and read again as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm import decontamination, mixing, near_duplicates, quality, repair
from rowferry.llm.ship import ship
from rowferry.operators.sizing import broadcast_if_small
from rowferry.session import configure, stage

#: The classifier, the join and the tokenizer are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ready(spark: SparkSession) -> SparkSession:
    ship(spark)
    return configure(spark)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality; the classifier is fitted on the labels of ``docs``.

    Null and empty texts go; repeated rows are judged alike, null ids pass, an
    empty table stays empty.
    """
    model = quality.train(docs, _table(_ready(spark), sf_dir, "labels"))
    return quality.good(docs, model)


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    Null texts and those without words are alike to nothing and stay, as do
    rows without an id. Of rows that repeat an id one stays. An empty table
    stays empty.
    """
    _ready(spark)
    return near_duplicates.representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; repeated rows are judged alike, null ids
    pass, an empty table of either kind removes nothing.
    """
    return decontamination.clean(docs, _table(_ready(spark), sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those taken 0 times go.

    The mix is made of row numbers and sizes; the texts are joined to their
    copies once. ``docs`` is a stored table, so a row has the same number in
    both scans. Null texts and those without words are taken once, repeated
    rows are mixed each on their own, an empty table stays empty.
    """
    _ready(spark)
    row = next(n for n in ("row_", *(f"row_{i}" for i in range(len(docs.columns) + 1))) if n not in docs.columns)
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    taken = stage(mixing.mix(numbered, keep=(row,)).where("copies > 0").select(
        F.col(f"kept.{row}").alias("taken_"), "copies"), "copies")
    copies = broadcast_if_small(taken.select(F.col("taken_").alias(row), F.col("copies").alias("copies_")))
    every = [F.col(f"`{c}`") for c in docs.columns]
    return numbered.join(copies, row).select(
        *every, F.explode(F.sequence(F.lit(1), F.col("copies_"))).alias("copy_")).select(*every)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every copy, from the shards written.

    A null text is an empty one; null ids come first; an empty table gives no rows.
    """
    import public_tokenizers

    _ready(spark)
    return repair.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicate_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each stage's rows are written before the next begins."""
    docs = _table(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
