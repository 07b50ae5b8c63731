"""Repeated ids with null texts, dotted names, many partitions, long texts, unfinished rounds."""

import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowferry.llm import components, mixing, near_duplicates, quality, repair
from rowferry.session import stage

FOLDER = "/root/testdata/sf0.001"


def test_repeated_ids_with_null_texts_keep_a_row(spark):
    docs = spark.createDataFrame([(1, None, "en"), (1, None, "de"), (2, None, "x"), (2, "a b", "y"), (3, "c", "z")],
                                 "doc_id long, text string, lang string")
    kept = near_duplicates.representatives(docs).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, None), (2, "a b"), (3, "c")]
    assert all(r.lang for r in kept)


def test_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 7), (1, "a b c", "s", 8), (2, "d", "s", 9)],
                                 "doc_id long, text string, source string, `x.y` int")
    assert near_duplicates.representatives(docs).columns == docs.columns
    assert near_duplicates.representatives(docs).count() == 2
    mixed = mixing.mix(docs, keep=("x.y",)).select("kept.`x.y`", "copies").collect()
    assert sorted(r["x.y"] for r in mixed) == [7, 8, 9]
    stored = stage(docs)
    out = corpus_pipeline.source_mixing(spark, stored, FOLDER)
    assert out.columns == docs.columns and out.count() >= 2


def test_stages_take_odd_documents(spark, odd):
    stored = stage(odd.withColumn("a.b", F.lit(1)).withColumn("row_", F.lit(2)))
    for _, fn in corpus_pipeline.STAGES[1:-1]:
        kept = stage(fn(spark, stored, FOLDER))
        assert kept.columns == stored.columns
        assert kept.where("doc_id is null and lang is null").count() == 0
    none = stage(odd.limit(0))
    for _, fn in corpus_pipeline.STAGES:
        assert stage(fn(spark, none, FOLDER)).count() == 0


def test_partitions_beyond_2048(spark, monkeypatch):
    class Late:
        @staticmethod
        def get():
            return Late

        @staticmethod
        def partitionId():
            return 5_000_000

    monkeypatch.setattr(near_duplicates, "TaskContext", Late)
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, text + f" x{i}") for i in range(6)] + [(9, "other words")],
                                 "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.component_id for r in near_duplicates.classes(docs).collect()}
    assert found == {**dict.fromkeys(range(6), 0), 9: 9}


def test_components_that_do_not_settle_raise(spark, monkeypatch):
    monkeypatch.setattr(components, "MAX_ROUNDS", 1)
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    with pytest.raises(RuntimeError, match="settle"):
        components.components(edges)


def test_targets_that_are_not_met_raise(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_STEPS", 1)
    docs = spark.createDataFrame([(i, "w " * (i + 1), "ab"[i % 2]) for i in range(20)],
                                 "doc_id long, text string, source string")
    with pytest.raises(RuntimeError, match="settle"):
        mixing.mix(docs)


def test_rows_of_one_id_have_a_place(spark):
    import public_tokenizers

    rows = [(1, f"text number {i}", i) for i in range(30)] + [(None, f"none {i}", i) for i in range(30)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = []
    for parts in (1, 6):
        docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(parts, "n")
        both.append(repair.round_trip(docs, path).collect())
    assert sorted(map(repr, both[0])) == sorted(map(repr, both[1]))


def test_long_texts_are_encoded_as_short_ones_are(monkeypatch):
    texts = ["Aa bb, 12 cc.\n" * 700 + "tail", "x" * 5000 + " y z", "", "short text here", None]
    whole, begin = quality.encode(pa.array(texts))
    monkeypatch.setattr(quality, "LONG_BYTES", 1000)
    monkeypatch.setattr(quality, "SPAN_BYTES", 700)
    again, at = quality.encode(pa.array(texts))
    assert begin.tolist() == at.tolist() and np.allclose(whole, again, atol=1e-6)


def test_memory_of_a_long_text():
    """A text of 50 MB takes less than 300 MB more."""
    code = (
        "import sys, resource, numpy as np, pyarrow as pa\n"
        f"sys.path.insert(0, {str(sys.path[0])!r}); sys.path.insert(0, '/root/repo')\n"
        "from rowferry.llm import quality\n"
        "quality.encode(pa.array(['a b'] * 10))\n"
        "text = pa.array(['Some words, 12 of them. ' * 2_100_000])\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "x, begin = quality.encode(text)\n"
        "print(len(x), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)\n")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, check=True)
    n, used = map(int, out.stdout.split())
    assert n == 105_000 and used < 300
