"""The pipeline, stage by stage against plain counterparts, and as a whole."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rowferry.llm import quality
from rowferry.session import stage
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def passed(spark):
    """The rows that each stage was given and gave."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for _, fn in corpus_pipeline.STAGES:
        kept = stage(fn(spark, docs, FOLDER))
        out.append((docs.collect(), kept.collect(), docs.columns, kept.columns))
        docs = kept
    return out


def test_stages_keep_the_columns(passed):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(passed) == 5
    for _, _, before, after in passed[:-1]:
        assert before == after


def test_good_documents_stay(spark, passed):
    before, after, *_ = passed[0]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in after} == good and 0 < len(after) < len(before)


def test_one_of_each_group_stays(passed):
    before, after, *_ = passed[1]
    found = brute.components([r.doc_id for r in before], [r.text for r in before])
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in found.items() if i == c)


def test_leaks_go(spark, passed):
    def plain(text):
        return " " + " ".join(re.findall(r"\w+", text.lower())) + " "

    before, after, *_ = passed[2]
    items = [plain(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in before if not any(i in plain(r.text) for i in items)}
    assert {r.doc_id for r in after} == clean


def test_sources_are_mixed(passed):
    before, after, *_ = passed[3]
    size = {r.doc_id: len(brute.WORD.findall(r.text)) for r in before}
    copies, by_source, taken = Counter(r.doc_id for r in after), Counter(), Counter()
    for r in before:
        by_source[r.source] += size[r.doc_id]
        taken[r.source] += size[r.doc_id] * copies[r.doc_id]
    assert max(copies.values()) <= 3
    largest = max(size.values())
    for source, target in brute.targets(by_source).items():
        assert abs(taken[source] - target) <= largest
    assert Counter(tuple(r) for r in after) == Counter({tuple(r): copies[r.doc_id] for r in before if copies[r.doc_id]})


def test_ids_of_the_mix(passed):
    before, after, *_ = passed[4]
    plain, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    after = sorted(after, key=lambda r: r.start)
    for r, doc in zip(after, sorted(before, key=lambda r: r.doc_id), strict=True):
        ids = np.array([*plain.encode(doc.text, add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_the_whole_gives_the_same(spark, passed):
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(tuple(r) for r in passed[4][1])
