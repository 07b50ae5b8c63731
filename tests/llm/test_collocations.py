"""Phrases from stripes against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from rowferry.llm import collocations
from tests.llm import brute


def plain(rows, top=2000, least=30):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute._LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        ranked = []
        for p, a in found.items():
            if any(100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, b in found.items() if len(q) > len(p)):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, n=400):
    rng = random.Random(seed)
    fixed = ["the quick brown fox", "New York City", "rock n roll", "ad hoc", "é à", "x x x x", "sooner or later"]
    out = []
    for i in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.4 else f"w{int(rng.paretovariate(0.7)) % 50}"
                 for _ in range(rng.randrange(40))]
        gaps = [rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ! "]) for _ in words]
        out.append((rng.choice(["en", "en", "de", None, "und", ""]), "".join(w + g for w, g in zip(words, gaps))))
    return out


@pytest.mark.parametrize("chunk, filter_bits", [(4 << 20, 28), (500, 28), (2000, 15)])
def test_against_plain_counting(spark, monkeypatch, chunk, filter_bits):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(collocations, "FILTER_BITS", filter_bits)
    rows = corpus(chunk)
    docs = spark.createDataFrame([(t, g, "z", 1) for g, t in rows], "text string, lang string, phrase string, a int")
    found, want = rows_of(collocations.phrases(docs.repartition(5))), plain(rows)
    assert found == want and len(want) > 30
    assert rows_of(collocations.phrases(docs, top=3)) == plain(rows, top=3)


def test_one_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 300)
    rows = [("en", " ".join(t for _, t in corpus(9, 150)) + " a b" * 200)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(collocations.phrases(docs)) == plain(rows)


def test_ties_and_subsumption(spark):
    rows = [("en", "a b c d. " * 30 + "a b! " * 7 + "b c. b c. " * 4 + "é y. E Z. " * 40 + "p q. " * 40)]
    found = rows_of(collocations.phrases(spark.createDataFrame(rows, "lang string, text string")))
    assert found == plain(rows)
    phrases = [r[2] for r in found]
    assert "a b c d" in phrases and "a b c" not in phrases and "a b" not in phrases  # 30 of 37
    assert "b c" in phrases  # 30 of 38 is less than four fifths
    assert phrases.index("e z") < phrases.index("p q") < phrases.index("é y")


def test_sums_beyond_64_bits(spark, monkeypatch):
    big = 2**62
    table = [("en", 0, "", 0, {"x": big, "y": big, "": 2**63 - 1}, big), ("en", 1, "x", 0, {"y": big}, big)]
    held = spark.createDataFrame(table, "lang string, k int, prefix string, slice int, nexts map<string,long>, most long")
    monkeypatch.setattr(collocations, "stripes", lambda *a: held)
    docs = spark.createDataFrame([], "lang string, text string")
    assert rows_of(collocations.phrases(docs)) == [("en", 1, "x y", big, big, big, 2**63 - 1, 1_000_000)]


def test_odd_documents(spark, odd):
    many = odd
    for _ in range(5):
        many = many.union(many)
    rows = [(r["lang"], r["text"]) for r in many.collect() if r["doc_id"] != 5]
    assert rows_of(collocations.phrases(many.where("doc_id is null or doc_id <> 5"))) == plain(rows)
    assert collocations.phrases(odd.where("false")).count() == 0
    assert collocations.phrases(odd.where("doc_id in (3, 4, 6)")).count() == 0


def test_filter_misses_no_frequent_hash():
    w = collocations._Words(pa.array(["en", None]), pa.array(["A b. c", "a  b\tc"]))
    assert w.word.to_pylist() == ["a", "b", "c"] * 2 and w.totals.tolist() == [3, 3]
    assert w.joined.tolist() == [True, False, False, True, True, False] and len(set(w.hash.tolist())) == 6
