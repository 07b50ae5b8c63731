"""Fingerprints by consistent weighted sampling."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rowferry.llm import fingerprints
from rowferry.llm.fingerprints import SAMPLES, signatures
from tests.llm import brute


def similarity(a, b):
    a, b = (Counter(brute.WORD.findall((t or "").translate(brute._LOWER))) for t in (a, b))
    least, most = sum((a & b).values()), sum((a | b).values())
    return least / most if most else 1.0


def plain(ids_and_texts):
    """(id, n_chars, sha of the edited text) in plain Python, rows with distinct ids."""
    order = sorted(ids_and_texts, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        changed = text[:len(text) - cut] + following[:cut]
        out[doc_id] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), changed, following)
    return out


def random_texts(n, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    return [" ".join(rng.choices(vocabulary, weights=range(1, 61), k=rng.randrange(1, 120))) for _ in range(n)]


def test_collisions_follow_generalised_jaccard():
    texts = random_texts(60)
    texts += [t + " " + " ".join(random_texts(1, i)) for i, t in enumerate(texts)]
    codes, some = signatures(pa.array(texts), 512)
    assert some.all()
    off = []
    for i in range(0, len(texts), 3):
        for j in range(i + 1, len(texts)):
            true = similarity(texts[i], texts[j])
            off.append(((codes[i] == codes[j]).mean() - true) / max(0.01, (true * (1 - true) / 512) ** 0.5))
    off = np.array(off)
    assert abs(off.mean()) < 0.2 and 0.8 < off.std() < 1.2 and abs(off).max() < 5


def test_weights_matter():
    a, b = "x " * 9 + "y", "x y"
    codes, _ = signatures(pa.array([a, b]), 2048)
    assert abs((codes[0] == codes[1]).mean() - similarity(a, b)) < 0.05 and similarity(a, b) == 0.2


def test_grouping_and_spans_do_not_matter(monkeypatch):
    texts = [*random_texts(30), "", None, " \n", "x" * 5000 + " y"]
    whole, some = signatures(pa.array(texts))
    for i, t in enumerate(texts):
        one, there = signatures(pa.array([t], pa.string()))
        assert (one[0] == whole[i]).all() and there[0] == some[i]
    monkeypatch.setattr(fingerprints, "SPAN_BYTES", 64)
    again, _ = signatures(pa.array(texts))
    assert (again == whole).all() and some[-2:].tolist() == [False, True]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_rows_against_plain_python(spark, parts):
    rows = list(enumerate([*random_texts(36), None, "", "ab", "Größe 日本語 x"]))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(t, i, "z") for i, t in rows], "text string, doc_id long, fp string").repartition(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        found = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = plain(rows)
    assert found.keys() == want.keys()
    for i, (n, sha, changed, following) in want.items():
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        text = dict(rows)[i] or ""
        codes, some = signatures(pa.array([text, changed, following]))
        hexes = [c.astype(">u2").tobytes().hex() if s else "" for c, s in zip(codes, some)]
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple(hexes[:2])

        def near(a, b):
            if not a or not b:
                return float(a == b)
            return sum(a[k:k + 4] == b[k:k + 4] for k in range(0, len(a), 4)) / SAMPLES
        assert r["near_edited"] == near(*hexes[:2]) and r["near_next"] == near(hexes[0], hexes[2])


def test_odd_documents(spark, odd):
    found = fingerprints.fingerprints(odd).collect()
    assert sorted(r["doc_id"] or -1 for r in found) == sorted(r["doc_id"] or -1 for r in odd.collect())
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[1][0]["fingerprint"] == by_id[1][1]["fingerprint"] == by_id[None][0]["fingerprint"]
    # letters are lower-cased, and the two equal texts follow each other
    assert by_id[2][0]["fingerprint"] == by_id[1][0]["fingerprint"] and by_id[2][0]["near_next"] == 1.0
    assert by_id[7][0]["fingerprint"] == by_id[8][0]["fingerprint"] and by_id[8][0]["near_next"] == 1.0
    for i in (3, 4):
        assert by_id[i][0]["fingerprint"] == "" and by_id[i][0]["near_edited"] == 1.0
    # white space alone: the next document's beginning brings its first word
    assert by_id[6][0]["fingerprint"] == "" and by_id[6][0]["near_edited"] == 0.0
    # 11 is the largest id: nothing precedes it, and the row without an id follows after 1
    assert by_id[None][0]["near_next"] == 0.0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)


def test_no_rows_and_one_row(spark, odd):
    assert fingerprints.fingerprints(odd.where("false")).count() == 0
    one = fingerprints.fingerprints(odd.where("doc_id = 7")).first()
    changed = "one two three"[:9] + "one "
    assert one["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and one["near_next"] == 1.0
