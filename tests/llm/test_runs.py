"""Periodic runs against all periods tried one by one."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowferry.llm import runs
from tests.llm import brute


def stretches(words, least=0):
    """Every (start, end, smallest period) of at least three periods that can't be made longer."""
    out = {}
    n = len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - a >= max(least, 3 * q):
                out.setdefault((a, i + q), q)
    return sorted(((a, b, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def several(lists):
    names = {}
    ids = np.array([names.setdefault(w, len(names)) for x in lists for w in x], np.int64)
    return runs.runs_of(ids, np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64))


def want(lists):
    base, out = 0, []
    for x in lists:
        out += [(a + base, b + base, q) for a, b, q in stretches(x)]
        base += len(x)
    return out


def nested(rng, depth):
    """Repetitions within repetitions, with words between."""
    if depth == 0:
        return [rng.choice("abcd") for _ in range(rng.randrange(1, 5))]
    block = [w for _ in range(rng.randrange(1, 4)) for w in nested(rng, depth - 1)]
    block = block * rng.choice([1, 1, 2, 3, 4, 7])
    return block[rng.randrange(max(1, len(block) // 3)):]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=60), max_size=4))
def test_two_letters(lists):
    assert several(lists) == want(lists)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_repetitions_within_repetitions(seed):
    rng = random.Random(seed)
    lists = [nested(rng, rng.randrange(4))[:400] for _ in range(rng.randrange(1, 4))]
    assert several(lists) == want(lists)


@pytest.mark.parametrize("inner", [1, 2, 3, 5, 8, 13, 40])
@pytest.mark.parametrize("outer", [17, 50, 51, 63, 64, 65, 127, 200])
def test_small_period_fills_most_of_a_large_one(inner, outer):
    base = (["x", "y", "z", "u", "v", *map(str, range(40))][:inner] * outer)[:outer - 1] + ["end"]
    for times, cut in ((3, 0), (3, outer // 2), (5, outer - 1)):
        text = (base * (times + 1))[cut:cut + times * outer]
        assert several([["q", *text, "r"]]) == want([["q", *text, "r"]])


def test_fibonacci_and_thue_morse_words():
    a, b = "a", "ab"
    while len(b) < 600:
        a, b = b, b + a
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(512))
    assert several([b, morse]) == want([b, morse]) and stretches(morse) == []


def test_long_runs_take_little_time():
    text = ["a"] * 200_000 + ["b"] + ["c", "d"] * 100_000 + [f"w{i % 5001}" for i in range(100_000)]
    assert several([text]) == [(0, 200_000, 1), (200_001, 400_001, 2), (400_001, 500_001, 5001)]


def plain(doc_id, text):
    words = brute.WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = stretches(words, 24)
    dropped = {i for a, b, q in found for i in range(a + q, b)}
    best = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(found), *((best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best
                          else [None] * 4),
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def check(spark, docs):
    found = runs.digests(runs.periodic_runs(docs, alter=runs.altered)).collect()
    rows = docs.select("doc_id", "text").collect()
    assert sorted(map(repr, ((r["doc_id"], *tuple(r)[1:]) for r in found))) == sorted(
        map(repr, ((i, *plain(i, t)) for i, t in rows)))
    return found


def test_rows_against_plain_python(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        words = nested(rng, rng.randrange(1, 4))[:150] if i % 3 else [f"W{rng.randrange(40)}" for _ in range(rng.randrange(150))]
        rows.append((i, "\t ".join(words) + " \n" * (i % 2)))
    found = check(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(r["n_runs"] > 1 for r in found) > 10


def test_odd_documents(spark, odd):
    check(spark, odd.where("doc_id is null or doc_id <> 5"))
    long = runs.periodic_runs(odd.where("doc_id = 5")).first()
    assert [(r["start"], r["length"], r["period"]) for r in long["runs"]] == []
    assert runs.periodic_runs(odd.where("false")).count() == 0


def test_words_are_numbered_exactly():
    words, ids, at = runs.words_of(pa.array(["Aa aa  é", None, "", "é\tAa"]))
    assert words.to_pylist() == ["Aa", "aa", "é", "é", "Aa"] and at.tolist() == [0, 3, 3, 3, 5]
    assert ids[0] == ids[4] and ids[2] == ids[3] and len(set(ids.tolist())) == 3
