"""Re-Pair goes on until no pair is frequent."""

from collections import Counter

import numpy as np
import pytest

from rowferry.llm import repair

BASE = 1000


def compressed(docs, **settings):
    starts = np.r_[0, np.cumsum([len(d) for d in docs])].astype(np.int64)
    ids = np.concatenate([np.asarray(d, np.int64) for d in docs]) if docs else np.zeros(0, np.int64)
    seq, at, left, right = repair.compress(ids, starts, BASE, **settings)
    for i, d in enumerate(docs):
        assert repair.expand(seq[at[i]:at[i + 1]], left, right, BASE).tolist() == list(d)
    return seq, at, left, right


def frequent_pairs(seq, at):
    """How often each pair stands within a document, overlaps of one symbol with itself counted as they can be replaced."""
    counts = Counter()
    for a, b in zip(at[:-1], at[1:]):
        i = a
        while i + 1 < b:
            counts[seq[i], seq[i + 1]] += 1
            i += 1
    return counts


def plain_repair(docs, least):
    """Textbook Re-Pair: the most frequent pair is replaced, again and again."""
    docs, rules = [list(d) for d in docs], 0
    while True:
        counts = Counter(p for d in docs for p in zip(d, d[1:]))
        best = max(counts.items(), key=lambda x: (x[1], x[0]), default=(None, 0))
        if best[1] < least:
            return sum(map(len, docs)) + 2 * rules
        new, rules = BASE + rules, rules + 1
        for d in docs:
            i, out = 0, []
            while i < len(d):
                if i + 1 < len(d) and (d[i], d[i + 1]) == best[0]:
                    out.append(new)
                    i += 2
                else:
                    out.append(d[i])
                    i += 1
            d[:] = out


def test_copies_of_a_document_become_a_symbol_each():
    rng = np.random.default_rng(1)
    document = rng.integers(0, BASE, 501)
    seq, _, left, _ = compressed([document] * 1000)
    assert len(seq) == 1000 and len(left) == 500


def test_a_long_cycle_shrinks_to_a_few_symbols():
    seq, _, left, _ = compressed([np.tile(np.random.default_rng(2).permutation(199), 200)])
    assert len(seq) < 20 and len(left) < 210


@pytest.mark.parametrize("seed", range(6))
def test_no_frequent_pair_is_left_and_size_is_near_the_textbook(seed):
    rng = np.random.default_rng(seed)
    words = [rng.integers(0, 30, rng.integers(2, 9)) for _ in range(40)]
    docs = [np.concatenate([words[i] for i in np.minimum(rng.geometric(0.15, 120), 39)]) for _ in range(12)]
    seq, at, left, _ = compressed(docs, least=8)
    assert max(frequent_pairs(seq, at).values(), default=0) < 8
    assert len(seq) + 2 * len(left) <= 1.1 * plain_repair(docs, 8)


def test_odd_documents():
    compressed([])
    compressed([[], [5], [], [5] * 300, [1, 2] * 100, []], least=2)
    seq, at, _, _ = compressed([[7] * 4096], least=2)
    assert len(seq) <= 2
