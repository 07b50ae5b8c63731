"""Toxicity by a factorization machine over hashed terms.

Words are hashed into columns; the score of a window of words is linear in its
terms plus the products of their factors, so an insult weighs differently beside
a mention of whom it is aimed at.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rowferry.llm.training import MAX_ROWS, held_out, labelled
from rowferry.llm.words import buffers, hashes, in_parts, per_group, spans

#: Terms are hashed to this many columns, each with this many factors; column 0 is kept for terms without weight.
COLUMNS, FACTORS = 1 << 18, 4
#: A word gives a term for itself and one for each of its beginnings of these many bytes, so inflected and compound
#: forms share what they have in common.
PREFIXES = (4, 5, 6, 7, 8)
EPOCHS, RATE, SHRINK, SEED, MIN_TEXTS = 10, 0.05, 1e-4, 7, 5
#: Factors are spread by this at first and shrunk, and learned at the lower rate; so are the linear weights that start
#: from 0, with their own shrinkage.
SPREAD, LOW_RATE, SHRINK_FACTORS, SHRINK_NEUTRAL = 0.01, 0.02, 0.03, 0.1
#: The linear weights of terms whose log odds are within this many standard errors of 0 start from 0. Such terms are
#: learned like all others: what is neutral alone may not be beside another term.
ERRORS = 1.5
#: Share of the log odds that linear weights start from; beginnings of a word repeat its evidence.
START = 0.3
#: A document is scored by windows of this many words; it is as toxic as its most toxic window.
WINDOW = 40
#: Windows with about this many terms are scored at once.
TERMS = 200_000

_U = np.uint64

class Model(NamedTuple):
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the hashed terms, a row per word of all texts in order, and where each text begins (and the last ends).

    A word is a run of letters, digits and non-ASCII bytes, so punctuation
    around an insult doesn't hide it.
    """
    data, offsets = buffers(pc.utf8_lower(texts))
    starts, ends, at = spans(data, offsets, letters=True)
    shift = _U(64 - (COLUMNS.bit_length() - 1))
    columns = np.zeros((len(starts), 1 + len(PREFIXES)), np.int64)
    columns[:, 0] = (hashes(data, starts, ends) >> shift).astype(np.int64)
    for k, size in enumerate(PREFIXES, 1):
        long = np.flatnonzero(ends - starts > size)
        begun = hashes(data, starts[long], starts[long] + size) ^ _U(0x51ED270B9F1C6A35)
        columns[long, k] = (begun >> shift).astype(np.int64)
    return columns, at


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the windows over all texts, and which text each is of; none for a text without words."""
    n = np.diff(at)
    # Windows overlap by half, so terms at most half a window apart meet in one.
    step = WINDOW // 2
    count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // step) + 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = at[:-1][text] + nth * step
    return start, np.minimum(start + WINDOW, at[1:][text]), text


def weighty(columns: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms that have weights, and how many of them each word has."""
    mask = known[columns]
    return columns[mask].astype(np.int32), mask.sum(1, dtype=np.int8)


def bounds(count: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms of each window begin and end, by how many each word has."""
    edge = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=edge[1:])
    return edge[start], edge[end]


def raw_scores(model: Model, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Log odds of each window of words from running sums over its terms."""
    out, i = np.empty(len(low)), 0
    while i < len(low):
        j = max(i + 1, int(np.searchsorted(high, low[i] + TERMS, "right")))
        a, b = low[i], high[j - 1]
        v = model.factors[term[a:b]].astype(np.float64)
        each = np.concatenate([v, (v * v).sum(1)[:, None], model.linear[term[a:b]].astype(np.float64)[:, None]], 1)
        sums = np.zeros((b - a + 1, FACTORS + 2))
        np.cumsum(each, axis=0, out=sums[1:])
        d = sums[high[i:j] - a] - sums[low[i:j] - a]
        out[i:j] = model.bias + d[:, FACTORS + 1] + 0.5 * ((d[:, :FACTORS] ** 2).sum(1) - d[:, FACTORS])
        i = j
    return out


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED,
        weights: np.ndarray | None = None) -> Model:
    """Stochastic gradients (AdaGrad) on the most toxic window of each text.

    Linear weights start from smoothed log odds of the terms, so that the first
    windows chosen are plausible. All terms in at least ``MIN_TEXTS`` texts have
    weights and factors; rarer ones would only be learned by heart. ``weights``
    says how many texts each stands for.
    """
    rng = np.random.default_rng(seed)
    p, n, lengths, i = np.zeros(COLUMNS), np.zeros(COLUMNS), [np.zeros(0, np.int64)], 0
    for part in in_parts(texts):
        columns, at = terms(part)
        seen = np.unique(np.repeat(np.arange(len(part)), np.diff(at))[:, None] * COLUMNS + columns)
        mark, column = labels[i + seen // COLUMNS] == 1, seen % COLUMNS
        p += np.bincount(column[mark], minlength=COLUMNS)
        n += np.bincount(column[~mark], minlength=COLUMNS)
        lengths.append(np.diff(at))
        i += len(part)
    at = np.r_[0, np.cumsum(np.concatenate(lengths))]
    start, end, text = windows(at)
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    n_pos, n_neg = max(1, int((labels == 1).sum())), max(1, int((labels == 0).sum()))
    linear = np.log((p + 1) / (n_pos + 2)) - np.log((n + 1) / (n_neg + 2))
    known = p + n >= MIN_TEXTS
    known[0] = False
    telling = known & (np.abs(linear) > ERRORS * np.sqrt(1 / (p + 1) + 1 / (n + 1)))
    linear *= telling * START
    shrink, rate = np.where(telling, SHRINK, SHRINK_NEUTRAL), np.where(telling, RATE, LOW_RATE)
    used, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int8)]
    for part in in_parts(texts):
        term, count = weighty(terms(part)[0], known)
        used.append(term)
        counts.append(count)
    term = np.concatenate(used)
    del used
    low, high = bounds(np.concatenate(counts), start, end)
    factors, bias = rng.normal(0, SPREAD, (COLUMNS, FACTORS)) * known[:, None], -2.0
    g_linear, g_factors, g_bias = np.full(COLUMNS, 1.0), np.full((COLUMNS, FACTORS), 1.0), 1.0
    weight = np.ones(len(texts)) if weights is None else weights / weights.mean()
    odds = weight[labels == 0].sum() / max(1e-9, weight[labels == 1].sum())
    weight = weight * np.where(labels == 1, min(4.0, max(1.0, odds)), 1.0)
    for _ in range(epochs):
        scores = raw_scores(Model(bias, linear, factors), term, low, high)
        for i in rng.permutation(len(texts)):
            a, b = first[i], first[i + 1]
            if a == b:
                continue
            w = a + int(np.argmax(scores[a:b]))  # found once an epoch
            c = term[low[w]:high[w]]
            v = factors[c]
            total = v.sum(0)
            z = bias + linear[c].sum() + 0.5 * (total @ total - (v * v).sum())
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]) * weight[i]
            g_bias += g * g
            bias -= RATE * g / np.sqrt(g_bias)
            if not len(c) or abs(g) < 1e-3:
                continue
            unique, back = np.unique(c, return_inverse=True)
            count = np.bincount(back).astype(float)
            gl = g * count + shrink[unique] * linear[unique]
            gv = g * count[:, None] * (total - factors[unique]) + SHRINK_FACTORS * factors[unique]
            g_linear[unique] += gl * gl
            g_factors[unique] += gv * gv
            linear[unique] -= rate[unique] * gl / np.sqrt(g_linear[unique])
            factors[unique] -= LOW_RATE * gv / np.sqrt(g_factors[unique])
    return Model(bias, linear.astype(np.float32), factors.astype(np.float32))


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability that each text is toxic: that of its most toxic window, or of no terms at all."""
    columns, at = terms(texts)
    start, end, text = windows(at)
    best = np.full(len(texts), -np.inf)
    term, count = weighty(columns, (model.linear != 0) | model.factors.any(1))
    np.maximum.at(best, text, raw_scores(model, term, *bounds(count, start, end)))
    best[np.isneginf(best)] = model.bias
    return 1 / (1 + np.exp(-np.clip(best, -60, 60)))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **columns) -> Model:
    """Fit on at most ``max_rows`` labelled rows (see :func:`labelled`), on the driver."""
    rows = labelled(docs, labels, "toxic", max_rows, **columns).select(
        "doc_id", "label", "text", "weight").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, r.text))
    return fit([r.text for r in rows], np.array([r.label for r in rows], np.int64),
               weights=np.array([r.weight for r in rows], float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null and empty texts get the score of a text without terms. Repeated rows
    and rows with null ids are each scored; other columns are not read.
    Nothing is shuffled; the model is of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col]).alias("held_out"),
                         docs[text_col].cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = score_texts(shared.value, batch.column(2))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
            ["doc_id", "held_out", "score", "predicted"])

    return per_group(picked, "text", run, "doc_id long, held_out boolean, score double, predicted int")
