"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded as a vector of word
and character statistics and hashed word shapes; a gated attention network
weighs the passages, and a logistic layer scores their weighted mean. Labels
are of documents only; which passages decide is learned.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rowferry.llm.training import MAX_ROWS, held_out, labelled
from rowferry.llm.words import buffers, hashes, mix, per_group, spans

#: Words of a passage; the last passage of a text may be shorter.
PASSAGE = 100
#: Columns for hashed shapes of words.
SHAPES = 64
#: A longer text than this is encoded in spans of about so many bytes.
LONG_BYTES, SPAN_BYTES = 2 << 20, 1 << 20
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 40, 64, 4e-3, 1e-4, 11
#: Documents are of good quality from this score.
THRESHOLD = 0.3

_U = np.uint64
_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 other sign, 6 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 5
_KIND[[ord(c) for c in ".,;:?!'\"()-"]] = 4
STATISTICS = 16


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    out: np.ndarray
    bias: float
    empty: float


def _word_spans(data: np.ndarray):
    """A long text in spans of about :data:`SPAN_BYTES` that end between words: where each begins, and its words."""
    at = 0
    while at < len(data):
        end = at + SPAN_BYTES
        while True:
            part = data[at:end]
            starts, ends, _ = spans(part, np.array([0, len(part)]))
            if end >= len(data):
                yield at, len(data), starts, ends
                return
            whole = len(starts) // PASSAGE * PASSAGE
            if whole and whole < len(starts):  # the rest of the words begin the next span
                yield at, at + int(starts[whole]), starts[:whole], ends[:whole]
                at += int(starts[whole])
                break
            end += SPAN_BYTES


def _encode_long(data: np.ndarray) -> np.ndarray:
    """Vectors of all passages of one long text, a span of whole passages at a time."""
    words = sum(len(starts) for _, _, starts, _ in _word_spans(data))
    return np.concatenate([
        _encoded(data[a:b], starts, ends, np.array([0, len(starts)]), np.array([words]))[0]
        for a, b, starts, ends in _word_spans(data)])


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages of all texts, and where each text's begin (and the last ends)."""
    data, offsets = buffers(texts)
    if (np.diff(offsets) > LONG_BYTES).any():
        each = [_encode_long(data[a:b]) if b - a > LONG_BYTES else _encoded(
            data[a:b], *spans(data[a:b], np.array([0, b - a])))[0] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.concatenate(each), np.r_[0, np.cumsum([len(x) for x in each])]
    return _encoded(data, *spans(data, offsets))


def _encoded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray,
             words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of passages from the words of texts; ``words`` are numbers of words where only parts are given."""
    n = np.diff(at)
    count = -(-n // PASSAGE)
    begin = np.r_[0, np.cumsum(count)]
    text = np.repeat(np.arange(len(n)), count)
    first = at[:-1][text] + (np.arange(len(text)) - begin[:-1][text]) * PASSAGE
    size = np.minimum(first + PASSAGE, at[1:][text]) - first
    total = len(first)
    if not total:
        return np.zeros((0, STATISTICS + SHAPES), np.float32), begin
    word = hashes(data, starts, ends)
    passage = np.repeat(np.arange(total), size)
    kind = _KIND[data]
    # Counts of each kind of byte per word from running sums.
    sums = np.zeros((len(data) + 1, 7), np.int32)
    for k in range(7):
        np.cumsum(kind == k, out=sums[1:, k])
    per_word = sums[ends] - sums[starts]
    length = ends - starts
    chars = np.add.reduceat(per_word, first, axis=0).astype(np.float64)
    bytes_ = np.add.reduceat(length, first).astype(np.float64)
    last = kind[ends - 1]
    repeat = np.r_[False, word[1:] == word[:-1]]
    repeat[first] = False
    letters = per_word[:, 1] + per_word[:, 2] + per_word[:, 6]

    def share(mask):
        return np.add.reduceat(mask.astype(np.float64), first) / size

    key = np.sort(passage.astype(np.uint64) << _U(40) | (word >> _U(24)))
    distinct = np.bincount((key[np.r_[True, key[1:] != key[:-1]]] >> _U(40)).astype(np.int64), minlength=total)
    lines = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data == 10, out=lines[1:])
    statistics = np.stack([
        chars[:, 1] / bytes_, chars[:, 2] / bytes_, chars[:, 3] / bytes_, chars[:, 4] / bytes_, chars[:, 5] / bytes_,
        chars[:, 6] / bytes_, np.minimum(bytes_ / size, 40) / 10, distinct / size, share(repeat), share(last == 4),
        share(last == 5), share(letters == 0), share((per_word[:, 2] > 1) & (per_word[:, 1] == 0)),
        np.log1p(size), np.log1p((n if words is None else words)[text]) / 4,
        (lines[ends[first + size - 1]] - lines[starts[first]]) / size,
    ], 1)
    # The shape of a word: kinds of its last three bytes and its first, and its length.
    shape = (kind[starts] * 7 + kind[ends - 1]) * 7 + kind[np.maximum(starts, ends - 2)]
    shape = (shape * 7 + kind[np.maximum(starts, ends - 3)]) * 16 + np.minimum(length, 15)
    column = (mix(shape.astype(np.uint64)) % _U(SHAPES)).astype(np.int64)
    shapes = np.bincount(passage * SHAPES + column, minlength=total * SHAPES).reshape(total, SHAPES) / size[:, None]
    return np.concatenate([statistics, np.sqrt(shapes)], 1).astype(np.float32), begin


def _attend(x, begin, v, u, w):
    """Attention of each passage, normalised over its text; texts have at least one passage."""
    a, b = np.tanh(x @ v), 1 / (1 + np.exp(-(x @ u)))
    e = (a * b) @ w
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin[:-1]), np.diff(begin)))
    return a, b, e / np.repeat(np.add.reduceat(e, begin[:-1]), np.diff(begin))


def fit(x: np.ndarray, begin: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED,
        weights: np.ndarray | None = None) -> Model:
    """Gradient descent (Adam) on the documents' labels, from the vectors of :func:`encode`.

    ``weights`` says how many documents each stands for.
    """
    rng = np.random.default_rng(seed)
    weights = np.ones(len(labels)) if weights is None or not len(labels) else weights / weights.mean()
    prior = float(np.clip((labels * weights).mean() if len(labels) else 0.5, 0.01, 0.99))
    some = np.flatnonzero(np.diff(begin) > 0)
    d = STATISTICS + SHAPES
    mean = x.mean(0) if len(x) else np.zeros(d)
    scale = 1 / (x.std(0) + 1e-3) if len(x) else np.ones(d)
    x = np.clip((x - mean) * scale, -8, 8).astype(np.float64)
    p = {"v": rng.normal(0, 0.1, (d, HIDDEN)), "u": rng.normal(0, 0.1, (d, HIDDEN)), "w": rng.normal(0, 0.1, HIDDEN),
         "out": np.zeros(d), "bias": np.zeros(1)}
    p["bias"][0] = np.log(prior / (1 - prior))
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(some)
        for i in range(0, len(order), BATCH):
            docs = order[i:i + BATCH]
            n = begin[docs + 1] - begin[docs]
            b = np.r_[0, np.cumsum(n)]
            h = x[np.repeat(begin[docs] - b[:-1], n) + np.arange(b[-1])]
            t, g, a = _attend(h, b, p["v"], p["u"], p["w"])
            z = np.add.reduceat(h * a[:, None], b[:-1], axis=0)
            dz = 1 / (1 + np.exp(-np.clip(z @ p["out"] + p["bias"][0], -30, 30))) - labels[docs]
            dz *= weights[docs] / len(docs)
            each = (h @ p["out"]) * np.repeat(dz, n)  # slope by each attention
            de = a * (each - np.repeat(np.add.reduceat(a * each, b[:-1]), n))
            inner = de[:, None] * p["w"]
            grads = {"out": z.T @ dz, "bias": np.array([dz.sum()]), "w": (t * g).T @ de,
                     "v": h.T @ (inner * g * (1 - t * t)), "u": h.T @ (inner * t * g * (1 - g))}
            step += 1
            for k, gradient in grads.items():
                gradient = gradient + DECAY * p[k] * (k != "bias")
                m1[k] = 0.9 * m1[k] + 0.1 * gradient
                m2[k] = 0.999 * m2[k] + 0.001 * gradient * gradient
                p[k] = p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    # Texts without words: as those among the labelled, leaning to poor quality.
    without = np.diff(begin) == 0 if len(labels) else np.zeros(0, bool)
    return Model(mean, scale, p["v"], p["u"], p["w"], p["out"], float(p["bias"][0]),
                 float(((labels * weights)[without].sum() + 0.1) / (weights[without].sum() + 1)))


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of good quality of each text."""
    x, begin = encode(texts)
    out = np.full(len(texts), model.empty)
    some = np.flatnonzero(np.diff(begin) > 0)
    if len(some):
        x = np.clip((x - model.mean) * model.scale, -8, 8)
        bounds = np.r_[begin[some], begin[-1]]
        _, _, a = _attend(x, bounds, model.v, model.u, model.w)
        z = np.add.reduceat(x * a[:, None], bounds[:-1], axis=0)
        out[some] = 1 / (1 + np.exp(-np.clip(z @ model.out + model.bias, -60, 60)))
    return out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **columns) -> Model:
    """Fit on at most ``max_rows`` labelled rows (see :func:`labelled`).

    Their passages are encoded where the texts are; the driver gets the vectors.
    """
    rows = labelled(docs, labels, "quality", max_rows, **columns).select(
        "doc_id", "label", "text", "weight")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, begin = encode(batch.column(2))
        each = [x[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(each, pa.binary()), batch.column(3)],
            ["doc_id", "label", "vectors", "weight"])

    kept = per_group(rows, "text", run, "doc_id long, label int, vectors binary, weight double").collect()
    kept.sort(key=lambda r: (r.doc_id, r.label, r.vectors))
    width = STATISTICS + SHAPES
    sizes = [len(r.vectors) // (4 * width) for r in kept]
    x = np.frombuffer(b"".join(r.vectors for r in kept), np.float32).reshape(-1, width)
    return fit(x, np.r_[0, np.cumsum(sizes)].astype(np.int64), np.array([r.label for r in kept], np.int64),
               weights=np.array([r.weight for r in kept], float))


def _appended(docs: DataFrame, model: Model, text_col: str, only: bool, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = score_texts(shared.value, batch.column(at))
        if only:
            return batch.filter(pa.array(s >= THRESHOLD))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
            ["doc_id", "held_out", "score", "predicted"])

    return per_group(docs, text_col, run, schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null and empty texts, and texts of white space only, get one low score.
    Repeated rows and rows with null ids are each scored; other columns are not
    read. Nothing is shuffled; the model is of fixed size.
    """
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col]).alias("held_out"),
                         docs[text_col].cast("string").alias("text"))
    return _appended(picked, model, "text", False, "doc_id long, held_out boolean, score double, predicted int")


def good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is of good quality.

    Null and empty texts have the score of :func:`score`, which is low, so they
    go; repeated rows stay or go together, null ids make no difference, an
    empty table stays empty.
    """
    return _appended(docs, model, text_col, True, docs.schema)
