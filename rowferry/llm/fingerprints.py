"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words (ASCII letters lower-cased), weighted by how
often they occur. For each of :data:`SAMPLES` samples every term has two gamma
variates and a uniform shift, all derived from the term's hash; they quantise
the term's weight on a logarithmic grid of its own and give a value that is the
smaller the heavier the term. The term with the smallest value and its grid
point are the sample. Two texts agree in a sample with a probability equal to
their generalised Jaccard similarity, the sum of the smaller weights over the
sum of the larger ones.

Documents are sorted once. Each is compared with its neighbour in that order
while the sorted rows stream by; only at the borders of partitions do two texts
have to be brought together afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowferry.llm.words import buffers, groups, hashes, mix, spans, trimmed
from rowferry.session import stage

#: Samples of a fingerprint; the standard error of a likeness is below ``0.5 / sqrt(SAMPLES)``.
SAMPLES = 128
#: Terms of a longer text are counted in spans of about this many bytes.
SPAN_BYTES = 4 << 20

_U = np.uint64
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 9, 10, 11, 12, 13]] = True


def _counted(terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(terms, kind="stable")
    terms, counts = terms[order], counts[order]
    first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
    return terms[first], np.add.reduceat(counts, first) if len(first) else counts


def _terms_of_one(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of one text in ascending order and their counts, a span at a time."""
    held = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    at = 0
    while at < len(data):
        end = min(len(data), at + SPAN_BYTES)
        while end < len(data):  # a span ends at white space
            gap = np.flatnonzero(_SPACES[data[end:end + SPAN_BYTES]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + SPAN_BYTES)
        part = data[at:end]
        starts, ends, _ = spans(part, np.array([0, len(part)]))
        mine = _counted(hashes(part, starts, ends), np.ones(len(starts), np.int64))
        held = _counted(np.concatenate([held[0], mine[0]]), np.concatenate([held[1], mine[1]]))
        at = end
    return held


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts together: which text, term hash and count, in ascending order of both."""
    data, offsets = buffers(texts)
    if len(data) > 2 * SPAN_BYTES:
        each = [_terms_of_one(data[offsets[i]:offsets[i + 1]]) for i in range(len(texts))]
        return (np.repeat(np.arange(len(each)), [len(e[0]) for e in each]),
                np.concatenate([e[0] for e in each]), np.concatenate([e[1] for e in each]))
    starts, ends, at = spans(data, offsets)
    doc, term = np.repeat(np.arange(len(texts)), np.diff(at)), hashes(data, starts, ends)
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    if not len(doc):
        return doc, term, np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])
    return doc[first], term[first], np.diff(np.r_[first, len(doc)])


_ODD = [_U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _units(bits: np.ndarray) -> np.ndarray:
    """Two numbers within (0, 1) of 23 bits from each 64."""
    out = (bits.view(np.uint32) >> np.uint32(9)).view(np.int32).astype(np.float32)
    out += np.float32(0.5)
    out *= np.float32(2.0**-23)
    return out


def variates(terms: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each term in one sample: a Gamma(2, 1) step, the logarithm of another such variate, and a uniform shift.

    Such a variate is minus the logarithm of a product of two uniform ones. Single precision decides between all but
    a few terms in a million; the rest go by their order.
    """
    a = (terms ^ mix(np.array([sample], np.uint64))) * _ODD[0]
    a ^= a >> _U(32)
    a *= _ODD[1]
    a ^= a >> _U(29)
    b = a * _ODD[2]
    b ^= b >> _U(32)
    u = _units(a)
    step = -np.log(u[0::2] * u[1::2])
    u = _units(b)
    other = np.log(-np.log(u[0::2] * u[1::2]))
    return step, other, _units(b * _ODD[3])[1::2]


def signatures(texts: pa.Array, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """A row of ``samples`` 16-bit codes for every text, and which texts have terms at all."""
    doc, term, count = term_counts(texts)
    out, some = np.zeros((len(texts), samples), np.uint16), np.zeros(len(texts), bool)
    if not len(doc):
        return out, some
    # Values depend on term and weight alone: each distinct pair is worked out once.
    order = np.lexsort((count, term))
    t, c = term[order], count[order]
    new = np.r_[True, (t[1:] != t[:-1]) | (c[1:] != c[:-1])]
    pair = np.empty(len(doc), np.int32)
    pair[order] = np.cumsum(new) - 1
    pair_term, weight = t[new], np.log(c[new].astype(np.float32))
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    width, mine = np.diff(np.r_[first, len(doc)]), doc[first]
    some[mine] = True
    for k in range(samples):
        step, other, shift = variates(pair_term, k)
        grid = np.floor(weight / step + shift)
        value = (other - step * (grid - shift + np.float32(1)))[pair]
        hit = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, first), width))
        hit = hit[np.r_[True, doc[hit[1:]] != doc[hit[:-1]]]]  # of equal values that of the smallest hash
        best = pair[hit]
        out[mine, k] = mix(pair_term[best] ^ mix(grid[best].astype(np.int64).astype(np.uint64))) >> _U(48)
    return out, some


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Share of samples in which rows agree; texts without terms are alike, and unlike all others."""
    return np.where(some_a & some_b, (a == b).mean(axis=1), (some_a == some_b).astype(np.float64))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many characters from the beginning of another."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def _binary(codes: np.ndarray, some: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() if s else b"" for row, s in zip(codes.astype(">u2"), some, strict=True)], pa.binary())


_ROWS = ("doc_id long, n_chars long, sha string, fp binary, edited_fp binary, near_edited double, near_next double, "
         "part int, edge int, text string")
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(),
          pa.int32(), pa.string()]
FIRST, LAST = 1, 2


def _signed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return signatures(pa.array(texts, pa.large_string()))


def _finished(ids: list, texts: list[str], changed: list[str], own: tuple, after: tuple, edits: tuple) -> pa.RecordBatch:
    """Rows of texts and edited texts, from the signatures of the texts, of the following ones and of the edited ones."""
    blank = [None] * len(texts)
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        _binary(*own), _binary(*edits), pa.array(likeness(own[0], edits[0], own[1], edits[1])),
        pa.array(likeness(own[0], after[0], own[1], after[1])), *(pa.array(blank, t) for t in _TYPES[7:])], _NAMES)


def _edge(doc_id, text: str, which: int) -> pa.RecordBatch:
    values = [doc_id, *[None] * 6, TaskContext.get().partitionId(), which, text]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES, strict=True)], _NAMES)


def _streamed(batches) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition, each with the one before it; the first and the last also as edges."""
    before = None
    for batch in batches:
        for piece in groups(batch, 1):
            ids, texts = piece.column(0).to_pylist(), piece.column(1).to_pylist()
            if before is None:
                yield _edge(ids[0], texts[0], FIRST)
            else:
                ids, texts = [before[0], *ids], [before[1], *texts]
            changed = [edited(t, f) for f, t in zip(texts[:-1], texts[1:], strict=True)]
            n = len(changed)
            codes, some = _signed((texts[1:] if before else texts) + changed)
            if before:
                codes, some = np.concatenate([before[2], codes]), np.r_[before[3], some]
            own, edits = (codes[1:n + 1], some[1:n + 1]), (codes[n + 1:], some[n + 1:])
            if n:
                yield _finished(ids[1:], texts[1:], changed, own, (codes[:n], some[:n]), edits)
            before = ids[-1], texts[-1], codes[n:n + 1], some[n:n + 1]
    if before is not None:
        yield _edge(before[0], before[1], LAST)


def _joined(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in groups(batch, 1):
            ids, texts, following = (piece.column(i).to_pylist() for i in range(3))
            changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
            yield _finished(ids, texts, changed, _signed(texts), _signed(following), _signed(changed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A fingerprint of every row of ``docs`` and of its edited text, and how alike they are.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. The edited text has its last third replaced by the
    beginning of the next document in descending order of ids; the first one
    follows the last. A fingerprint is the hexadecimal form of its samples, 16
    bits each, and empty where a text has no words. A null text is empty. Texts
    without words are alike (1) and unlike all others (0). Rows that repeat an
    id are rows of their own, in order of a hash of their texts; rows without an
    id come after all others. A single row is its own next document. An empty
    table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    # The last key divides rows that are alike in all else, so that no partition has to hold all copies of one row.
    ordered = rows.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id())
    found = stage(ordered.mapInArrow(trimmed(_streamed), _ROWS), "fingerprints")
    parts = sorted(r[0] for r in found.where(F.col("edge") == FIRST).select("part").collect())
    before = spark.createDataFrame(list(zip(parts, parts[-1:] + parts[:-1], strict=True)), "part int, before int")
    first = found.where(F.col("edge") == FIRST).select("part", "doc_id", "text").join(F.broadcast(before), "part")
    last = found.where(F.col("edge") == LAST).select(F.col("part").alias("before"), F.col("text").alias("following"))
    borders = first.join(last, "before").select("doc_id", "text", "following").mapInArrow(trimmed(_joined), _ROWS)
    return found.where("edge is null").union(borders).select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), F.lower(F.hex("fp")).alias("fingerprint"),
        F.lower(F.hex("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")
