"""Periodic runs of words by string synchronising sets.

For every scale, a power of two, positions are chosen by the hashes of the
windows that begin there: a position is chosen if the least hash of the windows
that begin within a scale's length of it is that of the first or the last of
them. The choice depends on nothing but the words close by, so two places with
the same words around them are chosen alike, and some position is chosen
everywhere but inside stretches whose period is below a third of the scale.
Windows inside such stretches, found at smaller scales, are left out, or a few
words repeated for long would be chosen all over.

A run of period ``q`` holds a chosen position of the scale between ``q / 4`` and
``q / 2`` early enough for its context, longer than ``q``, to come again ``q``
words later and not before. Neighbouring chosen positions with equal contexts
therefore propose every period at that scale; comparing words gives the whole
stretch. Only runs of period 1 are looked for directly.

Windows are named by pairs of the names of their halves, exactly, not by
hashes, and only where both halves come more than once; the work for a scale
shrinks with the text's repetition. Texts are handled together in groups; names
are of one text each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowferry.llm.words import buffers, cut_out, groups, mix, spans, trimmed

#: A run has at least this many words, and at least this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3

_U = np.uint64
_FAR = np.uint64(2**64 - 1)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words, an exact number for each (equal words, equal numbers), and where each text's words begin."""
    data, offsets = buffers(texts)
    starts, ends, at = spans(data, offsets)
    words = cut_out(data, starts, ends)
    return words, pc.dictionary_encode(words).indices.to_numpy(), at


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct pair, and how often each occurs."""
    _, name, count = np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True, return_counts=True)
    return name, count


class _Names:
    """Names of the windows of one length: equal windows of one text share a name below ``known``.

    A window that occurs once has a name of its own beyond; one that would pass
    the text's end has none (-1).
    """

    def __init__(self, name: np.ndarray, known: int):
        self.name, self.known = name, known

    @classmethod
    def of(cls, n: int, where: np.ndarray, valid: np.ndarray, first: np.ndarray, second: np.ndarray) -> _Names:
        """Windows at ``where`` from two numbers each; those elsewhere occur once."""
        name = np.arange(n, dtype=np.int64) + n
        if len(where):
            mine, count = _distinct(first, second)
            often = count[mine] > 1
            name[where[often]] = (np.cumsum(count > 1) - 1)[mine[often]]
        name[~valid] = -1
        return cls(name, n)

    def repeated(self) -> np.ndarray:
        return np.flatnonzero((self.name >= 0) & (self.name < self.known))


def _extent(ids: np.ndarray, low: int, high: int, at: int, period: int) -> tuple[int, int]:
    """The longest stretch around ``at`` within ``low`` and ``high`` whose words ``period`` apart are equal."""
    end, step = at, 32
    while end + period < high:
        stop = min(high - period, end + step)
        other = np.flatnonzero(ids[end:stop] != ids[end + period:stop + period])
        if len(other):
            end += int(other[0])
            break
        end, step = stop, step * 2
    start, step = at, 32
    while start > low:
        stop = max(low, start - step)
        other = np.flatnonzero(ids[stop:start] != ids[stop + period:start + period])
        if len(other):
            start = stop + int(other[-1]) + 1
            break
        start, step = stop, step * 2
    return start, end + period


def _windowed_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each position on; positions too close to the end count what there is."""
    least, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        least[:-step] = np.minimum(least[:-step], least[step:])
        have += step
    return least


def _chosen(name: np.ndarray, valid: np.ndarray, scale: int, skip: np.ndarray) -> np.ndarray:
    """The positions of the synchronising set; ``skip`` marks windows of small period."""
    rank = mix(name.astype(np.uint64))
    rank[skip | (name < 0)] = _FAR
    least = _windowed_least(rank, scale + 1)
    last = np.full(len(rank), _FAR)
    last[:len(rank) - scale] = rank[scale:]
    return valid & (least != _FAR) & ((rank == least) | (last == least))


def _pairs(where: np.ndarray, context: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours among ``where`` with equal contexts, ``low`` to ``high`` apart: position and distance."""
    order = np.lexsort((where, context))
    w, c = where[order], context[order]
    apart = np.diff(w)
    hit = (c[1:] == c[:-1]) & (apart >= low) & (apart <= high)
    return w[:-1][hit], apart[hit]


def runs_of(ids: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """All stretches of at least three periods as (start, end, period), of all texts, in order of start and period.

    ``ids`` are the words' numbers of all texts and ``at`` where each text begins.
    """
    n = len(ids)
    if n == 0:
        return []
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    left = at[1:][text] - np.arange(n)  # words to the text's end
    found: set[tuple[int, int, int]] = set()
    # Period 1 directly.
    same = np.r_[False, (ids[1:] == ids[:-1]) & (text[1:] == text[:-1]), False]
    edge = np.flatnonzero(same[1:] != same[:-1])
    found.update((int(a), int(b) + 1, 1) for a, b in zip(edge[::2], edge[1::2], strict=True)
                 if b + 1 - a >= LEAST_PERIODS)

    small = _Names.of(n, np.arange(n), left >= 1, text.astype(np.int64), ids.astype(np.int64))
    scale = 1

    def doubled(names: _Names, width: int) -> _Names:
        where = names.repeated()
        where = where[left[where] >= 2 * width]
        where = where[(names.name[where + width] >= 0) & (names.name[where + width] < n)]
        return _Names.of(n, where, left >= 2 * width, names.name[where], names.name[where + width])

    two = doubled(small, 1)
    while True:
        four = doubled(two, 2 * scale)
        # Contexts of three scales for periods up to that, of four for longer ones.
        where = two.repeated()
        where = where[left[where] >= 3 * scale]
        where = where[two.name[where + scale] < n]
        if not len(where):
            break
        three_name, _ = _distinct(two.name[where], two.name[where + scale])
        skip = np.zeros(n + 1, np.int32)
        for a, b, q in found:  # windows inside a stretch of small period
            if 3 * q <= scale <= b - a:
                skip[a] += 1
                skip[b - scale + 1] -= 1
        chosen = _chosen(small.name, left >= 2 * scale, scale, np.cumsum(skip[:-1]) > 0)
        picked = chosen[where]
        at3, far3 = _pairs(where[picked], three_name[picked], 2 * scale, 3 * scale)
        where = four.repeated()
        where = where[chosen[where]]
        at4, far4 = _pairs(where, four.name[where], 3 * scale + 1, 4 * scale - 1)
        places, periods = np.r_[at3, at4], np.r_[far3, far4]
        done: tuple[int, int, int] | None = None
        for i in np.lexsort((places, periods)):
            place, period = int(places[i]), int(periods[i])
            if done is not None and done[2] == period and place + period < done[1]:
                continue
            a, b = _extent(ids, int(at[text[place]]), int(at[text[place] + 1]), place, period)
            done = a, b, period
            if b - a >= LEAST_PERIODS * period:
                found.add(done)
        small, two, scale = two, four, 2 * scale
    return sorted(found, key=lambda r: (r[0], r[2]))


def altered(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a document chosen for repetition by its id; None for others."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most periods, exactly; of equal ones that with the smallest start, then period."""
    if not runs:
        return None
    top = max((b - a) / q for a, b, q in runs) * (1 - 1e-9)
    near = [r for r in runs if (r[1] - r[0]) / r[2] >= top]
    return min(near, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]))


_ROWS = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<"
         "start:long,length:long,period:long>>, collapsed string")
_NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]
_TYPES = [*[pa.int64()] * 6, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])),
          pa.large_string()]


def _examined(batch: pa.RecordBatch, alter) -> pa.RecordBatch:
    words, ids, at = words_of(batch.column(1))
    doc_ids = batch.column(0).to_pylist()
    source = np.arange(len(ids))
    for i, doc_id in enumerate(doc_ids):
        place = alter(doc_id, int(at[i + 1] - at[i])) if alter else None
        if place is not None:
            source[at[i]:at[i + 1]] = at[i] + place
    runs = [r for r in runs_of(ids[source], at) if r[1] - r[0] >= LEAST_WORDS]
    covered = np.zeros(len(ids) + 1, np.int32)
    for a, b, q in runs:
        covered[a + q] += 1
        covered[b] -= 1
    kept = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    cuts = np.searchsorted(kept, at)
    lists = pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), words.take(pa.array(source[kept])))
    collapsed = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
    bounds = np.searchsorted([r[0] for r in runs], at)
    out: list[list] = [[] for _ in range(7)]
    for i, doc_id in enumerate(doc_ids):
        base = int(at[i])
        mine = [(a - base, b - base, q) for a, b, q in runs[bounds[i]:bounds[i + 1]]]
        best = _best(mine)
        values = [None] * 4 if best is None else [
            best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]]
        for column, value in zip(out, (doc_id, len(mine), *values, [
                {"start": a, "length": b - a, "period": q} for a, b, q in mine]), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, t) for c, t in zip(out, _TYPES)), collapsed.cast(pa.large_string())], _NAMES)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alter=None) -> DataFrame:
    """The periodic runs of every text, and the text with its repetitions collapsed.

    Returns ``doc_id, n_runs, start, length, period, exponent_milli, runs,
    collapsed``. ``runs`` lists every stretch of at least 24 words and three
    periods that can't be made longer, by start and period, counted in words
    from 0. The columns before describe the one with most periods and are null
    where there is no run. ``collapsed`` has the words that no run contains
    after its first period, joined by single spaces. ``alter(doc_id, n)`` may
    give, for a text of n words, the word to be taken for each place.

    A null text is an empty one and has no runs. Repeated rows are rows of
    their own, null ids are kept, an empty table gives an empty result. Other
    columns are not read.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in groups(batch, 1):
                yield _examined(piece, alter)

    return rows.mapInArrow(trimmed(run), _ROWS)


def digests(found: DataFrame) -> DataFrame:
    """Rows of :func:`periodic_runs` with digests of their runs and of their collapsed texts."""
    lines = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
