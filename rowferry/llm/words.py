"""Words, hashes and shingles of whole texts, computed over Arrow buffers.

A word is a maximal run of bytes other than space and 0x09 to 0x0D; ASCII
letters are lower-cased before hashing. Everything works on whole texts, a
bounded number of bytes at a time.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Texts are handled in groups of about this many bytes; a longer text is a group of its own.
GROUP_BYTES = 1 << 20
#: Words whose hashes are taken at once span at most about this many bytes.
SPAN = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(48, 58), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15 | 1
_ODD = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_P))[_LOWER]
_POWERS: list[np.ndarray] = []
_LIBC = ctypes.CDLL(None)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        both = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            p = np.full(max(n, SPAN + 4096), base, dtype=np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets between them; null counts as empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    elif pa.types.is_string(texts.type):
        kind = np.int32
    else:
        texts, kind = texts.cast(pa.large_string()), np.int64
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, letters: bool = False,
          kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (and one past the last).

    With ``letters`` a word is a run of ASCII letters, digits and bytes beyond ASCII only; with ``kind`` a run of
    bytes that this table marks.
    """
    word = kind[data] if kind is not None else _LETTER[data] if letters else ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def cut_out(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words between ``starts`` and ``ends``, in order and apart, as strings."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    cuts = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=cuts[1:])
    kept = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(kept)])


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, lower-cased."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SPAN, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        up, down = _powers(high - low)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_TABLE[data[low:high]] * up[:high - low], out=total[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _U(_ODD[2]))
        i = j
    return out


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text; of the whole sequence if it is shorter; none of no words."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    total = np.full(n - width + 1, _U((0x1234567 * (width if n < size else 0)) & (2**64 - 1)), np.uint64)
    for k in range(width):
        total = mix(total * _U(3) + words[k:n - width + 1 + k] * _U(_ODD[k % 5]))
    return total


def groups(batch: pa.RecordBatch, column: int, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``size`` bytes (:data:`GROUP_BYTES`)."""
    _, offsets = buffers(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (size or GROUP_BYTES), "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def in_parts(texts: list[str]) -> Iterator[pa.Array]:
    """A list of texts as arrays of about :data:`GROUP_BYTES` characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= GROUP_BYTES // 2:
            yield pa.array(part, pa.string())
            part, size = [], 0
    if part:
        yield pa.array(part, pa.string())


def trim() -> None:
    """Give memory that this worker holds but doesn't use back to the system; workers live on between tasks."""
    if len(_POWERS) and len(_POWERS[0]) > SPAN + 4096:
        _POWERS.clear()
    pa.default_memory_pool().release_unused()
    _LIBC.malloc_trim(0) if hasattr(_LIBC, "malloc_trim") else None  # only the GNU C library has it


def trimmed(run: Callable) -> Callable:
    """``run`` over the batches of a task, with :func:`trim` behind it."""
    def held(batches):
        yield from run(batches)
        trim()

    return held


def per_group(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str,
              size: int | None = None) -> DataFrame:
    """``mapInArrow`` over slices with a bounded number of bytes in text column ``column``."""
    at, names = df.columns.index(column), df.columns

    def run(batches):
        for batch in batches:
            for part in groups(batch.rename_columns(names), at, size):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    # Columns are handed over by position, since names with dots can't be.
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).mapInArrow(trimmed(run), schema)
