"""Token ids of many texts by the tokenizers library, each distinct piece encoded once.

A byte-level BPE encodes the pieces of its splitting pattern one by one, so
equal pieces have equal ids. Texts of common letters are split here over code
point arrays and only distinct pieces go to the library; any other text goes to
it whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa

from rowferry.llm.words import buffers, mix

#: Texts with code points from here on are left to the library.
COMMON = 0x250
#: Pieces kept between calls, at most, some 30 bytes each; and new ones that are gathered before they are sorted in.
KEPT, GATHERED = 600_000, 60_000
#: Text of special tokens, which the library treats in its own way.
SPECIAL = b"<|"

_U = np.uint64
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_CLASS = np.array([
    _SPACE if c in (*range(9, 14), 32, 0x85, 0xA0) else
    {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(COMMON)], np.int8)
_TABLE = mix(np.arange(1, COMMON + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_P = 0x9E3779B97F4A7C15 | 1


def _pieces(code: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Starts of the pieces of all texts; ``texts`` holds where each non-empty text begins."""
    n = len(code)
    kind = _CLASS[code]
    begins = np.zeros(n + 1, bool)
    begins[texts] = True
    begins[n] = True
    run = begins.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    cut = run.copy()
    space = kind == _SPACE
    # The last white space before other text is a piece of its own, or joins what follows if it is a plain space.
    before = np.zeros(n, bool)
    before[:-1] = space[:-1] & ~space[1:] & ~begins[1:n]
    at = np.flatnonzero(before)
    cut[at] = True
    cut[at[code[at] == 32] + 1] = False
    # A lone apostrophe with nothing before it in its piece takes certain letters after it.
    tick = np.flatnonzero((code[:-1] == 39) & cut[:-1][:n - 1] & run[1:n] & ~begins[1:n] & (kind[1:] == _LETTER))
    if len(tick):
        padded = np.r_[code, 0, 0]
        a, b = padded[tick + 1], padded[tick + 2]
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        two &= ~begins[np.minimum(tick + 2, n)]
        one = np.isin(a, [115, 116, 109, 100])
        for these, size in ((tick[one], 1), (tick[two], 2)):
            cut[these + 1] = False
            cut[these + 1 + size] = True
    cut[n] = False
    return np.flatnonzero(cut)


class _Pieces:
    """Ids of pieces by hash: sorted keys, and for each the place of its ids."""

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.width = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of keys, -1 where unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, width: np.ndarray, flat: np.ndarray) -> None:
        at = len(self.flat) + np.cumsum(width) - width
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        self.keys = all_keys[order]
        self.at = np.concatenate([self.at, at])[order]
        self.width = np.concatenate([self.width, width])[order]
        self.flat = np.concatenate([self.flat, flat])

    def merge(self, other: _Pieces) -> None:
        at = np.concatenate([self.at, other.at + len(self.flat)])
        keys = np.concatenate([self.keys, other.keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order]
        self.width = np.concatenate([self.width, other.width])[order]
        self.flat = np.concatenate([self.flat, other.flat])


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """The process's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    """Encodes batches of texts and remembers their pieces."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        [self.line_break] = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.known, self.recent = _Pieces(), _Pieces()
        self.powers: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _hash(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(code)
        if self.powers is None or len(self.powers[0]) < n:
            both = []
            for base in (_P, pow(_P, -1, 1 << 64)):
                p = np.full(max(n, 1 << 20), base, np.uint64)
                p[0] = 1
                both.append(np.cumprod(p, dtype=np.uint64))
            self.powers = both[0], both[1]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[code] * self.powers[0][:n], out=total[1:])
        return mix((total[ends] - total[starts]) * self.powers[1][starts] + (ends - starts).astype(np.uint64))

    def _pieces(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all ids. Pieces with a line break between them stay as they are."""
        space = np.r_[0, np.cumsum(_CLASS[code] == _SPACE)]
        alone = (space[ends] > space[starts + 1]) | ((ends - starts == 1) & (space[ends] > space[starts]))
        width, out = np.zeros(len(starts), np.int64), [None] * 2
        plain = np.flatnonzero(~alone)
        size = ends[plain] - starts[plain] + 1
        begin = np.cumsum(size) - size
        joined = np.full(int(size.sum()), 10, "<u4")
        row = np.repeat(np.arange(len(plain)), size - 1)
        nth = np.arange(len(row)) - np.repeat(begin - np.arange(len(plain)), size - 1)
        joined[begin[row] + nth] = code[starts[plain][row] + nth]
        text = joined.tobytes().decode("utf-32-le")
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        ids = np.array(encode([text], add_special_tokens=False)[0].ids, np.int32)
        breaks = np.flatnonzero(ids == self.line_break)
        width[plain] = np.diff(np.r_[-1, breaks]) - 1
        out[0] = np.delete(ids, breaks)
        rest = np.flatnonzero(alone)
        lists = [self.tokenizer.encode(code[starts[i]:ends[i]].tobytes().decode("utf-32-le"), add_special_tokens=False).ids
                 for i in rest]
        width[rest] = [len(x) for x in lists]
        out[1] = np.array([x for some in lists for x in some], np.int32)
        flat = np.empty(int(width.sum()), np.int32)
        mine = np.repeat(~alone, width)
        flat[mine], flat[~mine] = out
        return width, flat

    def _fast(self, code: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        begin = np.r_[0, np.cumsum(sizes)]
        if not len(code):
            return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        starts = _pieces(code, begin[:-1][sizes > 0])
        ends = np.r_[starts[1:], len(code)]
        key = self._hash(code, starts, ends)
        unique, first, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.recent.keys) > GATHERED:
            if len(self.known.keys) > KEPT:
                self.known = _Pieces()
            self.known.merge(self.recent)
            self.recent = _Pieces()
        old = self.known.find(unique)
        new = np.flatnonzero((old < 0) & (self.recent.find(unique) < 0))
        if len(new):
            self.recent.add(unique[new], *self._pieces(code, starts[first[new]], ends[first[new]]))
        young = self.recent.find(unique)
        is_old = old >= 0
        width = np.empty(len(unique), np.int64)
        at = np.empty(len(unique), np.int64)
        flat = np.concatenate([self.known.flat, self.recent.flat])
        for mine, pieces, where, shift in ((is_old, self.known, old, 0),
                                           (~is_old, self.recent, young, len(self.known.flat))):
            width[mine] = pieces.width[where[mine]]
            at[mine] = pieces.at[where[mine]] + shift
        at = at[back]
        width = width[back]
        out = flat[np.repeat(at - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))]
        total = np.r_[0, np.cumsum(width)]
        piece = np.searchsorted(starts, begin)
        return out, np.diff(total[piece])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        data, offsets = buffers(texts)
        out: list[np.ndarray | None] = [None] * len(texts)
        easy, codes = [], []
        for i in range(len(texts)):
            raw = data[offsets[i]:offsets[i + 1]].tobytes()
            text = raw.decode()
            code = np.frombuffer(text.encode("utf-32-le"), "<u4")
            if SPECIAL in raw or (len(code) and int(code.max()) >= COMMON):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)
            else:
                easy.append(i)
                codes.append(code)
        if easy:
            ids, count = self._fast(np.concatenate(codes), np.array([len(c) for c in codes]))
            for i, part in zip(easy, np.split(ids, np.cumsum(count)[:-1]), strict=True):
                out[i] = part
        return out
