"""Plain counterparts of the operators, row by row in Python."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, size=5):
    words = WORD.findall((text or "").translate(_LOWER))
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def components(ids, texts):
    """(number of shingles, component) by id, from all pairs."""
    sets = {i: shingles(t) for i, t in zip(ids, texts)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def secret_spans(text):
    text = text or ""
    assign = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def targets(sizes, weights=(5, 2, 1), limit=3):
    """Target by source, resharing the excess until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if left * w[s] / total > limit * sizes[s]]
        if not full:
            out.update({s: left * w[s] / total for s in open_})
            break
        for s in full:
            out[s] = float(limit * sizes[s])
        left -= sum(out[s] for s in full)
        open_ -= set(full)
    return out
