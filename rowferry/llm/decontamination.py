"""Benchmark decontamination by BM25 retrieval with block-max pruning.

Test items form an inverted index with the largest weight of every list and of
every block of items in it. Each passage of each document is a query; WAND's
tests, that the maxima of the lists and then of their blocks can reach the
threshold, are made for many passages at once, and what passes is scored in
full. Retrieved items count as leaked if the document holds enough of both
their question and their answer.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowferry.llm.words import buffers, hashes, mix, per_group, spans
from rowferry.session import stage

#: Words of a passage, which begin half a passage apart, and of the pieces in which items are indexed.
PASSAGE, PIECE = 128, 64
K1, B = 1.2, 0.75
#: A piece is retrieved from this share of the score that it has as its own query.
RETRIEVE = 0.6
#: Question and answer must both be covered to this share by runs of ``RUN`` words.
COVERED, RUN = 0.5, 3
#: Items are in blocks of this many pieces; words of all items in one shard of the index.
BLOCK, SHARD_WORDS = 64, 2_000_000

#: Bytes of text that are queried at once; lists of all their passages are held together.
GROUP = 1 << 19

_U = np.uint64


class Index(NamedTuple):
    """Postings by term (``at``), each a piece and its share of the piece's own score; blocks of them (``block_at``)."""

    terms: np.ndarray
    at: np.ndarray
    piece: np.ndarray
    weight: np.ndarray
    most: np.ndarray
    block_at: np.ndarray
    block: np.ndarray
    block_most: np.ndarray
    block_from: np.ndarray
    item_of: np.ndarray
    items: list


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in lower case, and where each text begins (and the last ends)."""
    data, offsets = buffers(pc.utf8_lower(texts))
    starts, ends, at = spans(data, offsets, letters=True)
    return hashes(data, starts, ends), at


def _parts(text: str, n: int) -> int:
    """How many of an item's ``n`` words are its question: those before its last sentence, or three quarters."""
    cut = max(text.rfind(m, 0, len(text.rstrip()) - 1) for m in (". ", "? ", "! ", ".\n", "?\n", "!\n", "\n"))
    if cut > 0:
        answer = len(words_of(pa.array([text[cut + 1:]]))[0])
        if 0 < answer < n:
            return n - answer
    return n - max(1, n // 4)


def runs(words: np.ndarray, size: int = RUN) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return words[:0]
    out = np.full(n, _U(size))
    for k in range(size):
        out = mix(out * _U(3) + words[k:n + k])
    return out


def _items(batch: pa.RecordBatch) -> pa.RecordBatch:
    words, at = words_of(batch.column(1))
    texts = batch.column(1).to_pylist()
    lists = [words[at[i]:at[i + 1]].view(np.int64) for i in range(batch.num_rows)]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array([_parts(t or "", len(w)) if len(w) else 0 for t, w in zip(texts, lists)], pa.int32()),
         pa.array([w.tolist() for w in lists], pa.list_(pa.int64()))], ["item_id", "question", "words"])


def build(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
          shard_words: int = SHARD_WORDS):
    """Yields the shards of the index; each is built from a bounded number of items.

    Document frequencies, the number of pieces and their mean length are taken
    over all items. Items without words (null or empty ones) cannot leak and are left out.
    """
    picked = benchmark.select(benchmark[id_col].cast("long").alias("item_id"),
                              benchmark[text_col].cast("string").alias("text"))
    items = stage(per_group(picked, "text", _items, "item_id long, question int, words array<long>").where(
        F.size("words") > 0), "items")
    pieces = items.select(F.xxhash64("item_id", "words").alias("item"), F.posexplode("words").alias("pos", "term")).select(
        "item", F.expr(f"pos div {PIECE}").alias("piece"), "term")
    counts = items.agg(F.sum(F.ceil(F.size("words") / PIECE)), F.sum(F.size("words").cast("long"))).first()
    if not counts[0]:
        return
    n, total = int(counts[0]), int(counts[1])
    df = stage(pieces.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df")), "item-terms")
    shards = -(-total // shard_words)
    in_shard = F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(-1))), F.lit(shards))
    for s in range(shards):
        mine = items.where(in_shard == s)
        known = mine.select(F.explode("words").alias("term")).distinct().join(df, "term").toPandas()
        rows = mine.orderBy("item_id").collect()
        if rows:
            yield _index(rows, known["term"].to_numpy(np.int64).view(np.uint64), known["df"].to_numpy(), n, total / n)


def _index(rows, terms: np.ndarray, df: np.ndarray, n: int, mean: float) -> Index:
    order = np.argsort(terms)
    terms, df = terms[order], df[order]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    items, term_ids, pieces, weights, item_of = [], [], [], [], []
    for no, row in enumerate(rows):
        words = np.array(row["words"], np.int64).view(np.uint64)
        q = row["question"]
        items.append((row["item_id"], [runs(part, min(RUN, max(1, len(part)))) for part in (words[:q], words[q:])],
                      [min(RUN, max(1, len(part))) for part in (words[:q], words[q:])]))
        for a in range(0, len(words), PIECE):
            part = words[a:a + PIECE]
            unique, tf = np.unique(part, return_counts=True)
            t = np.searchsorted(terms, unique)
            w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(part) / mean))
            term_ids.append(t)
            weights.append(w / w.sum())
            pieces.append(np.full(len(t), len(item_of)))
            item_of.append(no)
    term, piece, weight = np.concatenate(term_ids), np.concatenate(pieces), np.concatenate(weights)
    order = np.lexsort((piece, term))
    term, piece, weight = term[order], piece[order], weight[order]
    at = np.searchsorted(term, np.arange(len(terms) + 1))
    block = piece // BLOCK
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])])
    return Index(terms, at, piece, weight, np.maximum.reduceat(weight, at[:-1]),
                 np.searchsorted(term[first], np.arange(len(terms) + 1)), block[first],
                 np.maximum.reduceat(weight, first), np.r_[first, len(term)], np.array(item_of), items)


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``start .. start + size`` of all rows, and the row that each is of."""
    row = np.repeat(np.arange(len(size)), size)
    return start[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size), row


def retrieve(index: Index, words: np.ndarray, at: np.ndarray, threshold: float = RETRIEVE):
    """All (text, first word of the passage, piece, score) with a score of at least ``threshold``."""
    n = np.diff(at)
    step = PASSAGE // 2
    count = np.where(n > 0, np.maximum(1, -(-(n - PASSAGE) // step) + 1), 0)
    begin = np.r_[0, np.cumsum(count)]
    where = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    pos = np.flatnonzero(index.terms[where] == words)
    text = np.searchsorted(at, pos, "right") - 1
    inner = (pos - at[text]) // step
    t = len(index.terms)
    # A word is in the passage that begins in its half and in the one before.
    key = np.concatenate([(begin[text] + np.minimum(inner - k, count[text] - 1))[inner >= k] * t + where[pos][inner >= k]
                          for k in (0, 1)])
    key = np.unique(key)
    passage, term = key // t, key % t
    bound = np.bincount(passage, index.most[term], begin[-1])
    open_ = bound[passage] >= threshold - 1e-9
    passage, term = passage[open_], term[open_]
    if not len(passage):
        return []
    which, row = _spread(index.block_at[term], np.diff(index.block_at)[term])
    blocks = int(index.block.max()) + 1
    pair = passage[row] * blocks + index.block[which]
    unique, back = np.unique(pair, return_inverse=True)
    good = (np.bincount(back, index.block_most[which]) >= threshold - 1e-9)[back]
    which, row = which[good], row[good]
    entry, r = _spread(index.block_from[which], index.block_from[which + 1] - index.block_from[which])
    total = len(index.item_of)
    unique, back = np.unique(passage[row[r]] * total + index.piece[entry], return_inverse=True)
    score = np.bincount(back, index.weight[entry])
    hit = np.flatnonzero(score >= threshold - 1e-9) if len(unique) else []
    out = []
    for h in hit:
        p, piece = divmod(int(unique[h]), total)
        i = int(np.searchsorted(begin, p, "right")) - 1
        out.append((i, (p - int(begin[i])) * step, piece, float(score[h])))
    return out


def leaks_of(index: Index, texts: pa.Array) -> list[tuple]:
    """(text, item, score, question and answer overlap) of each item that a text holds."""
    words, at = words_of(texts)
    if not len(words):
        return []
    near: dict[tuple[int, int], list] = {}
    for i, first, piece, score in retrieve(index, words, at):
        near.setdefault((i, int(index.item_of[piece])), []).append((first, score))
    best: dict[tuple, tuple] = {}
    for (i, no), places in near.items():
        item, parts, sizes = index.items[no]
        mine = words[at[i]:at[i + 1]]
        found = [np.zeros(len(p), bool) for p in parts]
        for first, _ in places:
            around = mine[max(0, first - PIECE):first + PASSAGE + PIECE]
            for k, part in enumerate(parts):
                found[k] |= np.isin(part, runs(around, sizes[k]))
        q, a = (float(f.mean()) if len(f) else 1.0 for f in found)
        if q >= COVERED and a >= COVERED:
            row = (max(s for _, s in places), q, a)
            best[i, item] = max(best.get((i, item), row), row)
    return [(i, item, *row) for (i, item), row in sorted(best.items(), key=lambda x: (x[0][0], x[0][1] or 0))]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **items) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` of every leaked item of every document.

    Null and empty texts hold nothing; repeated rows give repeated results, a
    null id passes through. An empty table of either kind gives no rows. Other
    columns are not read. Documents are read once for each shard of the index
    and not shuffled.
    """
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    names = [x.split()[0] for x in schema.split(", ")]
    out = docs.sparkSession.createDataFrame([], schema)
    for index in build(benchmark, **items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, shared=shared):
            rows = leaks_of(shared.value, batch.column(1))
            if not rows:
                return None
            i, item, *rest = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(i)), pa.array(item, pa.int64()),
                 *(pa.array(x, pa.float64()) for x in rest)], names)

        out = out.union(per_group(picked, "text", run, schema, GROUP))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **items) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item."""
    at, schema = docs.columns.index(text_col), docs.schema
    for index in build(benchmark, **items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, shared=shared):
            keep = np.ones(batch.num_rows, bool)
            keep[[row[0] for row in leaks_of(shared.value, batch.column(at))]] = False
            return batch.filter(pa.array(keep))

        docs = per_group(docs, text_col, run, schema, GROUP)
    return docs
