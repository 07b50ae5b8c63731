"""Token ids in grammar-compressed shards (Re-Pair) with random access.

A shard holds the ids of some documents. Frequent pairs of neighbouring symbols
are replaced by nonterminals, round after round, until none is frequent; the shard stores the rules,
the length that each expands to, and for every document where its symbols and
ids begin. A document is decoded from its own symbols and the rules alone.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowferry.llm.files import create, open_input
from rowferry.llm.pretokens import encoder_for
from rowferry.llm.words import groups, trimmed
from rowferry.operators.sizing import broadcast_if_small
from rowferry.session import scratch_path

#: Ids that a shard holds before it is closed; a longer document makes a longer shard.
SHARD_IDS = 1 << 20
#: A pair is replaced as long as it occurs so often, by a rule that is used at least ``USES`` times at once.
LEAST, USES = 16, 4
END = 0
_MAGIC = b"RPG1"
_SLOT_BITS = 18
_U = np.uint64


class Shard(NamedTuple):
    doc_ids: np.ndarray  # long; absent ids are marked in ``absent``
    absent: np.ndarray
    symbol_at: np.ndarray  # where each document's symbols begin, and the end
    id_at: np.ndarray  # where its ids begin, and the end
    base: int  # the first nonterminal
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray


def compress(ids: np.ndarray, starts: np.ndarray, base: int,
             least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, their starts by document, and the two sides of each rule. No pair spans documents.

    Each round replaces all pairs that occur ``least`` times at once; where they
    overlap the more frequent one goes first and the other one waits for the
    next round. It ends when no pair is left that occurs so often. Counting by
    hash tells first which places are worth sorting, few in all but the first
    rounds.
    """
    seq = ids.astype(np.int64)
    ends = np.zeros(len(seq), bool)  # the last symbol of a document
    full = np.diff(starts) > 0
    ends[starts[1:][full] - 1] = True
    lefts, rights, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while len(seq) > 1:
        key = seq[:-1] << 32 | seq[1:]
        slot = (key.view(np.uint64) * _U(0x9E3779B97F4A7C15) >> _U(64 - _SLOT_BITS)).view(np.int64)
        slot[ends[:-1]] = 1 << _SLOT_BITS
        seen = np.bincount(slot, minlength=(1 << _SLOT_BITS) + 1)
        seen[-1] = 0
        place = np.flatnonzero(seen[slot] >= least)
        name, value = pd.factorize(key[place])
        count = np.bincount(name, minlength=len(value))
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        rank_of = np.full(len(value), -1, np.int64)
        rank_of[often[np.lexsort((value[often], -count[often]))]] = np.arange(len(often))
        rank = rank_of[name]
        place, rank = place[rank >= 0], rank[rank >= 0]
        # Neighbouring places overlap: the lower rank wins, and every other one in a run of the same.
        order = rank * 2 + (place & 1)
        close = place[1:] - place[:-1] == 1
        take = np.ones(len(place), bool)
        take[1:] &= ~close | (order[1:] < order[:-1])
        take[:-1] &= ~close | (order[:-1] < order[1:])
        used = np.bincount(rank[take], minlength=len(often))
        good = used >= USES
        good[0] = True  # the most frequent pair is never in another's way, so each round replaces something
        take &= good[rank]
        at = place[take]
        name = np.cumsum(good) - 1
        seq[at] = base + total + name[rank[take]]
        ends[at] |= ends[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, ends = seq[keep], ends[keep]
        chosen = np.empty(len(often), np.int64)
        chosen[rank_of[often]] = value[often]
        lefts.append(chosen[good] >> 32)
        rights.append(chosen[good] & 0xFFFFFFFF)
        total += int(good.sum())
    inner = np.zeros(len(starts), np.int64)
    inner[1:][full] = np.flatnonzero(ends) + 1
    return seq, np.maximum.accumulate(inner), np.concatenate(lefts), np.concatenate(rights)


def rule_lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule expands to."""
    out = np.zeros(len(left), np.int64)
    done = np.zeros(len(left), bool)
    while not done.all():  # as often as rules are nested
        def size(x):
            inner = np.maximum(x - base, 0)
            return np.where(x < base, 1, out[inner]), (x < base) | done[inner]

        (a, ready), (b, too) = size(left), size(right)
        now = ready & too & ~done
        out[now] = (a + b)[now]
        done |= now
    return out


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, base: int,
           lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids that symbols stand for; ``lengths`` are those of the rules, worked out if not given.

    Lengths tell where both sides of a rule begin, so each symbol is visited once.
    """
    lengths = rule_lengths(left, right, base) if lengths is None else lengths.astype(np.int64)

    def size(x):
        return np.where(x < base, 1, lengths[np.maximum(x - base, 0)]) if len(lengths) else np.ones(len(x), np.int64)

    open_ = symbols.astype(np.int64)
    width = size(open_)
    out = np.empty(int(width.sum()), np.int64)
    at = np.cumsum(width) - width
    while True:
        rule = open_ >= base
        out[at[~rule]] = open_[~rule]
        if not rule.any():
            return out
        rules, at = open_[rule] - base, at[rule]
        first = left[rules]
        open_, at = np.concatenate([first, right[rules]]), np.concatenate([at, at + size(first)])


def dumps(doc_ids: list, ids: list[np.ndarray], base: int, **settings) -> bytes:
    """A shard of documents as bytes."""
    id_at = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int64)
    seq, symbol_at, left, right = compress(np.concatenate(ids) if ids else np.zeros(0, np.int64), id_at, base, **settings)
    width = "<u2" if base + len(left) <= 1 << 16 else "<u4"
    absent = np.array([d is None for d in doc_ids], np.uint8)
    head = struct.pack("<4sIIIQB", _MAGIC, len(doc_ids), base, len(left), len(seq), int(width[-1]))
    out = io.BytesIO()
    out.write(head)
    for part, kind in ((np.array([d or 0 for d in doc_ids], np.int64), "<i8"), (absent, "u1"), (symbol_at, "<i8"),
                       (id_at, "<i8"), (left, "<u4"), (right, "<u4"),
                       (rule_lengths(left, right, base), "<u4"), (seq, width)):
        out.write(np.ascontiguousarray(part.astype(kind)).tobytes())
    return out.getvalue()


def loads(data: bytes) -> Shard:
    magic, docs, base, rules, symbols, width = struct.unpack_from("<4sIIIQB", data)
    if magic != _MAGIC:
        raise ValueError("not a shard of token ids")
    at, parts = struct.calcsize("<4sIIIQB"), []
    for count, kind in ((docs, "<i8"), (docs, "u1"), (docs + 1, "<i8"), (docs + 1, "<i8"), (rules, "<u4"),
                        (rules, "<u4"), (rules, "<u4"), (symbols, f"<u{width}")):
        part = np.frombuffer(data, kind, count, at)
        parts.append(part)
        at += part.nbytes
    return Shard(parts[0], parts[1], parts[2], parts[3], base, parts[4].astype(np.int64), parts[5].astype(np.int64),
                 parts[6], parts[7])


def document(shard: Shard, i: int) -> np.ndarray:
    """The ids of one document, from its own symbols only."""
    return expand(shard.symbols[shard.symbol_at[i]:shard.symbol_at[i + 1]], shard.left, shard.right, shard.base,
                  shard.lengths)


_MANIFEST = "part int, seq int, file string, offset long, length long, first long, n_ids long, n_docs long"


def write_shards(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text",
                 shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode all texts, in ascending order of ids, into shards below ``folder``; returns the manifest.

    Each document's ids are followed by :data:`END`; a null text is empty. Null
    ids come first; rows of one id follow each other in order of a hash of
    their texts. Other columns are not
    read. Every attempt of a task writes a file of its own name, and only files
    of accepted attempts are in the manifest, which is written last.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    # The last key divides rows that are alike in all else.
    order = [F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        encoder, part = encoder_for(tokenizer), TaskContext.get().partitionId()
        base = max(encoder.size, END + 1)
        name = f"{folder}/part-{part:05d}-{uuid.uuid4().hex}.rpg"
        out, offset, seq, done, held, ids, total = None, 0, 0, 0, [], [], 0
        manifest = []

        def shut():
            nonlocal out, offset, seq, done, total
            if out is None:
                out = create(name)
            data = dumps(held, ids, base)
            out.write(data)
            manifest.append((part, seq, name, offset, len(data), done, total, len(held)))
            offset, seq, done, total = offset + len(data), seq + 1, done + total, 0
            held.clear()
            ids.clear()

        for batch in batches:
            for piece in groups(batch, 1):
                encoded = encoder.encode(piece.column(1))
                for doc_id, x in zip(piece.column(0).to_pylist(), encoded, strict=True):
                    held.append(doc_id)
                    ids.append(np.append(x, END))
                    total += len(x) + 1
                    if total >= shard_ids:
                        shut()
        if held:
            shut()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*manifest, strict=True), (
                    pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 5), strict=True)],
                [x.split()[0] for x in _MANIFEST.split(", ")])

    rows.mapInArrow(trimmed(run), _MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of every document, decoded from the shards.

    ``start`` counts the ids of all documents before. Shards know their place
    in their file; only one sum per file is taken over all of them.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    placed = manifest.join(broadcast_if_small(parts), "part").select(
        "file", "offset", "length", (F.col("part_start") + F.col("first")).alias("start"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open_input(row["file"]) as f:
                    shard = loads(f.read_at(row["length"], row["offset"]))
                flat = expand(shard.symbols, shard.left, shard.right, shard.base, shard.lengths).astype("<u4")
                sizes = np.diff(shard.id_at)
                each = [flat[a:a + n] for a, n in zip(shard.id_at[:-1], sizes, strict=True)]
                columns = [pa.array(shard.doc_ids, mask=shard.absent.astype(bool)),
                           pa.array(shard.id_at[:-1] + row["start"]), pa.array(sizes),
                           pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    slots = manifest.sparkSession.sparkContext.defaultParallelism * 4
    return placed.repartition(max(1, slots)).mapInArrow(trimmed(run), schema)


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, **columns) -> DataFrame:
    """Write the shards, by default in the session's shared folder, and read them back."""
    folder = folder or scratch_path(docs.sparkSession, "token-ids")
    return read_shards(write_shards(docs, tokenizer, folder, **columns))
