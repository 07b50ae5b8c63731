"""Exact Jaccard join of word shingles by token-combination prefixes.

1. Equal shingle sets are one node from here on.
2. A set in a link has few tokens of its own, also among those with the
   smallest hashes. Sets with too few shared tokens there drop out; for that,
   chunks of documents exchange packed tokens, each token once per chunk.
3. The tokens of the remaining sets are ordered from rare to frequent. Two
   linked sets share a token in a prefix of each, and two tokens in prefixes
   one longer. Rare tokens are indexed alone, frequent ones in pairs, for each
   class of sizes that a partner can have.
4. In a list of the index, all sets are compared with the one that has most in
   common with others; what that links is one component. Then only pairs of
   different components remain to be compared. No link between components is
   lost and groups of copies never become pairs of all with all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowferry.llm.components import components
from rowferry.llm.words import buffers, groups, hashes, mix, shingles, spans, trim, trimmed
from rowferry.operators.sizing import broadcast_if_small
from rowferry.session import stage

WORDS = 5
#: Sets link from a Jaccard similarity of NUM / DEN.
NUM, DEN = 4, 5
#: Tokens of a chunk that are exchanged together, and bytes of text for one range of tokens.
CHUNK_TOKENS, RANGE_BYTES = 1 << 20, 24 << 20
#: Tokens in more sets than this are frequent and indexed in pairs, for partners of up to PAIR_SIZE tokens.
FREQUENT, PAIR_SIZE = 4096, 400
#: Pairs with the same first set that one task compares.
PAIRS_TOGETHER = 256

_U = np.uint64


def _classes() -> np.ndarray:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, edges[-1] * 28 // 25))
    return np.array(edges)


#: Lower ends of the classes of set sizes.
CLASSES = _classes()


def _overlap(a, b):
    """Tokens that sets of ``a`` and ``b`` tokens share at least if they link."""
    return -(-NUM * (a + b) // (NUM + DEN))


def token_sets(batch: pa.RecordBatch, column: int, size: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (63 bits) of every text of a batch."""
    data, offsets = buffers(batch.column(column))
    starts, ends, at = spans(data, offsets)
    words = hashes(data, starts, ends)
    return [np.unique(shingles(words[at[i]:at[i + 1]], size) >> _U(1)).astype(np.int64)
            for i in range(batch.num_rows)]


def _print(tokens: np.ndarray) -> tuple[int, int]:
    t = tokens.astype(np.uint64)
    a, b = mix(t).sum(dtype=np.uint64), mix(t ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _low(n: int) -> int:
    """How many of the smallest hashes of a set are looked at for shared tokens."""
    return min(n, -(-n // 4) + 1)


_CHUNKS = ("chunk long, idx int, doc_id long, n long, f1 long, f2 long, shared int, "
           "range long, tokens binary, owners binary")
_CHUNK_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(),
                pa.binary(), pa.binary()]


def _chunk_rows(chunk: int, docs: list, bits: int, size: int):
    """Rows of one chunk: its documents, and its tokens by range with the index of the one set they are in."""
    seen, mine, owner = set(), [], []
    shared = np.zeros(len(docs), np.int32)
    for i, (doc_id, n, f1, f2, low) in enumerate(docs):
        if n and doc_id is not None and (f1, f2) not in seen:
            seen.add((f1, f2))
            mine.append(low)
            owner.append(np.full(len(low), i, np.int32))
    names = [x.split()[0] for x in _CHUNKS.split(", ")]
    blank = [None] * len(docs)

    def rows(columns):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, _CHUNK_TYPES, strict=True)], names)

    blobs = []
    if mine:
        key, owner = mix(np.concatenate(mine).astype(np.uint64)), np.concatenate(owner)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[first, len(key)])
        np.add.at(shared, owner[np.repeat(count > 1, count)], 1)
        key, owner = key[first], np.where(count > 1, np.int32(-1), owner[first])
        part = (key >> _U(64 - bits)).astype(np.int64)
        short = (key >> _U(32 - bits)).astype(np.uint32)
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        blobs = [(int(part[a]), short[a:b].tobytes(), owner[a:b].tobytes())
                 for a, b in zip(cut, np.r_[cut[1:], len(key)], strict=True)]
    yield rows([[chunk] * len(docs), range(len(docs)), *([d[k] for d in docs] for k in range(4)),
                shared, blank, blank, blank])
    for at in range(0, len(blobs), 64):
        some = blobs[at:at + 64]
        blank = [None] * len(some)
        yield rows([[chunk] * len(some), *[blank] * 6, *zip(*some, strict=True)])


def _chunked(docs: DataFrame, bits: int, size: int) -> DataFrame:
    def run(batches):
        part, seq, held, tokens = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for piece in groups(batch, 1):
                for doc_id, t in zip(piece.column(0).to_pylist(), token_sets(piece, 1, size), strict=True):
                    low = t[:_low(len(t))].copy()
                    held.append((doc_id, len(t), *_print(t), low))
                    tokens += len(low) + 1
                    if tokens >= CHUNK_TOKENS:
                        yield from _chunk_rows(part << 20 | seq, held, bits, size)
                        seq, held, tokens = seq + 1, [], 0
        if held:
            yield from _chunk_rows(part << 20 | seq, held, bits, size)

    return docs.mapInArrow(trimmed(run), _CHUNKS)


def _shared_elsewhere(group: pa.Table) -> pa.Table:
    """How many tokens of each set are in another chunk too, for one range of tokens."""
    tokens = [np.frombuffer(x, np.uint32) for x in group.column("tokens").to_pylist()]
    owners = np.concatenate([np.frombuffer(x, np.int32) for x in group.column("owners").to_pylist()])
    chunks = np.repeat(group.column("chunk").to_numpy(), [len(t) for t in tokens])
    tokens = np.concatenate(tokens)
    order = np.argsort(tokens, kind="stable")
    tokens, owners, chunks = tokens[order], owners[order], chunks[order]
    same = np.zeros(len(tokens), bool)
    equal = tokens[1:] == tokens[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    same &= owners >= 0
    # Chunks have 43 bits and places in them 20.
    both, count = np.unique(chunks[same] << 20 | owners[same], return_counts=True)
    trim()
    return pa.table({"chunk": both >> 20, "idx": (both & (1 << 20) - 1).astype(np.int32), "more": count.astype(np.int64)})


_POSTINGS = "key long, class int, node long, n long, own long, spare long, centre long, early array<long>"
#: First keys of a set in a class that are kept beside each of its entries.
EARLY = 8


def _postings(batches):
    """Index entries of each set: tokens of its prefixes for every class of partner sizes.

    ``spare`` is how many of its tokens are in other sets too, ``centre`` its
    rank as the set that others are compared with first, ``early`` the first of
    its keys in the class.
    """
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        early: list[list] = []
        lists = batch.column(2)
        each = lists.flatten()
        dfs, tokens = each.field(0).to_numpy(), each.field(1).to_numpy()
        ends = np.cumsum(lists.value_lengths().to_numpy())
        for node, n, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.r_[0, ends[:-1]], ends,
                                 strict=True):
            token, at = np.unique(tokens[a:b], return_index=True)
            df = dfs[a:b][at]
            order = np.argsort(df, kind="stable")
            df, token = df[order], token[order]
            alone = n - len(token)
            centre = len(token) * 1_000_000 // n
            low, own = -(-NUM * n // DEN), int(np.searchsorted(CLASSES, n, "right")) - 1
            for c in range(int(np.searchsorted(CLASSES, low, "right")) - 1, own + 1):
                prefix = n - _overlap(max(int(CLASSES[c]), low), n) + 1
                k = prefix - alone
                if k <= 0:
                    continue
                keys = token[:k]
                if CLASSES[c] <= PAIR_SIZE:
                    often = token[:k + 1][df[:k + 1] > FREQUENT].astype(np.uint64)
                    i, j = np.triu_indices(len(often), 1)
                    keys = np.concatenate([keys[df[:k] <= FREQUENT],
                                           mix(often[i] * _U(3) + mix(often[j])).astype(np.int64)])
                for column, value in zip(out, (keys, c, node, n, int(c == own), len(token), centre), strict=True):
                    column.append(value if column is out[0] else np.full(len(keys), value))
                early += [keys[:EARLY].tolist()] * len(keys)
        if out[0]:
            columns = [np.concatenate(c) for c in out]
            columns[1] = columns[1].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(early, pa.list_(pa.int64()))],
                                             [x.split()[0] for x in _POSTINGS.split(", ")])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, both, link`` of pairs ``a, b`` of nodes: how many tokens both sets have, and whether they link."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_TOGETHER).cast("int").alias("lots"))
    many = stage(many, "pair-counts")
    lot = F.pmod(F.xxhash64("b"), F.col("lots")).cast("int")
    heads = many.select("a", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot")).join(
        sets.select(F.col("node").alias("a"), "tokens"), "a").select(
        "a", "lot", F.lit(None).cast("long").alias("b"), "tokens")
    members = pairs.join(many, "a").select("a", lot.alias("lot"), "b").join(
        sets.select(F.col("node").alias("b"), "tokens"), "b").select("a", "lot", "b", "tokens")

    def run(batches):
        now, heads = None, []
        for batch in batches:
            a, lots, b, tokens = (batch.column(i) for i in range(4))
            links = []
            for i in range(batch.num_rows):
                key = (a[i].as_py(), lots[i].as_py())
                if key != now:
                    now, heads = key, []
                mine = np.frombuffer(tokens[i].as_buffer(), np.int64)
                if not b[i].is_valid:
                    heads.append(mine.copy())
                    continue
                for head in heads:
                    both = len(np.intersect1d(head, mine, assume_unique=True))
                    links.append((key[0], b[i].as_py(), both, int(both >= _overlap(len(head), len(mine)))))
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b", "both", "link"])

    dealt = heads.union(members).repartition("a", "lot").sortWithinPartitions("a", "lot", F.col("b").asc_nulls_first())
    return stage(dealt.mapInArrow(trimmed(run), "a long, b long, both long, link long").groupBy("a", "b").agg(
        F.max("both").alias("both"), F.max("link").alias("link")), "compared")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Components are those of the links between documents whose shingle sets have
    a Jaccard similarity of at least 0.8; ``component_id`` is the smallest id.
    Texts without words, null ones included, have no shingles and link with
    nothing. Rows that repeat an id are one document; a row without an id links
    with nothing and has no component. Other columns are not read.
    """
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    total = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, min(31, int(total // RANGE_BYTES).bit_length()))
    chunks = stage(_chunked(picked, bits, size), "chunks")
    rows = chunks.where("idx is not null").select(
        "chunk", "idx", "doc_id", "n", "f1", "f2", "shared", (F.col("chunk") * (1 << 20) + F.col("idx")).alias("row"))
    more = chunks.where("range is not null").select("range", "chunk", "tokens", "owners").groupBy(
        "range").applyInArrow(_shared_elsewhere, "chunk long, idx int, more long").groupBy("chunk", "idx").agg(
        F.sum("more").alias("more"))
    held = rows.where("n > 0 and doc_id is not null")
    nodes = held.groupBy("f1", "f2", "n").agg(
        F.min(F.struct("doc_id", "row")).alias("head"), F.count(F.lit(1)).alias("docs"))
    # Of the two smallest-hash samples of linked sets, one ends first; what it holds and the other set has too is in
    # both. That leaves at least 5 % of the tokens of either set, and one more.
    counted = held.join(more, ["chunk", "idx"], "left").where(
        F.col("shared") + F.coalesce("more", F.lit(0)) > F.floor(F.col("n") / 20))
    keys = stage(counted.select("f1", "f2", "n").distinct(), "alive-keys")
    alive = stage(nodes.join(broadcast_if_small(keys), ["f1", "f2", "n"], "left_semi").select(
        "f1", "f2", "n", F.col("head.row").alias("node"), F.col("head.doc_id").alias("doc_id")), "alive")

    def full(batch: pa.RecordBatch):
        sets = token_sets(batch, 1, size)
        both = [_print(t) for t in sets]
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in both], pa.int64()), pa.array([p[1] for p in both], pa.int64()),
             pa.array([t.tobytes() for t in sets], pa.binary()),
             pa.array([t.tolist() for t in sets], pa.list_(pa.int64()))], ["f1", "f2", "tokens", "each"])

    def run(batches):
        for batch in batches:
            for piece in groups(batch, 1):
                yield full(piece)

    wanted = picked.join(broadcast_if_small(alive.select("doc_id").distinct()), "doc_id", "left_semi")
    sets = wanted.mapInArrow(trimmed(run), "f1 long, f2 long, tokens binary, each array<long>").join(
        broadcast_if_small(alive.select("f1", "f2", "node", "n")), ["f1", "f2"])
    sets = stage(sets.select("node", "n", "tokens", "each"), "sets")

    # Rare to frequent: exact counts, but that of a hot token comes from counts taken before its rows are dealt out.
    def often(batches):
        for batch in batches:
            token, count = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token[count > 3]), pa.array(count[count > 3])],
                                             ["token", "many"])

    hot = stage(sets.select("each").mapInArrow(trimmed(often), "token long, many long").groupBy("token").agg(
        F.sum("many").alias("many")).where(F.col("many") > 1000), "hot-tokens")
    tokens = sets.select("node", "n", F.explode("each").alias("token"))
    tokens = tokens.join(broadcast_if_small(hot), "token", "left").withColumn(
        "salt", F.when(F.col("many").isNotNull(), F.pmod("node", F.ceil(F.col("many") / 500))).otherwise(0))
    df = F.count(F.lit(1)).over(Window.partitionBy("token", "salt"))
    common = tokens.select("node", "n", "token", F.coalesce(F.col("many"), df).alias("df")).where("df > 1")
    postings = stage(common.groupBy("node", "n").agg(F.collect_list(F.struct("df", "token")).alias("shared"))
                     .mapInArrow(trimmed(_postings), _POSTINGS), "postings")

    lists = postings.groupBy("key", "class").agg(
        F.max_by("node", F.struct("centre", -F.col("node"))).alias("a"), F.count(F.lit(1)).alias("entries")).where(
        "entries > 1").drop("entries")
    first = stage(postings.join(lists, ["key", "class"]).where("a <> node").select(
        "a", F.col("node").alias("b")).distinct(), "pairs")
    compared = _compared(first, sets)
    links = compared.where("link = 1").select("a", "b")

    found = components(links)
    marked = postings.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("centre")
    open_lists = marked.groupBy("key", "class").agg(
        F.min("root").alias("x"), F.max("root").alias("y"), F.max("own").alias("owned")).where(
        "x <> y and owned = 1").select("key", "class")
    # What a set has in common with the one that its list was compared with bounds what two sets can have in common.
    shared = compared.select("a", F.col("b").alias("node"), "both")
    left = marked.join(open_lists.join(lists, ["key", "class"]), ["key", "class"]).join(
        shared, ["a", "node"], "left").withColumn("both", F.coalesce("both", "n")).withColumn(
        "beside", F.greatest(F.col("spare") - F.col("both"), F.lit(0)))
    left = stage(left, "open")
    x, y = left.alias("x"), left.alias("y")
    need = F.ceil((F.col("x.n") + F.col("y.n")) * NUM / (NUM + DEN))
    soon = F.array_intersect("x.early", "y.early")
    rest = x.join(y, [F.col("x.key") == F.col("y.key"), F.col("x.class") == F.col("y.class"),
                      F.col("x.node") < F.col("y.node"), F.col("x.root") != F.col("y.root"),
                      F.col("x.own") + F.col("y.own") > 0,
                      F.least("x.n", "y.n") * DEN >= F.greatest("x.n", "y.n") * NUM,
                      F.least("x.spare", "y.spare") >= need,
                      F.least("x.both", "y.both") + F.least("x.beside", "y.beside") >= need,
                      # Of the lists in which two sets meet, the first of their early ones is enough.
                      (F.size(soon) == 0) | (F.get(soon, F.lit(0)) == F.col("x.key"))]).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stage(rest.join(done, ["a", "b"], "left_anti"), "pairs")
    links = links.union(_compared(rest, sets).where("link = 1").select("a", "b"))

    # Copies share a node; rows of one id are one document.
    copies = nodes.where("docs > 1").select(
        "f1", "f2", "n", F.col("head.row").alias("node"))
    rows = held.join(broadcast_if_small(stage(copies, "copies")), ["f1", "f2", "n"], "left").select(
        "row", "doc_id", F.coalesce("node", "row").alias("node"))
    rows = stage(rows, "rows")
    again = rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    twice = rows.join(broadcast_if_small(stage(again, "again")), "doc_id").select("a", F.col("node").alias("b"))
    roots = components(links.union(twice))
    placed = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("k")).where("k > 1")
    placed = placed.join(broadcast_if_small(stage(least.drop("k"), "components")), "root", "left").select(
        "row", F.coalesce("component_id", "doc_id").alias("component_id"))
    every = chunks.where("idx is not null").select(
        "doc_id", F.col("n").alias("n_shingles"), (F.col("chunk") * (1 << 20) + F.col("idx")).alias("row"))
    return every.join(placed, "row", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one document of each component is kept.

    The document with the smallest id stays; of rows that repeat an id one
    stays, that with the smallest text, of those alike in that one with the
    smallest hash of all its columns. Rows without an id all stay, as do texts
    without words. Names of columns may hold dots.
    """
    found = stage(classes(docs, id_col, text_col, size).where("doc_id is not null"), "classes")
    key = docs[f"`{id_col}`"].cast("long")
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(broadcast_if_small(gone), key == gone["doc_id"], "left_anti")
    again = stage(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again_")), "again")
    if again.limit(1).count() == 0:
        return kept
    some = broadcast_if_small(again)
    every = [F.col(f"`{c}`") for c in docs.columns]
    text = F.col(f"`{text_col}`").cast("string")
    least = F.min_by(F.struct(*every), F.struct(text.isNull(), text, F.xxhash64(*every)))
    one = kept.join(some, kept[f"`{id_col}`"].cast("long") == F.col("again_"), "left_semi").groupBy(
        F.col(f"`{id_col}`").cast("long").alias("of_")).agg(least.alias("one"))
    return kept.join(some, kept[f"`{id_col}`"].cast("long") == F.col("again_"), "left_anti").union(
        one.select(*[F.col(f"one.`{c}`").alias(c) for c in docs.columns]))
