"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node. The graph starts from leaves of random directions;
then neighbours of a node are compared with each other (each is a neighbour of
a neighbour of the others) and improve each other's lists, in iterations of
joins and shuffles. A query walks the graph: the best nodes not yet expanded
are, their neighbours are scored where their vectors lie, and the best are
kept. What is found is scored again in double precision on the vectors as given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowferry.llm.words import mix
from rowferry.operators.sizing import broadcast_if_small
from rowferry.session import stage

#: Neighbours kept of each node, and of those that have it as theirs.
NEIGHBOURS, BACKWARD = 24, 48
#: Passes over random leaves, leaves of each node in one, nodes of a leaf at most, neighbours taken from it.
LEAVES, PROBES, LEAF, FROM_LEAF = 4, 2, 512, 16
#: A leaf that is too large is split by at most this many directions at once.
SPLIT = 64
#: NN-descent: share of changed list entries at which it ends, list entries that take part forward, and backward in one comparison, and improvements sent.
CHANGED, FORWARD, TOGETHER, IMPROVE = 0.002, 16, 32, 4
#: Search: nodes expanded in a step, at most, and all expanded at the end; nodes kept; scored again at the end.
EXPAND, POOL, FINAL = 256, 512, 24
#: Vectors that lie together when queries are scored against them.
TOGETHER_VECTORS = 16_384
SEED = 5


class Graph(NamedTuple):
    rows: DataFrame  # vec_id, node: every vector that takes part and the node it is equal to
    nodes: DataFrame  # node, vec: normalised, float32
    given: DataFrame  # node, original: as given
    links: DataFrame  # node, ids, sims: neighbours in both directions
    size: int


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows that agree in their first ``keys`` columns."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        change = np.zeros(batch.num_rows - 1, bool)
        for k in range(keys):
            column = batch.column(k).to_numpy(zero_copy_only=False)
            change |= column[1:] != column[:-1]
        cuts = np.r_[0, np.flatnonzero(change) + 1]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)
        rest = batch.slice(cuts[-1])
    if rest is not None:
        yield rest


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    """Binary values of equal length as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _row(node: int, ids: np.ndarray, sims: np.ndarray) -> tuple:
    return node, ids.astype(np.int64).tobytes(), sims.astype(np.float32).tobytes()


def _lists(rows: list[tuple]) -> pa.RecordBatch:
    nodes, ids, sims = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array(ids, pa.binary()), pa.array(sims, pa.binary())], ["node", "ids", "sims"])


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1]) * 2
        if size > 4 << 20:
            yield _lists(held)
            held, size = [], 0
    if held:
        yield _lists(held)


_LISTS = "node long, ids binary, sims binary"


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of a list with repeats, best first, ties to the smaller id."""
    ids, at = np.unique(ids, return_index=True)
    sims = sims[at]
    order = np.lexsort((ids, -sims))[:k]
    return ids[order], sims[order]


def _merged(lists: DataFrame, k: int, spread: bool = False) -> DataFrame:
    """One list of each node, of the best ``k`` of all its lists. ``spread``: a node may have very many lists."""
    def run(batches):
        def rows():
            for g in _groups(batches, 1):
                ids = np.frombuffer(b"".join(g.column("ids").to_pylist()), np.int64)
                sims = np.frombuffer(b"".join(g.column("sims").to_pylist()), np.float32)
                yield _row(g.column(0)[0].as_py(), *_best(ids, sims, k))

        yield from _batched(rows())

    if spread:
        salted = lists.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(64)))
        lists = salted.repartition("node", "salt").sortWithinPartitions("node").drop("salt").mapInArrow(run, _LISTS)
    return lists.repartition("node").sortWithinPartitions("node").mapInArrow(run, _LISTS)


def _split(placed: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """``leaf, lot, node`` of leaves with at most ``LEAF`` nodes.

    A larger leaf is split by random directions from its middle, where vectors
    that are alike differ, again and again. Only what directions cannot part
    any more, equal vectors in float32, is cut by hash.
    """
    done, last, turn = [], None, 0
    while True:
        sizes = stage(placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "leaf-sizes")
        hot = stage(sizes.where(F.col("n") > LEAF), "hot-leaves")
        total = hot.agg(F.count(F.lit(1)), F.sum("n")).first()
        done.append(placed.join(broadcast_if_small(hot.select("leaf")), "leaf", "left_anti").select(
            "leaf", F.lit(0).cast("long").alias("lot"), "node"))
        if not total[0]:
            break
        inside = placed.join(broadcast_if_small(hot), "leaf").join(vectors, "node").select("leaf", "n", "node", "vec")
        if last == tuple(total):  # nothing was parted
            done.append(inside.select("leaf", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / LEAF)).alias("lot"), "node"))
            break
        last, turn = tuple(total), turn + 1

        def sums(batches):
            held = {}
            for batch in batches:
                leaf, x = batch.column(0).to_numpy(), _matrix(batch.column(3), np.float32, width)
                ids, at = np.unique(leaf, return_inverse=True)
                part = np.zeros((len(ids), width))
                np.add.at(part, at, x)
                for i, p in zip(ids.tolist(), part, strict=True):
                    held[i] = held[i] + p if i in held else p
                if len(held) > 4096:
                    yield from out(held)
                    held = {}
            yield from out(held)

        def out(held):
            if held:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(held), pa.int64()), pa.array([p.tobytes() for p in held.values()], pa.binary())],
                    ["leaf", "total"])

        def added(batches):
            for g in _groups(batches, 1):
                yield from out({g.column(0)[0].as_py(): _matrix(g.column(1), np.float64, width).sum(0)})

        kind = "leaf long, total binary"
        inside = stage(inside, "inside")
        middles = stage(inside.mapInArrow(sums, kind).repartition("leaf").sortWithinPartitions("leaf").mapInArrow(
            added, kind), "middles")

        def part(batches, turn=turn):
            ways = np.random.default_rng(SEED + turn).normal(size=(width, SPLIT))
            for batch in batches:
                n = batch.column(1).to_numpy()
                x = _matrix(batch.column(3), np.float32, width) - _matrix(batch.column(4), np.float64, width) / n[:, None]
                s = x @ ways
                s[np.arange(SPLIT) >= np.minimum(SPLIT, np.maximum(2, -(-2 * n // LEAF)))[:, None]] = -np.inf
                # A new name of the leaf, from its own and the direction.
                name = mix(batch.column(0).to_numpy().astype(np.uint64) * np.uint64(SPLIT) + np.argmax(s, 1).astype(
                    np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name), batch.column(2)], ["leaf", "node"])

        placed = stage(inside.join(broadcast_if_small(middles), "leaf").select("leaf", "n", "node", "vec", "total").mapInArrow(
            part, "leaf long, node long"), "leaves")
    whole = done[0]
    for d in done[1:]:
        whole = whole.union(d)
    return whole


def _leaves(nodes: DataFrame, size: int, width: int) -> DataFrame:
    """``node, ids, sims`` from exact comparison within leaves of nodes nearest to the same random directions."""
    wanted = max(1, 2 * PROBES * size // LEAF)
    levels = 1 if wanted <= 2048 else 2
    directions = max(1, math.ceil(wanted ** (1 / levels)))

    def assign(batches):
        rng = np.random.default_rng(SEED)
        ways = [[rng.normal(size=(width, directions)).astype(np.float32) for _ in range(levels)] for _ in range(LEAVES)]
        for batch in batches:
            x = _matrix(batch.column(1), np.float32, width)
            node = batch.column(0).to_numpy()
            for r in range(LEAVES):
                near = np.argsort(-(x @ ways[r][0]), 1)[:, :PROBES].astype(np.int64)
                for w in ways[r][1:]:
                    near = near * directions + np.argmax(x @ w, 1)[:, None]
                for p in range(near.shape[1]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(near[:, p] * LEAVES + r), pa.array(node)], ["leaf", "node"])

    placed = stage(nodes.select("node", "vec").mapInArrow(assign, "leaf long, node long"), "leaves")
    placed = _split(placed, nodes.select("node", "vec"), width)

    def run(batches):
        def rows():
            for g in _groups(batches, 2):
                n = g.num_rows
                if n < 2:
                    continue
                node, x = g.column(2).to_numpy(), _matrix(g.column(3), np.float16, width).astype(np.float32)
                s = x @ x.T
                np.fill_diagonal(s, -9)
                k = min(FROM_LEAF, n - 1)
                near = np.argpartition(-s, k - 1, 1)[:, :k]
                for i in range(n):
                    yield _row(int(node[i]), node[near[i]], s[i, near[i]])

        yield from _batched(rows())

    short = nodes.select("node", "vec16")
    return placed.join(short, "node").select("leaf", "lot", "node", "vec16").repartition("leaf", "lot") \
        .sortWithinPartitions("leaf", "lot", "node").mapInArrow(run, _LISTS)


def _each(lists: DataFrame, first: int | None = None) -> DataFrame:
    """``node, other, sim`` of the (``first``) entries of each list."""
    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(x, np.int64)[:first] for x in batch.column(1).to_pylist()]
            sims = [np.frombuffer(x, np.float32)[:first] for x in batch.column(2).to_pylist()]
            count = [len(x) for x in ids]
            if sum(count):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch.column(0).to_numpy(), count)), pa.array(np.concatenate(ids)),
                     pa.array(np.concatenate(sims))], ["node", "other", "sim"])

    return lists.mapInArrow(run, "node long, other long, sim float")


def _changed(old: DataFrame, new: DataFrame) -> float:
    """Share of the entries of new lists that the old ones don't have."""
    def run(batches):
        for batch in batches:
            fresh, count = 0, 0
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = np.frombuffer(b, np.int64)
                fresh += len(np.setdiff1d(b, np.frombuffer(a or b"", np.int64)))
                count += len(b)
            yield pa.RecordBatch.from_arrays([pa.array([fresh]), pa.array([count])], ["fresh", "count"])

    both = old.select("node", F.col("ids").alias("was")).join(new.select("node", "ids"), "node", "right")
    row = both.select("was", "ids").mapInArrow(run, "fresh long, count long").agg(F.sum("fresh"), F.sum("count")).first()
    return (row[0] or 0) / (row[1] or 1)


def _improvements(graph: DataFrame, nodes: DataFrame, width: int, turn: int = 0) -> DataFrame:
    """Lists of better neighbours from comparing the neighbours of each node with each other."""
    def weakest(batches):
        for batch in batches:
            sims = [np.frombuffer(x, np.float32) for x in batch.column(2).to_pylist()]
            low = [float(s[-1]) if len(s) >= NEIGHBOURS else -2.0 for s in sims]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, pa.float32())], ["node", "low"])

    low = graph.mapInArrow(weakest, "node long, low float")
    members = nodes.select("node", "vec16").join(low, "node", "left").select(
        F.col("node").alias("member"), "vec16", F.coalesce("low", F.lit(-2.0).cast("float")).alias("low"))
    near = stage(_each(graph, FORWARD).select("node", "other"), "near")
    lots = stage(near.groupBy(F.col("other").alias("node")).agg(
        F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("lots")).where("lots > 1"), "hubs")
    hubs = broadcast_if_small(lots)
    # A node with many backward neighbours meets them in several lots, with its forward ones in each.
    forward = near.union(near.select("node", F.col("node").alias("other")).distinct()).join(hubs, "node", "left").select(
        "node", F.explode(F.sequence(F.lit(0), F.coalesce("lots", F.lit(1)) - 1)).alias("lot"),
        F.col("other").alias("member"))
    backward = near.select(F.col("other").alias("node"), F.col("node").alias("member")).join(hubs, "node", "left").select(
        "node", F.pmod(F.xxhash64("member", F.lit(turn)), F.coalesce("lots", F.lit(1))).cast("int").alias("lot"), "member")

    def run(batches):
        def rows():
            for g in _groups(batches, 2):
                member, first = np.unique(g.column(2).to_numpy(), return_index=True)
                n = len(member)
                if n < 2:
                    continue
                x = _matrix(g.column(3), np.float16, width)[first].astype(np.float32)
                s = x @ x.T
                np.fill_diagonal(s, -9)
                better = np.where(s > g.column(4).to_numpy()[first][:, None], s, -9)
                k = min(IMPROVE, n - 1)
                top = np.argpartition(-better, k - 1, 1)[:, :k]
                for i in range(n):
                    these = top[i][better[i, top[i]] > -5]
                    if len(these):
                        yield _row(int(member[i]), member[these], s[i, these])

        yield from _batched(rows())

    return forward.union(backward).join(members, "member").select("node", "lot", "member", "vec16", "low").repartition(
        "node", "lot").sortWithinPartitions("node", "lot").mapInArrow(run, _LISTS)


def build(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", iterations: int | None = None) -> Graph:
    """The neighbour graph of all vectors of a table.

    Rows whose id or vector is null, whose vector is empty, zero or holds a null or non-finite
    component take no part; neither do those of another length than most.
    Equal vectors are one node, named by their smallest id. NN-descent goes on
    until few entries change, or for so many ``iterations``.
    """
    given = table.select(table[id_col].cast("long").alias("vec_id"), table[vector_col].cast("array<double>").alias("v"))
    sound = given.where("vec_id is not null and v is not null").where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).where(
        F.exists("v", lambda x: x != 0))
    common = sound.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = common["w"] if common else 1
    sound = stage(sound.where(F.size("v") == width), "vectors")
    classes = sound.groupBy("v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n"))

    def normal(batches):
        for batch in batches:
            x = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)
            x = x / np.abs(x).max(1)[:, None]
            x = (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()),
                 pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary()), batch.column(1), batch.column(2)],
                ["node", "vec", "vec16", "v", "n"])

    nodes = stage(classes.select("node", "v", "n").mapInArrow(
        normal, "node long, vec binary, vec16 binary, v array<double>, n long"), "nodes")
    size = nodes.count()
    twice = nodes.where("n > 1").select("v", "node")
    rows = sound.join(twice, "v", "left").select("vec_id", F.coalesce("node", "vec_id").alias("node"))
    graph = stage(_merged(_leaves(nodes, size, width), NEIGHBOURS), "graph")
    turn = 0
    while iterations is None or turn < iterations:
        old, turn = graph, turn + 1
        graph = stage(_merged(old.union(_improvements(old, nodes, width, turn)), NEIGHBOURS), "graph")
        if iterations is None and _changed(old, graph) <= CHANGED:
            break

    def turned(batches):
        for batch in batches:
            yield _lists([_row(o, np.array([n]), np.array([s])) for n, o, s in zip(
                *(c.to_pylist() for c in batch.columns), strict=True)])

    back = _merged(_each(graph).mapInArrow(turned, _LISTS), BACKWARD, spread=True)
    links = stage(_merged(graph.union(back), NEIGHBOURS + BACKWARD), "links")
    return Graph(stage(rows, "rows"), nodes.select("node", "vec"), nodes.select("node", F.col("v").alias("original")),
                 links, size)


_STATE = "query long, kind int, vec binary, ids binary, sims binary, done binary, seen binary"


def _walk(graph: Graph, state: DataFrame) -> DataFrame:
    """One step of all queries: ``state`` has for each the nodes kept, which are expanded, and all nodes seen."""
    names = [x.split()[0] for x in _STATE.split(", ")]

    def frontier(batches):
        for batch in batches:
            queries, nodes = [], []
            for q, ids, done in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(5).to_pylist(),
                                    strict=True):
                ids, done = np.frombuffer(ids, np.int64), np.frombuffer(done, bool)
                some = ids[:EXPAND][~done[:EXPAND]]
                queries.append(np.full(len(some), q))
                nodes.append(some)
            if queries:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(queries)), pa.array(np.concatenate(nodes))], ["query", "node"])

    empty = F.lit(None).cast("binary")
    reached = state.mapInArrow(frontier, "query long, node long").join(graph.links.select("node", "ids"), "node").select(
        "query", F.lit(1).alias("kind"), empty.alias("vec"), "ids", empty.alias("sims"), empty.alias("done"),
        empty.alias("seen"))
    parts = max(8, graph.size // TOGETHER_VECTORS)

    def requests(batches):
        out = [[], [], [], []]
        for g in _groups(batches, 1):
            lists = g.column(3).to_pylist()
            seen = np.frombuffer(g.column(6)[0].as_py(), np.int64)
            if g.num_rows == 1:
                continue
            new = np.setdiff1d(np.unique(np.frombuffer(b"".join(lists[1:]), np.int64)), seen, assume_unique=True)
            part = (mix(new.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            for p in np.unique(part):
                for column, value in zip(out, (int(p), g.column(0)[0].as_py(), g.column(2)[0].as_py(),
                                               new[part == p].tobytes()), strict=True):
                    column.append(value)
            if len(out[0]) > 2000:
                yield asked(out)
                out = [[], [], [], []]
        if out[0]:
            yield asked(out)

    def asked(out):
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                                           pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())],
                                          ["part", "query", "vec", "ids"])

    def lying(batches):
        for batch in batches:
            part = (mix(batch.column(0).to_numpy().astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.nulls(batch.num_rows, pa.int64()), batch.column(1),
                 pa.array([int(x).to_bytes(8, "little", signed=True) for x in batch.column(0).to_pylist()], pa.binary())],
                ["part", "query", "vec", "ids"])

    kind = "part long, query long, vec binary, ids binary"
    wanted = state.union(reached).repartition("query").sortWithinPartitions("query", "kind").mapInArrow(requests, kind)
    both = graph.nodes.mapInArrow(lying, kind).union(wanted).repartition("part").sortWithinPartitions(
        "part", F.col("query").asc_nulls_first())

    def scored(batches):
        now, held, ids, vectors = None, [], None, None

        def settle():
            nonlocal ids, vectors
            ids = np.frombuffer(b"".join(i for i, _ in held), np.int64)
            order = np.argsort(ids)
            ids = ids[order]
            width = len(held[0][1]) // 4
            vectors = np.frombuffer(b"".join(v for _, v in held), np.float32).reshape(-1, width)[order]

        for batch in batches:
            out = []
            for part, query, vec, asked_ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    now, held, ids = part, [], None
                if query is None:
                    held.append((asked_ids, vec))
                    continue
                if ids is None:
                    settle()
                want = np.frombuffer(asked_ids, np.int64)
                sims = vectors[np.searchsorted(ids, want)] @ np.frombuffer(vec, np.float32)
                out.append((query, 1, None, asked_ids, sims.tobytes(), None, None))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _STATE_TYPES, strict=True)], names)

    def merged(batches):
        for g in _groups(batches, 1):
            q, vec = g.column(0)[0].as_py(), g.column(2)[0].as_py()
            ids, sims, seen = (np.frombuffer(g.column(c)[0].as_py(), t) for c, t in ((3, np.int64), (4, np.float32),
                                                                                    (6, np.int64)))
            done = np.frombuffer(g.column(5)[0].as_py(), bool).copy()
            done[:EXPAND] = True
            finished = ids[done]
            new = np.frombuffer(b"".join(g.column(3).to_pylist()[1:]), np.int64)
            new_sims = np.frombuffer(b"".join(g.column(4).to_pylist()[1:]), np.float32)
            pool, pool_sims = _best(np.r_[ids, new], np.r_[sims, new_sims], POOL)
            row = (q, 0, vec, pool.tobytes(), pool_sims.tobytes(), np.isin(pool, finished).tobytes(),
                   np.r_[seen, new].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, _STATE_TYPES, strict=True)], names)

    moved = state.union(both.mapInArrow(scored, _STATE)).repartition("query").sortWithinPartitions("query", "kind")
    return stage(moved.mapInArrow(merged, _STATE), "walk")


_STATE_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def search(graph: Graph, queries: DataFrame, k: int, steps: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each row of ``queries`` (column ``vec_id``), itself left out.

    Queries are rows of the table and start from their own node. Each walk goes
    on until its best nodes are all expanded, or for so many ``steps`` after the first.
    """
    names = [x.split()[0] for x in _STATE.split(", ")]
    asked = queries.select("vec_id").distinct().join(graph.rows, "vec_id")
    asked = stage(asked.select(F.col("vec_id").alias("query_id"), "node"), "queries")

    def begin(batches):
        for batch in batches:
            rows = [(n, 0, v, np.int64(n).tobytes(), np.float32(1).tobytes(), np.zeros(1, bool).tobytes(),
                     np.int64(n).tobytes()) for n, v in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _STATE_TYPES, strict=True)], names)

    starts = graph.nodes.join(broadcast_if_small(asked.select("node").distinct()), "node", "left_semi")
    state = stage(starts.select("node", "vec").mapInArrow(begin, _STATE), "walk")

    def open_(batches):
        for batch in batches:
            left = sum(not np.frombuffer(d, bool)[:EXPAND].all() for d in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([left])], ["left"])

    step = 0
    while steps is None or step <= steps:
        state, step = _walk(graph, state), step + 1
        if steps is None and not state.select("done").mapInArrow(open_, "left long").agg(F.sum("left")).first()[0]:
            break
    found = stage(_each(state.select(F.col("query").alias("node"), "ids", "sims"), FINAL).select(
        F.col("node").alias("query"), F.col("other").alias("node")), "found")

    # Of the vectors equal to a node the k + 1 smallest ids can count; hot ones are cut down in two steps.
    salted = Window.partitionBy("node", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    whole = Window.partitionBy("node").orderBy("vec_id")
    wanted = found.select("node").distinct()
    members = graph.rows.join(broadcast_if_small(wanted), "node", "left_semi").distinct().withColumn(
        "i", F.row_number().over(salted)).where(F.col("i") <= k + 1).withColumn(
        "i", F.row_number().over(whole)).where(F.col("i") <= k + 1).drop("i")
    a, b = graph.given.select(F.col("node").alias("query"), F.col("original").alias("x")), graph.given
    pairs = found.join(broadcast_if_small(wanted), "node", "left_semi").join(b, "node").join(a, "query")

    def measure(batches):
        for batch in batches:
            x, y = (np.array(batch.column(c).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)
                    for c in (2, 3))
            large = [np.abs(m).max(1) for m in (x, y)]
            x, y = x / large[0][:, None], y / large[1][:, None]
            s = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], ["query", "node", "score"])

    scores = pairs.select("query", "node", "x", "original").mapInArrow(measure, "query long, node long, score double")
    each = asked.withColumnRenamed("node", "query").join(scores, "query").join(members, "node").where(
        "vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
