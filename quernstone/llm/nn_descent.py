"""Approximate nearest neighbours: NN-descent and greedy graph search.

``build_graph`` gives every vector its ``degree`` nearest others by cosine, as far as neighbours of neighbours lead to them:

1. Rows with the same vector are one node. A node keeps at most as many ids as an answer can hold, the smallest ones.
2. First lists come from blocks of neighbours in sorted order of random hyperplane codes, a few such orders.
3. A round joins neighbours of neighbours: nodes live at places (a hash of the node), and three shuffles carry who
   lists whom, the vectors to the places where they are listed (once for each place, as bytes), and the pairs found that beat
   the worst entry of a list, already cut to a list's length. The lists themselves never move. Only pairs with a new
   entry are compared; rounds end when few entries change.

``search`` walks the graph for all queries at once. A round joins the nodes that each query wants to open with the
graph, which holds the neighbours' vectors as bytes beside their ids, and merges what beats the end of the query's beam. A query is
done when all nodes of its beam are open. The best of the beam are compared again on the original vectors in double precision.

Lists, beams, blocks and entry points are bounded by parameters. A node that very many list is told so at most
``degree`` times by each place.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.columns import parts as shuffle_parts
from quernstone.llm.hashing import mix
from quernstone.llm.resident import Block, dealt, kept, next_step
from quernstone.session import stored

ORDERS = 4
BLOCK = 256
#: Nodes of a place: the fewest, while there are tasks left, and the most.
PLACE = (1024, 8192)
PLANES = 48
AT_ONCE = 64
CUT_LINEAGE = 4


@dataclass
class Graph:
    """``nodes(node, v, ids)`` and the bucketed table ``links`` of (node, others, codes, scales) with ``width`` bytes a vector."""

    spark: SparkSession
    nodes: DataFrame
    links: str
    width: int
    entries: list[int]
    rounds: int

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.links}")


# Vectors and nodes


def _usable(v: Column) -> Column:
    """Not null, finite in all components, and of a length that can be divided by."""
    inf = F.lit(float("inf"))
    whole = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < inf), F.lit(False)))
    return F.coalesce(whole & (_square(v) > 0) & (_square(v) < inf), F.lit(False))


def _square(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows with an id and a vector that has a direction; repeated rows once."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & _usable(F.col("v"))).distinct()


def _nodes(vectors: DataFrame, answers: int) -> tuple[DataFrame, int]:
    """One row (node, v, ids) for each different vector of the width of the smallest id, and that width."""
    rows = stored(usable_vectors(vectors), "vectors")
    first = rows.select("vec_id", F.size("v").alias("d")).orderBy("vec_id", "d").limit(1).collect()
    width = first[0].d if first else 0
    own = Window.partitionBy("v").orderBy("vec_id")
    few = rows.filter(F.size("v") == width).withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= answers + 1)
    classes = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return stored(classes.withColumn("node", F.monotonically_increasing_id()).select("node", "v", "ids"), "nodes"), width


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as bytes, and what one step of each is worth."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    scale = np.abs(x).max(axis=1) / 127
    return np.rint(x / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def place(nodes: np.ndarray, places: int) -> np.ndarray:
    return (mix(nodes.view(np.uint64)) % np.uint64(places)).astype(np.int64)


# First lists


def _ordered(width: int):
    """Each node once for every order, with its code there."""
    planes = np.random.default_rng(11).normal(size=(ORDERS, width, PLANES))
    weights = 1 << np.arange(PLANES - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, scale = encode(_matrix(batch.column(1), width))
            bits = pa.array([c.tobytes() for c in codes], pa.binary())
            for t in range(ORDERS):
                key = ((codes.astype(np.float32) @ planes[t] > 0) * weights).sum(axis=1)
                yield pa.record_batch(
                    [pa.array(np.full(len(codes), t, np.int32)), pa.array(key), batch.column(0), bits, pa.array(scale)], ["t", "key", "node", "bits", "scale"]
                )

    return run


def _first_lists(width: int, degree: int, places: int):
    """The nearest of each node within its block, and its bytes, for the node's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(2).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int8).reshape(len(nodes), width)
            scale = batch.column(4).to_numpy()
            held = []
            for a in range(0, len(nodes), BLOCK):
                ids, x = nodes[a : a + BLOCK], codes[a : a + BLOCK].astype(np.float32) * scale[a : a + BLOCK, None]
                near = x @ x.T
                near[ids[:, None] == ids[None, :]] = -2
                k = min(max(1, degree // 2), len(ids))
                best = np.argpartition(-near, k - 1, axis=1)[:, :k]
                sims = np.take_along_axis(near, best, 1)
                held.append((np.repeat(ids, k), ids[best].ravel(), sims.ravel()))
            own, other, sim = (np.concatenate(x) for x in zip(*held))
            good = sim > -2
            own, other, sim = own[good], other[good], sim[good]
            first = batch.column(0).to_numpy() == 0
            for p, (rows, links) in _split((nodes[first], codes[first], scale[first]), (own, other, sim), places):
                yield pa.record_batch([pa.array([p], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (*rows, *links))], _FIRST)

    return run


_FIRST = ["place", "nodes", "codes", "scales", "own", "other", "sim"]


def _split(rows: tuple, links: tuple, places: int) -> Iterator[tuple[int, tuple]]:
    at, to = place(rows[0], places), place(links[0], places)
    for p in np.unique(np.r_[at, to]).tolist():
        yield p, (tuple(x[at == p] for x in rows), tuple(x[to == p] for x in links))


# Rounds. The state of a place: nodes (ascending), their bytes and scales, and lists of others, similarities and what is new.


def best_of(own: np.ndarray, other: np.ndarray, sim: np.ndarray, new: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of links (own, other) each once, an old one before a new one, and for each ``own`` the ``k`` with the largest similarity, in order."""
    order = np.lexsort((new, -sim, other, own))
    own, other, sim, new = own[order], other[order], sim[order], new[order]
    once = np.r_[True, (own[1:] != own[:-1]) | (other[1:] != other[:-1])][: len(own)]
    # A link that is old keeps its flag, whichever copy came first.
    if len(own):
        new = np.minimum.reduceat(new, np.flatnonzero(once))
    own, other, sim = own[once], other[once], sim[once]
    order = np.lexsort((other, -sim, own))
    own, other, sim, new = own[order], other[order], sim[order], new[order]
    cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
    rank = np.arange(len(own)) - np.repeat(cuts, np.diff(np.r_[cuts, len(own)]))
    keep = rank < k
    return own[keep], other[keep], sim[keep], new[keep], rank[keep]


def _lists(nodes: np.ndarray, links: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, other, sim, new, rank = best_of(*links, k)
    others, sims, fresh = np.full((len(nodes), k), -1, np.int64), np.full((len(nodes), k), -2, np.float32), np.zeros((len(nodes), k), bool)
    row = np.searchsorted(nodes, own)
    others[row, rank], sims[row, rank], fresh[row, rank] = other, sim, new
    return others, sims, fresh


def _told(nodes: np.ndarray, others: np.ndarray, fresh: np.ndarray, places: int, salt: int) -> Iterator[Block]:
    """To the place of every listed node: who lists it, at most a list's length of them, new ones first."""
    row, col = np.nonzero(others >= 0)
    mid, own, new = others[row, col], nodes[row], fresh[row, col]
    turn = mix(own.view(np.uint64) + np.uint64(salt))
    order = np.lexsort((turn, ~new, mid))
    mid, own, new = mid[order], own[order], new[order]
    cuts = np.flatnonzero(np.r_[True, mid[1:] != mid[:-1]][: len(mid)])
    rank = np.arange(len(mid)) - np.repeat(cuts, np.diff(np.r_[cuts, len(mid)]))
    keep = rank < others.shape[1]
    mid, own, new = mid[keep], own[keep], new[keep]
    to = place(mid, places)
    for p in np.unique(to).tolist():
        at = to == p
        yield p, ("sent", mid[at], own[at], new[at])


def _opened(degree: int, places: int):
    """First state of a place from its lists, and who is told."""

    def run(blocks: Iterator[Block]) -> Iterator[Block]:
        here, rows, links = None, [], []
        for here, (row, link) in blocks:
            rows.append(row)
            links.append(link)
        if here is None:
            return
        nodes, codes, scale = (np.concatenate(x) for x in zip(*rows))
        own, other, sim = (np.concatenate(x) for x in zip(*links))
        order = np.argsort(nodes)
        nodes, codes, scale = nodes[order], codes[order], scale[order]
        lists = _lists(nodes, (own, other, sim, np.ones(len(own), bool)), degree)
        yield here, ("own", nodes, codes, scale, *lists)
        yield from _told(nodes, lists[0], lists[2], places, 0)

    return run


def _gathered(blocks: Iterator[Block]) -> tuple:
    """(place, state, columns of the messages) of one place."""
    here, state, come = None, None, []
    for at, block in blocks:
        if block[0] == "own":
            here, state = at, block[1:]
        elif block[0] == "come":
            come.append(block[1:])
    return here, state, [np.concatenate(x) for x in zip(*come)]


def _introduced(places: int):
    """From who lists whom: a bounded reverse list for each node, and each node's vector to the places that need it."""

    def run(blocks: Iterator[Block]) -> Iterator[Block]:
        here, state, told = _gathered(blocks)
        if state is None:
            return
        nodes, codes, scale, others, sims, fresh = state
        k = others.shape[1]
        back, back_new = np.full((len(nodes), k), -1, np.int64), np.zeros((len(nodes), k), bool)
        row, col = np.nonzero(others >= 0)
        need, to = nodes[row], place(others[row, col], places)
        if told:
            mid, own, new = told
            need, to = np.r_[need, mid], np.r_[to, place(own, places)]
            at = np.searchsorted(nodes, mid)
            other = ~(others[at] == own[:, None]).any(axis=1)
            mid, own, new, at = mid[other], own[other], new[other], at[other]
            order = np.lexsort((mix(own.view(np.uint64)), ~new, at))
            at, own, new = at[order], own[order], new[order]
            cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
            rank = np.arange(len(at)) - np.repeat(cuts, np.diff(np.r_[cuts, len(at)]))
            keep = rank < k
            back[at[keep], rank[keep]], back_new[at[keep], rank[keep]] = own[keep], new[keep]
        yield here, ("own", *state, back, back_new)
        worst = sims[:, -1]
        pairs = np.unique(np.stack([to, np.searchsorted(nodes, need)], axis=1), axis=0) if len(need) else np.zeros((0, 2), np.int64)
        for p in np.unique(pairs[:, 0]).tolist():
            at = pairs[pairs[:, 0] == p, 1]
            yield p, ("sent", nodes[at], codes[at], scale[at], worst[at])

    return run


def _compared(places: int):
    """All pairs of the nodes that a node lists or is listed by, as far as one of the two entries is new."""

    def run(blocks: Iterator[Block]) -> Iterator[Block]:
        here, state, met = _gathered(blocks)
        if state is None:
            return
        nodes, codes, scale, others, sims, fresh, back, back_new = state
        yield here, ("own", nodes, codes, scale, others, sims, np.zeros_like(fresh))
        if not met:
            return
        k = others.shape[1]
        ids, first = np.unique(met[0], return_index=True)
        x = met[1][first].astype(np.float32) * met[2][first][:, None]
        worst = met[3][first]
        members, new = np.concatenate([others, back], axis=1), np.concatenate([fresh, back_new], axis=1)
        busy = new.any(axis=1)
        members, new = members[busy], new[busy]
        at = np.searchsorted(ids, members)
        found, n = [], 0
        for a in range(0, len(members), AT_ONCE):
            m, where, own_new = members[a : a + AT_ONCE], at[a : a + AT_ONCE], new[a : a + AT_ONCE]
            there = m >= 0
            where = np.where(there, where, 0)
            own = x[where]
            near = own @ own.transpose(0, 2, 1)
            take = (near > worst[where][:, :, None]) & there[:, :, None] & there[:, None, :] & (own_new[:, :, None] | own_new[:, None, :])
            take &= where[:, :, None] != where[:, None, :]
            b, i, j = np.nonzero(take)
            found.append((where[b, i].astype(np.int32), where[b, j].astype(np.int32), near[b, i, j]))
            n += len(b)
            if n > 1 << 21:
                found = [_cut(found, k)]
                n = len(found[0][0])
        if not n:
            return
        own, other, sim = _cut(found, k)
        own, other = ids[own], ids[other]
        to = place(own, places)
        for p in np.unique(to).tolist():
            mine = to == p
            yield p, ("sent", own[mine], other[mine], sim[mine])

    return run


def _cut(found: list[tuple], k: int) -> tuple:
    own, other, sim = (np.concatenate(x) for x in zip(*found))
    return best_of(own, other, sim, np.ones(len(own), bool), k)[:3]


def _improved(places: int, salt: int):
    """The lists with what was found, how many entries changed, and who is told."""

    def run(blocks: Iterator[Block]) -> Iterator[Block]:
        here, state, found = _gathered(blocks)
        if state is None:
            return
        nodes, codes, scale, others, sims, fresh = state
        if found:
            row, col = np.nonzero(others >= 0)
            links = (np.r_[nodes[row], found[0]], np.r_[others[row, col], found[1]], np.r_[sims[row, col], found[2]], np.r_[fresh[row, col], np.ones(len(found[0]), bool)])
            others, sims, fresh = _lists(nodes, links, others.shape[1])
        yield here, ("own", nodes, codes, scale, others, sims, fresh)
        yield here, ("changed", int(fresh.sum()))
        yield from _told(nodes, others, fresh, places, salt)

    return run


def _linked(blocks: Iterator[Block]) -> Iterator[tuple]:
    """Rows of the graph: each node's others, listed by it or listing it, with their bytes."""
    _, state, met = _gathered(blocks)
    if state is None:
        return
    nodes, _, _, others, _, _, back, _ = state
    ids, codes, scale = (met[0], met[1], met[2]) if met else (np.zeros(0, np.int64), np.zeros((0, 1), np.int8), np.zeros(0, np.float32))
    order = np.argsort(ids)
    for v, row in zip(nodes.tolist(), np.concatenate([others, back], axis=1)):
        row = row[row >= 0]
        at = order[np.searchsorted(ids, row, sorter=order)]
        yield v, bytearray(row.tobytes()), bytearray(codes[at].tobytes()), bytearray(scale[at].tobytes())


def _changes(block: Block) -> int:
    return block[1][1] if block[1][0] == "changed" else 0


def build_graph(vectors: DataFrame, degree: int = 32, max_rounds: int = 12, least_change: float = 0.02, answers: int = 5, entries: int = 16) -> Graph:
    """The neighbour graph of ``vectors(vec_id, embedding)`` for searches of at most ``answers`` results.

    Rounds end when less than ``least_change`` of all entries change, or after ``max_rounds``. ``entries`` nodes,
    chosen by a hash, are where a search may start. Rows without id, and those whose vector is null, empty, zero, holds a null or non-finite component or
    has a length beyond the range of doubles, take no part; nor do vectors of another width than that of the smallest id
    (the shorter vector if it has several). Repeated rows count once; rows that repeat an id with other vectors are candidates of
    their own. Other columns are ignored; an empty table gives an empty graph. The table ``links`` is the caller's to drop.
    """
    spark = vectors.sparkSession
    nodes, width = _nodes(vectors, answers)
    n = nodes.count()
    places = max(1, min(-(-n // PLACE[0]), max(shuffle_parts(vectors), -(-n // PLACE[1]))))
    links = f"neighbours_{uuid.uuid4().hex}"
    schema = "node long, others binary, codes binary, scales binary"
    if not n:
        spark.createDataFrame([], schema).write.format("parquet").saveAsTable(links)
        return Graph(spark, nodes, links, 0, [], 0)
    ordered = nodes.select("node", "v").mapInArrow(_ordered(width), "t int, key long, node long, bits binary, scale float")
    tasks = max(1, min(places, n * ORDERS // 2048))
    blocks = ordered.repartitionByRange(tasks, "t", "key", "node").sortWithinPartitions("t", "key", "node").mapInArrow(
        _first_lists(width, degree, places), "place int, nodes binary, codes binary, scales binary, own binary, other binary, sim binary"
    )

    def opened(r) -> Block:
        rows = np.frombuffer(r[1], np.int64), np.frombuffer(r[2], np.int8).reshape(-1, width), np.frombuffer(r[3], np.float32)
        return r[0], (rows, (np.frombuffer(r[4], np.int64), np.frombuffer(r[5], np.int64), np.frombuffer(r[6], np.float32)))

    state = kept(dealt(blocks.rdd.map(opened), places).mapPartitions(_opened(degree, places), preservesPartitioning=True))
    rounds = 0
    while rounds < max_rounds:
        rounds += 1
        known = next_step(state, _introduced(places))
        found = next_step(known, _compared(places))
        after = next_step(found, _improved(places, rounds))
        if rounds % CUT_LINEAGE == 0 and spark.sparkContext.getCheckpointDir():
            after.checkpoint()
        changed = after.map(_changes).sum()
        for old in (state, known, found):
            old.unpersist()
        state = after
        if changed <= least_change * n * degree:
            break
    known = next_step(state, _introduced(places))
    made = spark.createDataFrame(next_step(known, _linked), schema, verifySchema=False)
    # Each task writes one bucket; otherwise every task would leave a file in nearly each of them.
    made.repartition(places, "node").write.bucketBy(places, "node").sortBy("node").format("parquet").saveAsTable(links)
    state.unpersist()
    known.unpersist()
    starts = [r.node for r in nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(entries).collect()]
    return Graph(spark, nodes, links, width, starts, rounds)


# Search. A query's row: its number, unit vector, beam (nodes, similarities, whether opened), the end of the beam, and what to open next.

QUERY = "q long, x binary, ids binary, sims binary, done binary, floor float, front array<long>"
FRONT = QUERY.replace("q long", "q long, told boolean")


def _score(width: int):
    """What the opened nodes' neighbours are worth to the query, as far as they beat the end of its beam."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, ids, sims = [], [], []
            for k, x, floor, others, codes, scales in zip(*(batch.column(c).to_pylist() for c in range(6))):
                own = np.frombuffer(others, np.int64)
                near = (np.frombuffer(codes, np.int8).reshape(len(own), width).astype(np.float32) @ np.frombuffer(x, np.float32)) * np.frombuffer(scales, np.float32)
                good = near > floor
                if good.any():
                    q.append(k)
                    ids.append(own[good].tobytes())
                    sims.append(near[good].tobytes())
            yield pa.record_batch([pa.array(q, pa.int64()), pa.array(ids, pa.binary()), pa.array(sims, pa.binary())], ["q", "ids", "sims"])

    return run


def _merged(beam: int, at_once: int):
    """Each query's row with the replies to it, which follow it."""

    def close(row: tuple, ids: list, sims: list) -> tuple:
        q, x, own, near, done = row
        own, near, done = np.frombuffer(own, np.int64), np.frombuffer(near, np.float32), np.frombuffer(done, bool)
        own, near = np.concatenate([own, *ids]), np.concatenate([near, *sims])
        done = np.r_[done, np.zeros(len(own) - len(done), bool)]
        order = np.lexsort((~done, own))
        own, near, done = own[order], near[order], done[order]
        once = np.r_[True, own[1:] != own[:-1]][: len(own)]
        own, near, done = own[once], near[once], done[once]
        order = np.lexsort((own, -near))[:beam]
        own, near, done = own[order], near[order], done[order].copy()
        front = np.flatnonzero(~done)[:at_once]
        done[front] = True
        floor = float(near[-1]) if len(near) == beam else -2.0
        return q, x, own.tobytes(), near.tobytes(), done.tobytes(), floor, own[front].tolist()

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float32(), pa.list_(pa.int64()))
        names = ["q", "x", "ids", "sims", "done", "floor", "front"]
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, ids, sims, made = None, [], [], []
        for batch in batches:
            for q, kind, x, own, near, done in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if kind == 0:
                    if row is not None:
                        made.append(close(row, ids, sims))
                    row, ids, sims = (q, x, own, near, done), [], []
                else:
                    ids.append(np.frombuffer(own, np.int64))
                    sims.append(np.frombuffer(near, np.float32))
            if len(made) > 1000:
                yield out(made)
                made = []
        if row is not None:
            made.append(close(row, ids, sims))
        if made:
            yield out(made)

    return run


def _started(width: int, entries: list[int]):
    """First row of each query: it opens its own node, if it is one, and the entry points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)
            own = batch.column(2).to_pylist()
            ids = [np.array([] if v is None else [v], np.int64) for v in own]
            none = pa.array([np.ones(len(i), np.float32).tobytes() for i in ids], pa.binary())
            yield pa.record_batch(
                [
                    batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([i.tobytes() for i in ids], pa.binary()), none,
                    pa.array([np.ones(len(i), bool).tobytes() for i in ids], pa.binary()), pa.array(np.full(len(x), -2, np.float32)),
                    pa.array([i.tolist() + [e for e in entries if e not in i] for i in ids], pa.list_(pa.int64())),
                ],
                ["q", "x", "ids", "sims", "done", "floor", "front"],
            )

    return run


def _unpacked(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, np.int64)[:most].tolist() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], ["q", "found"])

    return run


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors of doubles."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return dot / (F.sqrt(_square(a)) * F.sqrt(_square(b)))


def search(graph: Graph, queries: DataFrame, k: int = 5, beam: int = 256, at_once: int = 128, compared: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found to every usable row of ``queries(vec_id, embedding)``.

    Nearest first, ties to the smaller id; a query's own id is no candidate. ``k`` may not exceed what the graph was built for. A beam holds ``beam``
    nodes, a round opens ``at_once`` of them for each query, and the ``compared`` best are compared on the original vectors. Queries of another width than the
    graph's, and those that could take no part in it, have no rows; a query that is no node of the graph starts from its entry points alone. Queries that
    repeat an id with other vectors are answered each.
    """
    spark = graph.spark
    out = "query_id long, rank int, vec_id long, score double"
    if not graph.width:
        return spark.createDataFrame([], out)
    parts = shuffle_parts(queries)
    asked = usable_vectors(queries).filter(F.size("v") == graph.width)
    asked = stored(asked.join(graph.nodes.select("node", "v"), "v", "left").withColumn("q", F.monotonically_increasing_id()), "queries")
    links = spark.table(graph.links)
    state = stored(asked.select("q", "v", "node").mapInArrow(_started(graph.width, graph.entries), QUERY), "beams")
    finished = []
    while not state.isEmpty():
        front = state.select("q", "x", "floor", F.explode("front").alias("node"))
        replies = front.join(links, "node").select("q", "x", "floor", "others", "codes", "scales").mapInArrow(_score(graph.width), "q long, ids binary, sims binary")
        none = F.lit(None).cast("binary")
        both = state.select("q", F.lit(0).alias("kind"), "x", "ids", "sims", "done").union(replies.select("q", F.lit(1), none, "ids", "sims", none))
        after = stored(both.repartition(parts, "q").sortWithinPartitions("q", "kind").mapInArrow(_merged(beam, at_once), QUERY), "beams")
        finished.append(after.filter(F.size("front") == 0).select("q", "ids"))
        state = after.filter(F.size("front") > 0)
    best = asked.select("q", "v").limit(0).select("q", F.lit(None).cast("binary").alias("ids"))
    for part in finished:
        best = best.union(part)
    pairs = best.mapInArrow(_unpacked(compared), "q long, found array<long>").select("q", F.explode("found").alias("node"))
    near = pairs.join(graph.nodes, "node").join(asked.select("q", F.col("vec_id").alias("query_id"), F.col("v").alias("x")), "q")
    scored = near.select("q", "query_id", cosine(F.col("x"), F.col("v")).alias("score"), F.explode("ids").alias("vec_id")).filter("vec_id != query_id")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return stored(ranked.select("query_id", "rank", "vec_id", "score"), "answers")
