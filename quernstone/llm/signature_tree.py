"""N-gram Jaccard join: signature trees with dual traversal.

``link_documents`` finds every pair of documents whose sets of word shingles have a Jaccard
similarity of at least ``threshold`` percent and gives each document the smallest id it reaches by such links.

1. Documents with equal sets form one class and are one node from here on.
2. A class whose shingles hardly occur elsewhere cannot have a partner. Each class sends the smallest
   part of its shingles (by hash); a pair above the threshold shares several of them, so a class with fewer shared
   ones is done. Only compact hashes travel, and a false match can only keep a class too long.
3. For the others, shingle frequencies give a global order, rarest first. Any linked pair shares one of
   the first ``n - T + 1`` shingles, so classes meet in groups that hold one such shingle. Groups
   of the same classes count once, under their first shingle.
4. In rounds, every class is compared with one hub of its groups, a hub that it is not known to be connected with. What is linked
   so far shares a label, and a group of one label is done, however large it is: copies are never expanded into pairs. The
   rounds end when one links few of its pairs.
5. In every other group a signature tree is built: nodes hold the OR of their classes' token bitmaps,
   the range of sizes, the most shingles that any of them has from the group's own on, and the common label, if any. A traversal of node pairs leaves out
   those that are connected already, whose sizes do not fit, or whose largest possible overlap is too small. A pair counts only in the group of the first shingle
   it shares, where nothing before that shingle can add to its overlap. Groups beyond ``block`` classes are cut into
   blocks, and each pair of blocks is a task of its own.
6. Surviving pairs are compared exactly, and the components of all links are found.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm import packed
from quernstone.llm.columns import parts as hash_parts
from quernstone.llm.components import components
from quernstone.llm.hashing import mix, shingle_sets
from quernstone.session import stored

BITS = 1024
LEAF = 16
FANOUT = 8
BLOCK = 2048
#: How many of a class's first shingles are looked at to leave a pair to an earlier group.
EARLY = 64
#: A round that links fewer than one in so many of its pairs is the last.
LEAST_YIELD = 50
#: Pairs of one hub that are compared in one task.
SPREAD = 1000
#: A rank within the shingle order: how often, then which.
SHARED = np.dtype([("token", "<u8"), ("df", "<u4")])


def needed(n, threshold: int):
    """The least overlap that a set of ``n`` can have with a partner."""
    return (threshold * n + 99) // 100


def _spare(n: int, threshold: int) -> int:
    """How many common shingles the first filter asks for of a set of ``n``."""
    return max(1, -(-n // 8))


def set_signature(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    size = np.uint64(len(tokens))
    a = mix(np.array([(mix(tokens ^ np.uint64(0x5851F42D4C957F2D))).sum(dtype=np.uint64) + size], np.uint64))
    b = mix(np.array([(mix(tokens + np.uint64(0x14057B7EF767814F))).sum(dtype=np.uint64) ^ size], np.uint64))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(len(s), *set_signature(s)) for _, s in shingle_sets(batch.column(2))]
        n, a, b = (list(x) for x in zip(*rows)) if rows else ([], [], [])
        made = pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())
        yield pa.record_batch([batch.column(0), batch.column(1), *made], ["doc_id", "h", "n", "node", "check"])


def _first_tokens(parts: int, threshold: int):
    """The smallest shingles of every document, dealt into parts of another hash of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owner, values, held = [], [], [], 0
            for _, s in shingle_sets(batch.column(0)):
                if not len(s):
                    continue
                head = mix(s[: len(s) - needed(len(s), threshold) + _spare(len(s), threshold)] ^ np.uint64(0xA0761D6478BD642F))
                owner.append(np.full(len(head), len(keys), np.int32))
                keys.append(set_signature(s)[0])
                values.append(head)
                held += len(head)
                if held > 1 << 21:
                    yield _dealt(keys, owner, values, parts)
                    keys, owner, values, held = [], [], [], 0
            if keys:
                yield _dealt(keys, owner, values, parts)

    return run


def _dealt(keys, owner, values, parts: int) -> pa.RecordBatch:
    tokens = np.concatenate(values)
    part = (tokens % np.uint64(parts)).astype(np.int32)
    return packed.pack(part, np.concatenate(owner), np.array(keys, np.int64), (tokens >> np.uint64(32)).astype(np.uint32))


def _shared_counts(parts: int):
    """How many of a class's tokens in this part another class has as well, dealt by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, token = packed.unpack(batches, np.dtype("<u4"))
        if not len(key):
            return
        nodes, place = np.unique(key, return_inverse=True)
        full = (part << np.uint64(32)) | token
        order = np.lexsort((place, full))
        full, place = full[order], place[order]
        new = np.r_[True, (full[1:] != full[:-1]) | (place[1:] != place[:-1])]
        full, place = full[new], place[new]
        same = full[1:] == full[:-1]
        shared = np.r_[same, False] | np.r_[False, same]
        counts = np.bincount(place[shared], minlength=len(nodes)).astype(np.uint32)
        nodes, counts = nodes[counts > 0], counts[counts > 0]
        if len(nodes):
            yield packed.pack((nodes.view(np.uint64) % np.uint64(parts)).astype(np.int32), np.arange(len(nodes)), nodes, counts)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _, key, count = packed.unpack(batches, np.dtype("<u4"))
    nodes, place = np.unique(key, return_inverse=True)
    total = np.bincount(place, weights=count, minlength=len(nodes)).astype(np.int64)
    for a in range(0, len(nodes), 100_000):
        yield pa.record_batch([pa.array(nodes[a : a + 100_000]), pa.array(total[a : a + 100_000])], ["node", "shared"])


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """The token bitmap of a set."""
    bits = np.zeros(BITS, np.uint8)
    bits[(tokens % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class, size, shingles, bitmap of the candidates' texts, where the text is the class's."""
    for batch in batches:
        rows, held, nodes = [], 0, batch.column(0).to_pylist()
        for row, s in shingle_sets(batch.column(1)):
            if set_signature(s)[0] != nodes[row]:
                continue
            rows.append((nodes[row], len(s), s.view(np.int64), bitmap(s).tobytes()))
            held += len(s)
            if held > 1 << 20:
                yield _set_batch(rows)
                rows, held = [], 0
        if rows:
            yield _set_batch(rows)


def _set_batch(rows) -> pa.RecordBatch:
    offsets = np.cumsum([0, *(r[1] for r in rows)]).astype(np.int32)
    tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[2] for r in rows])))
    return pa.record_batch(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), tokens, pa.array([r[3] for r in rows], pa.binary())],
        ["node", "n", "tokens", "bits"],
    )


def _all_tokens(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            lists = batch.column(1)
            tokens = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = np.diff(lists.offsets.to_numpy())
            if len(tokens):
                owner = np.repeat(np.arange(len(nodes)), sizes)
                yield packed.pack((mix(tokens) % np.uint64(parts)).astype(np.int32), owner, nodes, tokens, sizes)

    return run


def _frequencies(parts: int):
    """Tokens with their class counts, those of one class left out, dealt by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, key, token, size = packed.unpack(batches, np.dtype("<u8"), sized=True)
        if not len(key):
            return
        order = np.argsort(token, kind="stable")
        key, token, size = key[order], token[order], size[order]
        cuts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        runs = np.diff(np.r_[cuts, len(token)])
        df = np.repeat(runs, runs)
        key, token, size, df = key[df > 1], token[df > 1], size[df > 1], df[df > 1]
        order = np.argsort(key, kind="stable")
        nodes, first, owner = np.unique(key[order], return_index=True, return_inverse=True)
        values = np.zeros(len(order), SHARED)
        values["token"], values["df"] = token[order], df[order]
        if len(order):
            yield packed.pack((nodes.view(np.uint64) % np.uint64(parts)).astype(np.int32)[owner], owner, nodes, values, size[order][first])

    return run


def _rarest(threshold: int):
    """The rarest shared shingles of each class: as many as any partner may lack, and one. Shingles of no other class
    come first in that order; they count, but need no group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, key, value, size = packed.unpack(batches, SHARED, sized=True)
        if not len(key):
            return
        order = np.lexsort((value["token"], value["df"], key))
        key, token, df, size = key[order], value["token"][order], value["df"][order].astype(np.int64), size[order].astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        shared = np.diff(np.r_[cuts, len(key)])
        place = np.arange(len(key)) - np.repeat(cuts, shared)
        weight = np.repeat(np.add.reduceat(df, cuts), shared)
        kept = place <= np.repeat(shared, shared) - needed(size, threshold)
        rest = np.repeat(shared, shared) - place
        columns = [x[kept] for x in (token.view(np.int64), key, size, weight, df, rest)]
        for a in range(0, len(columns[0]), 200_000):
            yield pa.record_batch([pa.array(x[a : a + 200_000]) for x in columns], ["token", "node", "n", "weight", "df", "rest"])

    return run


class Tree:
    """A signature tree over the classes of one group; each level is a set of aligned arrays."""

    def __init__(self, sizes: np.ndarray, labels: np.ndarray, bits: np.ndarray, rest: np.ndarray | None = None):
        order = np.lexsort((sizes, labels))
        self.order = order
        rest = sizes if rest is None else rest
        sizes, labels, bits, rest = sizes[order], labels[order], bits[order], rest[order]
        extra = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(sizes, sizes, extra, rest, labels, np.ones(len(sizes), bool), bits)]
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            low, high, extra, rest, labels, alike, bits = self.levels[-1]
            at = np.arange(0, len(low), width)
            one = np.minimum.reduceat(labels, at)
            self.levels.append((
                np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at), np.maximum.reduceat(rest, at), one,
                np.logical_and.reduceat(alike, at) & (one == np.maximum.reduceat(labels, at)), np.bitwise_or.reduceat(bits, at, axis=0),
            ))
            width = FANOUT

    def children(self, level: int, nodes: np.ndarray) -> list[np.ndarray]:
        width = LEAF if level == 1 else FANOUT
        n = len(self.levels[level - 1][0])
        return [np.arange(x * width, min(n, (x + 1) * width)) for x in nodes]


def _possible(a, b, i: np.ndarray, j: np.ndarray, threshold: int) -> np.ndarray:
    """Which node pairs may hold a linked pair that is not known to be connected."""
    low, high, extra, rest, labels, alike, bits = a
    low2, high2, extra2, rest2, labels2, alike2, bits2 = b
    known = alike[i] & alike2[j] & (labels[i] == labels2[j])
    fits = (100 * high[i] >= threshold * low2[j]) & (100 * high2[j] >= threshold * low[i])
    overlap = np.bitwise_count(bits[i] & bits2[j]).sum(axis=1, dtype=np.int64) + np.minimum(extra[i], extra2[j])
    overlap = np.minimum(overlap, np.minimum(rest[i], rest2[j]))
    return ~known & fits & ((100 + threshold) * overlap >= threshold * (low[i] + low2[j]))


def dual_traversal(a: Tree, b: Tree, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries (one of each tree) that may be linked. With ``a is b``, each pair once."""
    same = a is b
    level_a, level_b = len(a.levels) - 1, len(b.levels) - 1
    stack = [(level_a, level_b, np.zeros(1, int), np.zeros(1, int))]
    while stack:
        la, lb, i, j = stack.pop()
        keep = _possible(a.levels[la], b.levels[lb], i, j, threshold)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if la == 0 and lb == 0:
            yield a.order[i], b.order[j]
            continue
        for lo in range(0, len(i), 512):
            ci = a.children(la, i[lo : lo + 512]) if la else [i[k : k + 1] for k in range(lo, min(len(i), lo + 512))]
            cj = b.children(lb, j[lo : lo + 512]) if lb else [j[k : k + 1] for k in range(lo, min(len(j), lo + 512))]
            x = np.concatenate([np.repeat(p, len(q)) for p, q in zip(ci, cj)])
            y = np.concatenate([np.tile(q, len(p)) for p, q in zip(ci, cj)])
            if same:
                inner = x < y if la == 1 else x <= y
                x, y = x[inner], y[inner]
            stack.append((max(la - 1, 0), max(lb - 1, 0), x, y))


def first_masks(early: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words for each class, with a bit for each shingle that it has before the group's own."""
    sizes = np.array([len(e) for e in early])
    kinds, place = np.unique(np.concatenate(early) if len(early) else np.zeros(0, np.int64), return_inverse=True)
    bits = np.zeros((len(early), max(1, -(-len(kinds) // 64)) * 64), np.uint8)
    bits[np.repeat(np.arange(len(early)), sizes), place] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def _group_pairs(threshold: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        side, node = group.side.to_numpy(), group.node.to_numpy()
        masks = first_masks([np.asarray(e, np.int64) for e in group.early])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)

        def tree(rows: np.ndarray) -> Tree:
            own = group.iloc[rows]
            bits = np.frombuffer(b"".join(own.bits), np.uint64).reshape(len(rows), BITS // 64)
            return Tree(own.n.to_numpy(), own.label.to_numpy(), bits, own.rest.to_numpy())

        out_a, out_b = [], []
        if len(left):
            a = tree(left)
            b, other = (tree(right), right) if len(right) else (a, left)
            for i, j in dual_traversal(a, b, threshold):
                i, j = left[i], other[j]
                first = ~(masks[i] & masks[j]).any(axis=1)
                out_a.append(node[i[first]])
                out_b.append(node[j[first]])
        x = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
        y = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def _linked(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The rows of ``pairs(a, b, ...)`` whose sets are similar enough, compared exactly. A class ``a`` of many pairs is sent to several tasks."""
    often = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("_k"))
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("_s")).join(often, "a")
    left = left.select("a", "_s", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_i"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("_t"))
    dealt = pairs.join(often, "a").withColumn("_i", F.pmod(F.xxhash64("b"), F.col("_k")).cast("int")).drop("_k")
    both = F.size(F.array_intersect("_s", "_t"))
    return (
        dealt.join(right, "b").join(left, ["a", "_i"])
        .filter((100 + threshold) * both >= threshold * (F.size("_s") + F.size("_t")))
        .select(*pairs.columns)
    )


def candidate_classes(docs: DataFrame, signed: DataFrame, threshold: int) -> DataFrame:
    """Classes (node, n, rep) that share enough of their first shingles with others."""
    parts = hash_parts(docs)
    counts = (
        docs.select("text").mapInArrow(_first_tokens(parts, threshold), packed.SCHEMA)
        .repartition(parts, "part").mapInArrow(_shared_counts(parts), packed.SCHEMA)
        .repartition(parts, "part").mapInArrow(_summed, "node long, shared long")
    )
    classes = signed.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"))
    least = F.floor((F.lit(threshold) * F.col("n") + 99) / 100)
    return classes.join(counts, "node").filter(F.col("shared") >= F.greatest(F.lit(1), F.ceil(least / 8))).select("node", "n", "rep")


def _roots(parents: DataFrame) -> DataFrame:
    """(node, label): the last of each node's ancestors. ``parents(node, up)`` has each node once and leads in no circle."""
    now = stored(parents, "parents")
    while True:
        above = now.select(F.col("node").alias("up"), F.col("up").alias("top"))
        after = stored(now.select("node", "up").join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "parents")
        if after.filter("moved").isEmpty():
            return after.select("node", F.col("up").alias("label"))
        now = after


def _mixed(told: DataFrame) -> DataFrame:
    """The members of the groups that hold more than one label."""
    groups = told.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("token")
    return stored(told.join(groups, "token"), "mixed")


def _links(sets: DataFrame, parts: int, threshold: int, block: int) -> DataFrame:
    """(a, b): links between classes whose components are those of all links."""
    rows = stored(
        sets.select("node", "tokens").mapInArrow(_all_tokens(parts), packed.SCHEMA)
        .repartition(parts, "part").mapInArrow(_frequencies(parts), packed.SCHEMA)
        .repartition(parts, "part").mapInArrow(_rarest(threshold), "token long, node long, n long, weight long, df long, rest long"),
        "groups",
    )
    groups = (
        rows.groupBy("token")
        .agg(
            F.count("*").alias("c"), F.first("df").alias("df"), F.max(F.struct("weight", "node")).alias("hub"),
            F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(2), "node")).alias("s2"),
        )
        .filter("c > 1").groupBy("c", "s1", "s2", "hub").agg(F.min(F.struct("df", "token")).alias("g"))
        .select(F.col("g.token").alias("token"), "hub", "c")
    )
    members = stored(rows.join(groups, "token"), "members")
    first = stored(members.groupBy("node").agg(F.max("hub")["node"].alias("hub")).filter("hub != node").select(F.col("hub").alias("a"), F.col("node").alias("b")), "first")
    links = stored(_linked(first, sets, threshold), "seeds")
    # A hub is heavier than what links to it, so these links are a forest.
    labels = _roots(links.select(F.col("b").alias("node"), F.col("a").alias("up")))
    told = _mixed(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    for turn in count(1):
        # Another hub for each group that is left, and the classes that are not known to be connected with it.
        hubs = told.groupBy("token").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), "node", "label")).alias("_hub"))
        asked = told.join(hubs, "token").filter(F.col("label") != F.col("_hub.label"))
        pairs = asked.groupBy("node", "label").agg(F.min("_hub").alias("_hub")).select(F.col("_hub.node").alias("a"), F.col("node").alias("b"), F.col("_hub.label").alias("x"), F.col("label").alias("y"))
        pairs = stored(pairs, "round")
        new = stored(_linked(pairs, sets, threshold), "found")
        if new.count() * LEAST_YIELD <= pairs.count():
            links = links.union(new.select("a", "b"))
            break
        links = links.union(new.select("a", "b"))
        merged = _roots(new.groupBy(F.greatest("x", "y").alias("node")).agg(F.min(F.least("x", "y")).alias("up"))).select(F.col("node").alias("label"), F.col("label").alias("to"))
        told = _mixed(told.join(merged, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to"))
    early = told.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "token"))), 1, EARLY).alias("early"))
    before = F.transform(F.filter("early", lambda e: (e["df"] < F.col("df")) | ((e["df"] == F.col("df")) & (e["token"] < F.col("token")))), lambda e: e["token"])
    left = told.join(early, "node").withColumn("early", before).join(sets.select("node", "bits"), "node").withColumn("_n", F.ceil(F.col("c") / block).cast("int"))
    left = left.withColumn("_i", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    # Block i meets itself and every later block: as the left side of (i, j), and the right side of (j, i).
    spread = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda k: F.struct(
            F.least(F.col("_i"), k).alias("x"), F.greatest(F.col("_i"), k).alias("y"), F.when(k < F.col("_i"), 1).otherwise(0).alias("side")
        ),
    )
    pairs = (
        left.withColumn("_to", F.explode(spread))
        .select("token", "_to.x", "_to.y", "_to.side", "node", "n", "label", "bits", "rest", "early")
        .groupBy("token", "x", "y").applyInPandas(_group_pairs(threshold), "a long, b long")
        .distinct()
    )
    return links.union(_linked(stored(pairs, "pairs"), sets, threshold))


def _labelled(docs: DataFrame, threshold: int, block: int) -> DataFrame:
    """(doc_id, h, n, node, root) of every row of ``docs(doc_id, text)``; ``h`` is a hash of the text, ``root`` one for each component."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    signed = stored(hashed.mapInArrow(_signatures, "doc_id long, h long, n long, node long, check long"), "signed")
    chosen = stored(candidate_classes(docs, signed, threshold), "classes")
    # The candidates' sets are kept by class in a bucketed table, so that no later join moves them.
    parts, name = hash_parts(docs), f"shingle_sets_{uuid.uuid4().hex}"
    # The classes have no proven bound: they are never broadcast, whatever their size seems to be.
    texts = docs.join(chosen.hint("merge"), docs.doc_id.eqNullSafe(chosen.rep)).select("node", "text")
    sets = texts.mapInArrow(_sets, "node long, n long, tokens array<long>, bits binary").repartition(parts, "node").dropDuplicates(["node"])
    try:
        sets.write.bucketBy(parts, "node").format("parquet").saveAsTable(name)
        reached = components(_links(docs.sparkSession.table(name), parts, threshold, block))
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    return signed.join(reached, "node", "left").withColumn("root", F.coalesce("root", "node"))


def link_documents(docs: DataFrame, threshold: int = 75, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs(doc_id, text)``.

    Two documents link when ``100 * intersection >= threshold * union`` of their five-word shingle sets
    (A-Z lower-cased; a shorter text is one shingle). A text that is null, empty or without words has the size 0, links
    with nothing and is its own component. Rows without an id take part, but never name a component that holds an id; a
    component of such rows alone is null. Rows that repeat an id are taken one by one, each by its own text.
    Columns other than the two are ignored; an empty table gives no rows. ``threshold`` is a percentage of 1 or more.
    """
    named = _labelled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), threshold, block)
    names = named.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = named.join(names, "root", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def first_of_each(docs: DataFrame, threshold: int = 75, block: int = BLOCK) -> DataFrame:
    """Of each component of ``docs(doc_id, text, ...)`` one row: that with the smallest id, then with the smallest hash of its text.

    Rows without an id come after all others of their component; of rows that agree in id and text one stays. A text that is
    null, empty or without words links with nothing, so its row stays, however often it is repeated. All columns stay as they are; an empty table gives no rows.
    """
    row, key = "_row", ["_id", "_h"]
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    named = _labelled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), threshold, block).filter("n > 0")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("h"))
    keys = named.groupBy("root", place.alias("k")).agg(F.count("*").alias("c"))
    many = keys.groupBy("root").agg(F.min("k").alias("first"), F.sum("c").alias("rows")).filter("rows > 1")
    fate = keys.join(many, "root").select(F.col("k.id").alias("_i"), F.col("k.h").alias("_g"), (F.col("k") == F.col("first")).alias("first"), "c")
    # An id and a text lie in one component only, so each key has one fate. Repeated first rows leave with the others, and one of each comes back.
    fate = stored(fate.filter("not first or c > 1"), "fates")
    same = lambda f: own["_id"].eqNullSafe(f["_i"]) & (own["_h"] == f["_g"])
    stays = own.join(fate, same(fate), "left_anti")
    again = fate.filter("first")
    order = Window.partitionBy(*key).orderBy(F.to_json(row))
    back = own.join(again, same(again), "left_semi").withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return stays.select(f"{row}.*").unionByName(back.select(f"{row}.*"))
