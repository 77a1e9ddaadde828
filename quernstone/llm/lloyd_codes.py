"""Vector code compression: product codes by member-resident Lloyd rounds.

Vectors become integers, are cut into equal parts, and every position has a codebook of its own. A part lives with the owner
(position, entry, salt) of the entry it is assigned to; the salt is a hash of the row, so an entry that holds all rows is
spread over every task.

1. Parts are assigned to the first codebook and dealt to their owners, the only time that all of them move.
2. Owners sum their resident members. Sums are combined by (position, entry) on the way, so the driver gets one row per entry,
   ``positions * entries`` in all, and sends the new codebooks out.
3. Owners look their members up in the new codebooks. A part whose entry changes goes to its new owner in the next
   shuffle; all others stay where they are.

All arithmetic is in 64-bit integers, so results do not depend on the order of rows, tasks or retries.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.columns import parts as shuffle_parts
from quernstone.llm.hashing import mix
from quernstone.llm.resident import Block, beside, dealt, kept
from quernstone.session import stored

SCALE = 4096
BLOCK = 1 << 16
SLICE = 1 << 13


@dataclass
class Codebooks:
    """``entries[position, entry]`` are the components of an entry; empty if there was no vector."""

    entries: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components in order, as decimal numbers with commas between them."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def component_limit(width: int) -> int:
    """Larger integers count as this one, so that squared distances over a whole vector fit into 64 bits."""
    return math.isqrt((1 << 62) // max(1, width)) // 2


def _finite(vector: Column) -> Column:
    big = F.lit(float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < big), F.lit(False))), F.lit(False))


def integer_vectors(vectors: DataFrame, positions: int) -> tuple[DataFrame, int]:
    """(vec_id, label, components, row) of the rows that take part, stored, and their width (0 if there are none)."""
    whole = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("v")
    ).filter(_finite(F.col("v")) & (F.size("v") > 0) & (F.size("v") % positions == 0))
    first = whole.select("vec_id", F.size("v").alias("d")).orderBy(F.col("vec_id").asc_nulls_last(), "d").limit(1).collect()
    width = first[0].d if first else 0
    limit = F.lit(float(component_limit(width)))
    ints = F.transform("v", lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * SCALE, limit), -limit)), limit.cast("long")), -limit.cast("long")).cast("int"))
    rows = whole.filter(F.size("v") == width).select("vec_id", "label", ints.alias("x")).withColumn("row", F.monotonically_increasing_id())
    return stored(rows, "vectors"), width


def nearest(books: np.ndarray, position: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of each part's codebook, the lower index on ties."""
    entry, error = np.zeros(len(parts), np.int32), np.zeros(len(parts), np.int64)
    for a in range(0, len(parts), SLICE):
        own = books[position[a : a + SLICE]]
        gap = own - parts[a : a + SLICE, None, :]
        far = np.einsum("nkd,nkd->nk", gap, gap)
        entry[a : a + SLICE] = far.argmin(axis=1)
        error[a : a + SLICE] = far.min(axis=1)
    return entry, error


def _owner_place(position: np.ndarray, entry: np.ndarray, row: np.ndarray, places: int) -> np.ndarray:
    """Where the owner (position, entry, salt) lives; the salts of one entry are spread over all places."""
    salt = (mix(row.view(np.uint64)) % np.uint64(places)).astype(np.int64)
    return (salt + position + entry) % places


def _by_owner(position, entry, row, parts, places: int) -> Iterator[Block]:
    """Members as blocks for the places of their owners, at most ``BLOCK`` parts each, owners in order."""
    place = _owner_place(position, entry, row, places)
    order = np.lexsort((row, entry, position, place))
    place = place[order]
    cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(place)]):
        for c in range(a, b, BLOCK):
            own = order[c : min(b, c + BLOCK)]
            yield int(place[a]), (position[own], entry[own], row[own], parts[own])


def _split(width: int, positions: int, books, places: int):
    """Rows to blocks of their parts, assigned to the first codebook."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            row = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), positions)
            parts = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(n * positions, width // positions)
            position = np.tile(np.arange(positions, dtype=np.int32), n)
            entry, _ = nearest(books.value, position, parts)
            sent = list(_by_owner(position, entry, row, parts, places))
            yield pa.record_batch(
                [pa.array([p for p, _ in sent], pa.int32()), *(pa.array([b[k].tobytes() for _, b in sent], pa.binary()) for k in range(4))],
                ["place", "position", "entry", "row", "part"],
            )

    return run


def _members(blocks: Iterator[Block]) -> Iterator[tuple]:
    """The members of one place, small blocks put together."""
    held, n = [], 0
    for _, block in blocks:
        held.append(block)
        n += len(block[0])
        if n >= BLOCK:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _sums(positions: int, entries: int):
    def run(blocks: Iterator[Block]) -> Iterator[tuple[int, tuple]]:
        total = None
        for position, entry, _, parts in _members(blocks):
            at = position.astype(np.int64) * entries + entry
            if total is None:
                total, count = np.zeros((positions * entries, parts.shape[1]), object), np.zeros(positions * entries, np.int64)
            order = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
            total[at[order][cuts]] += np.add.reduceat(parts[order].astype(np.int64), cuts, axis=0).astype(object)
            count += np.bincount(at, minlength=len(count))
        if total is not None:
            for k in np.flatnonzero(count):
                yield int(k), (int(count[k]), total[k].tolist())

    return run


def _leaving(books, places: int):
    """The members whose entry changes, for their new owners."""

    def run(blocks: Iterator[Block]) -> Iterator[Block]:
        for position, entry, row, parts in _members(blocks):
            found, _ = nearest(books.value, position, parts)
            go = found != entry
            if go.any():
                yield from _by_owner(position[go], found[go], row[go], parts[go], places)

    return run


def _staying(books):
    """The members whose entry does not change, where they are."""

    def run(blocks: Iterator[Block]) -> Iterator[Block]:
        place = None
        own = []

        def seen() -> Iterator[Block]:
            nonlocal place
            for at, block in blocks:
                place = at
                yield at, block

        for position, entry, row, parts in _members(seen()):
            found, _ = nearest(books.value, position, parts)
            own = found == entry
            if own.any():
                yield place, (position[own], entry[own], row[own], parts[own])

    return run


def _settled(books):
    def run(blocks: Iterator[Block]) -> Iterator[tuple]:
        for position, _, row, parts in _members(blocks):
            entry, error = nearest(books.value, position, parts)
            yield bytearray(row.tobytes()), bytearray(position.tobytes()), bytearray(entry.tobytes()), bytearray(error.tobytes())

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (np.int64, np.int32, np.int32, np.int64)
    for batch in batches:
        for block in zip(*(batch.column(k).to_pylist() for k in range(4))):
            yield pa.record_batch([pa.array(np.frombuffer(x, kind)) for x, kind in zip(block, kinds)], ["row", "position", "entry", "error"])


def _added(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], [x + y for x, y in zip(a[1], b[1])]


def _updated(books: np.ndarray, state: RDD) -> np.ndarray:
    """The codebooks after one update; an entry without members stays."""
    positions, entries, _ = books.shape
    out = books.copy()
    for k, (count, total) in state.mapPartitions(_sums(positions, entries)).reduceByKey(_added).collect():
        out[k // entries, k % entries] = [x // count for x in total]
    return out


def compress(vectors: DataFrame, positions: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, errors) of every row of ``vectors(vec_id, embedding, label)`` that takes part, and the codebooks.

    ``code`` holds the entry's index and ``errors`` the squared distance of each position, in order. A component x counts as
    ``floor(4096 * x)``. The first entries are the parts of the rows with the smallest ids; each round assigns every part to the nearest entry (ties:
    the lower index) and moves each entry to the floor of its parts' mean; a last assignment gives the result.

    Rows whose vector is null or empty, holds a null, NaN or infinite component, or cannot be cut into ``positions`` equal parts are left out;
    so are vectors of another width than that of the smallest id among the rest. Rows without id come last when the first entries
    are chosen; rows that repeat an id count as rows of their own, the smaller vector first. With fewer rows than ``entries`` the
    codebook has one entry per row; equal entries leave all but the first unused. Integers beyond ``component_limit`` (134 million at 64
    components, 32,768 in x) count as that limit. Other columns are ignored; an empty table gives no rows and empty codebooks.
    """
    spark = vectors.sparkSession
    rows, width = integer_vectors(vectors, positions)
    places = shuffle_parts(vectors)
    result = "row long, position int, entry int, error long"
    if not width:
        none = spark.createDataFrame([], result)
        return _joined(rows, none), Codebooks(np.zeros((positions, 0, 0), np.int64))
    seeds = [r.x for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    books = np.array(seeds, np.int64).reshape(len(seeds), positions, width // positions).transpose(1, 0, 2).copy()
    sent = spark.sparkContext.broadcast(books)
    shape = (-1, width // positions)
    blocks = rows.select("row", "x").mapInArrow(_split(width, positions, sent, places), "place int, position binary, entry binary, row binary, part binary").rdd
    opened = blocks.map(
        lambda r: (r[0], (np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.int64), np.frombuffer(r[4], np.int32).reshape(shape)))
    )
    state = kept(dealt(opened, places))
    for k in range(rounds):
        books = _updated(books, state)
        sent = spark.sparkContext.broadcast(books)
        if k + 1 < rounds:
            before = state
            gone = before.mapPartitions(_leaving(sent, before.getNumPartitions()))
            state = kept(beside(before.mapPartitions(_staying(sent), preservesPartitioning=True), gone))
            state.count()
            before.unpersist()
    last = spark.createDataFrame(state.mapPartitions(_settled(sent)), "row binary, position binary, entry binary, error binary", verifySchema=False)
    found = stored(last.mapInArrow(_rows, result), "codes")
    state.unpersist()
    return _joined(rows, found), Codebooks(books)


def _joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One row per vector; a vector has one found row per position, so the lists are as long as that."""
    codes = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("position", "entry", "error"))).alias("c"))
    return rows.select("row", "vec_id", "label").join(codes, "row").select("vec_id", "label", F.col("c.entry").alias("code"), F.col("c.error").alias("errors"))
