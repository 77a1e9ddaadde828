"""Breadth-first search from many starts at once, 64 starts to a word.

A row (id, word, bits) says which of a word's starts reach a node. A hop joins the rows of the last one with the edges and combines
what arrives at a node by ``bit_or``, so starts that share their way travel as one row, and no row is ever made for one start and one node. Sums per
start are taken off the words at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.graph_query import _steps, _typed
from quernstone.session import cut_lineage, stored

WORD = 64
SALT = 8


def numbered_starts(starts: DataFrame) -> DataFrame:
    """(start, word, bit): a place for every different ``id`` of ``starts``, written once so that it stays."""
    n = F.monotonically_increasing_id()
    return stored(starts.select(F.col("id").alias("start")).distinct().withColumn("_n", n).select("start", F.floor(F.col("_n") / WORD).alias("word"), (F.col("_n") % WORD).cast("int").alias("bit")), "starts")


def reach_bits(numbered: DataFrame, edges: DataFrame, depth: int, direction: str = "out", with_start: bool = True) -> DataFrame:
    """(id, word, bits, hops): the starts of each word that reach a node first after ``hops`` edges, up to ``depth``.

    A start reaches itself at 0; without ``with_start`` it does so only on a way round of up to ``depth`` edges.
    """
    steps = _steps(edges, direction).select("at", "to").distinct()
    front = numbered.groupBy(F.col("start").alias("id"), "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    seen = front if with_start else front.limit(0)
    levels = [seen.withColumn("hops", F.lit(0))]
    for hop in range(1, depth + 1):
        old = seen.select("id", "word", F.col("bits").alias("_old"))
        come = front.join(steps, front["id"] == steps["at"]).groupBy(F.col("to").alias("id"), "word").agg(F.bit_or("bits").alias("bits"))
        new = come.join(old, ["id", "word"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_old", F.lit(0).cast("long"))))).drop("_old")
        front = cut_lineage(new.filter("bits <> 0"))
        levels.append(front.withColumn("hops", F.lit(hop)))
        if hop < depth:
            if front.isEmpty():
                break
            seen = seen.unionByName(front).groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _bit_sums(width: int):
    """The sums of each bit's rows, word by word; rows of one word come one after another."""

    def flush(word: int, sums: np.ndarray) -> pa.RecordBatch:
        own = np.flatnonzero(sums[:, 0])
        return pa.record_batch([pa.array(np.full(len(own), word)), pa.array(own.astype(np.int32)), *(pa.array(sums[own, k]) for k in range(width))], ["word", "bit", *(f"v{k}" for k in range(width))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            words, bits = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values = np.stack([batch.column(2 + k).to_numpy() for k in range(width)], axis=1).astype(np.int64)
            cuts = np.r_[0, np.flatnonzero(np.diff(words)) + 1, len(words)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if words[a] != now:
                    if now is not None:
                        yield flush(now, sums)
                    now, sums = int(words[a]), np.zeros((WORD, width), np.int64)
                each = np.unpackbits(np.ascontiguousarray(bits[a:b]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                sums += each.T.astype(np.int64) @ values[a:b]
        if now is not None:
            yield flush(now, sums)

    return run


def per_start(rows: DataFrame, numbered: DataFrame, sums: dict[str, Column] | None = None, count: str = "n") -> DataFrame:
    """(start, ``count``, sums): for every start how many rows its bit is set in, and the sums of whole numbers over them.

    A word's rows may be many, so they are summed in several tasks.
    """
    sums = sums or {}
    names = [f"v{k}" for k in range(len(sums) + 1)]
    lean = rows.select("word", "bits", F.lit(1).cast("long").alias("v0"), *[c.cast("long").alias(f"v{k + 1}") for k, c in enumerate(sums.values())], F.pmod(F.xxhash64(*[c for c in rows.columns if c not in ("word", "bits")]), F.lit(SALT)).alias("_s"))
    dealt = lean.repartition("word", "_s").sortWithinPartitions("word").drop("_s")
    part = dealt.mapInArrow(_bit_sums(len(names)), "word long, bit int, " + ", ".join(f"{n} long" for n in names))
    total = part.groupBy("word", "bit").agg(*[F.sum(n).alias(n) for n in names])
    return numbered.join(total, ["word", "bit"]).select("start", F.col("v0").alias(count), *[F.col(f"v{k + 1}").alias(n) for k, n in enumerate(sums)])


def traverse_counts(starts: DataFrame, edges: DataFrame, types: list[str] | None = None, depth: int = 2, direction: str = "out", sums: dict[str, Column] | None = None) -> DataFrame:
    """(start, n_nodes, sums, n_edges): what ``traverse`` finds from each start, counted. ``sums`` are over ``id`` and ``hops`` of its nodes."""
    typed = _typed(edges, types)
    numbered = numbered_starts(starts)
    near = reach_bits(numbered, typed, depth, direction)
    on = near.filter(F.col("hops") < depth).join(_steps(typed, direction).distinct(), F.col("id") == F.col("at"))
    on = on.groupBy("src", "dst", "type", "word").agg(F.bit_or("bits").alias("bits"))
    nodes = per_start(near, numbered, sums, "n_nodes")
    found = per_start(on, numbered, count="n_edges")
    return nodes.join(found, "start", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0).cast("long")))


def impact_counts(targets: DataFrame, edges: DataFrame, hops: int = 2, sums: dict[str, Column] | None = None) -> DataFrame:
    """(target, n_dependents, sums): how many nodes ``impact`` finds for each target that has any. ``sums`` are over their ``id``."""
    numbered = numbered_starts(targets)
    near = reach_bits(numbered, edges, hops, "in", with_start=False)
    return per_start(near, numbered, sums, "n_dependents").withColumnRenamed("start", "target")
