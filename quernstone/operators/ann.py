"""Approximate nearest neighbours by a quantised inverted file.

Vectors lie in cells around k-means centres, about the square root of their number of them. Of each vector the index also holds
a short code: its parts' nearest entries in small codebooks. A search scores the codes of the probed cells from one table of
products per query, and reads the vectors themselves only of the best ``rescored`` rows for exact scores. Centres and codebooks are fitted on a bounded sample; every
vector is indexed. The index is written once and read by any number of searches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.operators.ranking import by_score, top_k
from quernstone.operators.vector import cosine, l2_normalize
from quernstone.session import shared_folder, stored

SAMPLE = 20_000
SHELVES = 256
ROUNDS = 12
SLICE = 100_000


@dataclass
class AnnIndex:
    """``rows`` (keys, shelf, cell, code, v) by shelf, a group of cells; ``books[piece, entry]`` are parts of unit vectors."""

    rows: DataFrame
    keys: list[str]
    centres: np.ndarray
    books: np.ndarray
    count: int

    @property
    def probes(self) -> int:
        """Half of the cells."""
        return -(-len(self.centres) // 2)


def lloyd(x: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means centres of the rows of a bounded sample; as many as there are different rows at most."""
    rng = np.random.default_rng(seed)
    kinds = np.unique(x, axis=0)
    centres = kinds[rng.permutation(len(kinds))[:k]]
    for _ in range(rounds if len(kinds) > k else 0):
        near = (x @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def _fit(cells: int, pieces: int, entries: int, seed: int):
    """One group per codebook, and one (piece -1) for the cells."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group.sort_values("h").part.to_numpy()).astype(float)
        made = lloyd(x, cells if key[0] < 0 else entries, seed)
        return pd.DataFrame({"piece": key[0], "entry": np.arange(len(made)), "v": list(made)})

    return run


def build_index(
    vectors: DataFrame, keys: list[str], vec: str = "embedding", cells: int | None = None, pieces: int = 16, entries: int = 256, sample: int = SAMPLE, seed: int = 7,
) -> AnnIndex:
    """The index of all rows of ``vectors`` with a vector; ``pieces`` must divide the width, ``entries`` is 256 at most.

    ``sample`` rows, chosen by a hash of the keys, fit the centres and codebooks, each in a task of its own.
    """
    unit = vectors.filter(F.col(vec).isNotNull()).select(*keys, l2_normalize(F.col(vec)).alias("v"))
    n = unit.count()
    cells = cells or max(1, int(np.ceil(np.sqrt(n))))
    chosen = unit.select("v", F.xxhash64(*keys).alias("h")).orderBy("h").limit(sample)
    width = F.size("v") / pieces
    part = lambda p: F.slice("v", (p * width + 1).cast("int"), width.cast("int"))
    cut = F.concat(F.array(F.struct(F.lit(-1).alias("piece"), F.col("v").alias("part"))), F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda p: F.struct(p.alias("piece"), part(p).alias("part"))))
    fitted = chosen.select("h", F.explode(cut).alias("c")).select("h", "c.piece", "c.part").groupBy("piece").applyInPandas(
        _fit(cells, pieces, entries, seed), "piece int, entry int, v array<double>"
    ).toPandas()
    if not len(fitted):
        return AnnIndex(stored(unit.select(*keys, F.lit(0).alias("cell"), F.lit(b"").alias("code"), "v", F.lit(0).alias("shelf")), "ann"), keys, np.zeros((0, 0)), np.zeros((0, 0, 0)), 0)
    fitted = fitted.sort_values(["piece", "entry"])
    centres = np.stack(fitted[fitted.piece < 0].v.to_numpy())
    books = [np.stack(fitted[fitted.piece == p].v.to_numpy()) for p in range(pieces)]
    # Codebooks of few kinds are filled up with their first entry, which is never nearer than itself.
    most = max(len(b) for b in books)
    books = np.stack([np.concatenate([b, np.repeat(b[:1], most - len(b), axis=0)]) for b in books])
    sent = vectors.sparkSession.sparkContext.broadcast((centres, books))

    def place(frames):
        centres, books = sent.value
        for pdf in frames:
            if not len(pdf):
                continue
            x = np.stack(pdf.v.to_numpy()).astype(float)
            pdf["cell"] = (x @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1).astype(np.int32)
            parts = x.reshape(len(x), len(books), -1)
            codes = np.stack([(parts[:, p] @ b.T - 0.5 * (b**2).sum(axis=1)).argmax(axis=1) for p, b in enumerate(books)], axis=1).astype(np.uint8)
            pdf["code"] = [c.tobytes() for c in codes]
            yield pdf[[*keys, "cell", "code", "v"]]

    schema = T.StructType([*(unit.schema[k] for k in keys), T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType()), unit.schema["v"]])
    each = -(-len(centres) // SHELVES)
    path = shared_folder(vectors.sparkSession, "ann")
    placed = unit.mapInPandas(place, schema).withColumn("shelf", F.floor(F.col("cell") / each).cast("int"))
    # A shelf may be large, so its rows go to several tasks; a file holds whole cells in order as far as possible.
    salt = F.pmod(F.xxhash64(*keys), F.lit(4))
    placed.repartition("shelf", salt).sortWithinPartitions("shelf", "cell").write.partitionBy("shelf").parquet(path)
    return AnnIndex(vectors.sparkSession.read.parquet(path), keys, centres, books, n)


def _score_codes(keys: list[str], keep: int, books: np.ndarray):
    """The best rows of one cell's slice for each query that probes it."""

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], **{k: [] for k in keys}, "shelf": [], "near": []})
        if not len(rows) or not len(asked):
            return empty
        codes = np.frombuffer(b"".join(rows.code), np.uint8).reshape(len(rows), len(books))
        out = []
        for query_id, q in zip(asked.query_id, asked.q):
            table = np.einsum("ped,pd->pe", books, np.asarray(q, float).reshape(len(books), -1))
            near = table[np.arange(len(books)), codes].sum(axis=1)
            best = np.argpartition(-near, keep - 1)[:keep] if len(near) > keep else np.arange(len(near))
            part = rows.iloc[best][[*keys, "shelf"]].assign(near=near[best])
            part.insert(0, "query_id", query_id)
            out.append(part)
        return pd.concat(out)

    return run


def candidates(index: AnnIndex, queries: DataFrame, rescored: int, probes: int | None = None, salt: int = 16) -> DataFrame:
    """(query_id, keys, shelf): the rows of the probed cells with the best codes, ``rescored`` for each query."""
    probes = min(probes or index.probes, len(index.centres))
    q = queries.select("query_id", l2_normalize(F.col("embedding")).alias("q"))
    sent = index.rows.sparkSession.sparkContext.broadcast(index.centres)
    each = -(-len(index.centres) // SHELVES)

    def probe(frames):
        for pdf in frames:
            if len(pdf):
                near = np.stack(pdf.q.to_numpy()).astype(float) @ sent.value.T - 0.5 * (sent.value**2).sum(axis=1)
                pdf["cells"] = list(np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int32))
                yield pdf[["query_id", "q", "cells"]]

    wanted = q.mapInPandas(probe, T.StructType([*q.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])).select(
        "query_id", "q", F.explode("cells").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("_salt")
    ).withColumn("shelf", F.floor(F.col("cell") / each).cast("int"))
    rows = index.rows.select(*index.keys, "shelf", "cell", "code", F.pmod(F.xxhash64(*index.keys), F.lit(salt)).cast("int").alias("_salt"))
    schema = T.StructType([q.schema["query_id"], *(index.rows.schema[k] for k in index.keys), T.StructField("shelf", T.IntegerType()), T.StructField("near", T.DoubleType())])
    # The shelves that are probed at all are known from a join on the partition column, which prunes the scan.
    live = rows.join(wanted.select("shelf").distinct(), "shelf", "left_semi")
    best = live.groupBy("cell", "_salt").cogroup(wanted.groupBy("cell", "_salt")).applyInPandas(_score_codes(index.keys, rescored, index.books), schema)
    return top_k(best, ["query_id"], by_score("near", tuple(index.keys)), rescored).drop("rank", "near")


def knn_ann(index: AnnIndex, queries: DataFrame, k: int, rescored: int = 50, probes: int | None = None) -> DataFrame:
    """(query_id, keys, score, rank): the ``k`` nearest found to each row of ``queries(query_id, embedding)``, by exact cosine, ties by key."""
    asked = queries.select("query_id", "embedding").filter(F.col("embedding").isNotNull())
    if not index.count:
        none = index.rows.select(*index.keys, "v").limit(0)
        return top_k(asked.limit(0).crossJoin(none).select("query_id", *index.keys, F.lit(0.0).alias("score")), ["query_id"], by_score("score", tuple(index.keys)), k)
    found = candidates(index, asked, rescored, probes)
    near = found.join(index.rows.select(*index.keys, "shelf", "v"), [*index.keys, "shelf"]).join(asked, "query_id")
    scored = near.select("query_id", *index.keys, F.round(cosine(F.col("embedding"), F.col("v")), 9).alias("score"))
    return top_k(scored, ["query_id"], by_score("score", tuple(index.keys)), k)
