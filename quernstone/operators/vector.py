"""Vector search: embedding, exact and approximate nearest neighbours, filtered search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions.terms import terms_of
from quernstone.functions.text import mapped_lower, stop_list
from quernstone.operators.ranking import by_score, top_k

QUERY_ROWS = 4096
#: With as many queries as that, the scores of one block take a quarter of a gigabyte.
BLOCK_ROWS = 8_192
DIM = 64


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(
        F.transform(v, lambda x: x.cast("double"))
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def _unit_rows(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1.0)


def hash_embedding(df: DataFrame, keys: list[str], text: str, dim: int = DIM, out: str = "embedding") -> DataFrame:
    """(keys, embedding): signed term counts in ``dim`` hash buckets, L2-normalised; no model needed.

    Terms are found and hashed in the tasks, each different word of a batch once, so nothing is shuffled. Rows without a term have no vector.
    """
    stops = stop_list()
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            row, _, code, forms = terms_of(col("_mapped"), stops)
            digests = [hashlib.md5(w.encode()).hexdigest() for w in forms.to_pylist()]
            bucket = np.array([int(d[:4], 16) % dim for d in digests], np.int64)
            sign = np.array([1.0 - int(d[4], 16) % 2 * 2 for d in digests])
            sums = np.bincount(row * dim + bucket[code], weights=sign[code], minlength=batch.num_rows * dim)
            unit = _unit_rows(sums.reshape(batch.num_rows, dim))
            vecs = pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), dim).cast(pa.list_(pa.float64()))
            made = pa.RecordBatch.from_arrays([*(col(k) for k in keys), vecs], names=[*keys, out])
            yield made.filter(pa.array(np.bincount(row, minlength=batch.num_rows) > 0))

    return df.select(*keys, mapped_lower(F.col(text)).alias("_mapped")).mapInArrow(count, schema)


def embed_batch(
    df: DataFrame, keys: list[str], text: str,
    encoder: Callable[[list[str]], np.ndarray] | None = None, dim: int = DIM,
) -> DataFrame:
    """(keys, embedding) of unit length: ``encoder`` per Arrow batch, or the hashing default."""
    if encoder is None:
        return hash_embedding(df, keys, text, dim)
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vecs = np.asarray(encoder(pdf[text].fillna("").tolist()), dtype=float)
            size = np.linalg.norm(vecs, axis=1, keepdims=True)
            vecs = vecs / np.where(size > 0, size, 1.0)
            yield pdf[keys].assign(embedding=list(vecs))

    return df.select(*keys, text).mapInPandas(run, schema)


def _best(frame: pd.DataFrame, keys: list[str], k: int) -> pd.DataFrame:
    frame = frame.sort_values(["query_id", "score", *keys], ascending=[True, False, *([True] * len(keys))])
    return frame.groupby("query_id", sort=False).head(k)


def _score_block(
    qids: np.ndarray, qmat: np.ndarray, allowed: list | None, vmat: np.ndarray, vals, vkeys: pd.DataFrame, k: int
) -> pd.DataFrame:
    """The k best vectors of one block for every query, ties at the cut included."""
    scores = np.round(qmat @ _unit_rows(vmat).T, 9) + 0.0
    if allowed is not None:
        for i, ok in enumerate(allowed):
            if ok is not None and len(ok):
                scores[i, ~np.isin(vals, np.asarray(list(ok)))] = -np.inf
    n = scores.shape[1]
    cut = np.partition(scores, n - k, axis=1)[:, n - k][:, None] if n > k else np.full((len(qids), 1), -np.inf)
    qi, vi = np.nonzero((scores >= cut) & (scores > -np.inf))
    out = vkeys.iloc[vi].reset_index(drop=True)
    out.insert(0, "query_id", qids[qi])
    out["score"] = scores[qi, vi]
    return out


def knn_exact(
    queries: DataFrame, vectors: DataFrame, k: int, keys: list[str], vec: str = "embedding",
    filter_col: str | None = None, query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, keys, score, rank): the k nearest vectors by cosine, ties by key.

    ``queries``: (query_id, embedding[, allow]); with ``filter_col`` only vectors whose value
    is in the query's ``allow`` list take part (an empty or missing list allows all).

    Up to ``query_rows`` queries travel to the tasks and the vectors are scanned where they
    lie, without a shuffle. More queries are cut into blocks of rows by hash, as are the
    vectors, and every pair of blocks is one task. Either way a task emits no more than the
    best few rows per query, never the pairs it has scored.
    """
    has_allow = filter_col is not None
    qcols = ["query_id", "embedding"] + (["allow"] if has_allow else [])
    queries = queries.select(*qcols).filter(F.col("embedding").isNotNull())
    use = [*keys, vec] + ([filter_col] if has_allow and filter_col not in keys else [])
    vectors = vectors.select(*use).filter(F.col(vec).isNotNull())
    schema = T.StructType(
        [queries.schema["query_id"], *(vectors.schema[c] for c in keys), T.StructField("score", T.DoubleType())]
    )
    head = queries.limit(query_rows + 1).toPandas()
    if len(head) == 0:
        local = vectors.sparkSession.createDataFrame([], schema)
    elif len(head) <= query_rows:
        qids = head["query_id"].to_numpy()
        qmat = _unit_rows(np.stack(head["embedding"].to_numpy()).astype(float))
        allowed = head["allow"].tolist() if has_allow else None

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                col = batch.column(batch.schema.get_field_index(vec))
                vmat = col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                pdf = batch.select(keys).to_pandas()
                vals = batch.column(batch.schema.get_field_index(filter_col)).to_pandas() if has_allow else None
                part = _score_block(qids, qmat, allowed, vmat, vals, pdf, k)
                best = _best(part if best is None else pd.concat([best, part], ignore_index=True), keys, k)
            if best is not None and len(best):
                yield from pa.Table.from_pandas(best, preserve_index=False).to_batches()

        local = vectors.mapInArrow(scan, schema)
    else:
        n_q, n_v = queries.count(), vectors.count()
        qb, vb = -(-n_q // query_rows), max(1, -(-n_v // block_rows))
        cut = queries.withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("int")).withColumn(
            "_vb", F.explode(F.sequence(F.lit(0), F.lit(vb - 1)))
        )
        blocks = vectors.withColumn("_vb", F.pmod(F.xxhash64(*keys), F.lit(vb)).cast("int")).withColumn(
            "_qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))
        )

        def block(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            if len(q) == 0 or len(v) == 0:
                return pd.DataFrame({f.name: [] for f in schema.fields})
            part = _score_block(
                q["query_id"].to_numpy(), _unit_rows(np.stack(q["embedding"].to_numpy()).astype(float)),
                q["allow"].tolist() if has_allow else None, np.stack(v[vec].to_numpy()).astype(float),
                v[filter_col] if has_allow else None, v[keys], k,
            )
            return _best(part, keys, k)

        local = cut.groupBy("_qb", "_vb").cogroup(blocks.groupBy("_qb", "_vb")).applyInPandas(block, schema)
    return top_k(local, ["query_id"], by_score("score", tuple(keys)), k)


def knn_filtered(
    queries: DataFrame, vectors: DataFrame, k: int, keys: list[str], filter_col: str, vec: str = "embedding",
    mode: str = "pre",
) -> DataFrame:
    """Nearest neighbours under a per-query value list (``allow``).

    ``pre`` filters, then takes k; ``post`` takes k, then filters, and may return fewer.
    """
    if mode == "pre":
        return knn_exact(queries, vectors, k, keys, vec, filter_col)
    hits = knn_exact(queries, vectors, k, keys, vec)
    allow = queries.select("query_id", "allow")
    kept = (
        hits.join(vectors.select(*keys, filter_col), keys)
        .join(allow, "query_id")
        .filter(F.col("allow").isNull() | (F.size("allow") == 0) | F.expr(f"array_contains(allow, {filter_col})"))
        .drop("allow", filter_col, "rank")
    )
    return top_k(kept, ["query_id"], by_score("score", tuple(keys)), k)
