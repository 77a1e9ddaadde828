"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of features ``x`` is ``w0 + w.x + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``: every pair of
features interacts through low-rank factors, at a cost linear in the features of the text. The logistic of
it is the probability of label 1. It is fitted by AdaGrad on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.hashing import SPACE, slices, span_hashes, utf8, word_spans

WORDS = 1 << 15
#: Byte classes whose share in a text is a statistic.
CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!", b".,;:?", b"\n", bytes(range(0x80, 0x100)),
)
STATS = len(CLASSES) + 5
META = 64
DIM = WORDS + STATS + META
CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _k, _members in enumerate(CLASSES):
    CLASS_OF[list(_members)] = _k


@dataclass
class QualityModel:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    rows: int


def _stats(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, distinct: int, lines: int, repeated: int) -> np.ndarray:
    size = max(1, len(part))
    shares = np.bincount(CLASS_OF[part], minlength=len(CLASSES) + 1)[: len(CLASSES)] / size
    n = len(starts)
    length = (ends - starts).mean() / 10 if n else 0.0
    return np.r_[shares * 4, min(length, 5.0), distinct / max(1, n), np.log1p(n) / 10, repeated / max(1, lines), float(n < 20)]


def line_hashes(part: np.ndarray) -> np.ndarray:
    """The hash of each line of a text that has anything but blanks."""
    cuts = np.flatnonzero(part == 0x0A)
    a, b = np.r_[0, cuts + 1], np.r_[cuts, len(part)]
    held = np.r_[0, np.cumsum(~SPACE[part])]
    some = held[b] > held[a]
    return span_hashes(part, a[some], b[some], lower=False)


def features(column: pa.Array, meta: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, feature ids, values) of every text; ``meta`` is a bucket of the metadata, or -1."""
    data, offsets = utf8(column)
    buckets = meta.fill_null(-1).to_numpy(zero_copy_only=False)
    for lo, hi in slices(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = word_spans(part, at)
        ids = (span_hashes(part, starts, ends) % np.uint64(WORDS)).astype(np.int64)
        for row in range(lo, hi):
            a, b = first[row - lo], first[row - lo + 1]
            words, counts = np.unique(ids[a:b], return_counts=True)
            values = np.log1p(counts)
            if len(values):
                values = values / np.sqrt((values * values).sum())
            own = part[at[row - lo] : at[row - lo + 1]]
            lines = line_hashes(own)
            stats = _stats(own, starts[a:b], ends[a:b], len(words), len(lines), len(lines) - len(np.unique(lines)))
            k = int(buckets[row])
            extra = [WORDS + STATS + k % META] if k >= 0 else []
            yield row, np.r_[words, WORDS + np.arange(STATS), extra].astype(np.int64), np.r_[values, stats, [1.0] * len(extra)]


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, ids, values in features(batch.column(1), batch.column(2)):
            yield pa.record_batch(
                [batch.column(0).slice(row, 1), pa.array([ids.astype(np.int32).tobytes()], pa.binary()), pa.array([values.astype(np.float32).tobytes()], pa.binary())],
                ["label", "ids", "values"],
            )


def _sums(v: np.ndarray, x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(v * x[:, None], cuts, axis=0)


def train(rows: list[tuple[float, np.ndarray, np.ndarray]], rank: int = 8, epochs: int = 6, steps: int = 600, rate: float = 0.1, decay: float = 1e-5, batch: int = 128) -> QualityModel:
    """AdaGrad on the logistic loss over (label, ids, values), in a fixed shuffled order: ``epochs`` times, and ``steps`` batches at least."""
    rng = np.random.default_rng(7)
    w, v = np.zeros(DIM), rng.normal(0, 0.01, (DIM, rank))
    gw, gv, g0 = np.full(DIM, 1e-2), np.full((DIM, rank), 1e-2), 1e-2
    share = np.clip(np.mean([r[0] for r in rows]), 0.01, 0.99) if rows else 0.5
    bias = float(np.log(share / (1 - share)))
    for _ in range(max(epochs, -(-steps * batch // max(1, len(rows))))):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), batch):
            own = [rows[i] for i in order[a : a + batch]]
            y = np.array([r[0] for r in own])
            ids, x = np.concatenate([r[1] for r in own]), np.concatenate([r[2] for r in own])
            cuts = np.cumsum([0, *(len(r[1]) for r in own)])[:-1]
            sizes = np.diff(np.r_[cuts, len(ids)])
            s = _sums(v[ids], x, cuts)
            z = bias + np.add.reduceat(w[ids] * x, cuts) + 0.5 * (s**2 - np.add.reduceat((v[ids] * x[:, None]) ** 2, cuts, axis=0)).sum(axis=1)
            slope = (1 / (1 + np.exp(-z)) - y) / len(own)
            e = np.repeat(slope, sizes) * x
            touched, place = np.unique(ids, return_inverse=True)
            dw = np.bincount(place, weights=e) + decay * w[touched]
            pull = e[:, None] * (np.repeat(s, sizes, axis=0) - v[ids] * x[:, None])
            dv = np.stack([np.bincount(place, weights=pull[:, f]) for f in range(rank)], axis=1) + decay * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            v[touched] -= rate * dv / np.sqrt(gv[touched])
            g0 += slope.sum() ** 2
            bias -= rate * slope.sum() / np.sqrt(g0)
    return QualityModel(bias, w, v, len(rows))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> QualityModel:
    """A model of ``labels(doc_id, quality)`` over ``docs(doc_id, text, n_chars)``.

    At most ``max_rows`` labelled ids, chosen by a hash, are joined to their texts and fitted in one task; rows that repeat a text under its id count
    once, and that number bounds what the task gathers (about 3 KB each) where an id has one text. Null labels and ids teach nothing; without any label the score is the same for every text.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label")).dropna().distinct()
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    texts = _inputs(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "meta", F.xxhash64("text")).agg(F.min("text").alias("text"))
    rows = texts.select("label", "text", "meta").mapInArrow(_sample, "label double, ids binary, values binary")
    [fitted] = rows.repartition(1).mapInArrow(_train, "bias double, weights binary, factors binary, n long").collect()
    factors = np.frombuffer(fitted.factors, np.float64).reshape(DIM, -1)
    return QualityModel(fitted.bias, np.frombuffer(fitted.weights, np.float64), factors, fitted.n)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of one task's rows, which are the bounded sample; in a fixed order, so that reruns agree."""
    made = sorted(x for b in batches for x in zip(*(b.column(k).to_pylist() for k in range(3))))
    model = train([(y, np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(x, np.float32).astype(np.float64)) for y, i, x in made])
    yield pa.record_batch(
        [pa.array([model.bias]), pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.factors.tobytes()], pa.binary()), pa.array([model.rows])],
        ["bias", "weights", "factors", "n"],
    )


def _meta(docs: DataFrame):
    """The metadata's bucket: the power of two that ``n_chars`` lies in, or -1 where it is not given."""
    given = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return F.coalesce(F.when(given >= 0, F.floor(F.log2(given + 1))), F.lit(-1)).cast("int")


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _meta(docs).alias("meta"))


def scores(model: QualityModel, column: pa.Array, meta: pa.Array) -> np.ndarray:
    """The probability of label 1 of every text."""
    out = np.zeros(len(column))
    for row, ids, x in features(column, meta):
        vx = model.factors[ids] * x[:, None]
        z = model.bias + (model.weights[ids] * x).sum() + 0.5 * float((vx.sum(axis=0) ** 2 - (vx**2).sum(axis=0)).sum())
        out[row] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return out


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(scores(sent.value, batch.column(1), batch.column(2)))], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every row of ``docs(doc_id, text, n_chars)``; only the text and its length are read.

    A null text counts as empty; empty texts get the score of their statistics. A missing or null ``n_chars`` is no feature. Repeated rows
    get the same score each; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return _inputs(docs).mapInArrow(_score(sent), "doc_id long, score double")


def accepted(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 2  # the text and its metadata once more, behind the row's own columns
            keep = scores(sent.value, batch.column(n), batch.column(n + 1)) >= threshold
            yield batch.select(list(range(n))).filter(pa.array(keep))

    wide = docs.select("*", F.col("text").cast("string").alias("_scored_text"), _meta(docs).alias("_scored_meta"))
    return wide.mapInArrow(run, docs.schema)
