"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed byte n-grams (one to three bytes of its lower-cased letters, other signs as blanks),
weighted by TF-IDF and normalised. Spherical k-means gives each language several centroids; a text gets the
language of the centroid of the largest cosine. A text further from that centroid than its own training texts
ever are, with a margin, is rejected: it keeps the prediction, but is not ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.hashing import slices, utf8
from quernstone.session import stored

DIM = 4096
UNKNOWN = "und"
LETTERS = np.full(256, 0x20, np.uint32)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


@dataclass
class LanguageModel:
    """idf, centroids (rows of unit length), the language of each, and the least cosine each accepts."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray


def ngram_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, n-gram counts) of every text."""
    lowered = pc.utf8_lower(column.fill_null(""))
    data, offsets = utf8(lowered)
    for lo, hi in slices(offsets):
        part = LETTERS[data[offsets[lo] : offsets[hi]]]
        for row in range(lo, hi):
            a, b = offsets[row] - offsets[lo], offsets[row + 1] - offsets[lo]
            x = part[a:b]
            grams = [x]
            if len(x) > 1:
                grams.append((x[:-1] * np.uint32(2654435761) + x[1:] * np.uint32(40503)) >> np.uint32(7))
            if len(x) > 2:
                grams.append((x[:-2] * np.uint32(2246822519) + x[1:-1] * np.uint32(3266489917) + x[2:] * np.uint32(668265263)) >> np.uint32(9))
            ids = np.concatenate(grams) % np.uint32(DIM)
            yield row, np.bincount(ids, minlength=DIM)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors; frequencies count in full, so that of a text in two languages the one it has more of decides."""
    made = counts * idf
    size = np.sqrt((made * made).sum(axis=-1, keepdims=True))
    return made / np.where(size > 0, size, 1)


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, counts in ngram_counts(batch.column(1)):
            yield pa.record_batch([batch.column(0).slice(row, 1), pa.array([counts.astype(np.float32).tobytes()], pa.binary())], ["lang", "counts"])


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of unit length and the place of each row; started from rows far from each other."""
    start = [0]
    while len(start) < min(k, len(x)):
        start.append(int(np.argmin((x @ x[start].T).max(axis=1))))
    centres = x[start].copy()
    for _ in range(rounds):
        place = np.argmax(x @ centres.T, axis=1)
        for c in range(len(centres)):
            if (place == c).any():
                mean = x[place == c].sum(axis=0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres, np.argmax(x @ centres.T, axis=1)


def fit_languages(docs: DataFrame, per_language: int = 400, clusters: int = 4, margin: float = 0.1) -> LanguageModel:
    """A model learnt from a bounded sample of ``docs(doc_id, text, lang)``.

    At most ``per_language`` texts with letters of each language are read, chosen by a hash of their ids; repeated rows count
    once. Each language is fitted in a task of its own, and its centroids come to the driver. Rows without language, id or letters teach nothing. Without any, the model is empty.
    """
    known = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & has_letter(F.col("text")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h")
    # Only ids are ranked; the texts of the chosen ones, whose number is bounded, are read in a second pass.
    lean = known.select("lang", "doc_id", F.xxhash64("text").alias("h")).distinct()
    chosen = lean.withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= per_language).select("lang", "doc_id", "h")
    # Rows that repeat a chosen one fold before their n-grams are counted.
    texts = known.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "doc_id", "h"], "left_semi").groupBy("lang", "doc_id", "h").agg(F.min("text").alias("text"))
    sample = stored(texts.select("lang", "text").mapInArrow(_sample_counts, "lang string, counts binary"), "language_sample")
    held = sample.select("counts").mapInArrow(_text_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    total = sum(r.n for r in held if r.slot == DIM)
    if not total:
        return LanguageModel(np.ones(DIM), np.zeros((0, DIM)), [], np.zeros(0))
    having = np.zeros(DIM + 1)
    for r in held:
        having[r.slot] = r.n
    idf = np.log((1 + total) / (1 + having[:DIM])) + 1
    rows = sample.groupBy("lang").applyInPandas(_fit(idf.astype(np.float32), clusters, margin), "lang string, place int, centroid binary, least double").collect()
    rows.sort(key=lambda r: (r.lang, r.place))
    centroids = np.stack([np.frombuffer(r.centroid, np.float32) for r in rows]).astype(np.float64)
    return LanguageModel(idf, centroids, [r.lang for r in rows], np.array([r.least for r in rows]))


def _text_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, n): the task's texts that hold an n-gram, and under ``DIM`` all of its texts."""
    having = np.zeros(DIM + 1, np.int64)
    for batch in batches:
        for counts in batch.column(0):
            having[:DIM] += np.frombuffer(counts.as_py(), np.float32) > 0
            having[DIM] += 1
    slots = np.flatnonzero(having)
    yield pa.record_batch([pa.array(slots.astype(np.int32)), pa.array(having[slots])], ["slot", "n"])


def _fit(idf: np.ndarray, clusters: int, margin: float):
    """The centroids of one language's texts, whose number is bounded."""

    def run(texts: pd.DataFrame) -> pd.DataFrame:
        # The rows come in no fixed order: sort them, so that the model is the same each time.
        own = _vectors(np.stack([np.frombuffer(c, np.float32) for c in sorted(bytes(c) for c in texts["counts"])]), idf)
        centres, place = _kmeans(own, clusters)
        used = [c for c in range(len(centres)) if (place == c).any()]
        return pd.DataFrame({
            "lang": [texts["lang"].iloc[0]] * len(used), "place": np.array(used, np.int32), "centroid": [centres[c].astype(np.float32).tobytes() for c in used],
            "least": [float((own[place == c] @ centres[c]).min()) - margin for c in used],
        })

    return run


def has_letter(text):
    """Whether a text has a letter; false for null."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _predict(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            lettered = batch.column(2).to_pylist()
            lang, score, fine = [], [], []
            for row, counts in ngram_counts(batch.column(1)):
                if not lettered[row] or not model.languages:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    fine.append(False)
                    continue
                cosine = model.centroids @ _vectors(counts, model.idf)
                best = int(np.argmax(cosine))
                lang.append(model.languages[best])
                score.append(float(min(1.0, max(0.0, cosine[best]))))
                fine.append(bool(cosine[best] >= model.least[best]))
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(fine, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    return run


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every row of ``docs(doc_id, text)``.

    ``lang_pred`` is the language of the nearest centroid and ``score`` its cosine; a text that is null or has no letter is
    ``und`` with the score 0, as is every text under an empty model. Ties go to the first language by name. Only the text
    is read; repeated rows and rows without id get a row each; an empty table gives none.
    """
    text = F.col("text").cast("string")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), has_letter(text).alias("lettered")).mapInArrow(
        _predict(sent), "doc_id long, lang_pred string, score double, accepted boolean"
    )
