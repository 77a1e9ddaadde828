"""Quality rules by distribution divergence.

Each document's histogram of character classes and its histogram of a language's common words are compared to the references
of that language, counted over the whole corpus, by Jensen-Shannon distance (the square root of the divergence to
base 2, from 0 to 1). A document is kept if one language is near enough in both. Short texts say too little about a
distribution: a comparison counts only from a minimum length on, and the divergence of words is taken less what ``n`` words drawn from
the reference itself would show on average, which is ``(classes - 1) / (8 n ln 2)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.factorisation import line_hashes
from quernstone.llm.hashing import SPACE, slices, span_hashes, utf8, windows, word_spans

#: Bytes by class; bytes of no class continue a character of several.
CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\n\x0b\x0c\r", b".,;:?\"'()-", b"!", b"#*$%&|<>",
    b"+/=@[\\]^_`{}~", bytes(range(0xC0, 0x100)),
)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _k, _members in enumerate(CLASSES):
    CLASS_OF[list(_members)] = _k
WINDOW = 8


@dataclass
class References:
    """For each language: class shares, hashes of common words (ascending), their shares and, last, that of all others."""

    languages: list[str]
    classes: list[np.ndarray]
    words: list[np.ndarray]
    shares: list[np.ndarray]


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two distributions."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = (np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()) / 2
    return float(np.sqrt(max(d, 0.0)))


def _class_counts(part: np.ndarray) -> np.ndarray:
    return np.bincount(CLASS_OF[part], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def _corpus_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n): class counts (kind 0) and word counts (kind 1) by language, summed up in the task."""
    classes: dict[str, np.ndarray] = {}
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in classes.items():
            yield _rows(lang, 0, np.arange(len(CLASSES)), counts)
        for lang, lists in held.items():
            keys, n = np.unique(np.concatenate(lists), return_counts=True)
            for a in range(0, len(keys), 200_000):
                yield _rows(lang, 1, keys[a : a + 200_000].view(np.int64), n[a : a + 200_000])

    for batch in batches:
        langs = batch.column(0).to_pylist()
        data, offsets = utf8(batch.column(1))
        for lo, hi in slices(offsets):
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            starts, ends, first = word_spans(part, at)
            hashes = span_hashes(part, starts, ends)
            for row in range(lo, hi):
                lang = langs[row]
                a, b = at[row - lo], at[row - lo + 1]
                classes[lang] = classes.get(lang, 0) + _class_counts(part[a:b])
                held.setdefault(lang, []).append(hashes[first[row - lo] : first[row - lo + 1]])
            size += len(hashes)
            if size > 6_000_000 or len(classes) > 1000:
                yield from flush()
                classes, held, size = {}, {}, 0
    yield from flush()


def _rows(lang: str, kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    size = len(keys)
    return pa.record_batch([pa.array([lang] * size, pa.string()), pa.array(np.full(size, kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "kind", "key", "n"])


def fit_references(docs: DataFrame, common: int = 32) -> References:
    """The references of the languages of ``docs(text, lang)``, counted over all rows whose language is not null.

    ``common`` words of each language are gathered; every language with a word has a reference.
    """
    known = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter(F.col("lang").isNotNull())
    counts = known.mapInArrow(_corpus_counts, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    total = F.sum(F.when(F.col("kind") == 1, F.col("n")))
    # Only a language's sums and commonest words are kept of the counts, in one pass over them.
    best = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.col("n").desc(), "key"))
    ranked = counts.withColumn("_i", best).filter(F.col("_i") <= max(common, len(CLASSES)))
    sums = counts.filter("kind = 1").groupBy("lang").agg(total.alias("words"))
    by_lang: dict[str, list] = {}
    for r in ranked.join(sums, "lang").select("lang", "kind", "key", "n", "words", "_i").collect():
        by_lang.setdefault(r.lang, []).append(r)
    made = References([], [], [], [])
    for lang, own in sorted(by_lang.items()):
        classes = np.zeros(len(CLASSES))
        for r in own:
            if r.kind == 0:
                classes[r.key] = r.n
        top = [r for r in own if r.kind == 1 and r._i <= common]
        words = np.array([r.key for r in top], np.int64).view(np.uint64)
        order = np.argsort(words)
        n = np.array([r.n for r in top], float)[order]
        every = own[0].words
        made.languages.append(lang)
        made.classes.append(classes / classes.sum())
        made.words.append(words[order])
        made.shares.append(np.r_[n, every - n.sum()] / every)
    return made


def _judge(sent, min_chars: int, min_words: int, far_classes: float, far_words: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = sent.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out = []
            for lo, hi in slices(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first = word_spans(part, at)
                raw = span_hashes(part, starts, ends, lower=False)
                low = span_hashes(part, starts, ends)
                runs = windows(raw, WINDOW)
                letters = np.r_[0, np.cumsum(~SPACE[part] & ((part & 0xC0) != 0x80))]
                for row in range(lo, hi):
                    a, b = first[row - lo], first[row - lo + 1]
                    own = part[at[row - lo] : at[row - lo + 1]]
                    out.append(_row(own, int(letters[at[row - lo + 1]] - letters[at[row - lo]]), int(b - a), runs[a : max(a, b - WINDOW + 1)], low[a:b], refs, min_chars, min_words))
            n, chars, symbols, dup, repeat, by_class, by_word = (list(x) for x in zip(*out)) if out else ([],) * 7
            failed = [k < 20 or 100 * r > 30 * k for k, r in zip(n, repeat)]
            near = [c <= far_classes and w <= far_words for c, w in zip(by_class, by_word)]
            yield pa.record_batch(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, chars, symbols, dup, repeat)), pa.array(failed, pa.bool_()),
                 pa.array([ok and not f for ok, f in zip(near, failed)], pa.bool_()), pa.array(by_class, pa.float64()), pa.array(by_word, pa.float64())],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"],
            )

    return run


def _repeated(runs: np.ndarray) -> int:
    """How many words stand in windows that occur more than once."""
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    again = np.zeros(len(runs), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(runs) + WINDOW, np.int64)
    np.add.at(covered, np.flatnonzero(again), 1)
    np.add.at(covered, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def _row(own, chars, n, runs, low, refs: References, min_chars: int, min_words: int):
    lines = line_hashes(own)
    classes = _class_counts(own)
    size = int(classes.sum())
    best = (0.0, 0.0)
    if refs.languages and (size >= min_chars or n >= min_words):
        found = []
        for c, words, shares in zip(refs.classes, refs.words, refs.shares):
            by_class = distance(classes / size, c) if size >= min_chars else 0.0
            by_word = 0.0
            if n >= min_words:
                place = np.minimum(np.searchsorted(words, low), len(words) - 1)
                hit = words[place] == low
                counts = np.bincount(np.where(hit, place, len(words)), minlength=len(words) + 1)
                by_word = float(np.sqrt(max(0.0, distance(counts / n, shares) ** 2 - len(words) / (8 * n * np.log(2)))))
            found.append((by_class + by_word, by_class, by_word))
        best = min(found)[1:]
    return n, chars, int(SYMBOLS[own].sum()), len(lines) - len(np.unique(lines)), _repeated(runs) if len(runs) > 1 else 0, *best


def judge(docs: DataFrame, refs: References, min_chars: int = 120, min_words: int = 30, far_classes: float = 0.32, far_words: float = 0.22) -> DataFrame:
    """(doc_id, the base statistics, base_failed, kept, class_distance, word_distance) of every row of ``docs(doc_id, text)``.

    Of the languages the nearest by the sum of both distances counts. A distance is 0 where the text has fewer
    than ``min_chars`` characters or ``min_words`` words, or where there are no references. ``kept`` is false where ``base_failed``, and
    else tells whether both distances are within ``far_classes`` and ``far_words``. A null or empty text has no words and
    fails. Repeated rows and rows without id get a row each; an empty table gives none; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(refs)
    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
        "class_distance double, word_distance double"
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_judge(sent, min_chars, min_words, far_classes, far_words), schema)
