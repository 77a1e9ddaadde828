"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to ``k`` edits, ``k`` being a share of its length. Cut into ``k + 1``
pieces, at least one piece of any such occurrence is untouched. All pieces of all items are looked for in a document
at once, by an Aho-Corasick automaton; around each hit, Myers' bit-parallel algorithm gives the edit distance
of the item to the best stretch of text.

Texts and items are compared as lower-cased words (letters, digits) joined by single blanks. The documents are read where they
lie: nothing is shuffled. The items go to the tasks in blocks of bounded size, one pass over the documents for each block.

The budget goes by characters, so that scripts without blanks count like others. Items too short for any edit are looked for
as they are, between the bounds of words; next to a letter of a script that sets no blanks any place may be one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOT_WORD = re.compile(r"[\W_]+")
BLOCK_BYTES = 1 << 20
#: Letters of scripts that set no blanks between words: Thai, Lao, Myanmar, Khmer, kana, Chinese characters.
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def normalise(text: str | None) -> str:
    return NOT_WORD.sub(" ", f" {text or ''} ".lower())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``k + 1`` pieces of nearly equal length that make up the item."""
    cuts = [round(i * len(item) / (k + 1)) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(item: str, text: str, k: int, masks: dict[str, int] | None = None) -> tuple[int, int] | None:
    """(distance, end) of the stretch of ``text`` nearest to ``item``, the first of several; None if further than ``k``."""
    m = len(item)
    if masks is None:
        masks = char_masks(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = k + 1, -1
    for at, ch in enumerate(text):
        eq = masks.get(ch, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(xh | plus) & full)
        down = plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (~(xv | up) & full)
        minus = up & xv
        if score < best:
            best, end = score, at + 1
            if not best:
                break
    return (best, end) if best <= k else None


def char_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, ch in enumerate(item):
        masks[ch] = masks.get(ch, 0) | 1 << i
    return masks


def bounded(text: str, start: int, end: int) -> bool:
    """Whether a stretch of normalised text begins and ends where a word may."""
    parted = lambda a, b: " " in (a, b) or UNSPACED.match(a) or UNSPACED.match(b)
    return bool(parted(text[start - 1], text[start]) and parted(text[end - 1], text[end]))


@dataclass
class Block:
    """Some test items: id, text, budget and whether only whole words count; the automaton is built in each task."""

    items: list[tuple[int | None, str, int, bool]]
    masks: dict[int, dict[str, int]] = field(default_factory=dict)
    automaton: object = None

    def built(self):
        if self.automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for n, (_, item, k, _) in enumerate(self.items):
                for at, piece in pieces(item, k):
                    if made.exists(piece):
                        made.get(piece).append((n, at, len(piece)))
                    else:
                        made.add_word(piece, [(n, at, len(piece))])
            made.make_automaton()
            self.automaton = made
        return self.automaton

    def __getstate__(self):
        return {"items": self.items, "masks": {}, "automaton": None}

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item's place, distance, start, end in the normalised text) of the best occurrence of every item found."""
        spans: dict[int, list[tuple[int, int]]] = {}
        whole: dict[int, tuple[int, int]] = {}
        for last, owners in self.built().iter(text):
            for n, at, size in owners:
                _, item, k, words = self.items[n]
                if not k:  # The piece is the item, and its first occurrence counts.
                    if n not in whole and not (words and not bounded(text, last + 1 - size, last + 1)):
                        whole[n] = (last + 1 - size, last + 1)
                    continue
                begin = last + 1 - size - at
                spans.setdefault(n, []).append((max(0, begin - k), min(len(text), begin + len(item) + k)))
        out = [(n, 0, a, b) for n, (a, b) in whole.items()]
        for n, found in spans.items():
            _, item, k, _ = self.items[n]
            masks = self.masks.setdefault(n, char_masks(item))
            best = None
            for a, b in _merged(found):
                hit = myers(item, text[a:b], k, masks)
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], a, a + hit[1])
            if best:
                distance, a, end = best
                back = myers(item[::-1], text[max(a, end - len(item) - k) : end][::-1], distance)
                out.append((n, distance, end - (back[1] if back else len(item)), end))
        return sorted(out)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping stretches as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blocks(items: DataFrame, rate: float, min_words: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The distinct items of ``items(item_id, text)`` in blocks of about ``block_bytes``; only one block is on the driver at a time."""
    made = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull()).distinct()
    size = made.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        rows = made.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        own = sorted({(r.item_id is None, r.item_id or 0, normalise(r.text).strip()) for r in rows})
        kept = [(None if null else i, t, int(len(t) * rate), t.count(" ") + 1 < min_words) for null, i, t in own if t]
        if kept:
            yield Block(kept)


SCHEMA = "doc_id long, item_id long, distance int, budget int, start_word int, end_word int"


def _search(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                plain = normalise(text.as_py())
                for n, distance, a, b in block.matches(plain):
                    item, _, k, _ = block.items[n]
                    rows.append((doc, item, distance, k, plain.count(" ", 0, a + 1) - 1, plain.count(" ", 0, b)))
            if rows:
                cols = list(zip(*rows))
                yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[2:])], [f.split()[0] for f in SCHEMA.split(", ")])

    return run


def contaminations(docs: DataFrame, items: DataFrame, rate: float = 0.05, min_words: int = 8) -> DataFrame:
    """(doc_id, item_id, distance, budget, start_word, end_word): the best occurrence of each test item in each document that holds it.

    ``docs(doc_id, text)`` and ``items(item_id, text)`` compare as lower-cased words; an occurrence may differ by ``rate`` of the
    item's characters (at most ``budget`` edits), and the nearest one counts, the first of several. Words are numbered from 0,
    the end being exclusive. Items too short for an edit that have fewer than ``min_words`` words count only where they stand as whole
    words; items without any letter or digit are not looked for. Null and empty
    texts hold nothing, and null items are skipped; items and documents without ids are searched like others. Repeated documents give their rows
    each, repeated items once. Empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    out = spark.createDataFrame([], SCHEMA)
    for block in blocks(items, rate, min_words):
        out = out.union(rows.mapInArrow(_search(spark.sparkContext.broadcast(block)), SCHEMA))
    return out


def clean_documents(docs: DataFrame, items: DataFrame, rate: float = 0.05, min_words: int = 8) -> DataFrame:
    """The rows of ``docs`` in which no test item occurs, all columns as they are; rules as for ``contaminations``."""
    spark = docs.sparkSession
    out = docs
    for block in blocks(items, rate, min_words):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_columns - 1  # the text once more, behind the row's own columns
                keep = np.array([not sent.value.matches(normalise(t.as_py())) for t in batch.column(n)], bool)
                yield batch.select(list(range(n))).filter(pa.array(keep))

        out = out.select("*", F.col("text").cast("string").alias("_searched_text")).mapInArrow(run, docs.schema)
    return out
