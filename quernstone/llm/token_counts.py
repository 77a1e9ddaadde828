"""Token counts: pieces are counted once per distinct pre-token and joined to the documents' pre-token frequencies.

1. Every text is cut into pre-tokens as the tokenizer's own rules say, vectorised over code points. The distinct
   pre-tokens of the corpus and their frequencies form the vocabulary, keyed by a 64-bit hash.
2. The tokenizer splits each distinct pre-token once; only the number of its pieces is kept.
3. The pre-tokens above a frequency, at most ``head`` of them, go to every task as two sorted arrays: a broadcast bounded by that
   parameter. All others are joined by shuffling (document, pre-token, frequency), which are few, since words are Zipfian.

No token ids of a document are ever made.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.hashing import BASE, INVERSE, SLICE, _power, mix, slices
from quernstone.session import stored

#: Stands in for a missing id where rows are joined.
LAST = (1 << 63) - 1
# What the vectorised cutter stands for, as the tokenizer file has it.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, DIGIT, OTHER, BLANK = 0, 1, 2, 3


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = DIGIT
    out[SPACES] = BLANK
    return out


@functools.cache
def _values() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def specials(path: str) -> tuple[str, ...]:
    """The special strings of a tokenizer file that this module can cut for; any other file is refused."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    cutter = spec["pre_tokenizer"]["pretokenizers"][0]
    if spec["normalizer"]["normalizers"] != NORMALIZER or cutter["pattern"] != {"Regex": PATTERN} or not cutter["invert"] or spec["post_processor"]:
        raise ValueError(f"{path}: other normalisation or pre-tokens than this operator cuts")
    plain = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}
    if any(t[k] != v for t in spec["added_tokens"] for k, v in plain.items()):
        raise ValueError(f"{path}: added tokens of an unknown kind")
    return tuple(t["content"] for t in spec["added_tokens"])


def _plain(text: str, special: tuple[str, ...]) -> tuple[str, int]:
    """The normalised text with special strings replaced by blanks, and their number."""
    n = 0
    if "<" in text or not all(s.startswith("<") for s in special):
        for s in special:
            if s in text:
                n += text.count(s)
                text = text.replace(s, " ")
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")  # lower-casing knows no final sigma here
    return text.lower(), n


def cut(texts: list[str], special: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, starts, ends, first pre-token of each text, special strings of each text)."""
    plain = [_plain(t, special) for t in texts]
    points = np.frombuffer("".join(t for t, _ in plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.cumsum([0, *(len(t) for t, _ in plain)])
    kind = _classes()[points]
    n = len(points)
    if not n:
        return points, at[:0], at[:0], np.zeros(len(at), np.int64), np.array([k for _, k in plain], np.int64)
    first = np.ones(n, bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first |= edge[:-1]
    # A contraction begins with a quote that no other sign stands before, and takes letters from the word behind it.
    for q in np.flatnonzero((points == 0x27) & first):
        for c in CONTRACTIONS:
            e = q + 1 + len(c)
            if e <= n and not edge[q + 1 : e].any() and all(points[q + 1 + k] == ord(x) for k, x in enumerate(c)):
                first[q + 1] = False
                if e < n:
                    first[e] = True
                break
    starts = np.flatnonzero(first)
    ends = np.r_[starts[1:], n]
    keep = kind[starts] != BLANK
    starts, ends = starts[keep], ends[keep]
    return points, starts, ends, np.searchsorted(starts, at), np.array([k for _, k in plain], np.int64)


def piece_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(points)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_values()[points] * _power(BASE, n)[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * _power(INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def _slices(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    column = column.fill_null("")
    sizes = np.array([0, *pc.binary_length(column).to_numpy(zero_copy_only=False)], np.int64)
    for lo, hi in slices(np.cumsum(sizes), SLICE):
        yield lo, hi, column.slice(lo, hi - lo).to_pylist()


def _distinct(special: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, often, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            h, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate(often)).astype(np.int64)
            return pa.record_batch([pa.array(h.view(np.int64)), pa.concat_arrays(texts).take(pa.array(first)), pa.array(n)], ["hash", "piece", "freq"])

        for batch in batches:
            for _, _, rows in _slices(batch.column(0)):
                points, starts, ends, _, _ = cut(rows, special)
                h, first, count = np.unique(piece_hashes(points, starts, ends), return_index=True, return_counts=True)
                keys.append(h)
                texts.append(pa.array([points[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(starts[first], ends[first])], pa.string()))
                often.append(count)
                held += len(h)
                if held > 1 << 20:
                    yield flush()
                    keys, texts, often, held = [], [], [], 0
        if keys:
            yield flush()

    return run


def _split(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            pieces = batch.column(1).to_pylist()
            n = []
            for a in range(0, len(pieces), 2000):
                n += [len(e.ids) for e in t.encode_batch(pieces[a : a + 2000], add_special_tokens=False)]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), batch.column(2)], ["hash", "n", "freq"])

    return run


def _documents(special: tuple[str, ...], head):
    """(doc, text_hash, n_bytes, n, tail): what the head counts of each document, and the rest of its pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = head.value
        for batch in batches:
            sizes = pc.binary_length(batch.column(2).fill_null(""))
            for lo, hi, rows in _slices(batch.column(2)):
                points, starts, ends, at, extra = cut(rows, special)
                h, inverse = np.unique(piece_hashes(points, starts, ends), return_inverse=True)
                place = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = known[place] == h if len(known) else np.zeros(len(h), bool)
                each = np.where(hit, counts[place], 0)[inverse] if len(known) else np.zeros(len(inverse), np.int64)
                total = np.r_[0, np.cumsum(each)]
                n = total[at[1:]] - total[at[:-1]] + extra
                rest = np.flatnonzero(~hit[inverse])
                owner = np.searchsorted(at, rest, "right") - 1
                pair, freq = np.unique(np.stack([owner, inverse[rest]], axis=1), axis=0, return_counts=True)
                cuts = pa.array(np.searchsorted(pair[:, 0], np.arange(hi - lo + 1)).astype(np.int32))
                tail = pa.ListArray.from_arrays(cuts, pa.array(h[pair[:, 1]].view(np.int64)))
                often = pa.ListArray.from_arrays(cuts, pa.array(freq.astype(np.int64)))
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), sizes.slice(lo, hi - lo).cast(pa.int64()), pa.array(n), tail, often],
                    ["doc", "text_hash", "n_bytes", "n", "tail", "often"],
                )

    return run


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """(hash, n, freq): the pieces and the frequency of every distinct pre-token of ``docs(text)``."""
    found = docs.select(F.col("text").cast("string")).mapInArrow(_distinct(specials(path)), "hash long, piece string, freq long")
    return found.groupBy("hash").agg(F.first("piece").alias("piece"), F.sum("freq").alias("freq")).mapInArrow(_split(path), "hash long, n long, freq long")


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, head: int = 1_000_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs(doc_id, text)``.

    The counts are those of the tokenizer file at ``path`` without tokens added at the ends; special strings in a text count as one.
    A null or empty text has no bytes and no tokens. ``over_limit`` is ``n_tokens > limit``. Repeated rows
    and rows without an id are counted like any other; other columns are ignored; an empty table gives no rows.
    ``head`` bounds the pre-tokens sent to every task (16 bytes each).
    """
    spark = docs.sparkSession
    words = stored(vocabulary(docs, path), "vocabulary")
    by_freq = words.groupBy("freq").count().orderBy(F.col("freq").desc()).toLocalIterator()
    least, total = None, 0
    for freq, n in by_freq:
        total += n
        if total > head:
            break
        least = freq
    top = words.filter(F.col("freq") >= least).select("hash", "n").toArrow() if least is not None else None
    known = top["hash"].to_numpy().view(np.uint64) if top is not None else np.zeros(0, np.uint64)
    order = np.argsort(known)
    sent = spark.sparkContext.broadcast((known[order], top["n"].to_numpy()[order] if top is not None else np.zeros(0, np.int64)))

    text = F.col("text").cast("string")
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = stored(
        base.mapInArrow(_documents(specials(path), sent), "doc long, text_hash long, n_bytes long, n long, tail array<long>, often array<long>"), "token_rows"
    )
    rest = rows.filter(F.size("tail") > 0).dropDuplicates(["doc", "text_hash"]).select("doc", "text_hash", F.explode(F.arrays_zip("tail", "often")).alias("p"))
    rest = rest.select("doc", "text_hash", F.col("p.tail").alias("hash"), F.col("p.often").alias("often"))
    rare = words.filter(F.col("freq") < least) if least is not None else words
    more = rest.join(rare.select("hash", F.col("n").alias("pieces")), "hash").groupBy("doc", "text_hash").agg(F.sum(F.col("often") * F.col("pieces")).alias("more"))
    n = F.col("n") + F.coalesce("more", F.lit(0))
    out = rows.select("doc", "text_hash", "n_bytes", "n").join(more, ["doc", "text_hash"], "left")
    return out.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
