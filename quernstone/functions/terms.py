"""The analysed terms of whole texts, batch by batch; the same terms as ``text.analyze`` finds.

Texts come mapped and in lower case. Words are cut by a table over all signs, in place of a pattern that is tried sign by sign.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions import text as T

@lru_cache(maxsize=1)
def _in_words() -> np.ndarray:
    """Whether a sign belongs to words, as ``text.TOKEN`` says: letters, marks, digits and the underscore of any script."""
    signs = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)), bool, 0x110000)
    signs[ord("_")] = True
    return signs


@lru_cache(maxsize=1)
def _folding() -> dict[int, int]:
    return str.maketrans(*T.fold_tables())


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, position, word) of a batch's texts, in text order; a missing text has none."""
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_string())
    if data.max() < 128:
        width, sign, first = None, data, ends
    else:
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        width = np.diff(np.append(at, len(data)))
        sign = data[at].astype(np.int32)
        for n, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
            those = np.flatnonzero(width == n)
            code = sign[those] & mask
            for i in range(1, n):
                code = code << 6 | (data[at[those] + i] & 0x3F)
            sign[those] = code
        first = np.concatenate([[0], np.cumsum(lead)])[ends]
    inside = _in_words()[sign]
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    before[first[first < len(inside)]] = False
    start = np.flatnonzero(inside & ~before)
    row = np.searchsorted(first, start, "right") - 1
    pos = np.arange(len(row)) - np.searchsorted(row, row)
    if width is None:
        sizes, kept = np.add.reduceat(inside, start, dtype=np.int64) if len(start) else np.zeros(0, np.int64), data[inside]
    else:
        sizes = np.add.reduceat(np.where(inside, width, 0), start) if len(start) else np.zeros(0, np.int64)
        kept = data[np.repeat(inside, width)]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return row, pos, pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept)))


def _forms(row: np.ndarray, pos: np.ndarray, tokens: pa.Array, stops: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, position, number of the form, forms by number): the folded form of a word before its own, where they differ, without stop words.

    Words are folded and told from stop words once for all their places.
    """
    coded = tokens.dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    marked = np.flatnonzero(pc.not_equal(pc.binary_length(words), pc.utf8_length(words).cast(pa.int64())).to_numpy(zero_copy_only=False))
    bare = [w.translate(_folding()) for w in words.take(pa.array(marked)).to_pylist()]
    every = pa.concat_arrays([words, pa.array(bare, pa.large_string())]).dictionary_encode()
    numbers, forms = every.indices.to_numpy(), every.dictionary
    own = numbers[: len(words)]
    fold = own.copy()
    fold[marked] = numbers[len(words) :]
    keep = ~pc.is_in(forms, value_set=pa.array(stops, pa.large_string())).to_numpy(zero_copy_only=False)
    if (fold == own).all():
        kept = keep[codes]
        return row[kept], pos[kept], codes[kept], forms
    pairs = np.stack([fold[codes], own[codes]], 1)
    kept = np.stack([keep[fold][codes], (keep[own] & (own != fold))[codes]], 1)
    at, _ = np.nonzero(kept)
    return row[at], pos[at], pairs[kept], forms


def terms_of(mapped: pa.Array, stops: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """``_forms`` of a batch of texts that are mapped and in lower case."""
    return _forms(*_words(mapped), stops)


def term_lists(mapped: Column, stops: list[str]) -> Column:
    """(dl, terms): the forms of a mapped text in one list, in text order, and how many of its positions have any."""

    def find(texts: pa.Array) -> pa.Array:
        row, pos, code, forms = terms_of(texts, stops)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1])
        dl = np.bincount(row[new], minlength=len(texts)).astype(np.int32)
        starts = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
        terms = pa.ListArray.from_arrays(pa.array(starts), forms.take(pa.array(code)).cast(pa.string()))
        return pa.StructArray.from_arrays([pa.array(dl), terms], ["dl", "terms"])

    return F.arrow_udf(find, "dl int, terms array<string>")(mapped)
