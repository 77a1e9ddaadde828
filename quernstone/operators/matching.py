"""Joins that are not plain equality: substring containment and edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.ranking import top_k
from quernstone.session import stored

#: Characters of a pattern that it is looked up by, and bits of the table its anchors are tested against first, as powers of two: at least and at most.
ANCHOR = 8
TABLE_BITS = 24
MOST_BITS = 27
#: Windows of one anchor that meet its patterns in one task.
HOT_ROWS = 20_000
BROADCAST_ROWS = 50_000
DELETION_ROWS = 250_000


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than ``limit + 1`` of them."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its size allows, else as it is."""
    return F.broadcast(df) if small_enough(df, limit) else df


def _first_hash(codes: np.ndarray, n: int, lengths: set[int], bits: int = TABLE_BITS) -> Iterator[tuple[int, np.ndarray]]:
    """(length, place in the bit table of every window of that length) for each of ``lengths`` up to ``n``, from rolling hashes."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(1, min(n, len(codes)) + 1):
        h = h[: len(codes) - k + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[k - 1 :] + np.uint64(1)
        if k in lengths:
            yield k, ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _windows(texts: list[str], table: np.ndarray, lengths: set[int]) -> Iterator[tuple[int, int, int, int]]:
    """(text number, start, length, end of the text) of the windows whose bit in ``table`` is set, starts and ends in the joined texts."""
    ends = np.cumsum([len(t) for t in texts])
    for n, places in _first_hash(_codes("".join(texts)), ANCHOR, lengths, _table_bits(table)):
        at = np.flatnonzero((table[places >> np.uint64(3)] >> (np.uint64(7) - (places & np.uint64(7))).astype(np.uint8)) & 1)
        row = np.searchsorted(ends, at, "right")
        inside = at + n <= ends[row]
        yield from zip(row[inside].tolist(), at[inside].tolist(), repeat(n), ends[row[inside]].tolist())


def _strings(values: pd.Series) -> list[str]:
    return [v if isinstance(v, str) else "" for v in values]


def _table_bits(table: np.ndarray) -> int:
    return (8 * len(table)).bit_length() - 1


def _bits_for(anchors: int) -> int:
    """A table of so many bits, as a power of two, lets few other windows through."""
    return min(MOST_BITS, max(TABLE_BITS, (16 * anchors).bit_length()))


def _table_places(anchor: Column, bits: int) -> Column:
    """The place of an anchor in the bit table; anchors have 1 to ``ANCHOR`` characters."""

    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([int(next(p for _, p in _first_hash(_codes(a), len(a), {len(a)}, bits))[0]) for a in _strings(batch)], dtype="int64")

    return F.pandas_udf(places, "long", F.PandasUDFType.SCALAR_ITER)(anchor)


def _bits(places: np.ndarray, bits: int = TABLE_BITS) -> np.ndarray:
    """The table with the bits at ``places`` set, eight to a byte."""
    table = np.zeros(1 << (bits - 3), np.uint8)
    np.bitwise_or.at(table, places >> 3, (128 >> (places & 7)).astype(np.uint8))
    return table


def _found_patterns(text: Column, patterns: list[str]) -> Column:
    """The different patterns that occur in a text; they travel with the function, so they are few."""
    anchors: dict[str, list[str]] = {}
    for p in patterns:
        anchors.setdefault(p[:ANCHOR], []).append(p)
    lengths = {len(a) for a in anchors}

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = _bits(np.array([int(next(p for _, p in _first_hash(_codes(a), len(a), {len(a)}))[0]) for a in anchors], np.int64))
        for batch in batches:
            texts = _strings(batch)
            whole, found = "".join(texts), [set() for _ in texts]
            for row, at, n, end in _windows(texts, table, lengths):
                for p in anchors.get(whole[at : at + n], ()):
                    if len(p) == n or (at + len(p) <= end and whole.startswith(p, at)):
                        found[row].add(p)
            yield pd.Series([list(f) for f in found], dtype=object)

    return F.pandas_udf(find, "array<string>", F.PandasUDFType.SCALAR_ITER)(text)


def _possible_anchors(text: Column, packed: np.ndarray, lengths: set[int]) -> Column:
    """The different windows of a text whose place in the bit table is set: every anchor in it and a few others."""

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = _strings(batch)
            whole, found = "".join(texts), [set() for _ in texts]
            for row, at, n, _ in _windows(texts, packed, lengths):
                found[row].add(whole[at : at + n])
            yield pd.Series([list(f) for f in found], dtype=object)

    return F.pandas_udf(find, "array<string>", F.PandasUDFType.SCALAR_ITER)(text)


def _anchored(patterns: DataFrame) -> tuple[DataFrame, np.ndarray, set[int]]:
    """(patterns with their anchors ``_a``, the bit table of the anchors, their lengths); only the table passes through the driver."""
    cut = stored(patterns.select("_p", F.substring("_p", 1, ANCHOR).alias("_a")), "anchors")
    lengths = {r[0] for r in cut.select(F.length("_a")).distinct().collect()}
    different = cut.select("_a").distinct()
    bits = _bits_for(different.count())
    places = different.select(_table_places(F.col("_a"), bits).alias("at")).distinct().toPandas()["at"]
    return cut, _bits(places.to_numpy(), bits), lengths


def _with_copies(found: DataFrame, texts: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """A text row whose keys are given more than once meets the pattern once for each row with these keys that holds it."""
    key = F.xxhash64(*keys).alias("_h")
    again = stored(texts.select(key).groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1").select("_h"), "again")
    if again.isEmpty():
        return found
    copies = found.withColumn("_h", key).join(broadcast_if_small(again), "_h", "left_semi").groupBy(*keys, pattern).agg(F.count("*").alias("_n"))
    counted = found.join(copies, [*keys, pattern], "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    return counted.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n")


def contains_join(
    texts: DataFrame, patterns: DataFrame, text: str, pattern: str, keys: list[str], on: tuple[str, ...] = (), salt: int = 16,
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """All (text row, pattern row) pairs where ``pattern`` occurs in ``text``.

    A pattern is looked up by its anchor, its first ``ANCHOR`` characters or itself if it is shorter. Rolling hashes of all windows of a text
    are tested against a table of bits set for the anchors, so nothing is made of a text but the windows that may be anchors. Up to ``limit``
    different patterns are compared where the texts lie. Beyond that the windows, with the keys and without the texts, are joined with the
    anchors, those of very many windows salted by the text's key; a pattern that is its own anchor is found with it, for the others the texts join for the check.
    Empty patterns match nothing. ``keys`` identify a text row.
    """
    own = list(dict.fromkeys((*keys, *on)))
    pats = stored(patterns.filter(F.length(pattern) > 0).withColumn("_p", F.col(pattern)), "patterns")
    different = pats.select("_p").distinct()
    known = texts.dropna(subset=own)
    if small_enough(different, limit):
        few = [r[0] for r in different.collect()]
        # The outer form of explode: the inner one would run the function once more for a filter.
        found = known.withColumn("_p", F.explode_outer(_found_patterns(F.col(text), few))).filter("_p is not null")
        return _with_copies(found, known, keys, "_p").join(broadcast_if_small(pats, limit), ["_p", *on]).drop("_p")
    cut, table, lengths = _anchored(different)
    held = stored(known.select(*own, F.explode_outer(_possible_anchors(F.col(text), table, lengths)).alias("_a")).filter("_a is not null"), "held")
    anchored = pats.select("_p", *on).distinct().join(cut, "_p")
    hot = stored(held.groupBy("_a").agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT_ROWS).select("_a", F.lit(salt).alias("_parts")), "hot")
    if hot.isEmpty():
        pairs = held.join(anchored.hint("merge"), ["_a", *on]).select(*keys, "_p")
    else:
        dealt = lambda df: df.join(broadcast_if_small(hot, limit), "_a", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        spread = dealt(anchored).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        salted = dealt(held).withColumn("_salt", F.pmod(F.xxhash64(*keys), F.col("_parts")).cast("int"))
        pairs = salted.join(spread.hint("merge"), ["_a", "_salt", *on]).select(*keys, "_p")
    found = known.join(pairs, keys).filter(F.contains(F.col(text), F.col("_p")))
    return found.join(pats, ["_p", *on]).drop("_p")


def few_per_pattern(
    texts: DataFrame, patterns: DataFrame, text: str, pattern: str, key: str, limit: int, many: int = BROADCAST_ROWS,
) -> DataFrame:
    """(pattern, key): of the texts that hold a pattern the ``limit`` smallest keys. Enough to count a union of patterns up to ``limit``.

    Of more than ``many`` patterns those that are their own anchors are found as windows, of which each task keeps ``limit`` keys before
    anything moves.
    """
    short, long = patterns.select(F.col(pattern).alias("_p")).filter("_p <> ''").distinct(), None
    rows = texts.select(key, text).dropna(subset=[key])
    if not small_enough(short, many):
        cut, table, lengths = _anchored(short.filter(F.length("_p") <= ANCHOR))
        if lengths:
            long = short.filter(F.length("_p") > ANCHOR)
            held = rows.select(key, F.explode_outer(_possible_anchors(F.col(text), table, lengths)).alias("_p")).filter("_p is not null")
            first = top_k(_with_copies(held, rows, [key], "_p"), ["_p"], [F.col(key)], limit).join(cut.select("_p").distinct(), "_p", "left_semi")
            first = first.select(F.col("_p").alias(pattern), key)
    left = short if long is None else long
    found = contains_join(rows, left.withColumnRenamed("_p", pattern), text, pattern, [key], limit=many).select(pattern, key)
    rest = top_k(found, [pattern], [F.col(key)], limit).select(pattern, key)
    return rest if long is None else rest.unionByName(first)


def deletion_keys(word: Column, depth: int) -> Column:
    """The word and every string left after removing up to ``depth`` characters."""

    def drop_one(w: Column) -> Column:
        return F.when(F.length(w) == 0, F.array(w)).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.length(w)),
                lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))),
            )
        )

    level = F.array(word)
    out = level
    for _ in range(depth):
        level = F.array_distinct(F.flatten(F.transform(level, drop_one)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def allowed_edits(word: Column) -> Column:
    """Edits allowed by length: none up to 2 characters, one up to 5, two beyond."""
    return F.when(F.length(word) <= 2, 0).when(F.length(word) <= 5, 1).otherwise(2)


def fuzzy_join(words: DataFrame, vocab: DataFrame, word: str, term: str) -> DataFrame:
    """(word, term, edits) for every vocabulary term within the edits allowed for the word.

    Two strings within d edits share a string reachable by at most d deletions from each,
    so an equality join on those strings finds every pair; the distance is then checked.
    The words' strings are broadcast if they are few, so that the vocabulary's, many times the vocabulary, are compared where they
    arise. Neither side is broadcast by its estimated size, which knows nothing of the strings.
    """
    left = words.select(word).distinct().withColumn("_edits", allowed_edits(F.col(word)))
    left = left.withColumn(
        "_key",
        F.explode(
            F.when(F.col("_edits") == 0, F.array(F.col(word)))
            .when(F.col("_edits") == 1, deletion_keys(F.col(word), 1))
            .otherwise(deletion_keys(F.col(word), 2))
        ),
    )
    # A term of length n can only be near words of n-2 .. n+2 characters.
    right = vocab.select(term).distinct().withColumn(
        "_key",
        F.explode(
            F.when(F.length(term) <= 1, deletion_keys(F.col(term), 0 + 1))
            .when(F.length(term) <= 3, deletion_keys(F.col(term), 1))
            .otherwise(deletion_keys(F.col(term), 2))
        ),
    )
    keyed = stored(left, "deletions")
    near = right.join(F.broadcast(keyed), "_key") if small_enough(keyed, DELETION_ROWS) else right.join(keyed.hint("merge"), "_key")
    return (
        near.select(word, term, "_edits")
        .distinct()
        .withColumn("edits", F.levenshtein(F.col(word), F.col(term)))
        .filter(F.col("edits") <= F.col("_edits"))
        .drop("_edits")
    )
