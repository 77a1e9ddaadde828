"""Periodic run detection: suffix automaton with link-cut access.

A run is a stretch of words with smallest period q, at least ``min_exponent`` periods and ``min_length`` words long, that no
neighbouring word extends. For one stretch of text:

1. Its suffix automaton is built word by word; the states that are prefixes and their suffix links form a tree, in which the
   path from a prefix to the root holds all its suffixes.
2. Appending a word is an *access* as in link-cut trees: the path from the new prefix to the root takes the new end as
   its last occurrence, and the segments of one colour that are painted over are met on the way. The automaton is known in whole by
   then, so the paths are kept as stacks over the heavy paths of the tree instead of splay trees: an access
   paints the upper part of each heavy path it meets, and what it covers is popped for good.
3. A segment of suffixes up to ``hi`` words with the previous end ``e`` says that the last ``hi`` words before ``e`` and before the
   new end ``i`` are the same, and no longer ones. If ``d = i - e`` is at most ``hi`` that is a square of period ``d``, and it starts as
   far left as that period reaches. The same square found at the following words extends it to the right; what is
   found last is the run.

Most text holds no run. A run needs many neighbouring words whose short word groups were all seen at most a period before, which comparisons of
hashes over whole arrays tell; only stretches that hold such a row of words, with room for every run in them, get an automaton.
That loses nothing: each run lies within one stretch as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.hashing import mix, slices, span_hashes, utf8, windows, word_spans

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"
FLUSH = 1 << 22


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(longest suffix, suffix link) of every state, and the state of every prefix. State 0 is the empty word."""
    length, link, follow, prefix = [0], [-1], [{}], []
    last = 0
    for c in words:
        now = len(length)
        length.append(length[last] + 1)
        link.append(0)
        follow.append({})
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                follow.append(dict(follow[q]))
                link[q] = link[now] = copy
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
        prefix.append(now)
        last = now
    return length, link, prefix


def heavy_paths(length: list[int], link: list[int]) -> tuple[list[int], list[int]]:
    """The path of every state but the root, and the link that each path hangs on."""
    n = len(length)
    order = np.argsort(length, kind="stable").tolist()
    size, heavy = [1] * n, [-1] * n
    for v in reversed(order[1:]):
        up = link[v]
        size[up] += size[v]
        if heavy[up] < 0 or size[v] > size[heavy[up]]:
            heavy[up] = v
    path, above = [0] * n, []
    for v in order[1:]:
        up = link[v]
        if up and heavy[up] == v:
            path[v] = path[up]
        else:
            path[v] = len(above)
            above.append(up)
    return path, above


def squares(words: list[int]) -> dict[tuple[int, int], int]:
    """(start, period) of every stretch of two periods or more that nothing extends to the left, and where it ends last."""
    length, link, prefix = suffix_automaton(words)
    path, above = heavy_paths(length, link)
    reach, ends = [[] for _ in above], [[] for _ in above]
    found = {}
    for i, v in enumerate(prefix):
        below = -1  # the colour that goes on from the path below: its longest suffix was met there
        while v:
            p, x = path[v], length[v]
            lens, cols = reach[p], ends[p]
            top = cols[-1] if cols else -1
            hi = 0
            while lens and lens[-1] <= x:
                hi, e = lens.pop(), cols.pop()
                if i - e <= hi and e != below:
                    found[e - hi + 1, i - e] = i
            if lens and hi < x:
                e = cols[-1]
                if i - e <= x and e != below:
                    found[e - x + 1, i - e] = i
            lens.append(x)
            cols.append(i)
            below = top
            v = above[p]
    return found


def runs_in(words: list[int], min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start, then period."""
    out = []
    for (start, period), end in squares(words).items():
        n = end - start + 1
        if n >= max(min_length, min_exponent * period):
            out.append((start, n, period))
    return sorted(out)


def _stretches(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every stretch of at least ``least`` true values."""
    edge = np.diff(np.r_[0, mask.view(np.int8), 0])
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    long = b - a + 1 >= least
    return a[long], b[long]


def _seen_before(keys: np.ndarray) -> np.ndarray:
    """How far back each key was seen last; a large number if never."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    gap = np.full(len(keys), np.iinfo(np.int64).max)
    gap[order[1:][same]] = order[1:][same] - order[:-1][same]
    return gap


def zones(hashes: np.ndarray, first: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(row, from, to) of the stretches of words that can hold runs, by place. Row r has the words ``first[r]`` to ``first[r + 1]``.

    A run of period q has ``length - q - m + 1`` groups of m words in a row, each seen before at most q words back.
    With ``m <= q < 2 m`` for m = 1, 2, 4 and m = 8 from there on, rows of that many groups are looked for.
    """
    n = len(hashes)
    if min_exponent < 3:
        return [(r, int(a), int(b)) for r, (a, b) in enumerate(zip(first[:-1], first[1:])) if b - a >= min_length]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][row] if n else np.zeros(0, np.int64)
    lo, hi = [], []

    def note(close: np.ndarray, m: int, low: int, high: int) -> None:
        """Periods from ``low`` to ``high``; ``close`` says which groups were seen at most ``high`` words back."""
        a, b = _stretches(close, max(min_length, min_exponent * low) - low - m + 1)
        if len(a):
            lo.append(np.maximum(first[row[a]], a - high))
            hi.append(np.minimum(end[a], b + m))

    own = mix(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # equal words of different rows differ
    for m in (1, 2, 4):
        if n < m + 1:
            break
        groups = own if m == 1 else windows(own, m)
        close = np.zeros(len(groups), bool)
        for d in range(1, 2 * m):
            close[d:] |= groups[d:] == groups[:-d]
        note(close, m, m, 2 * m - 1)
    if n >= 16:
        gap = _seen_before(windows(own, 8))
        low = 8
        while 4 * low <= 2 * n:
            close = gap < 2 * low
            if len(_stretches(gap < n, min_exponent * low - low - 7)[0]) == 0:
                break
            note(close, 8, low, 2 * low - 1)
            low *= 2
    if not lo:
        return []
    lo, hi = np.concatenate(lo), np.concatenate(hi)
    order = np.argsort(lo, kind="stable")
    out = []
    for a, b in zip(lo[order].tolist(), hi[order].tolist()):
        r = int(row[a])
        if out and out[-1][0] == r and a < out[-1][2]:
            out[-1] = (r, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((r, a, b))
    return out


def find(min_length: int, min_exponent: int):
    """Texts to their runs and their words without the repeated periods."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            held, size, begun = [], 0, 0
            for a, b in slices(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, first = word_spans(part, at)
                hashes = span_hashes(part, starts, ends, lower=False)
                runs: dict[int, list] = {}
                for r, x, y in zones(hashes, first, min_length, min_exponent):
                    ids = np.unique(hashes[x:y], return_inverse=True)[1].tolist()
                    runs.setdefault(r, []).extend((int(x - first[r]) + s, n, q) for s, n, q in runs_in(ids, min_length, min_exponent))
                raw = part.tobytes()
                for r in range(b - a):
                    words = raw[at[r] : at[r + 1]].split()
                    n, own = len(words), runs.get(r, [])
                    for s, m, q in own:
                        words[s + q : s + m] = [None] * (m - q)
                    held.append((n, sorted(own), b" ".join(w for w in words if w is not None) if own else b" ".join(words)))
                    size += len(held[-1][2])
                if size > FLUSH:
                    yield _batch(batch.column(0).slice(begun, len(held)), held)
                    held, size, begun = [], 0, b
            if held:
                yield _batch(batch.column(0).slice(begun, len(held)), held)

    return run


def _batch(ids: pa.Array, held: list[tuple]) -> pa.RecordBatch:
    runs = [[{"start": s, "length": m, "period": q} for s, m, q in x[1]] for x in held]
    return pa.record_batch(
        [ids, pa.array([x[0] for x in held], pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array([x[2] for x in held], pa.binary()).cast(pa.string())],
        ["doc_id", "n_words", "runs", "text"],
    )


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, text) of every row of ``docs(doc_id, text)``; nothing is shuffled.

    Words are the runs ``[^\\x20\\x09-\\x0D]+`` as they are written, numbered from 0. ``runs`` lists (start, length, period) by start, then period; runs may overlap.
    ``text`` is the words joined by one blank, without those that a run holds after its first period. A text that is null, empty or
    without words has no words, no runs and an empty text. Words count as equal if their 64-bit hashes are. Rows without an id or with a
    repeated one are taken one by one; other columns are ignored; an empty table gives no rows. A long text is
    one piece of work: its automaton takes about half a kilobyte for each word of the stretches that may hold runs. An exponent
    below 3 is allowed, but gives every text an automaton as a whole.
    """
    if min_length < 2 or min_exponent < 2:
        raise ValueError("a run has at least two periods")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(find(min_length, min_exponent), SCHEMA)
