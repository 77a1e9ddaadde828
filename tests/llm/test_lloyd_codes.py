import hashlib
import math
import random

import numpy as np
import pytest

from quernstone.llm import lloyd_codes as L
from quernstone.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, code int, row int"


def brute(rows, positions=8, entries=16, rounds=6):
    """Row by row, in Python's integers. rows: (id, vector, label)."""
    kept = [(i, [math.floor(4096 * x) for x in v], y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // positions
    cut = [[v[p * w : (p + 1) * w] for p in range(positions)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(positions)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(positions):
            groups = {}
            for c in cut:
                groups.setdefault(best(c[p], books[p])[1], []).append(c[p])
            for k, g in groups.items():
                books[p][k] = [sum(x) // len(g) for x in zip(*g)]
    out = []
    for (i, _, y), c in zip(kept, cut):
        found = [best(c[p], books[p]) for p in range(positions)]
        out.append((i, y, [k for _, k in found], [e for e, _ in found]))
    return out, books


def vectors(n, width, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.2))) for x in rng.choice(centres)], rng.choice([None, 1, 2])) for i in range(n)]
    rng.shuffle(rows)
    return rows


def same(spark, rows, **kw):
    frame = spark.createDataFrame([(i, v, y, 1, 2) for i, v, y in rows], SCHEMA)
    found, books = L.compress(frame, **kw)
    want, entries = brute(rows, **kw)
    got = [(r.vec_id, r.label, list(r.code), list(r.errors)) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert books.entries.tolist() == entries


@pytest.mark.parametrize("n,width,kw", [(150, 16, {}), (60, 6, {"positions": 3, "entries": 4, "rounds": 3}), (7, 8, {}), (1, 8, {"rounds": 1})])
def test_equals_brute_force(spark, n, width, kw):
    same(spark, vectors(n, width, n), **kw)


def test_one_vector_holds_most_rows(spark):
    rows = vectors(40, 8, 3)
    same(spark, rows + [(100 + k, rows[0][1], 7) for k in range(400)])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = vectors(30, 8, 5)
    odd = [(500, None, 1), (501, [], 1), (502, [1.0, None] + [0.0] * 6, 1), (503, [nan] * 8, 1), (504, [0.0] * 7 + [inf], 2), (505, [-inf] * 8, 2)]
    same(spark, good + odd + [(None, good[0][1], None), (None, good[1][1], 3), (3, good[2][1], 1), (3, good[2][1], 1), (506, [0.0] * 8, 1)])
    wide = spark.createDataFrame([(i, v, y, 1, 2) for i, v, y in good + [(507, [1.0] * 16, 1), (508, [1.0] * 5, 1)]], SCHEMA)
    assert {r.vec_id for r in L.compress(wide)[0].collect()} == {i for i, _, _ in good}
    empty = spark.createDataFrame([], SCHEMA)
    found, books = L.compress(empty)
    assert found.collect() == [] and books.entries.size == 0
    assert L.compress(spark.createDataFrame([(1, None, 1, 1, 1)], SCHEMA))[0].collect() == []


def test_large_components_count_as_the_limit(spark):
    frame = spark.createDataFrame([(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.0] * 8, 1)], "vec_id long, embedding array<float>, label int")
    found, books = L.compress(frame, entries=1, rounds=1)
    limit = L.component_limit(8)
    assert books.entries.ravel().tolist() == [0] * 8
    assert {r.vec_id: r.errors[0] for r in found.collect()} == {1: limit**2, 2: limit**2, 3: 0}


def test_query_digests(spark, sf):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, books = brute(rows)
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    by_label = {}
    for _, y, _, errors in want:
        by_label[y] = by_label.get(y, 0) + sum(errors)
    lines = {(i, "".join(f"{k:02x}" for k in code), sum(errors), by_label[y], digest) for i, y, code, errors in want}
    assert {tuple(r) for r in QUERIES["op13_vector_codes"](spark, sf).collect()} == lines
