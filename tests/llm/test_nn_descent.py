import math
import random

import duckdb
import numpy as np
import pytest

from quernstone.llm import nn_descent as N
from quernstone.llm import queries as Q

SCHEMA = "vec_id long, embedding array<float>, node int, rank int, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "s") for i, v in rows], SCHEMA)


def usable(rows):
    out = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and (i, v) not in out:
            out.append((i, v))
    return out


def brute(rows, asked, k):
    """(query, rank, id, score) of every pair compared."""
    rows, out = usable(rows), []
    for q, x in usable(asked):
        a = math.sqrt(sum(c * c for c in x))
        near = sorted((-sum(c * d for c, d in zip(x, y)) / (a * math.sqrt(sum(d * d for d in y))), i) for i, y in rows if i != q)
        out += [(q, r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(near[:k])]
    return sorted(out)


def answers(spark, rows, asked, k=5, **kw):
    graph = N.build_graph(frame(spark, rows), **kw)
    try:
        return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in N.search(graph, frame(spark, asked), k).collect())
    finally:
        graph.drop()


def vectors(n, width, seed, groups=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    if groups:
        x = rng.normal(size=(groups, width))[rng.integers(0, groups, n)] * 2 + x * 0.3
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize("n,width,groups", [(300, 16, 0), (500, 8, 4)])
def test_small_tables_are_answered_exactly(spark, n, width, groups):
    rows = vectors(n, width, n, groups)
    asked = [r for r in rows if r[0] % 10 == 0] + [(5000 + i, v) for i, v in vectors(10, width, 1)]
    assert answers(spark, rows, asked) == brute(rows, asked, 5)


def test_fewer_rows_than_answers(spark):
    rows = vectors(4, 6, 2)
    assert answers(spark, rows, rows) == brute(rows, rows, 5)
    assert answers(spark, rows[:1], rows[:1]) == []
    assert answers(spark, [], rows) == []
    assert answers(spark, rows, []) == []


def test_many_copies_of_one_vector_and_ties(spark):
    rows = vectors(60, 6, 3)
    rows += [(100 + k, rows[0][1]) for k in range(200)] + [(400 + k, [-c for c in rows[0][1]]) for k in range(3)] + [(500, [2 * c for c in rows[0][1]])]
    rng = random.Random(1)
    rng.shuffle(rows)
    asked = [r for r in rows if r[0] in (0, 5, 100, 150, 299, 401, 500)]
    got, want = answers(spark, rows, asked), brute(rows, asked, 5)
    assert got == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(80, 4, 7)
    odd = [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 0.0, 0.0]), (204, [nan] * 4), (205, [inf, 0.0, 0.0, 0.0]), (None, rows[0][1]), (3, rows[9][1]), rows[5], rows[5]]
    asked = [rows[0], rows[5], (3, rows[9][1]), (9, rows[9][1]), *odd[:7]]
    assert answers(spark, rows + odd, asked) == brute(rows + odd, asked, 5)
    wide = rows + [(300, [1.0] * 5), (301, [1.0])]
    assert answers(spark, wide, [rows[1], (300, [1.0] * 5)]) == brute(rows, [rows[1]], 5)


def test_lists_keep_the_best_and_old_flags():
    own, other = np.array([7, 7, 7, 7, 2]), np.array([1, 3, 1, 5, 9])
    sim, new = np.array([0.5, 0.9, 0.5, 0.7, 0.1], np.float32), np.array([True, True, False, True, True])
    got = N.best_of(own, other, sim, new, 2)
    assert [x.tolist() for x in got[:2]] == [[2, 7, 7], [9, 3, 5]] and got[4].tolist() == [0, 0, 1]
    assert N.best_of(own, other, sim, new, 9)[3].tolist() == [True, True, True, False]
    assert N.best_of(*(np.zeros(0, t) for t in (np.int64, np.int64, np.float32, bool)), 3)[0].tolist() == []


def test_recall_against_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    got = {(r.query_id, r.vec_id): r.score for r in Q.op11_nearest(spark, sf).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = {(q, v): s for q, _, v, s in con.sql(Q.OP11_SQL).fetchall()}
    assert len(got) == len(want)
    assert len(set(got) & set(want)) >= 0.97 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-12 for p in set(got) & set(want))
