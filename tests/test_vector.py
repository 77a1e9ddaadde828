import numpy as np
from pyspark.sql import functions as F

from quernstone.operators import ann as A
from quernstone.operators import vector as V
from quernstone.plans.bindings import table


def vectors(spark, n=300, dim=8, seed=1):
    m = np.random.default_rng(seed).normal(size=(n, dim))
    m[7] = 0
    m[11] = m[12]
    return m, spark.createDataFrame([(i, m[i].tolist(), i % 4) for i in range(n)], "vec_id long, embedding array<double>, label int")


def brute(m, q, k, ok=None):
    size = np.linalg.norm(m, axis=1) * np.linalg.norm(q)
    s = np.round(np.divide(m @ q, size, out=np.zeros(len(m)), where=size > 0), 9) + 0.0
    ids = [i for i in range(len(m)) if ok is None or ok(i)]
    return [(i, s[i]) for i in sorted(ids, key=lambda i: (-s[i], i))[:k]]


def check(got, m, qs, k, ok=None):
    for i, q in enumerate(qs):
        rows = sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)
        want = brute(m, q, k, ok)
        assert [r.vec_id for r in rows] == [w[0] for w in want]
        assert np.allclose([r.score for r in rows], [w[1] for w in want])


def test_exact_on_both_paths(spark):
    m, df = vectors(spark)
    qs = np.random.default_rng(2).normal(size=(5, 8))
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs)], "query_id long, embedding array<double>")
    for rows, blocks in ((4096, 1000), (2, 50)):
        got = V.knn_exact(q, df, 6, ["vec_id"], query_rows=rows, block_rows=blocks).collect()
        check(got, m, qs, 6)


def test_filtered_pre_and_post(spark):
    m, df = vectors(spark)
    qs = np.random.default_rng(2).normal(size=(2, 8))
    q = spark.createDataFrame([(i, v.tolist(), [1, 2]) for i, v in enumerate(qs)], "query_id long, embedding array<double>, allow array<int>")
    for rows in (4096, 1):
        got = V.knn_exact(q, df, 6, ["vec_id"], filter_col="label", query_rows=rows, block_rows=70).collect()
        check(got, m, qs, 6, lambda i: i % 4 in (1, 2))
    post = V.knn_filtered(q, df, 6, ["vec_id"], "label", mode="post").collect()
    for i, v in enumerate(qs):
        want = [w[0] for w in brute(m, v, 6) if w[0] % 4 in (1, 2)]
        assert [r.vec_id for r in sorted((r for r in post if r.query_id == i), key=lambda r: r.rank)] == want


def test_ann_recall_and_what_it_reads(spark):
    m, df = vectors(spark, 1500, 32, 5)
    qs = np.random.default_rng(8).normal(size=(6, 32))
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs)], "query_id long, embedding array<double>")
    index = A.build_index(df, ["vec_id"])
    assert index.count == 1500 and len(index.centres) == 39 and index.rows.count() == 1500
    assert index.rows.agg(F.max(F.length("code"))).first()[0] == 16
    assert {r.n for r in A.candidates(index, q, 150).groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {150}
    exact = {(r.query_id, r.vec_id) for r in V.knn_exact(q, df, 10, ["vec_id"]).collect()}
    got = A.knn_ann(index, q, 10, rescored=150, probes=len(index.centres)).collect()
    assert len(exact & {(r.query_id, r.vec_id) for r in got}) / len(exact) >= 0.9
    size = np.linalg.norm(m, axis=1)
    assert all(abs(r.score - m[r.vec_id] @ qs[r.query_id] / (size[r.vec_id] * np.linalg.norm(qs[r.query_id]))) < 1e-8 for r in got)


def test_ann_prunes_shelves_it_does_not_probe(spark):
    m, df = vectors(spark, 200, 16, 6)
    q = spark.createDataFrame([(0, m[3].tolist())], "query_id long, embedding array<double>")
    index = A.build_index(df, ["vec_id"])
    best = A.knn_ann(index, q, 3, probes=1)
    assert best.orderBy("rank").first().vec_id == 3
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    cell = index.rows.filter("vec_id = 3").first().cell
    assert A.candidates(index, q, 500, probes=1).count() == index.rows.filter(F.col("cell") == cell).count()


def test_ann_of_few_equal_and_no_vectors(spark):
    q = spark.createDataFrame([(0, [1.0] * 16), (1, None)], "query_id long, embedding array<double>")
    same = spark.createDataFrame([(i, [2.0] * 16) for i in range(5)] + [(9, None)], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in A.knn_ann(A.build_index(same, ["vec_id"]), q, 3).orderBy("rank").collect()] == [(0, 0, 1.0), (0, 1, 1.0), (0, 2, 1.0)]
    assert A.knn_ann(A.build_index(same.limit(0), ["vec_id"]), q, 3).collect() == []


def test_embeddings_have_unit_length(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    norms = V.embed_batch(docs, ["doc_id"], "text").select(F.round(V.norm(F.col("embedding")), 6).alias("n")).distinct().collect()
    assert [r.n for r in norms] == [1.0]
    own = V.embed_batch(docs, ["doc_id"], "text", encoder=lambda ts: np.array([[len(t) + 1.0, 2.0] for t in ts]))
    assert own.filter(F.abs(V.norm(F.col("embedding")) - 1) > 1e-9).count() == 0
