from pyspark.sql import functions as F

from quernstone.operators import fusion as U
from quernstone.operators.filters import allowed_kinds, row_kind


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id string, chunk_id string, rank int, score double")


def ids(df):
    return [r.doc_id for r in df.orderBy("query_id", "rank").collect()]


A = [(1, "a", "1", 1, 0.9), (1, "b", "1", 2, 0.5), (1, "c", "1", 3, 0.5)]
B = [(1, "b", "1", 1, 12.0), (1, "d", "1", 2, 11.0)]


def test_rrf(spark):
    out = {r.doc_id: r for r in U.rrf(hits(spark, A), hits(spark, B)).collect()}
    assert round(out["b"].score, 9) == round(0.5 / 61 + 0.5 / 62, 9)
    assert (out["b"].bm25_score, out["b"].vector_score, out["b"].payload) == (12.0, 0.5, "keyword")
    assert out["d"].vector_score is None and out["a"].payload == "vector"
    one, two = U.rrf(hits(spark, A), hits(spark, B)), U.rrf(hits(spark, B), hits(spark, A))
    assert ids(one) == ids(two)


def test_rrf_last_copy_wins(spark):
    rows = [(1, "a", "1", 1, 0.9), (1, "a", "1", 4, 0.2)]
    r = U.rrf(hits(spark, rows), hits(spark, [])).first()
    assert round(r.score, 9) == round(0.5 / 64, 9) and r.vector_score == 0.2


def test_weighted(spark):
    out = {r.doc_id: r.score for r in U.weighted_fusion(hits(spark, A), hits(spark, B), 0.5, 0.5).collect()}
    assert out == {"a": 0.5, "b": 0.5, "c": 0.0, "d": 0.0}
    same = hits(spark, [(1, "a", "1", 1, 3.0), (1, "b", "1", 2, 3.0)])
    assert {r.score for r in U.weighted_fusion(same, hits(spark, [])).collect()} == {0.5}


def test_rerank_with_scorer_and_failing_scorer(spark):
    rows = spark.createDataFrame(
        [(1, f"doc{i}", "c", f"text {i}", i, s) for i, s in ((1, 0.8), (2, 0.7), (3, 0.6))],
        "query_id long, doc_id string, chunk_id string, text string, rank int, score double")
    q = spark.createDataFrame([(1, "question")], "query_id long, text string")
    table = {"text 1": 0.9, "text 2": 0.5, "text 3": 0.8}
    good = U.rerank(rows, q, 2, scorer=lambda qs, ts: [table[t] for t in ts])
    assert ids(good) == ["doc1", "doc3"]
    top = good.filter("rank = 2").first()
    assert (top.original_rank, top.original_score, top.score) == (3, 0.6, 0.8)

    def broken(qs, ts):
        raise RuntimeError("no model")

    same = U.rerank(rows, q, scorer=broken)
    assert ids(same) == ["doc1", "doc2", "doc3"] and [r.score for r in same.orderBy("rank").collect()] == [0.8, 0.7, 0.6]
    assert U.rerank(rows.limit(0), q).count() == 0


def test_language_and_model(spark):
    q = spark.createDataFrame([(1, "Điều kiện"), (2, "hello")], "query_id long, text string")
    assert [r[0] for r in q.orderBy("query_id").select(U.detect_language(F.col("text"))).collect()] == ["vi", "en"]
    h = spark.createDataFrame([(1, "học", 1), (1, "abc", 2), (2, "học", 1)], "query_id long, text string, rank int")
    assert {r.query_id: r.model for r in U.route_rerank_model(q, h).collect()} == {1: "vi", 2: "default"}


def test_accumulate_and_stop(spark):
    rows = [(1, it, r, f"passage {p}", 1.0) for it, r, p in ((1, 1, 0), (1, 2, 1), (1, 3, 0), (2, 1, 1), (2, 2, 2), (3, 1, 3), (3, 2, 2))]
    df = spark.createDataFrame(rows, "query_id long, iteration long, rank long, text string, score double")
    kept, new = U.context_accumulate(df, cap=2)
    assert [r.text for r in kept.orderBy("position").collect()] == ["passage 0", "passage 1"]
    assert {r.iteration: r.new_unique for r in new.collect()} == {1: 2, 2: 1, 3: 2}
    rounds = spark.createDataFrame(
        [(1, 1, 0.5, True, ["gap"], "next"), (1, 2, 0.6, True, [], "next"), (2, 1, 0.85, False, ["g"], "n"), (3, 1, 0.2, False, [], None)],
        "query_id long, iteration int, confidence double, can_answer boolean, gaps array<string>, next_query string")
    assert {r.query_id: r.stop_round for r in U.early_stop(rounds).collect()} == {1: 2, 2: 1, 3: None}


def test_gate(spark):
    df = spark.createDataFrame([("complex", 5.0), ("medium", 6.5), ("medium", 7.0), ("simple", 1.0)], "complexity string, score double")
    got = [(r.use_iterative, r.max_iterations) for r in U.iterative_gate(df).collect()]
    assert got == [(True, 2), (True, 2), (True, 3), (False, 2)]
    assert not any(r.use_iterative for r in U.iterative_gate(df, "disabled").collect())
    assert all(r.use_iterative for r in U.iterative_gate(df, "forced").collect())


def test_allowed_kinds_equal_a_plain_filter(spark):
    rows = [(i, ["law", "arts", None][i % 3], 2018 + i % 4, ["en", "vi"][i % 2]) for i in range(24)]
    chunks = spark.createDataFrame(rows, "doc_id long, faculty string, year int, language string")
    asked = [(1, ["law"], None, None, None), (2, ["law", "arts", "law"], [2018, 2019], None, None), (3, [], None, None, None), (4, ["nowhere"], None, None, None), (5, None, None, ["vi"], {"year": "2019"}), (6, None, None, None, {"other": "x"})]
    q = spark.createDataFrame(asked, "query_id int, faculties array<string>, years array<int>, languages array<string>, meta map<string,string>")
    lists = {"faculty": "faculties", "year": "years", "language": "languages"}
    kinds = {r.doc_id: r.kind for r in chunks.select("doc_id", row_kind(tuple(lists)).alias("kind")).collect()}
    got = {}
    for r in allowed_kinds(q, chunks, lists, "meta").collect():
        got.setdefault(r.query_id, set()).add(r.kind)
    assert 3 not in got and got[4] == {None} and got[6] == {None}

    def passes(a, r):
        _, faculties, years, languages, meta = a
        return (not faculties or r[1] in faculties) and (not years or r[2] in years) and (not languages or r[3] in languages) and (not meta or str(r[2]) == meta["year"])

    for a in asked[:2] + asked[4:5]:
        assert {i for i, k in kinds.items() if k in got[a[0]]} == {r[0] for r in rows if passes(a, r)}


def test_requests_with_modes_filters_and_weights(spark):
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    rows = [(i, f"{i}_0", " ".join(words[(i * j) % 5] for j in range(1, 7)), words[i % 5], ["law", "arts"][i % 2], 2018 + i % 3) for i in range(40)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id string, text string, title string, faculty string, year int")
    filters = "struct<doc_types:array<string>,faculties:array<string>,years:array<int>,subjects:array<string>,language:string,metadata_filters:map<string,string>>"
    law = (None, ["law"], None, None, None, None)
    asked = [(1, "alpha beta", "vector", 3, None, None, False, None), (2, "alpha beta", "bm25", 4, None, None, False, law), (3, "gamma delta", "hybrid", 5, 0.9, 0.1, True, law), (4, "gamma", "odd", 2, 0.0, None, None, (None, ["none"], None, None, None, None)), (5, "gamma delta", "hybrid", 5, 0.9, 0.1, False, (None, None, None, None, None, {"year": "2019"}))]
    req = spark.createDataFrame(asked, f"query_id int, text string, mode string, k int, vector_weight double, bm25_weight double, use_rerank boolean, filters {filters}")
    got = U.search_requests(req, chunks, fuzzy=False).collect()
    by = {q: sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"]) for q in range(1, 6)}
    assert [len(by[q]) for q in range(1, 6)] == [3, 4, 5, 0, 5]
    assert {r.source_type for r in by[1]} == {"vector"} and {r.source_type for r in by[2]} == {"bm25"} and {r.source_type for r in by[3]} == {"fused"}
    assert all(r.doc_id % 2 == 0 for r in by[2] + by[3]) and all(r.doc_id % 3 == 1 for r in by[5])
    assert all([r["rank"] for r in rows] == list(range(1, len(rows) + 1)) for rows in by.values())
    plain = U.search(spark.createDataFrame([(2, "alpha beta")], "query_id int, text string"), chunks.filter("faculty = 'law'"), "bm25", 4, use_rerank=False)
    # Document frequencies are those of the whole table, so only the rows are compared where scores tie in the same way.
    assert len(plain.collect()) == 4
    assert all(r.original_rank is not None for r in by[3]) and all(r.original_rank is None for r in by[5])


def test_a_scorer_that_fails_on_one_query_spares_the_others(spark):
    def scorer(queries, texts):
        if "bad" in queries:
            raise RuntimeError("no score")
        return [float(len(t)) for t in texts]

    q = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fine")], "query_id int, text string")
    rows = [(i, f"d{k}", "c", "x" * (5 - k if i == 1 else k + 1), k + 1, 1.0 - k / 10) for i in (1, 2, 3) for k in range(3)]
    h = spark.createDataFrame(rows, "query_id int, doc_id string, chunk_id string, text string, rank int, score double").coalesce(1)
    got = U.rerank(h, q, None, scorer).collect()
    by = {i: [r.doc_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] for i in (1, 2, 3)}
    assert by == {1: ["d0", "d1", "d2"], 2: ["d0", "d1", "d2"], 3: ["d2", "d1", "d0"]}
    assert all(r.rerank_score is None for r in got if r.query_id == 2) and all(r.rerank_score is not None for r in got if r.query_id != 2)
