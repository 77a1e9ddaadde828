import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import keyword as K
from quernstone.operators import matching as M

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()


def corpus(spark, n=60, seed=3):
    rnd = random.Random(seed)
    rows = [(i // 3, f"c{i}", " ".join(rnd.choices(WORDS, k=rnd.randint(1, 12))), " ".join(rnd.choices(WORDS, k=2))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, chunk_id string, text string, title string")


def brute_bm25(rows, query):
    toks = {f: [r[i].split() for r in rows] for f, i in (("text", 2), ("title", 3))}
    out = []
    for d, r in enumerate(rows):
        best = 0.0
        for f, boost in (("text", 1.0), ("title", 1.5)):
            docs = toks[f]
            avg = sum(map(len, docs)) / len(docs)
            s = 0.0
            for t in query.split():
                df = sum(t in x for x in docs)
                tf = docs[d].count(t)
                if tf:
                    s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / avg))
            best = max(best, boost * s)
        if best:
            out.append(((r[0], r[1]), round(best, 6)))
    return dict(out)


def test_analysis_modes(spark):
    df = spark.createDataFrame([("Quy định của trường và Đại học 2024",)], "t string")
    loose = df.select(T.analyze(F.col("t")).alias("x")).first().x
    strict = df.select(T.analyze(F.col("t"), strict=True).alias("x")).first().x
    assert "va" not in loose and "cua" not in loose
    assert "va" in strict and "cua" in strict and "của" not in strict
    assert "dai" in loose and "định" not in loose and "dịnh" in loose and "dinh" in loose


def test_plural_stem(spark):
    df = spark.createDataFrame([(w,) for w in ("ponies", "cats", "boxes", "gas", "us", "glass")], "w string")
    got = [r[0] for r in df.select(T.stem_plural(F.col("w"))).collect()]
    assert got == ["pony", "cat", "boxe", "ga", "us", "glass"]


def test_bm25_matches_brute_force_on_both_join_paths(spark):
    rows, df = corpus(spark)
    q = spark.createDataFrame([(1, "alpha beta"), (2, "kappa kappa zeta")], "query_id long, text string")
    index = K.build_index(df)
    for limit in (10_000, 0):
        got = K.match_scores(K.query_terms(q), index, limit=limit).collect()
        for qid, text in ((1, "alpha beta"), (2, "kappa kappa zeta")):
            mine = {(r.doc_id, r.chunk_id): round(r.score, 6) for r in got if r.query_id == qid}
            assert mine == brute_bm25(rows, text)


def test_phrase_on_both_join_paths(spark):
    rows, df = corpus(spark, 200)
    q = spark.createDataFrame([(1, "alpha beta"), (2, "eta theta iota"), (3, "nowhere")], "query_id long, text string")
    index = K.build_index(df)
    for limit in (10_000, 0):
        got = {(r.query_id, r.chunk_id): r.freq for r in K.phrase_matches(q, df, index, limit=limit).collect()}
        want = {}
        for qid, p in ((1, "alpha beta"), (2, "eta theta iota")):
            for r in rows:
                n = len(re.findall(rf"(?<!\S)(?={p}(?!\S))", r[2]))
                if n:
                    want[(qid, r[1])] = n
        assert got == want


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_fuzzy_join_equals_brute_force(spark):
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choices("abcé", k=rnd.randint(1, 8))) for _ in range(120)})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {(r.w, r.t, r.edits) for r in M.fuzzy_join(df, df.withColumnRenamed("w", "t"), "w", "t").collect()}
    want = set()
    for a in words:
        d = 0 if len(a) <= 2 else 1 if len(a) <= 5 else 2
        want |= {(a, b, lev(a, b)) for b in words if lev(a, b) <= d}
    assert got == want


def test_contains_join(spark):
    rnd = random.Random(9)
    texts = [(i, "".join(rnd.choices("ab c", k=rnd.randint(0, 30)))) for i in range(80)]
    pats = sorted({"".join(rnd.choices("ab c", k=rnd.randint(1, 6))) for _ in range(40)}) + [""]
    t = spark.createDataFrame(texts, "id long, body string")
    p = spark.createDataFrame([(x,) for x in pats], "pat string")
    want = {(i, x) for i, s in texts for x in pats if x and x in s}
    for salt in (1, 16):
        got = [(r.id, r.pat) for r in M.contains_join(t, p, "body", "pat", ["id"], salt=salt).select("id", "pat").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    few = M.few_per_pattern(t, p, "body", "pat", "id", 3).collect()
    assert sorted((r.pat, r.id) for r in few) == sorted((x, i) for x in {x for _, x in want} for i in sorted(i for i, y in want if y == x)[:3])


def test_contains_join_by_anchors(spark):
    rnd = random.Random(10)
    texts = [(i, "".join(rnd.choices("ab đ\U0001f600", k=rnd.randint(0, 60))) + "shared ending" * (i % 3)) for i in range(60)] + [(60, None), (61, "")]
    pats = sorted({t[a : a + n] for _, t in texts[:60] for a, n in [(rnd.randint(0, 20), rnd.randint(1, 14))]} | {"shared ending", "shared e", "shared exit", "đ", "endingsh", "absent"}) + [""]
    t = spark.createDataFrame(texts, "id long, body string").repartition(3)
    p = spark.createDataFrame([(x,) for x in pats], "pat string")
    want = {(i, x) for i, s in texts if s for x in pats if x and x in s}
    first = sorted((x, i) for x in {x for _, x in want} for i in sorted(i for i, y in want if y == x)[:2])
    for limit in (0, 1000):
        got = [(r.id, r.pat) for r in M.contains_join(t, p, "body", "pat", ["id"], limit=limit).select("id", "pat").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert sorted((r.pat, r.id) for r in M.few_per_pattern(t, p, "body", "pat", "id", 2, many=limit).collect()) == first
    # Nothing was stored for the windows of the texts that no pattern starts with.
    assert "regexp" not in M.contains_join(t, p, "body", "pat", ["id"], limit=0)._jdf.queryExecution().optimizedPlan().toString()


def test_contains_join_moves_no_text_with_its_runs(spark):
    t = spark.createDataFrame([(i, "common words " + "abcdef"[i % 6] * 5) for i in range(60)], "id long, body string")
    p = spark.createDataFrame([("common fff",), ("s fff",), ("zzz common",)], "pat string")
    found = M.contains_join(t, p, "body", "pat", ["id"])
    assert {(r.id, r.pat) for r in found.collect()} == {(i, "s fff") for i in range(5, 60, 6)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate regexp" not in plan  # the runs were stored without the texts; only keys come back
    groups = spark.createDataFrame([(1, "ab", 1), (2, "ab", 2)], "id long, body string, g int")
    on = spark.createDataFrame([("ab", 2, "kept")], "pat string, g int, more string")
    assert [(r.id, r.g, r.more) for r in M.contains_join(groups, on, "body", "pat", ["id"], on=("g",)).collect()] == [(2, 2, "kept")]


def test_highlight_keeps_best_fragments_in_order(spark):
    q = spark.createDataFrame([(1, "beta")], "query_id long, text string")
    text = "x " * 95 + "beta one. " + "y " * 100 + "beta beta. " + "z " * 100 + "beta beta beta."
    hits = spark.createDataFrame([(1, text)], "query_id long, text string")
    out = K.highlight(hits, q).first().highlights
    assert len(out) == 2 and "<mark>beta</mark> <mark>beta</mark> <mark>beta</mark>" in out[1].replace("\n", " ")
    assert Counter(re.findall("<mark>", "".join(out)))["<mark>"] == 5


def test_sentence_spans(spark):
    df = spark.createDataFrame([("Short. This sentence is long enough. Tail piece here",)], "t string")
    spans = df.select(T.sentence_spans(F.col("t")).alias("s")).first().s
    assert [(s.start, s.end) for s in spans] == [(7, 35), (37, 52)]


def test_native_operators_have_no_python_node(spark):
    rows, df = corpus(spark)
    q = spark.createDataFrame([(1, "alpha")], "query_id long, text string")
    plan = K.bm25_search(q, df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "Cartesian" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_keeps_one_row_per_row_and_field(spark):
    rows, df = corpus(spark, 50)
    index = K.build_index(df)
    fields = df.select(F.explode(F.array("text", "title")).alias("t")).filter(F.size(T.tokens(F.col("t"))) > 0)
    assert index.rows.count() == fields.count()
    # Rows with equal keys count together, as their terms do.
    twice = K.build_index(df.unionByName(df))
    assert twice.totals.orderBy("field").collect() == index.totals.orderBy("field").collect()
    assert twice.postings().agg(F.sum("tf")).first()[0] == 2 * index.postings().agg(F.sum("tf")).first()[0]


def test_many_weighted_terms_are_not_broadcast_by_size(spark):
    _, df = corpus(spark, 50)
    q = spark.createDataFrame([(1, "alpha beta")], "query_id long, text string")
    assert "BroadcastHashJoin" not in plan_of(K.match_scores(K.query_terms(q), K.build_index(df), limit=0))


def test_fuzzy_join_on_both_join_paths(spark, monkeypatch):
    words = spark.createDataFrame([("alpha",), ("betamax",), ("io",)], "w string")
    vocab = spark.createDataFrame([("alpa",), ("alpha",), ("betmx",), ("betamaxx",), ("i",), ("io",), ("gamma",)], "t string")
    want = [("alpha", "alpa", 1), ("alpha", "alpha", 0), ("betamax", "betamaxx", 1), ("betamax", "betmx", 2), ("io", "io", 0)]
    for limit in (1000, 0):
        monkeypatch.setattr(M, "DELETION_ROWS", limit)
        got = M.fuzzy_join(words, vocab, "w", "t")
        assert sorted(tuple(r) for r in got.collect()) == want
        assert ("BroadcastHashJoin" in plan_of(got)) == (limit > 0)


def test_texts_come_to_hits_found_once(spark):
    _, df = corpus(spark, 50)
    q = spark.createDataFrame([(1, "alpha beta")], "query_id long, text string")
    hits = K.bm25_search(q, df, 5)
    got = K.with_texts(hits, df)
    assert "Window" not in plan_of(got) and got.count() == hits.count()
    texts = {(r.doc_id, r.chunk_id): r.text for r in df.collect()}
    assert all(r.text == texts[(r.doc_id, r.chunk_id)] for r in got.collect())


def test_fulltext_nodes_in_small_tasks(spark, monkeypatch):
    rnd = random.Random(4)
    nodes = spark.createDataFrame([(str(i), rnd.choice("xy"), " ".join(rnd.choices(["red", "green", "blue", "grey"], k=rnd.randint(0, 5)))) for i in range(60)], "id string, label string, name string")
    q = spark.createDataFrame([(1, "red"), (2, "blue grey"), (3, "nothing")], "query_id long, text string")
    rows = lambda **o: sorted(map(tuple, K.fulltext_nodes(q, nodes, ["name"], 7, **o).collect()))
    want = rows()
    assert len(want) == 14
    monkeypatch.setattr(K, "NODES_PER_TASK", 5)
    assert rows() == want == rows(limit=0)


def test_parts_grow_with_the_rows(spark):
    from quernstone.plans.bindings import spread
    from quernstone.session import parts_for

    few, many = spark.range(100).repartition(4), spark.range(1000).repartition(4)
    assert [parts_for(d, 50) for d in (few, many)] == [4, 20]
    assert [spread(d, "id", rows=50).rdd.getNumPartitions() for d in (few, many)] == [4, 20]



def test_postings_with_positions_need_no_grouping(spark):
    texts = ["Quy định của trường, quy Định 2024", "", None, "café cafe CAFÉ được x", "a b a b a"]
    rows = [(i, f"c{i}", t, "định một") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_id string, text string, title string")
    order = lambda d: sorted(tuple(map(str, r)) for r in d.select("doc_id", "chunk_id", "field", "term", "dl", "tf", "positions").collect())
    got = K.build_postings(df, positions=True)
    assert order(got) == order(K._merged_postings(df, ("text", "title"), K.KEYS, True))
    assert "Aggregate" not in plan_of(got)
    twice = df.union(df.filter("doc_id > 2"))
    assert order(K.build_postings(twice, positions=True)) == order(K._merged_postings(twice, ("text", "title"), K.KEYS, True))


def test_near_terms_are_not_broadcast(spark):
    terms = spark.createDataFrame([(1, "alpha", 1.0), (2, "gamma", 2.0)], "query_id long, term string, weight double")
    vocab = spark.createDataFrame([(w,) for w in ("alpha", "alphas", "gama", "beta")], "term string")
    near = K.fuzzy_expand(terms, vocab)
    assert sorted((r.query_id, r.term, r.edits) for r in near.collect()) == [(1, "alpha", 0), (1, "alphas", 1), (2, "gama", 1)]
    assert "BuildLeft" in plan_of(near) and "BuildRight" not in plan_of(near)


def test_contains_join_with_frequent_anchors(spark, monkeypatch):
    t = spark.createDataFrame([(i, f"number {i} of the long list") for i in range(40)], "id long, body string")
    p = spark.createDataFrame([("number 1",), ("number 12 of",), ("list",), ("none",)], "pat string")
    want = sorted((i, q) for i in range(40) for (q,) in [("number 1",), ("number 12 of",), ("list",)] if q in f"number {i} of the long list")
    for hot in (0, 20_000):
        monkeypatch.setattr(M, "HOT_ROWS", hot)
        assert sorted((r.id, r.pat) for r in M.contains_join(t, p, "body", "pat", ["id"], limit=0).collect()) == want
    assert M._bits_for(10) == M.TABLE_BITS < M._bits_for(5_000_000) <= M.MOST_BITS


def test_row_terms_are_the_flat_forms(spark):
    texts = ["Quy định của trường, quy Định 2024", "", None, "café cafe CAFÉ được x", "plain words only", "dé cúa để và là la", "đ\u0130x \u212b ﬁ Ωmega naïve"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for o in ({}, {"strict": True}, {"stop_words": []}, {"stop_words": ["words", "cafe"]}, {"stem": True}):
        want = K.analyzed_fields(df, ("text",), ("doc_id",), **o).select("doc_id", "dl", F.array_sort(F.flatten("forms")).alias("terms"))
        got = K._row_terms(df, ("text",), ("doc_id",), **o).select("doc_id", "dl", F.array_sort("terms").alias("terms"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_term_stats_need_no_grouping_by_row(spark, monkeypatch):
    _, df = corpus(spark, 50)
    order = lambda d: sorted(map(tuple, d.select("field", "term", "df").collect()))
    repeated = df.unionByName(df.filter("doc_id < 5")).unionByName(df.filter("doc_id = 3").withColumn("text", F.lit("alpha omega")))
    index = K.build_index(repeated)
    assert order(index.term_stats) == order(K.build_term_stats(index.postings()))
    want = order(K.build_term_stats(K.build_index(df).postings()))
    monkeypatch.setattr(K.KeywordIndex, "postings", lambda *a: 1 / 0)
    assert order(K.build_index(df).term_stats) == want


def test_phrases_are_compared_only_where_all_terms_are(spark, monkeypatch):
    rows = [(1, "alpha beta gamma"), (2, "alpha gamma"), (3, "beta x alpha"), (4, "gamma delta"), (5, "beta alpha và beta"), (6, "Alphà của beta")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "alpha và beta"), (3, None), (4, "và")], "query_id long, text string")
    index, kept = K.build_index(df, ("text",), ("doc_id",)), {}
    monkeypatch.setattr(K, "stored", lambda d, name, f=K.stored: kept.setdefault(name, f(d, name)))
    found = K.phrase_matches(q, df, index)
    assert sorted((r.query_id, r.doc_id, r.freq) for r in found.collect()) == [(1, 1, 1), (2, 5, 1), (2, 6, 1)]
    assert sorted({r.doc_id for r in kept["possible"].collect()}) == [1, 3, 5, 6]
    assert "terms_" not in plan_of(found)  # the index is gone through once, however often the matches are read


def test_phrases_in_rows_and_queries_given_twice(spark):
    # A text meets a phrase once for each length under its key that has the rarest term, and once for each text of the query.
    rows = [(1, "alpha beta gamma"), (1, "beta alpha"), (2, "alpha beta"), (2, "alpha beta"), (3, "gamma delta")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (2, "gamma delta"), (3, "alpha"), (3, "")], "query_id long, text string")
    for limit in (10_000, 0):
        got = Counter((r.query_id, r.doc_id, r.freq) for r in K.phrase_matches(q, df, K.build_index(df, ("text",), ("doc_id",)), limit=limit).collect())
        assert got == {(1, 1, 1): 2, (1, 2, 1): 2, (2, 3, 1): 2, (3, 1, 1): 4, (3, 1, 3): 2, (3, 1, 4): 2, (3, 2, 1): 2, (3, 2, 3): 2}


def test_terms_of_batches_are_the_analysed_ones(spark):
    from quernstone.functions.terms import term_lists

    texts = ["Quy định của trường, quy Định 2024", "", None, "café_x  cafe\nCAFÉ được x", "plain words only", "và", "Å ﬁ Ωmega 語 naïve é", "éa İx ǅ ÿ–œ ¿q ßs ²½", "a\tb 日本 c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").coalesce(1)
    for stops in (T.stop_list(), []):
        own = None if stops else []
        want = df.select("i", T.analyze(F.coalesce("t", F.lit("")), stop_words=own).alias("terms"))
        got = df.select("i", T.mapped_lower(F.coalesce("t", F.lit(""))).alias("m")).select("i", term_lists(F.col("m"), stops).alias("p")).select("i", "p.terms")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_best_scores_are_those_of_the_whole_match_set(spark, monkeypatch):
    _, df = corpus(spark)
    q = spark.createDataFrame([(1, "alpha beta"), (2, "kappa kappa zeta"), (3, "eta theta iota"), (4, "nowhere")], "query_id long, text string")
    keyed = df.withColumn("kind", F.col("doc_id") % 3)
    twice = keyed.unionByName(keyed.filter("doc_id % 10 = 7")).unionByName(keyed.filter("doc_id % 10 = 8").withColumn("text", F.lit("alpha zeta iota")))
    lets = spark.createDataFrame([(1, 0), (1, 2), (3, None)], "query_id long, kind long")
    terms = K.stored(K.query_terms(q), "terms")
    order = [F.round("score", 9).desc(), F.col("doc_id"), F.col("chunk_id")]
    best = lambda d: sorted((r.query_id, r.rank, r.doc_id, r.chunk_id, round(r.score, 6)) for r in K.top_k(d, ["query_id"], order, 7).collect())
    index = K.build_index(twice, carry=("kind",))
    options = {"phrases": K.stored(K.phrase_scores(K.phrase_matches(q, twice, index)), "scores"), "allowed": lets}
    want = best(K.match_scores(terms, index, **options))
    monkeypatch.setattr(K, "SCORED_AT_ONCE", 10)
    assert best(K.match_scores(terms, index, k=7, **options)) == want and len(want) > 10
    monkeypatch.setattr(K, "QUERIES_AT_ONCE", 2)
    index = K.build_index(df)
    got = K.match_scores(terms, index, k=7)
    assert best(got) == best(K.match_scores(terms, index))
    # No pair of a query and a row is joined.
    assert "Generate" not in plan_of(got) and "Join" not in plan_of(got)
