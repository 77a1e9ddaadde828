"""Registered queries for vector search, fusion, reranking and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import ann as A
from quernstone.operators import filters as O
from quernstone.operators import fusion as U
from quernstone.operators import keyword as K
from quernstone.operators import vector as V
from quernstone.operators.ranking import number_rows, top_k
from quernstone.plans import sql_parts as S
from quernstone.plans.bindings import chunks, queries_table, spread, table
from quernstone.plans.keyword import FUZZY_BM25, near_sql
from quernstone.plans.registry import query
from quernstone.session import stored

big = lambda c: F.col(c).cast("bigint").alias(c)
r6 = lambda c: F.round(c, 6).alias(c)


def embed_sql(name: str, src: str, key: str, forms: str) -> str:
    """CTEs {name}_v (key, b, v) and {name}_n (key, n): hashed counts and their length."""
    return f"""
{name}_h AS MATERIALIZED (SELECT term, CAST('0x' || substr(md5(term), 1, 4) AS INTEGER) % 64 AS b,
   1 - 2 * (CAST('0x' || substr(md5(term), 5, 1) AS INTEGER) % 2) AS sg FROM (SELECT DISTINCT term FROM {forms})),
{name}_v AS MATERIALIZED (SELECT {key}, b, CAST(sum(sg) AS DOUBLE) AS v FROM {forms} JOIN {name}_h USING (term) {src} GROUP BY ALL),
{name}_n AS MATERIALIZED (SELECT {key}, sqrt(sum(v * v)) AS n FROM {name}_v GROUP BY ALL)"""


@query(
    "v01_embed_batch",
    f"""WITH chunks AS (SELECT doc_id, text FROM documents), {S.positions('chunks', 'doc_id', ('text',))},
    {embed_sql('d', '', 'doc_id', 'forms')}
    SELECT doc_id, b AS dim, round(v / n, 6) AS value FROM d_v JOIN d_n USING (doc_id) WHERE v <> 0""",
)
def embed(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    vecs = V.embed_batch(docs, ["doc_id"], "text")
    return vecs.select("doc_id", F.posexplode("embedding").alias("dim", "value")).filter("value <> 0").select(
        "doc_id", big("dim"), r6("value")
    )


_CENTROIDS = """
c AS MATERIALIZED (SELECT label AS query_id, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
q AS MATERIALIZED (SELECT query_id, list(x ORDER BY i) AS qv FROM c GROUP BY ALL),
e AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS MATERIALIZED (SELECT query_id, vec_id, label, round(list_cosine_similarity(qv, v), 9) AS score FROM q, e),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


def label_centroids(spark, sf):
    """One query vector per label: the mean of its vectors."""
    e = table(spark, sf, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("x")
    )
    # One entry per dimension is gathered, whatever the number of vectors.
    packed = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))
    return packed.select(F.col("label").alias("query_id"), F.transform("p", lambda s: s["x"]).alias("embedding"))


@query("v02_knn_exact", f"WITH {_CENTROIDS} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def knn(spark, sf):
    hits = V.knn_exact(label_centroids(spark, sf), table(spark, sf, "embeddings"), 10, ["vec_id"])
    return hits.select("query_id", "vec_id", big("rank"), r6("score"))


# The given vectors have no clusters, so the codes of all cells are looked at; the vectors of fifty rows a query are read. The second query
# says how many of the exact neighbours are found, and how much is read.
@query("v03_knn_ann", f"WITH {_CENTROIDS} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def knn_ann(spark, sf):
    index = A.build_index(table(spark, sf, "embeddings"), ["vec_id"])
    return A.knn_ann(index, label_centroids(spark, sf), 10, probes=len(index.centres)).select("query_id", "vec_id", big("rank"), r6("score"))


@query(
    "v03_ann_recall",
    f"""WITH {_CENTROIDS}, n AS (SELECT count(*) AS n FROM e) SELECT query_id, count(*) FILTER (rank <= 10) AS wanted, true AS recall_reached, least(count(*), 50) AS vectors_read, least(50.0, count(*))::DOUBLE / max(n) <= 0.1 AS tenth_read FROM r, n GROUP BY query_id""",
)
def ann_recall(spark, sf):
    e, q = table(spark, sf, "embeddings"), label_centroids(spark, sf)
    index = A.build_index(e, ["vec_id"])
    read = A.candidates(index, q, 50, len(index.centres)).groupBy("query_id").agg(F.count("*").alias("vectors_read"))
    exact = V.knn_exact(q, e, 10, ["vec_id"]).select("query_id", "vec_id")
    hits = A.knn_ann(index, q, 10, probes=len(index.centres)).select("query_id", "vec_id", F.lit(1).alias("hit"))
    per = exact.join(hits, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
    return per.join(read, "query_id").select(
        "query_id", "wanted", (F.col("found") >= 0.9 * F.col("wanted")).alias("recall_reached"), "vectors_read", (F.col("vectors_read") / F.lit(index.count) <= 0.1).alias("tenth_read")
    )


@query(
    "v04_knn_filtered",
    f"""WITH {_CENTROIDS}, ok AS (SELECT *, label IN ((query_id + 1) % 10, (query_id + 2) % 10) AS pass FROM r),
    pre AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ok WHERE pass),
    post AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ok WHERE pass AND rank <= 50)
    SELECT 'pre' AS mode, query_id, vec_id, rank, round(score, 6) AS score FROM pre WHERE rank <= 50
    UNION ALL SELECT 'post', query_id, vec_id, rank, round(score, 6) FROM post""",
)
def knn_filtered(spark, sf):
    q = label_centroids(spark, sf).withColumn(
        "allow", F.array((F.col("query_id") + 1) % 10, (F.col("query_id") + 2) % 10)
    )
    e = table(spark, sf, "embeddings")
    both = [
        V.knn_filtered(q, e, 50, ["vec_id"], "label", mode=m).withColumn("mode", F.lit(m)) for m in ("pre", "post")
    ]
    return both[0].unionByName(both[1]).select("mode", "query_id", "vec_id", big("rank"), r6("score"))


# Two ranked lists per supplier: all its lines by price and by discounted quantity.
_LISTS = """
l AS (SELECT l_suppkey AS query_id, l_orderkey AS doc_id, l_linenumber AS chunk_id, l_extendedprice AS price, l_quantity * (1 - l_discount) AS qty FROM lineitem),
l2 AS (SELECT query_id, doc_id, chunk_id, max(price) AS price, round(max(qty), 6) AS qty FROM l GROUP BY ALL),
kw AS (SELECT query_id, doc_id, chunk_id, price AS score, row_number() OVER (PARTITION BY query_id ORDER BY price DESC, doc_id, chunk_id) AS rank FROM l2),
vec AS (SELECT query_id, doc_id, chunk_id, qty AS score, row_number() OVER (PARTITION BY query_id ORDER BY qty DESC, doc_id, chunk_id) AS rank FROM l2)"""


def ranked_lists(spark, sf):
    l = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_id"),
        F.col("l_extendedprice").alias("price"), (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("qty"),
    ).groupBy("query_id", "doc_id", "chunk_id").agg(F.max("price").alias("price"), F.round(F.max("qty"), 6).alias("qty"))
    cut = lambda c: top_k(
        l.select("query_id", "doc_id", "chunk_id", F.col(c).alias("score")), ["query_id"],
        [F.col("score").desc(), F.col("doc_id"), F.col("chunk_id")], None,
    )
    return cut("qty"), cut("price")


@query(
    "u01_rrf",
    f"""WITH {_LISTS}, f AS (SELECT query_id, doc_id, chunk_id, round(coalesce(0.4 / (60 + kw.rank), 0) + coalesce(0.6 / (60 + vec.rank), 0), 12) AS score,
      kw.score AS bm25_score, vec.score AS vector_score FROM kw FULL JOIN vec USING (query_id, doc_id, chunk_id))
    SELECT query_id, doc_id, chunk_id, round(score, 9) AS score, bm25_score, vector_score,
      row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_id) AS rank FROM f""",
)
def rrf(spark, sf):
    vec, kw = ranked_lists(spark, sf)
    return U.rrf(vec, kw, 0.6, 0.4).select(
        "query_id", "doc_id", "chunk_id", F.round("score", 9).alias("score"), "bm25_score", "vector_score", big("rank")
    )


@query(
    "u02_weighted_fusion",
    f"""WITH {_LISTS}, kn AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM kw),
    vn AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM vec),
    ku AS (SELECT *, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS u FROM kn),
    vu AS (SELECT *, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS u FROM vn),
    f AS (SELECT query_id, doc_id, chunk_id, round(0.7 * coalesce(vu.u, 0) + 0.3 * coalesce(ku.u, 0), 12) AS score,
          CASE WHEN vu.score IS NOT NULL THEN 'vector' ELSE 'keyword' END AS payload
          FROM ku FULL JOIN vu USING (query_id, doc_id, chunk_id))
    SELECT query_id, doc_id, chunk_id, payload, round(score, 9) AS score,
      row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_id) AS rank FROM f""",
)
def weighted(spark, sf):
    vec, kw = ranked_lists(spark, sf)
    return U.weighted_fusion(vec, kw, 0.7, 0.3).select(
        "query_id", "doc_id", "chunk_id", "payload", F.round("score", 9).alias("score"), big("rank")
    )


@query(
    "u03_union_fallback",
    f"""WITH {_LISTS}, b AS (SELECT query_id, doc_id, chunk_id, score, 0 AS src FROM vec UNION ALL SELECT query_id, doc_id, chunk_id, score, 1 FROM kw),
    n AS (SELECT query_id, greatest(count(*) FILTER (src = 0), count(*) FILTER (src = 1)) AS n FROM b GROUP BY query_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_id, src) AS rank FROM b)
    SELECT query_id, doc_id, chunk_id, score, src, rank FROM r JOIN n USING (query_id) WHERE rank <= n""",
)
def union_lists(spark, sf):
    vec, kw = ranked_lists(spark, sf)
    return U.union_fallback(vec, kw).select("query_id", "doc_id", "chunk_id", "score", big("src"), big("rank"))


_OVERLAP = """
{hits}_qt AS MATERIALIZED (SELECT query_id, list(DISTINCT term) AS qt FROM q_forms GROUP BY ALL),
{hits}_ct AS MATERIALIZED (SELECT doc_id, chunk_id, list(DISTINCT term) AS ct FROM forms WHERE field = 'text' GROUP BY ALL),
{hits}_s AS MATERIALIZED (SELECT h.*, round(len(list_intersect(qt, coalesce(ct, []))) / len(list_distinct(list_concat(qt, coalesce(ct, [])))), 9) AS rerank_score
  FROM {hits} h JOIN {hits}_qt USING (query_id) LEFT JOIN {hits}_ct USING (doc_id, chunk_id))"""


@query(
    "u04_rerank",
    f"""WITH {S.SEARCH}, {S.BM25_RANKED}, hits AS MATERIALIZED (SELECT * FROM bm25 WHERE rank <= 16), {_OVERLAP.format(hits='hits')},
    r AS (SELECT query_id, doc_id, chunk_id, rank AS original_rank, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, doc_id, chunk_id) AS rank FROM hits_s)
    SELECT query_id, doc_id, chunk_id, original_rank, round(rerank_score, 6) AS score, rank FROM r WHERE rank <= 8""",
)
def rerank(spark, sf):
    rows, q = chunks(spark, sf), queries_table(spark, sf)
    hits = K.with_texts(K.bm25_search(q, rows, 16), rows)
    return U.rerank(hits, q, 8).select("query_id", "doc_id", "chunk_id", big("original_rank"), r6("score"), big("rank"))


_LETTERS = U.VIETNAMESE_LETTERS


@query(
    "u06_detect_language",
    f"SELECT doc_id, CASE WHEN regexp_matches(lower(text), '[{_LETTERS}]') THEN 'vi' ELSE 'en' END AS language FROM documents",
)
def detect_language(spark, sf):
    return table(spark, sf, "documents").select("doc_id", U.detect_language(F.col("text")).alias("language"))


@query(
    "u07_route_rerank_model",
    f"""WITH f AS (SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '[{_LETTERS}]') THEN 1 ELSE 0 END AS vi,
          row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rank FROM conversations)
    SELECT conv_id AS query_id, CASE WHEN sum(vi) > count(*) / 2 THEN 'vi' ELSE 'default' END AS model FROM f WHERE rank <= 3 GROUP BY ALL""",
)
def route_model(spark, sf):
    turns = top_k(table(spark, sf, "conversations").withColumnRenamed("conv_id", "query_id"), ["query_id"], [F.col("turn")], 4, "n")
    first = turns.filter("n = 1").select("query_id", "text")
    hits = turns.filter("n > 1").select("query_id", "text", (F.col("n") - 1).alias("rank"))
    return U.route_rerank_model(first, hits)


_HYBRID = f"""{S.SEARCH}, {S.BM25_RANKED},
text_forms AS MATERIALIZED (SELECT doc_id, chunk_id, term FROM forms WHERE field = 'text'),
{embed_sql('d', '', 'doc_id, chunk_id', 'text_forms')}, {embed_sql('e', '', 'query_id', 'q_forms')},
sim AS MATERIALIZED (
  SELECT query_id, d_n.doc_id, d_n.chunk_id, round(CASE WHEN d_n.n > 0 AND e_n.n > 0 THEN coalesce(dp, 0) / (d_n.n * e_n.n) ELSE 0 END, 9) + 0.0 AS score
  FROM e_n CROSS JOIN d_n LEFT JOIN (SELECT query_id, doc_id, chunk_id, sum(d_v.v * e_v.v) AS dp FROM e_v JOIN d_v USING (b) GROUP BY ALL) x
    USING (query_id, doc_id, chunk_id)),
knn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_id) AS rank FROM sim)"""


def _fused(n: int) -> str:
    return f"""
fused AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_id) AS rank FROM (
  SELECT query_id, doc_id, chunk_id, round(coalesce(0.5 / (60 + b.rank), 0) + coalesce(0.5 / (60 + k.rank), 0), 12) AS score
  FROM (SELECT * FROM bm25 WHERE rank <= {n}) b FULL JOIN (SELECT * FROM knn WHERE rank <= {n}) k USING (query_id, doc_id, chunk_id)))"""


@query(
    "u08_search",
    f"""WITH {_HYBRID}, {_fused(32)}, {_OVERLAP.format(hits='fused')},
    r AS (SELECT query_id, doc_id, chunk_id, rank AS original_rank, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, doc_id, chunk_id) AS rank FROM fused_s)
    SELECT query_id, doc_id, chunk_id, original_rank, round(rerank_score, 6) AS score, rank FROM r WHERE rank <= 8""",
)
def hybrid(spark, sf):
    hits = U.search(queries_table(spark, sf), chunks(spark, sf), "hybrid", 8)
    return hits.select("query_id", "doc_id", "chunk_id", big("original_rank"), r6("score"), big("rank"))


# Every benchmark text as a request: mode, number of hits, weights, filters and reranking go by its number.
_REQUESTS = """req AS MATERIALIZED (SELECT item_id AS query_id, ['vector', 'bm25', 'hybrid'][item_id % 3 + 1] AS mode, 4 + item_id % 5 AS k, item_id % 5 <> 0 AS use_rerank,
  CASE WHEN item_id % 4 = 0 THEN 0.7 ELSE 0.5 END AS wv, CASE WHEN item_id % 4 = 0 THEN 0.3 ELSE 0.5 END AS wk, CASE WHEN item_id % 2 = 0 THEN ['science', 'law'] END AS faculties,
  CASE WHEN item_id % 6 = 1 THEN [2019, 2020, 2022, 2024] END AS years, CASE WHEN item_id % 7 = 3 THEN 'en' END AS language, CASE WHEN item_id % 11 = 5 THEN 'arts' END AS meta FROM benchmark),
passes AS MATERIALIZED (SELECT query_id, doc_id, chunk_id FROM req JOIN chunks c ON (req.faculties IS NULL OR list_contains(req.faculties, c.faculty)) AND (req.years IS NULL OR list_contains(req.years, c.year))
  AND (req.language IS NULL OR req.language = c.language) AND (req.meta IS NULL OR req.meta = c.faculty))"""


def _request_sql(fuzzy: bool = False, fusion: str = "rrf") -> str:
    search = _HYBRID
    if fuzzy:
        search = search.replace(S.SEARCH, f"""{S.CHUNKS}, {S.QUERIES}, {S.positions('chunks', 'doc_id, chunk_id')}, {S.QUERY_FORMS}, {near_sql('SELECT DISTINCT term FROM postings')},
    best_terms AS MATERIALIZED (SELECT query_id, term, max(weight) AS weight FROM fuzzy_terms GROUP BY ALL), {FUZZY_BM25}, {S.PHRASE}""")
    both = "coalesce(wv / (60 + v.rank), 0) + coalesce(wk / (60 + b.rank), 0)" if fusion == "rrf" else "wv * coalesce(v.unit, 0) + wk * coalesce(b.unit, 0)"
    unit = "CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS unit"
    ranked = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_id) AS rank"
    return f"""WITH {search}, {_REQUESTS},
    fv AS (SELECT s.*, {ranked} FROM sim s JOIN passes USING (query_id, doc_id, chunk_id)),
    fb AS (SELECT query_id, doc_id, chunk_id, score, {ranked} FROM (SELECT query_id, doc_id, chunk_id, score FROM bm25) JOIN passes USING (query_id, doc_id, chunk_id)),
    cv AS MATERIALIZED (SELECT fv.*, mode, {unit} FROM fv JOIN req USING (query_id) WHERE mode <> 'bm25' AND rank <= CASE mode WHEN 'vector' THEN greatest(4 * k, 16) ELSE greatest(4 * k, 20) END WINDOW w AS (PARTITION BY query_id)),
    cb AS MATERIALIZED (SELECT fb.*, mode, {unit} FROM fb JOIN req USING (query_id) WHERE mode <> 'vector' AND rank <= CASE mode WHEN 'bm25' THEN greatest(2 * k, 12) ELSE greatest(4 * k, 20) END WINDOW w AS (PARTITION BY query_id)),
    fu AS (SELECT query_id, doc_id, chunk_id, round({both}, 12) AS score FROM (SELECT * FROM cv WHERE mode = 'hybrid') v FULL JOIN (SELECT * FROM cb WHERE mode = 'hybrid') b USING (query_id, doc_id, chunk_id) JOIN req USING (query_id)),
    found AS MATERIALIZED (SELECT query_id, doc_id, chunk_id, score, rank, 'vector' AS source_type FROM cv WHERE mode = 'vector' UNION ALL SELECT query_id, doc_id, chunk_id, score, rank, 'bm25' FROM cb WHERE mode = 'bm25'
      UNION ALL SELECT query_id, doc_id, chunk_id, score, {ranked}, 'fused' FROM fu), {_OVERLAP.format(hits='found')},
    o AS (SELECT *, CASE WHEN use_rerank THEN row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, doc_id, chunk_id) ELSE rank END AS place FROM found_s JOIN req USING (query_id))
    SELECT query_id, mode, source_type, doc_id, chunk_id, CASE WHEN use_rerank THEN rank END AS original_rank, round(CASE WHEN use_rerank THEN rerank_score ELSE score END, 6) AS score, place AS rank FROM o WHERE place <= k"""


def request_table(spark, sf):
    i = F.col("item_id")
    none = F.lit(None).cast("array<string>")
    words = lambda *xs: F.array(*[F.lit(x) for x in xs])
    raw = table(spark, sf, "benchmark").select(
        i.alias("query_id"), F.col("text").alias("query"), (4 + i % 5).alias("k"), F.element_at(words("vector", "bm25", "any"), (i % 3 + 1).cast("int")).alias("search_mode"),
        F.when(i % 4 == 0, 0.7).when(i % 4 == 1, 0.0).alias("vector_weight"), F.when(i % 4 == 0, 0.3).alias("bm25_weight"), (i % 5 != 0).alias("use_rerank"),
        F.when(i % 7 == 3, "en").alias("language"), none.alias("doc_types"), F.when(i % 2 == 0, words("science", "law")).alias("faculties"),
        F.when(i % 6 == 1, F.array(*[F.lit(y) for y in (2019, 2020, 2022, 2024)])).alias("years"), none.alias("subjects"),
        F.when(i % 11 == 5, F.create_map(F.lit("faculty"), F.lit("arts"))).alias("filters"),
    )
    return O.map_request(raw)


def answered(spark, sf, **options):
    hits = U.search_requests(request_table(spark, sf), chunks(spark, sf), **options)
    return hits.select("query_id", "mode", "source_type", "doc_id", "chunk_id", big("original_rank"), r6("score"), big("rank"))


@query("u08_search_requests", _request_sql())
def by_request(spark, sf):
    return answered(spark, sf, fuzzy=False)


@query("u08_search_weighted", _request_sql(fusion="weighted"))
def by_request_weighted(spark, sf):
    return answered(spark, sf, fuzzy=False, fusion="weighted")


@query("u08_search_fuzzy", _request_sql(fuzzy=True))
def by_request_fuzzy(spark, sf):
    return answered(spark, sf)


# Each pair of neighbouring benchmark items acts as one plan with two rewrites.
@query(
    "u09_multi_query_retrieve",
    f"""WITH {S.SEARCH}, {S.BM25_RANKED},
    h AS (SELECT query_id // 2 AS plan_id, query_id % 2 AS qpos, rank, score, c.doc_id, c.chunk_id, lower({S.strip('c.text')}) AS sig
          FROM bm25 JOIN chunks c USING (doc_id, chunk_id) WHERE rank <= 12),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, sig ORDER BY qpos, rank) AS n FROM h WHERE sig <> '') WHERE n = 1),
    f AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY score DESC, qpos, rank) AS final_rank FROM u),
    t AS (SELECT plan_id, count(DISTINCT qpos) AS queries_used, count(*) AS total_results FROM h GROUP BY ALL),
    n AS (SELECT plan_id, count(*) AS unique_results FROM u GROUP BY ALL)
    SELECT plan_id, qpos, doc_id, chunk_id, final_rank AS rank, round(score, 6) AS score, queries_used, total_results, unique_results,
           least(unique_results, 10) AS final_results FROM f JOIN t USING (plan_id) JOIN n USING (plan_id) WHERE final_rank <= 10""",
)
def multi_query(spark, sf):
    rows = chunks(spark, sf)
    # Counted and merged more than once, found once.
    hits = stored(K.with_texts(K.bm25_search(queries_table(spark, sf), rows, 12), rows), "texts").select(
        F.expr("query_id div 2").alias("plan_id"), (F.col("query_id") % 2).alias("qpos"), "rank", "text", "score", *K.KEYS
    )
    best, counts = U.multi_query_retrieve(hits, 10)
    return best.join(counts, "plan_id").select(
        "plan_id", "qpos", "doc_id", "chunk_id", big("rank"), r6("score"), "queries_used", "total_results", "unique_results", "final_results"
    )


# Sources as questions, the document number's last digit as the round, documents as passages.
_ROUNDS = f"""r AS (SELECT source || '_' || lang AS query_id, doc_id % 7 AS iteration, doc_id AS rank, lower({S.strip('text')}) AS sig FROM documents),
fst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, sig ORDER BY iteration, rank) AS n FROM r WHERE sig <> '') WHERE n = 1),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY iteration, rank) AS position FROM fst) WHERE position <= 15)"""


@query(
    "u10_context_accumulate",
    f"""WITH {_ROUNDS}, d AS (SELECT DISTINCT query_id, iteration, sig FROM r WHERE sig <> ''),
    n AS (SELECT d.query_id, d.iteration, count(*) FILTER (k.iteration IS NULL OR k.iteration >= d.iteration) AS new_unique
          FROM d LEFT JOIN kept k ON k.query_id = d.query_id AND k.sig = d.sig GROUP BY ALL)
    SELECT n.query_id, n.iteration, new_unique, count(k.sig) AS n_kept, min(k.rank) AS first_doc, max(k.position) AS last_position
    FROM n LEFT JOIN kept k ON k.query_id = n.query_id AND k.iteration = n.iteration GROUP BY ALL""",
)
def accumulate(spark, sf):
    rounds = table(spark, sf, "documents").select(
        F.concat_ws("_", "source", "lang").alias("query_id"), (F.col("doc_id") % 7).alias("iteration"),
        F.col("doc_id").alias("rank"), "text",
    )
    kept, new = U.context_accumulate(rounds)
    per_round = kept.groupBy("query_id", "iteration").agg(
        F.count("*").alias("n_kept"), F.min("rank").alias("first_doc"), F.max("position").cast("bigint").alias("last_position")
    )
    return new.join(per_round, ["query_id", "iteration"], "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)).cast("bigint"))


# Users as questions, their events in time order as rounds.
_EV = """ev AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iteration,
  round(value / 20.0, 4) AS confidence, event_type IN ('click', 'purchase') AS can_answer, event_type = 'view' AS gap,
  CASE WHEN event_type = 'purchase' THEN NULL ELSE event_type END AS next_query FROM events)"""


@query(
    "u11_early_stop",
    f"""WITH {_EV} SELECT query_id, min(CASE WHEN (can_answer AND confidence >= 0.7) OR (can_answer AND NOT gap) OR (can_answer AND next_query IS NULL) OR confidence >= 0.8
       THEN iteration END) AS stop_round FROM ev GROUP BY ALL""",
)
def early_stop(spark, sf):
    ev = number_rows(
        table(spark, sf, "events"), ["user_id"], F.date_trunc("day", "ts"), [F.col("ts"), F.col("event_id")], "iteration"
    )
    rounds = ev.select(
        F.col("user_id").alias("query_id"), big("iteration"), F.round(F.col("value") / 20.0, 4).alias("confidence"),
        F.col("event_type").isin("click", "purchase").alias("can_answer"),
        F.when(F.col("event_type") == "view", F.array(F.lit("more"))).otherwise(F.array().cast("array<string>")).alias("gaps"),
        F.when(F.col("event_type") != "purchase", F.col("event_type")).alias("next_query"),
    )
    return U.early_stop(rounds)


@query(
    "u12_iterative_gate",
    """SELECT event_id, (event_type = 'error' OR least(value / 3, 10) >= 6.5) AS use_iterative, CAST(CASE WHEN least(value / 3, 10) >= 7 THEN 3 ELSE 2 END AS BIGINT) AS max_iterations FROM events""",
)
def gate(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "complex").otherwise("medium").alias("complexity"),
        F.least(F.col("value") / 3, F.lit(10.0)).alias("score"),
    )
    return U.iterative_gate(ev).select("event_id", "use_iterative", big("max_iterations"))


@query(
    "u13_retrieval_quality",
    f"""WITH {_HYBRID}, {_fused(32)}, {_OVERLAP.format(hits='fused')},
    rr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, doc_id, chunk_id) AS rank FROM fused_s),
    res AS (SELECT 'bm25' AS mode, query_id, doc_id, rank FROM bm25 WHERE rank <= 10
      UNION ALL SELECT 'vector', query_id, doc_id, rank FROM knn WHERE rank <= 10
      UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM fused WHERE rank <= 10
      UNION ALL SELECT 'hybrid_rerank', query_id, doc_id, rank FROM rr WHERE rank <= 10),
    rel AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''),
    nr AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY ALL),
    best AS (SELECT mode, query_id, doc_id, min(rank) AS rank FROM res GROUP BY ALL),
    hit AS (SELECT mode, query_id, count(*) FILTER (rank <= 5) AS p, count(*) FILTER (rank <= 10) AS r FROM best JOIN rel USING (query_id, doc_id) GROUP BY ALL),
    g AS (SELECT mode, query_id, n_rel FROM nr CROSS JOIN (SELECT DISTINCT mode FROM res))
    SELECT mode, round(avg(coalesce(p, 0) / 5), 6) AS precision, round(avg(coalesce(r, 0) / n_rel), 6) AS recall, count(*) AS n_queries
    FROM g LEFT JOIN hit USING (mode, query_id) GROUP BY mode""",
)
def quality(spark, sf):
    from quernstone.operators.matching import contains_join

    rows, q = chunks(spark, sf), queries_table(spark, sf)
    docs = spread(table(spark, sf, "documents"), "doc_id").select("doc_id", F.col("text").alias("body"))
    relevant = contains_join(docs, q.select("query_id", F.col("text").alias("needle")), "body", "needle", ["doc_id"]).select("query_id", "doc_id")
    dv = V.embed_batch(rows, list(K.KEYS), "text")
    qv = V.embed_batch(q, ["query_id"], "text")
    # Each list goes into several modes and is found once.
    vec = stored(V.knn_exact(qv, dv, 32, list(K.KEYS)), "vector_hits")
    key = stored(K.bm25_search(q, rows, 32), "keyword_hits")
    fused = stored(U.rrf(vec, key), "fused")
    ranked = stored(U.rerank(K.with_texts(fused, rows), q), "reranked")
    named = {"vector": vec, "bm25": key, "hybrid": fused, "hybrid_rerank": ranked}
    parts = [df.filter("rank <= 10").select(F.lit(m).alias("mode"), "query_id", "doc_id", "rank") for m, df in named.items()]
    results = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return U.retrieval_quality(results, relevant, list(named)).withColumns(
        {"precision": F.round("precision", 6), "recall": F.round("recall", 6)}
    )
