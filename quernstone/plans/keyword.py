"""Registered queries for text analysis and keyword search."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import keyword as K
from quernstone.plans import sql_parts as S
from quernstone.plans.bindings import chunks, queries_table, spread, table
from quernstone.plans.registry import query
from quernstone.session import stored


@query(
    "k01_analyze_vi",
    f"""WITH c AS (SELECT doc_id, {S.tokens('text')} AS toks FROM documents),
    u AS MATERIALIZED (SELECT doc_id, unnest(toks) AS tok FROM c),
    v AS MATERIALIZED (SELECT tok, {S.fold('tok')} AS folded FROM (SELECT DISTINCT tok FROM u)),
    t AS MATERIALIZED (SELECT doc_id, tok, folded FROM u JOIN v USING (tok)),
    f AS (SELECT doc_id, folded AS term FROM t WHERE folded NOT IN {S.STOPS}
          UNION ALL SELECT doc_id, tok FROM t WHERE tok <> folded AND tok NOT IN {S.STOPS})
    SELECT doc_id, count(*) AS n_terms, count(DISTINCT term) AS n_distinct, min(term) AS first_term, max(term) AS last_term
    FROM f GROUP BY doc_id""",
)
def analyze(spark, sf):
    docs = table(spark, sf, "documents")
    terms = spread(docs, "doc_id").select("doc_id", F.explode_outer(T.analyze(F.col("text"))).alias("term")).filter("term is not null")
    return terms.groupBy("doc_id").agg(
        F.count("*").alias("n_terms"), F.countDistinct("term").alias("n_distinct"),
        F.min("term").alias("first_term"), F.max("term").alias("last_term"),
    )


@query(
    "k02_build_postings",
    f"""WITH {S.CHUNKS}, {S.positions('chunks', 'doc_id, chunk_id')},
    p AS (SELECT doc_id, chunk_id, field, term, count(*) AS tf, string_agg(pos, ',' ORDER BY pos) AS positions
          FROM forms GROUP BY ALL)
    SELECT doc_id, chunk_id, field, term, dl, tf, positions FROM p JOIN lens USING (doc_id, chunk_id, field)""",
)
def postings(spark, sf):
    return K.build_postings(chunks(spark, sf), positions=True).withColumn(
        "positions", F.concat_ws(",", F.col("positions").cast("array<string>"))
    ).withColumn("dl", F.col("dl").cast("bigint"))


@query(
    "k03_build_term_stats",
    f"""WITH {S.CHUNKS}, {S.positions('chunks', 'doc_id, chunk_id')}
    SELECT field, term, df, n_docs, round(avg_dl, 6) AS avg_dl FROM term_stats JOIN totals USING (field)""",
)
def term_stats(spark, sf):
    index = K.build_index(chunks(spark, sf))
    return index.term_stats.join(F.broadcast(index.totals), "field").select(
        "field", "term", "df", "n_docs", F.round("avg_dl", 6).alias("avg_dl")
    )


@query(
    "k04_bm25_search",
    f"""WITH {S.SEARCH}, {S.BM25_RANKED}
    SELECT query_id, doc_id, chunk_id, rank, round(score, 6) AS score FROM bm25 WHERE rank <= 10""",
)
def bm25(spark, sf):
    return K.bm25_search(queries_table(spark, sf), chunks(spark, sf), k=10).select(
        "query_id", "doc_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score")
    )


# One byte per letter, because the check engine's edit distance counts bytes.
_LETTERS = "àâäæçèéêëîïñôöùûüÿœßáíóú¿"
_BYTES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[: len(_LETTERS)]


def near_sql(vocab: str) -> str:
    """CTE fuzzy_terms (query_id, word, term, edits, weight): the terms of ``vocab`` near a query term."""
    return f"""
    vocab AS MATERIALIZED (SELECT term, length(term) AS n, translate(term, '{_LETTERS}', '{_BYTES}') AS bytes FROM ({vocab})),
    w AS MATERIALIZED (SELECT term AS word, n, bytes, CASE WHEN n <= 2 THEN 0 WHEN n <= 5 THEN 1 ELSE 2 END AS allowed
          FROM (SELECT DISTINCT term, length(term) AS n, translate(term, '{_LETTERS}', '{_BYTES}') AS bytes FROM q_terms)),
    near AS MATERIALIZED (SELECT word, term, levenshtein(w.bytes, vocab.bytes) AS edits, allowed
             FROM w JOIN vocab ON abs(vocab.n - w.n) <= allowed),
    fuzzy_terms AS MATERIALIZED (SELECT q.query_id, n.word, n.term, n.edits, q.weight * (1 - n.edits / least(length(n.word), length(n.term))) AS weight
             FROM q_terms q JOIN near n ON q.term = n.word WHERE n.edits <= n.allowed)"""


FUZZY_BM25 = S.BM25.replace("FROM q_terms", "FROM best_terms")


@query(
    "k04_bm25_fuzzy",
    f"""WITH {S.CHUNKS}, {S.QUERIES}, {S.positions('chunks', 'doc_id, chunk_id')}, {S.QUERY_FORMS}, {near_sql('SELECT DISTINCT term FROM postings')},
    best_terms AS MATERIALIZED (SELECT query_id, term, max(weight) AS weight FROM fuzzy_terms GROUP BY ALL), {FUZZY_BM25}, {S.PHRASE}, {S.BM25_RANKED}
    SELECT query_id, doc_id, chunk_id, rank, round(score, 6) AS score FROM bm25 WHERE rank <= 10""",
)
def bm25_fuzzy(spark, sf):
    return K.bm25_search(queries_table(spark, sf), chunks(spark, sf), k=10, fuzzy=True).select(
        "query_id", "doc_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score")
    )


@query(
    "k05_fuzzy_expand",
    f"""WITH {S.QUERIES}, {S.QUERY_FORMS},
    d0 AS MATERIALIZED (SELECT DISTINCT unnest({S.tokens('text')}) AS tok FROM documents),
    d AS MATERIALIZED (SELECT tok, {S.fold('tok')} AS folded FROM d0),
    {near_sql(f"""SELECT folded AS term FROM d WHERE folded NOT IN {S.STOPS} UNION SELECT tok FROM d WHERE tok <> folded AND tok NOT IN {S.STOPS}""")}
    SELECT query_id, word, term, edits, round(weight, 6) AS weight FROM fuzzy_terms""",
)
def fuzzy(spark, sf):
    docs = table(spark, sf, "documents")
    vocab = spread(docs, "doc_id").select(F.explode_outer(T.analyze(F.col("text"))).alias("term")).filter("term is not null").distinct()
    terms = K.query_terms(queries_table(spark, sf))
    return K.fuzzy_expand(terms, vocab).select(
        "query_id", "word", "term", F.col("edits").cast("bigint").alias("edits"), F.round("weight", 6).alias("weight")
    )


_DOC_CHUNKS = "chunks AS (SELECT doc_id, doc_id AS chunk_id, text, '' AS title FROM documents)"


@query(
    "k06_phrase_boost",
    f"""WITH {_DOC_CHUNKS}, {S.QUERIES}, {S.positions('chunks', 'doc_id, chunk_id')}, {S.QUERY_FORMS}, {S.PHRASE}
    SELECT query_id, doc_id, freq, round(phrase_score, 6) AS phrase_score FROM phrase_scores""",
)
def phrase(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    index = K.build_index(docs, ("text",), ("doc_id",))
    # The few matches are found once, for both sides of the join.
    found = stored(K.phrase_matches(queries_table(spark, sf), docs, index), "matches")
    return found.join(K.phrase_scores(found, ("doc_id",)), ["query_id", "doc_id"]).select(
        "query_id", "doc_id", "freq", F.round("phrase_score", 6).alias("phrase_score")
    )


@query(
    "k07_facets",
    f"""WITH {S.CHUNKS}, {S.QUERIES}, {S.positions('chunks', 'doc_id, chunk_id')}, {S.QUERY_FORMS},
    m AS (SELECT DISTINCT query_id, doc_id, chunk_id FROM q_terms JOIN postings USING (term)),
    j AS (SELECT m.query_id, c.* FROM m JOIN chunks c USING (doc_id, chunk_id)),
    u AS (SELECT query_id, 'doc_type' AS facet, doc_type AS key, 20 AS size FROM j
          UNION ALL SELECT query_id, 'faculty', faculty, 20 FROM j
          UNION ALL SELECT query_id, 'year', CAST(year AS VARCHAR), 10 FROM j),
    g AS (SELECT query_id, facet, key, size, count(*) AS doc_count FROM u WHERE key IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, facet ORDER BY doc_count DESC, key) AS rank FROM g)
    SELECT query_id, facet, key, doc_count, rank FROM r WHERE rank <= size""",
)
def facets(spark, sf):
    rows = chunks(spark, sf)
    matches = K.matched_rows(K.query_terms(queries_table(spark, sf)), K.build_index(rows))
    # Only the facet columns travel, not the texts.
    cols = rows.select(*K.KEYS, "doc_type", "faculty", "year")
    # Hashed, because sorting would sort all matches of all queries.
    return K.facets(matches.join(cols.hint("shuffle_hash"), list(K.KEYS))).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "k08_highlight",
    f"""WITH {S.SEARCH}, {S.BM25_RANKED},
    q AS (SELECT query_id, list(DISTINCT term) AS terms FROM q_forms GROUP BY ALL),
    h AS (SELECT query_id, doc_id, chunk_id, c.text FROM bm25 JOIN chunks c USING (doc_id, chunk_id) WHERE rank <= 10),
    p AS (SELECT query_id, doc_id, chunk_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS idx
          FROM (SELECT query_id, doc_id, chunk_id, regexp_extract_all(text, '(?s).{{1,200}}(?:\\s|$)|.{{200}}') AS ps FROM h)),
    w AS (SELECT query_id, doc_id, chunk_id, idx, piece, unnest(ws) AS w, generate_subscripts(ws, 1) AS wpos
          FROM (SELECT *, regexp_extract_all(piece, '{S.T.TOKEN}|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS ws FROM p)),
    m AS (SELECT w.*, (list_contains(q.terms, {S.mapped_lower('w')}) OR list_contains(q.terms, {S.fold(S.mapped_lower('w'))})) AS hit
          FROM w JOIN q USING (query_id)),
    f AS (SELECT query_id, doc_id, chunk_id, idx, count(*) FILTER (hit) AS hits,
                 string_agg(CASE WHEN hit THEN '<mark>' || w || '</mark>' ELSE w END, '' ORDER BY wpos) AS piece
          FROM m GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, chunk_id ORDER BY hits DESC, idx) AS rn FROM f WHERE hits > 0)
    SELECT query_id, doc_id, chunk_id, string_agg(piece, '|' ORDER BY idx) AS highlights FROM r WHERE rn <= 2 GROUP BY ALL""",
)
def highlight(spark, sf):
    # Every hit of the search; the hits go to the texts by key.
    rows = chunks(spark, sf)
    found = K.with_texts(K.bm25_search(queries_table(spark, sf), rows, k=10).select("query_id", *K.KEYS), rows)
    return K.highlight(found, queries_table(spark, sf)).filter(F.size("highlights") > 0).select(
        "query_id", *K.KEYS, F.concat_ws("|", "highlights").alias("highlights")
    )


@query(
    "k09_char_spans",
    f"""WITH s AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, string_split(text, '. ') AS ps FROM documents)),
    o AS (SELECT doc_id, i, p, CAST(coalesce(sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s)
    SELECT doc_id, start, start + length(p) AS "end", {S.strip('p')} AS text, 'sentence' AS type FROM o WHERE length({S.strip('p')}) > 10""",
)
def char_spans(spark, sf):
    docs = spread(table(spark, sf, "documents"), "doc_id")
    return K.char_spans(docs, ["doc_id"], "text").select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "text", "type")


# Distinct words of every benchmark text as keywords, and each text's first two words as a compound.
_KEYWORDS_SQL = """kw0 AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS keyword FROM benchmark
  UNION SELECT item_id, lower(regexp_extract(text, '^[^ ]+ [^ ]+')) FROM benchmark),
keywords AS (SELECT DISTINCT query_id, keyword FROM kw0 WHERE keyword <> '')"""


def keywords_table(spark, sf):
    b = table(spark, sf, "benchmark")
    singles = b.select(F.col("item_id").alias("query_id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"))).alias("keyword"))
    pairs = b.select(F.col("item_id").alias("query_id"), F.lower(F.regexp_extract("text", "^[^ ]+ [^ ]+", 0)).alias("keyword"))
    return singles.unionByName(pairs).filter("keyword <> ''").distinct()


@query(
    "k10_keyword_score_articles",
    f"""WITH {_KEYWORDS_SQL},
    articles AS (SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, text AS full_text FROM documents),
    s AS (SELECT query_id, id, title, full_text,
        sum((CASE WHEN contains(lower(title), keyword) THEN CASE WHEN contains(keyword, ' ') THEN 3.0 ELSE 1.0 END ELSE 0 END)
          + (CASE WHEN contains(lower(full_text), keyword) THEN CASE WHEN contains(keyword, ' ') THEN 2.0 ELSE 0.5 END ELSE 0 END)) AS score
        FROM articles JOIN keywords ON contains(lower(title), keyword) OR contains(lower(full_text), keyword) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
    SELECT query_id, rank, id, title, substr(full_text, 1, 500) AS content, CAST(score AS DOUBLE) AS score FROM r WHERE rank <= 10""",
)
def score_articles(spark, sf):
    docs = spread(table(spark, sf, "documents"), "doc_id").select(
        F.col("doc_id").alias("id"),
        F.element_at(F.split("text", "\n"), 1).alias("title"), F.col("text").alias("full_text"),
    )
    return K.keyword_score_articles(keywords_table(spark, sf), docs).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "k11_keyword_search_entities",
    f"""WITH {_KEYWORDS_SQL},
    e AS (SELECT c_custkey AS entity_id, c_name AS name, c_mktsegment AS type, 'customer in ' || n_name AS description
          FROM customer JOIN nation ON c_nationkey = n_nationkey),
    parts AS (SELECT p_partkey + 1000000000 AS entity_id, p_name AS name, p_brand AS type, p_type || ' ' || p_brand AS description FROM part),
    ent AS (SELECT * FROM e UNION ALL SELECT * FROM parts),
    words AS (SELECT DISTINCT c_mktsegment AS query_id, lower(c_mktsegment) AS keyword FROM customer
              UNION SELECT n_name, lower(n_name) FROM nation
              UNION SELECT p_brand, lower(p_brand) FROM part
              UNION SELECT 'bench_' || query_id, keyword FROM keywords),
    m AS (SELECT DISTINCT query_id, entity_id, name, type, description FROM ent JOIN words
          ON contains(lower(name), keyword) OR contains(lower(description), keyword)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY name, entity_id) AS rank FROM m)
    SELECT query_id, rank, entity_id, name, type, substr(description, 1, 200) AS description FROM r WHERE rank <= 20""",
)
def search_entities(spark, sf):
    customer, nation, part = (table(spark, sf, t) for t in ("customer", "nation", "part"))
    ent = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"),
        F.concat(F.lit("customer in "), "n_name").alias("description"),
    ).unionByName(part.select(
        (F.col("p_partkey") + 1000000000).alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"),
        F.concat_ws(" ", "p_type", "p_brand").alias("description"),
    ))
    words = (
        customer.select(F.col("c_mktsegment").alias("query_id"), F.lower("c_mktsegment").alias("keyword"))
        .union(nation.select("n_name", F.lower("n_name")))
        .union(part.select("p_brand", F.lower("p_brand")))
        .union(keywords_table(spark, sf).select(F.concat(F.lit("bench_"), "query_id"), "keyword"))
        .distinct()
    )
    return K.keyword_search_entities(words, ent).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "k12_fulltext_nodes",
    f"""WITH chunks AS (
      SELECT 'part' AS doc_id, CAST(p_partkey AS VARCHAR) AS chunk_id, concat_ws(' ', p_name, p_brand, p_type) AS text FROM part
      UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), concat_ws(' ', s_name, n_name, r_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), concat_ws(' ', c_name, n_name, c_mktsegment) FROM customer JOIN nation ON c_nationkey = n_nationkey),
    queries AS (SELECT n_nationkey AS query_id, n_name || ' ' || r_name || ' economy machinery steel' AS text FROM nation JOIN region ON n_regionkey = r_regionkey),
    {S.positions('chunks', 'doc_id, chunk_id', ('text',))}, {S.QUERY_FORMS},
    ls AS (SELECT doc_id, term, count(*) AS df FROM postings GROUP BY ALL),
    lt AS (SELECT doc_id, count(*) AS n_docs, avg(dl) AS avg_dl FROM lens GROUP BY ALL),
    sc AS (SELECT query_id, doc_id AS label, chunk_id AS id,
           sum(weight * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score
           FROM q_terms JOIN postings USING (term) JOIN ls USING (doc_id, term) JOIN lt USING (doc_id) GROUP BY ALL),
    a AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY round(score, 9) DESC, id) AS label_rank FROM sc),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, label, id) AS rank FROM a WHERE label_rank <= 10)
    SELECT query_id, label, id, label_rank, rank, round(score, 6) AS score FROM b WHERE rank <= 10""",
)
def fulltext(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    at = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")

    def node(df, label, key, *props):
        return df.select(F.lit(label).alias("label"), F.col(key).cast("string").alias("id"), *[F.col(p).alias(f"p{i}") for i, p in enumerate(props)])

    nodes = (
        node(table(spark, sf, "part"), "part", "p_partkey", "p_name", "p_brand", "p_type")
        .unionByName(node(table(spark, sf, "supplier").join(at, F.col("s_nationkey") == F.col("n_nationkey")), "supplier", "s_suppkey", "s_name", "n_name", "r_name"))
        .unionByName(node(table(spark, sf, "customer").join(at, F.col("c_nationkey") == F.col("n_nationkey")), "customer", "c_custkey", "c_name", "n_name", "c_mktsegment"))
    )
    q = at.select(F.col("n_nationkey").alias("query_id"), F.concat_ws(" ", "n_name", "r_name", F.lit("economy machinery steel")).alias("text"))
    return K.fulltext_nodes(q, nodes, ["p0", "p1", "p2"]).select(
        "query_id", "label", "id", F.col("label_rank").cast("bigint").alias("label_rank"),
        F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"),
    )


@query(
    "k13_keyword_analyzer",
    f"SELECT page_id, {S.fold(S.mapped_lower('url'))} AS url_key, md5({S.fold(S.mapped_lower('html'))}) AS html_key FROM pages",
)
def keyword_normal(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", T.keyword_normal(F.col("url")).alias("url_key"), F.md5(T.keyword_normal(F.col("html"))).alias("html_key")
    )
