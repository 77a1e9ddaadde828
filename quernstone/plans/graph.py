"""Registered queries for graph queries and analytics.

Customers act as articles and orders as references between them; parts form the
prerequisite tree; the geography tables form a labelled graph; documents mention words.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import graph_query as G
from quernstone.operators import reach_bits as R
from quernstone.operators.ranking import top_k
from quernstone.plans import sql_parts as S
from quernstone.plans.bindings import spread, table
from quernstone.plans.extract import LAW_ARTICLES, law_articles
from quernstone.plans.registry import query

big = lambda c: F.col(c).cast("bigint").alias(c)

# -- references between customers -------------------------------------------

NET = """n AS (SELECT count(*) AS n FROM customer),
net AS MATERIALIZED (SELECT o_custkey AS src, CAST(floor(o_totalprice) AS BIGINT) % n.n AS dst, 'REFERENCES' AS type, o_orderpriority AS ref_text, o_orderkey AS ord
  FROM orders, n WHERE o_custkey <> CAST(floor(o_totalprice) AS BIGINT) % n.n)"""


def network(spark, sf):
    n = table(spark, sf, "customer").select(F.count("*").alias("n")).scalar()
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("src"), (F.floor("o_totalprice").cast("bigint") % n).alias("dst"), F.lit("REFERENCES").alias("type"),
        F.col("o_orderpriority").alias("ref_text"), F.col("o_orderkey").alias("ord"),
    ).filter("src <> dst")


def customers(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.col("c_nationkey").alias("chapter"), F.col("c_name").alias("title")
    )


# First and last customer of every nation as the ends of a search.
PAIRS = "pairs AS (SELECT min(c_custkey) AS src, max(c_custkey) AS dst FROM customer GROUP BY c_nationkey)"


def nation_pairs(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("src"), F.max("c_custkey").alias("dst")).select("src", "dst")


@query(
    "p01_traverse",
    f"""WITH {NET}, s AS (SELECT DISTINCT src, dst FROM net),
    r AS (SELECT c_custkey AS start, c_custkey AS id, 0 AS hops FROM customer UNION ALL SELECT src, dst, 1 FROM s UNION ALL SELECT a.src, b.dst, 2 FROM s a JOIN s b ON a.dst = b.src),
    m AS (SELECT start, id, min(hops) AS hops FROM r GROUP BY ALL),
    e AS (SELECT start, count(*) AS n_edges FROM (SELECT DISTINCT start, src, dst FROM m JOIN s ON m.id = s.src WHERE hops < 2) GROUP BY ALL),
    k AS (SELECT start, count(*) AS n_nodes, CAST(sum(id) AS BIGINT) AS id_sum, CAST(sum(hops) AS BIGINT) AS hop_sum FROM m GROUP BY ALL)
    SELECT k.*, coalesce(n_edges, 0) AS n_edges FROM k LEFT JOIN e USING (start)""",
)
def p01(spark, sf):
    return R.traverse_counts(customers(spark, sf), network(spark, sf), ["REFERENCES"], 2, "out", {"id_sum": F.col("id"), "hop_sum": F.col("hops")})


@query("p02_neighbors", f"WITH {NET} SELECT src AS id, dst AS neighbor, src, dst, type FROM net UNION ALL SELECT dst, src, src, dst, type FROM net")
def p02(spark, sf):
    return G.neighbors(customers(spark, sf), network(spark, sf))


# -- geography --------------------------------------------------------------

GEO = """gn AS MATERIALIZED (SELECT 'r' || r_regionkey AS id, 'Region' AS label, r_name AS name, NULL AS title FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'Nation', n_name, NULL FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'Customer', c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'Supplier', NULL, NULL FROM supplier),
ge AS MATERIALIZED (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'IN_REGION' AS type FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'IN_NATION' FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'IN_NATION' FROM supplier)"""


def geo(spark, sf):
    r, n, c, s = (table(spark, sf, t) for t in ("region", "nation", "customer", "supplier"))
    key = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))

    def props(name, title):
        pairs = F.array(F.struct(F.lit("name").alias("k"), name.alias("v")), F.struct(F.lit("title").alias("k"), title.alias("v")))
        return F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))

    none = F.lit(None).cast("string")
    nodes = (
        r.select(key("r", "r_regionkey").alias("id"), F.lit("Region").alias("label"), props(F.col("r_name"), none).alias("props"))
        .unionByName(n.select(key("n", "n_nationkey").alias("id"), F.lit("Nation").alias("label"), props(F.col("n_name"), none).alias("props")))
        .unionByName(c.select(key("c", "c_custkey").alias("id"), F.lit("Customer").alias("label"), props(F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))).alias("props")))
        .unionByName(s.select(key("s", "s_suppkey").alias("id"), F.lit("Supplier").alias("label"), props(none, none).alias("props")))
    )
    edges = (
        n.select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"), F.lit("IN_REGION").alias("type"))
        .unionByName(c.select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst"), F.lit("IN_NATION").alias("type")))
        .unionByName(s.select(key("s", "s_suppkey").alias("src"), key("n", "s_nationkey").alias("dst"), F.lit("IN_NATION").alias("type")))
    )
    return nodes, edges


@query(
    "p03_pairs_by_type",
    f"""WITH {GEO}, d AS (SELECT id, label, coalesce(title, name, 'Entity_' || id) AS name FROM gn)
    SELECT src, dst, type, a.label AS source_type, a.name AS source_name, b.label AS target_type, b.name AS target_name FROM ge JOIN d a ON a.id = src JOIN d b ON b.id = dst""",
)
def p03(spark, sf):
    return G.pairs_by_type(*geo(spark, sf), ["IN_REGION", "IN_NATION"], None)


_LEVELS = """s AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM {net}),
l1 AS MATERIALIZED (SELECT p.src, p.dst, b AS nd, [a, b] AS path FROM pairs p JOIN s ON a = p.src WHERE p.src <> p.dst),
l2 AS MATERIALIZED (SELECT l.src, l.dst, b AS nd, min(list_append(path, b)) AS path FROM l1 l JOIN s ON a = nd WHERE b <> l.src AND NOT EXISTS (SELECT 1 FROM l1 x WHERE x.src = l.src AND x.dst = l.dst AND x.nd = b) GROUP BY ALL),
l3 AS MATERIALIZED (SELECT l.src, l.dst, b AS nd, min(list_append(path, b)) AS path FROM l2 l JOIN s ON a = nd WHERE b <> l.src
  AND NOT EXISTS (SELECT 1 FROM l1 x WHERE x.src = l.src AND x.dst = l.dst AND x.nd = b) AND NOT EXISTS (SELECT 1 FROM l2 x WHERE x.src = l.src AND x.dst = l.dst AND x.nd = b) GROUP BY ALL),
l4 AS MATERIALIZED (SELECT l.src, l.dst, b AS nd, min(list_append(path, b)) AS path FROM l3 l JOIN s ON a = nd WHERE b <> l.src AND NOT EXISTS (SELECT 1 FROM (SELECT src, dst, nd FROM l1 UNION ALL SELECT src, dst, nd FROM l2 UNION ALL SELECT src, dst, nd FROM l3) x WHERE x.src = l.src AND x.dst = l.dst AND x.nd = b) GROUP BY ALL),
l5 AS MATERIALIZED (SELECT l.src, l.dst, b AS nd, min(list_append(path, b)) AS path FROM l4 l JOIN s ON a = nd WHERE b <> l.src AND NOT EXISTS (SELECT 1 FROM (SELECT src, dst, nd FROM l1 UNION ALL SELECT src, dst, nd FROM l2 UNION ALL SELECT src, dst, nd FROM l3 UNION ALL SELECT src, dst, nd FROM l4) x WHERE x.src = l.src AND x.dst = l.dst AND x.nd = b) GROUP BY ALL),
short AS MATERIALIZED (SELECT src, dst, min(path) AS path, 1 AS hops FROM l1 WHERE nd = dst GROUP BY ALL UNION ALL SELECT src, dst, path, 2 FROM l2 WHERE nd = dst UNION ALL SELECT src, dst, path, 3 FROM l3 WHERE nd = dst
  UNION ALL SELECT src, dst, path, 4 FROM l4 WHERE nd = dst UNION ALL SELECT src, dst, path, 5 FROM l5 WHERE nd = dst)"""


def _text_path(df):
    return df.withColumn("path", F.concat_ws(",", F.transform("path", lambda x: x.cast("string")))).withColumn("hops", F.col("hops").cast("bigint"))


@query("p04_shortest_path", f"WITH {NET}, {PAIRS}, {_LEVELS.format(net='net')} SELECT src, dst, array_to_string(path, ',') AS path, hops::BIGINT AS hops FROM short")
def p04(spark, sf):
    return _text_path(G.shortest_path(nation_pairs(spark, sf), network(spark, sf)))


@query(
    "p05_all_paths",
    f"""WITH {NET}, {PAIRS}, s AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM net),
    e AS (SELECT p.src, p.dst, 1 AS hops, [a, b] AS path FROM pairs p JOIN s ON a = p.src WHERE b = p.dst
      UNION ALL SELECT p.src, p.dst, 2, [s1.a, s1.b, s2.b] FROM pairs p JOIN s s1 ON s1.a = p.src JOIN s s2 ON s2.a = s1.b WHERE s2.b = p.dst
      UNION ALL SELECT p.src, p.dst, 3, [s1.a, s1.b, s2.b, s3.b] FROM pairs p JOIN s s1 ON s1.a = p.src JOIN s s2 ON s2.a = s1.b JOIN s s3 ON s3.a = s2.b WHERE s3.b = p.dst AND NOT (s1.a = s3.a AND s1.b = s3.b)),
    r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY hops, path) AS rank FROM e)
    SELECT src AS start, dst AS "end", array_to_string(path, ',') AS path, hops::BIGINT AS hops, rank FROM r WHERE rank <= 10""",
)
def p05(spark, sf):
    return _text_path(G.all_paths(nation_pairs(spark, sf), network(spark, sf))).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "p06_subgraph",
    f"""WITH {NET}, {PAIRS}, s AS (SELECT src AS a, dst AS b FROM net UNION SELECT dst, src FROM net),
    m AS (SELECT src AS start, src AS id FROM pairs UNION SELECT p.src, b FROM pairs p JOIN s ON a = p.src),
    k AS (SELECT start, id FROM m JOIN customer ON c_custkey = id WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')),
    e AS (SELECT DISTINCT k1.start, net.src, net.dst FROM net JOIN k k1 ON k1.id = net.src JOIN k k2 ON k2.id = net.dst AND k2.start = k1.start)
    SELECT 'node' AS kind, start, id AS a, NULL::BIGINT AS b FROM k UNION ALL SELECT 'edge', start, src, dst FROM e""",
)
def p06(spark, sf):
    centers = nation_pairs(spark, sf).select(F.col("src").alias("id"))
    near, inner = G.subgraph(centers, customers(spark, sf), network(spark, sf), 1, ["MACHINERY", "BUILDING"])
    return near.select(F.lit("node").alias("kind"), "start", F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b")).unionByName(
        inner.select(F.lit("edge").alias("kind"), "start", F.col("src").alias("a"), F.col("dst").alias("b")))


# -- prerequisite tree ------------------------------------------------------

TREE = "tree AS MATERIALIZED (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0)"


def tree(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"), F.lit("PREREQUISITE").alias("type")).filter("src > 0")


def courses(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"))


def _climb(depth: int) -> str:
    return f"""RECURSIVE {TREE}, walk AS (SELECT src AS start, dst AS "end", [src, dst] AS path, 1 AS hops FROM tree
      UNION ALL SELECT w.start, t.dst, list_append(path, t.dst), hops + 1 FROM walk w JOIN tree t ON t.src = w."end" WHERE hops < {depth})"""


@query(
    "p08_prerequisite_chains",
    f"""WITH {_climb(10)} SELECT start, "end", array_to_string(path, ',') AS path, hops::BIGINT AS hops, row_number() OVER (PARTITION BY start ORDER BY hops DESC, path) AS rank FROM walk""",
)
def p08(spark, sf):
    return _text_path(G.prerequisite_chains(courses(spark, sf), tree(spark, sf))).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "p09_dependent_chains",
    f"""WITH {_climb(5)} SELECT "end" AS source, array_to_string(path, ',') AS path, hops::BIGINT AS hops, row_number() OVER (PARTITION BY "end" ORDER BY hops, path) AS rank FROM walk""",
)
def p09(spark, sf):
    return _text_path(G.dependent_chains(courses(spark, sf), tree(spark, sf))).withColumn("rank", F.col("rank").cast("bigint"))


def named_paths(spark, sf):
    """Chains of three with the names of their parts."""
    paths = G.prerequisite_chains(courses(spark, sf), tree(spark, sf), 3)
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"))
    # A path has at most four nodes.
    named = (
        paths.select("start", "rank", F.posexplode("path").alias("pos", "node")).join(names, "node")
        .groupBy("start", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    )
    return paths.join(named, ["start", "rank"]).withColumnRenamed("start", "query_id")


@query(
    "p10_filter_paths_by_concept",
    f"""WITH {_climb(3)}, r AS (SELECT start, path, row_number() OVER (PARTITION BY start ORDER BY hops DESC, path) AS rank FROM walk),
    x AS (SELECT start, rank, unnest(path) AS node FROM r), nm AS (SELECT start, rank, string_agg(lower(p_name), '|') AS names FROM x JOIN part ON p_partkey = node GROUP BY ALL),
    j AS (SELECT r.start, r.rank, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN contains(names, 'ring') ELSE contains(names, 'red') OR contains(names, 'gear') END AS hit FROM r JOIN nm USING (start, rank) JOIN part ON p_partkey = r.start),
    m AS (SELECT start, bool_or(hit) AS matched FROM j GROUP BY ALL)
    SELECT j.start AS query_id, rank, matched FROM j JOIN m USING (start) WHERE hit OR (NOT matched AND rank <= 10)""",
)
def p10(spark, sf):
    k = F.col("p_size") % 3
    concepts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("query_id"),
        F.when(k == 1, F.array(F.lit("Ring"))).when(k == 2, F.array(F.lit("red"), F.lit("GEAR"))).alias("concepts"),
    )
    return G.filter_paths_by_concept(named_paths(spark, sf), concepts).select("query_id", big("rank"), "matched")


@query(
    "p11_path_nodes",
    f"""WITH {_climb(5)}, r AS (SELECT start, path, row_number() OVER (PARTITION BY start ORDER BY hops DESC, path) AS rank FROM walk),
    x AS (SELECT start, rank, unnest(path) AS node, generate_subscripts(path, 1) - 1 AS pos FROM r)
    SELECT start AS query_id, node, min(rank * 100 + pos) // 100 AS path_rank, min(rank * 100 + pos) % 100 AS path_pos FROM x GROUP BY ALL""",
)
def p11(spark, sf):
    paths = G.prerequisite_chains(courses(spark, sf), tree(spark, sf), 5).withColumnRenamed("start", "query_id")
    return G.path_nodes(paths).withColumns({"path_rank": F.col("path_rank").cast("bigint"), "path_pos": F.col("path_pos").cast("bigint")})


@query(
    "p12_related_by_similarity",
    """WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst, round(max(l_discount * 10), 4) AS score FROM lineitem GROUP BY ALL),
    b AS (SELECT src AS id, dst AS related, score FROM e WHERE score >= 0.7 UNION ALL SELECT dst, src, score FROM e WHERE score >= 0.7),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, related, score) AS rank FROM b JOIN part ON p_partkey = id)
    SELECT id, related, score, rank FROM r WHERE rank <= 5""",
)
def p12(spark, sf):
    e = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.round(F.max(F.col("l_discount") * 10), 4).alias("score"))
    return G.related_by_similarity(courses(spark, sf), e).select("id", "related", "score", big("rank"))


# -- documents mention words ------------------------------------------------

MENTIONS = f"""ment AS MATERIALIZED (SELECT DISTINCT doc_id AS article_id, tok AS entity_id FROM (SELECT doc_id, unnest({S.tokens('text')}) AS tok FROM documents) WHERE length(tok) >= 6)"""


def word_mentions(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    long = F.array_distinct(F.filter(T.tokens(F.col("text")), lambda t: F.length(t) >= 6))
    return docs.select(F.col("doc_id").alias("article_id"), F.explode(long).alias("entity_id"))


@query(
    "p13_article_with_entities",
    f"WITH {MENTIONS} SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, entity_id AS name, CASE WHEN entity_id IS NOT NULL THEN lang END AS type FROM documents LEFT JOIN ment ON article_id = doc_id",
)
def p13(spark, sf):
    docs = table(spark, sf, "documents")
    lang = docs.select(F.col("doc_id").alias("article_id"), F.col("lang").alias("type"))
    m = word_mentions(spark, sf).join(lang, "article_id").select(F.col("article_id").alias("src"), F.col("entity_id").alias("name"), "type")
    return G.article_with_entities(docs.select(F.col("doc_id").alias("id"), F.element_at(F.split("text", "\n"), 1).alias("title")), m)


@query(
    "p14_articles_by_entity",
    f"""WITH {MENTIONS}, t AS (SELECT item_id AS query_id, lower(regexp_extract(text, '[A-Za-z]{{4,}}')) AS needle FROM benchmark),
    e AS (SELECT DISTINCT entity_id FROM ment), f AS (SELECT query_id, min(entity_id) AS entity_name FROM t JOIN e ON contains(entity_id, needle) WHERE needle <> '' GROUP BY ALL),
    h AS (SELECT query_id, article_id, entity_name, row_number() OVER (PARTITION BY query_id ORDER BY article_id) AS rank FROM f JOIN ment ON entity_id = entity_name)
    SELECT query_id, article_id, entity_name, rank FROM h WHERE rank <= 10""",
)
def p14(spark, sf):
    m = word_mentions(spark, sf)
    terms = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.regexp_extract("text", "[A-Za-z]{4,}", 0).alias("term"))
    ents = m.select("entity_id", F.col("entity_id").alias("name")).distinct()
    return G.articles_by_entity(terms, ents, m).select("query_id", "article_id", "entity_name", big("rank"))


# A document is followed by the next of its source; pairs are documents two apart in number.
@query(
    "p15_article_path",
    f"""WITH {MENTIONS}, net2 AS (SELECT doc_id AS src, lead(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS dst FROM documents),
    nx AS (SELECT * FROM net2 WHERE dst IS NOT NULL), pairs AS (SELECT doc_id AS src, doc_id + 2 AS dst FROM documents), {_LEVELS.format(net='nx')},
    rest AS (SELECT p.src, p.dst FROM pairs p LEFT JOIN short USING (src, dst) WHERE hops IS NULL),
    c AS (SELECT src, dst, a.entity_id, row_number() OVER (PARTITION BY src, dst ORDER BY a.entity_id) AS n FROM rest JOIN ment a ON a.article_id = src JOIN ment b ON b.article_id = dst AND b.entity_id = a.entity_id)
    SELECT src, dst, array_to_string(path, ',') AS path, hops::BIGINT AS hops, 'NEXT_ARTICLE' AS path_type FROM short
    UNION ALL SELECT src, dst, src || ',' || entity_id || ',' || dst, 2, 'SHARED_ENTITY' FROM c WHERE n <= 3""",
)
def p15(spark, sf):
    from pyspark.sql import Window

    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    # The next document of a group is the smallest larger number: a lead over ids only.
    nxt = docs.withColumn("dst", F.lead("doc_id").over(Window.partitionBy("source", "lang").orderBy("doc_id"))).filter("dst is not null").select(
        F.col("doc_id").alias("src"), "dst", F.lit("NEXT_ARTICLE").alias("type"))
    pairs = docs.select(F.col("doc_id").alias("src"), (F.col("doc_id") + 2).alias("dst"))
    return _text_path(G.article_path(pairs, nxt, word_mentions(spark, sf)))


# -- amendments: order lines as articles, orders' other lines amend them ------

AMENDS = f"""{LAW_ARTICLES},
la AS MATERIALIZED (SELECT doc_id || '_' || ord AS id, arg_min(title, title) AS title, arg_min(full_text, full_text) AS full_text, min(doc_id) AS doc_id, min(ord) AS ord FROM law_articles GROUP BY doc_id || '_' || ord),
am AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, 'sửa ' || a.ord AS description FROM la a JOIN la b ON a.doc_id = b.doc_id AND b.ord = a.ord + 1)"""


def amended_articles(spark, sf):
    la = law_articles(spark, sf).groupBy("doc_id", "ord").agg(F.min("title").alias("title"), F.min("full_text").alias("full_text")).withColumn(
        "id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("ord").cast("string"))
    )
    b = la.select("doc_id", (F.col("ord") - 1).alias("ord"), F.col("id").alias("dst"))
    am = la.select("doc_id", "ord", F.col("id").alias("src")).join(b, ["doc_id", "ord"]).select(
        "src", "dst", F.concat(F.lit("sửa "), F.col("ord").cast("string")).alias("description"))
    return la, am


_SECTION = """coalesce(nullif(trim(regexp_extract({t}, '(?si)---[^-]*điều\\s*' || {n} || '\\s*---\\s*(.*?)(---|$)', 1)), ''), NULL)"""


@query(
    "p16_latest_version",
    f"""WITH {AMENDS}, q AS (SELECT p_size AS query_id, 'điều ' || p_size || '.' AS needle FROM (SELECT DISTINCT p_size FROM part)),
    f AS (SELECT query_id, la.id, la.title, am.src AS amending_id, x.title AS amending_title, x.full_text AS amending_text, description,
      row_number() OVER (PARTITION BY query_id ORDER BY la.id, am.src NULLS FIRST) AS rank
      FROM q JOIN la ON contains(lower(la.title), needle) LEFT JOIN am ON am.dst = la.id LEFT JOIN la x ON x.id = am.src)
    SELECT query_id, rank, id, title, amending_id, amending_title, description, (amending_title IS NOT NULL) AS is_amended,
      coalesce(rank = min(CASE WHEN amending_title IS NOT NULL THEN rank END) OVER (PARTITION BY query_id), false) AS is_primary FROM f WHERE rank <= 5""",
)
def p16(spark, sf):
    la, am = amended_articles(spark, sf)
    q = table(spark, sf, "part").select(big("p_size").alias("query_id")).distinct().withColumn("title_search", F.concat(F.lit("Điều "), F.col("query_id").cast("string"), F.lit(".")))
    return G.latest_version(q, la, am).select("query_id", big("rank"), "id", "title", "amending_id", "amending_title", "description", "is_amended", "is_primary")


@query("p17_list_amendments", f"WITH {AMENDS} SELECT src, dst, a.title AS amending_title, o.title AS original_title, description, substr(a.full_text, 1, 500) AS amending_text FROM am JOIN la a ON a.id = src JOIN la o ON o.id = dst")
def p17(spark, sf):
    la, am = amended_articles(spark, sf)
    return G.list_amendments(la, am, None)


@query(
    "p18_search_with_amendments",
    f"""WITH {AMENDS}, kw AS (SELECT DISTINCT p_size AS query_id, unnest(['khóa ' || p_size, 'điều ' || p_size, 'sửa đổi']) AS kw FROM part),
    s AS (SELECT query_id, id, sum(CASE WHEN contains(lower(title), kw) THEN 10 ELSE 0 END + CASE WHEN contains(lower(full_text), kw) THEN 1 ELSE 0 END) AS relevance FROM la, kw
      WHERE contains(lower(title), kw) OR contains(lower(full_text), kw) GROUP BY ALL),
    a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS n FROM s),
    f AS (SELECT query_id, a.id, la.title, la.full_text, relevance, x.title AS amending_title, description, regexp_extract(lower(la.title), 'điều\\s*(\\d+)', 1) AS no, x.full_text AS xt,
      row_number() OVER (PARTITION BY query_id ORDER BY n, am.src NULLS FIRST) AS rank FROM a JOIN la USING (id) LEFT JOIN am ON am.dst = a.id LEFT JOIN la x ON x.id = am.src WHERE n <= 10)
    SELECT query_id, rank, id, title, full_text AS text, CAST(relevance AS BIGINT) AS relevance, amending_title IS NOT NULL AS is_amended, description AS amendment_note FROM f WHERE rank <= 10""",
)
def p18(spark, sf):
    la, am = amended_articles(spark, sf)
    n = F.col("query_id").cast("string")
    kw = table(spark, sf, "part").select(big("p_size").alias("query_id")).distinct().select(
        "query_id", F.explode(F.array(F.concat(F.lit("khóa "), n), F.concat(F.lit("Điều "), n), F.lit("sửa đổi"))).alias("keyword"))
    return G.search_with_amendments(kw, la, am).select("query_id", big("rank"), "id", "title", "text", big("relevance"), "is_amended", "amendment_note")


@query(
    "p19_extract_amendment_section",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN 'Nội dung ' || l_quantity WHEN 1 THEN 'giá ' || l_extendedprice END AS section FROM lineitem""",
)
def p19(spark, sf):
    s = lambda e: F.expr(f"cast({e} as string)")
    m = F.col("l_linenumber") % 3
    text = (
        F.when(m == 0, F.concat(F.lit("mở đầu\n--- Mục b Khoản 1 Điều "), s("l_suppkey"), F.lit(" ---\n Nội dung "), s("l_quantity"), F.lit(" \n--- Điều "), s("l_suppkey + 1"), F.lit(" ---\nkhác")))
        .when(m == 1, F.concat(F.lit("Sửa đổi Điều "), s("l_suppkey"), F.lit(" như sau: giá "), s("l_extendedprice"), F.lit(" Bổ sung Điều "), s("l_suppkey + 1"), F.lit(": x")))
        .otherwise(F.concat(F.lit("Điều "), s("l_suppkey"), F.lit(" giữ nguyên")))
    )
    title = F.concat(F.lit("Điều "), s("l_suppkey"), F.lit(". Tiêu đề"))
    staged = table(spark, sf, "lineitem").select("l_orderkey", big("l_linenumber"), "l_partkey", text.alias("t"), title.alias("h"))
    return staged.select("l_orderkey", "l_linenumber", "l_partkey", G.extract_amendment_section(F.col("t"), F.col("h")).alias("section"))


@query(
    "p20_department_courses",
    """WITH d AS (SELECT n_name AS query_id, c_custkey AS code, c_name AS name, row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) AS rank FROM nation JOIN customer ON c_nationkey = n_nationkey),
    e AS (SELECT DISTINCT p_brand AS program, p_partkey AS code, p_name AS name, p_size AS semester FROM part), q AS (SELECT DISTINCT p_brand AS query_id FROM part),
    p AS (SELECT query_id, code, name, row_number() OVER (PARTITION BY query_id ORDER BY semester, code, program) AS rank FROM q JOIN e ON contains(program, query_id))
    SELECT 'department' AS kind, query_id, code, name, rank FROM d WHERE rank <= 20 UNION ALL SELECT 'program', query_id, code, name, rank FROM p WHERE rank <= 30""",
)
def p20(spark, sf):
    n, c, p = (table(spark, sf, t) for t in ("nation", "customer", "part"))
    dep = G.department_courses(
        n.select(F.col("n_name").alias("query_id"), F.col("n_nationkey").alias("department")),
        c.select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name")), c.select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst")),
    )
    prog = G.program_courses(
        p.select(F.col("p_brand").alias("query_id"), F.col("p_brand").alias("needle")).distinct(), p.select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name")),
        p.select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("dst"), F.col("p_size").alias("semester")),
    )
    out = lambda df, k: df.select(F.lit(k).alias("kind"), "query_id", "code", "name", big("rank"))
    return out(dep, "department").unionByName(out(prog, "program"))


COMM = "comm AS (SELECT source || '_' || lang AS community_id, source || ' ' || lang AS label, max(text) AS full_summary, count(*) AS size FROM documents GROUP BY ALL)"


def communities(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy(F.concat_ws("_", "source", "lang").alias("community_id"), F.concat_ws(" ", "source", "lang").alias("label")).agg(
        F.max("text").alias("full_summary"), F.count("*").alias("size"))


@query(
    "p21_communities_overview",
    f"""WITH {COMM}, t AS (SELECT DISTINCT source || '_' || lang AS community_id, string_split(text, chr(10))[1] AS title FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY title) AS n FROM t)
    SELECT c.community_id, size, string_agg(title, '|' ORDER BY title) AS articles FROM comm c JOIN r USING (community_id) WHERE n <= 5 GROUP BY ALL""",
)
def p21(spark, sf):
    members = table(spark, sf, "documents").select(F.concat_ws("_", "source", "lang").alias("community_id"), F.element_at(F.split("text", "\n"), 1).alias("title"))
    return G.communities_overview(communities(spark, sf), members).select("community_id", "size", F.array_join("articles", "|").alias("articles"))


_SCORED = f"""{COMM}, big AS (SELECT * FROM comm),
w AS (SELECT community_id, size, unnest(list_distinct(list_filter(regexp_split_to_array(lower(full_summary), '\\s+'), lambda x: x <> ''))) AS word, 2 AS points FROM big
  UNION ALL SELECT community_id, size, unnest(list_distinct(regexp_split_to_array(lower(label), '\\s+'))), 3 FROM big),
q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) AS word FROM benchmark),
sc AS (SELECT query_id, community_id, size, CAST(sum(points) AS BIGINT) AS score FROM q JOIN w USING (word) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, size DESC, community_id) AS rank FROM sc)"""


@query("p22_score_communities", f"WITH {_SCORED} SELECT query_id, community_id, score, rank FROM ranked WHERE rank <= 3")
def p22(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return G.score_communities(q, communities(spark, sf)).select("query_id", "community_id", big("score"), big("rank"))


# -- analytics --------------------------------------------------------------


@query("a01_referrers", f"WITH {NET}, {PAIRS} SELECT src, dst, ref_text, ord FROM net WHERE dst IN (SELECT dst FROM pairs)")
def a01(spark, sf):
    return G.referrers(network(spark, sf), nation_pairs(spark, sf).select(F.col("dst").alias("id"))).select("src", "dst", "ref_text", "ord")


@query("a02_hub_articles", f"WITH {NET} SELECT dst AS id, count(*) AS ref_count FROM net GROUP BY ALL ORDER BY ref_count DESC, id LIMIT 5")
def a02(spark, sf):
    return G.hub_articles(network(spark, sf))


@query(
    "a03_impact",
    f"""WITH {NET}, s AS (SELECT DISTINCT src, dst FROM net), r AS (SELECT dst AS target, src AS id FROM s UNION SELECT a.dst, b.src FROM s a JOIN s b ON b.dst = a.src)
    SELECT target, count(*) AS n_dependents, CAST(sum(id) AS BIGINT) AS id_sum FROM r GROUP BY ALL""",
)
def a03(spark, sf):
    return R.impact_counts(customers(spark, sf), network(spark, sf), 2, {"id_sum": F.col("id")})


@query(
    "a04_undirected_shortest_path",
    f"""WITH {NET}, {PAIRS}, und AS (SELECT src, dst FROM net UNION SELECT dst, src FROM net), {_LEVELS.format(net='und')} SELECT src, dst, array_to_string(path, ',') AS path, hops::BIGINT AS hops FROM short""",
)
def a04(spark, sf):
    # The reference sets no bound; the search ends when every pair has met.
    return _text_path(G.shortest_path(nation_pairs(spark, sf), network(spark, sf), None, None, "both"))


@query("a05_orphans", "WITH e AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' UNION SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R') SELECT c_custkey AS id, c_name AS title FROM customer WHERE c_custkey NOT IN (SELECT k FROM e)")
def a05(spark, sf):
    # Two edge types: pending orders leave their customer, returned lines arrive at a supplier number.
    edges = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("src"), F.col("o_custkey").alias("dst")).union(
        table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select("l_suppkey", "l_suppkey"))
    return G.orphans(customers(spark, sf), edges).select("id", "title")


@query("a06_mutual_references", f"WITH {NET}, n2 AS (SELECT src, dst, count(*) AS n FROM net GROUP BY ALL) SELECT a.src, a.dst, a.n * b.n AS n_matches FROM n2 a JOIN n2 b ON a.src = b.dst AND a.dst = b.src")
def a06(spark, sf):
    return G.mutual_references(network(spark, sf))


@query("a07_clause_references", f"WITH {NET} SELECT src, dst, ord FROM net JOIN customer a ON a.c_custkey = src JOIN customer b ON b.c_custkey = dst WHERE a.c_mktsegment = 'MACHINERY' AND b.c_mktsegment = 'BUILDING'")
def a07(spark, sf):
    return G.clause_references(customers(spark, sf), network(spark, sf), "MACHINERY", "BUILDING").select("src", "dst", "ord")


@query("a08_article_context", f"WITH {NET} SELECT c_custkey AS id, dst AS ref FROM customer LEFT JOIN net ON src = c_custkey")
def a08(spark, sf):
    return G.article_context(customers(spark, sf), network(spark, sf))


@query("a09_citation_strength", f"WITH {NET} SELECT src, dst, count(*) AS ref_count FROM net GROUP BY ALL HAVING count(*) > 1")
def a09(spark, sf):
    return G.citation_strength(network(spark, sf))


@query("a10_reference_pairs", f"WITH {NET} SELECT src, dst FROM net WHERE src < dst")
def a10(spark, sf):
    return G.reference_pairs(network(spark, sf), None)


@query(
    "a11_chapter_reference_stats",
    f"""WITH {NET}, o AS (SELECT src, count(*) AS n FROM net GROUP BY ALL)
    SELECT c_nationkey AS chapter, count(*) AS articles, CAST(coalesce(sum(n), 0) AS BIGINT) AS refs, round(coalesce(sum(n), 0) / count(*), 6) AS avg_refs_per_article FROM customer LEFT JOIN o ON src = c_custkey GROUP BY ALL""",
)
def a11(spark, sf):
    return G.chapter_reference_stats(customers(spark, sf).select("chapter", "id"), network(spark, sf)).withColumn("avg_refs_per_article", F.round("avg_refs_per_article", 6))


@query(
    "a12_citation_chains",
    f"""WITH {NET} SELECT a.src AS start, count(*) AS n_chains, CAST(sum(c.dst) AS BIGINT) AS end_sum FROM net a JOIN net b ON b.src = a.dst JOIN net c ON c.src = b.dst WHERE a.ord <> b.ord AND b.ord <> c.ord AND a.ord <> c.ord GROUP BY ALL""",
)
def a12(spark, sf):
    return G.citation_chain_counts(customers(spark, sf), network(spark, sf), sums={"end_sum": F.col("end")})


@query(
    "a13_connectivity_matrix",
    f"""WITH {NET}, i AS (SELECT dst AS id, count(*) AS i FROM net GROUP BY ALL), o AS (SELECT src AS id, count(*) AS o FROM net GROUP BY ALL)
    SELECT c_custkey AS id, coalesce(i, 0) AS incoming_refs, coalesce(o, 0) AS outgoing_refs, coalesce(i, 0) + coalesce(o, 0) AS total_connectivity FROM customer LEFT JOIN i ON i.id = c_custkey LEFT JOIN o ON o.id = c_custkey""",
)
def a13(spark, sf):
    return G.connectivity_matrix(customers(spark, sf), network(spark, sf))


@query(
    "a14_graph_stats",
    f"""WITH {GEO} SELECT 'label' AS kind, label AS name, count(*) AS n FROM gn GROUP BY ALL UNION ALL SELECT 'label', 'TOTAL', count(*) FROM gn UNION ALL SELECT 'type', type, count(*) FROM ge GROUP BY ALL
    UNION ALL SELECT 'type', 'TOTAL', count(*) FROM ge UNION ALL SELECT 'triple', a.label || '|' || type || '|' || b.label, count(*) FROM ge JOIN gn a ON a.id = src JOIN gn b ON b.id = dst GROUP BY ALL""",
)
def a14(spark, sf):
    return G.graph_stats(*geo(spark, sf))


@query("a15_shared_entities", f"WITH {MENTIONS}, n AS (SELECT entity_id, count(*) AS n_articles FROM ment GROUP BY ALL) SELECT entity_id, n_articles, n_articles * (n_articles - 1) // 2 AS n_pairs FROM n WHERE n_articles > 1")
def a15(spark, sf):
    return G.shared_entities(word_mentions(spark, sf))


@query("a16_top_entities", f"WITH {MENTIONS} SELECT entity_id, count(*) AS mentions FROM ment GROUP BY ALL ORDER BY mentions DESC, entity_id LIMIT 5")
def a16(spark, sf):
    return G.top_entities(word_mentions(spark, sf))


@query(
    "a17_entity_json_coverage",
    """SELECT count(*) AS n_articles, count(*) FILTER (event_type <> 'view') AS n_with_json, count(*) FILTER (event_type = 'error') AS n_bad_json, count(*) FILTER (event_type NOT IN ('view', 'error')) AS n_entities FROM events""",
)
def a17(spark, sf):
    name = F.concat(F.lit('[{"name": "'), F.col("user_id").cast("string"), F.lit('", "type": "user"}]'))
    arts = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "[]").when(F.col("event_type") == "error", F.lit('[{"name":')).otherwise(name).alias("entities_json"))
    return G.entity_json_coverage(arts)


@query(
    "a18_detect_communities",
    """WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS a, p_partkey // 2 AS b, p_brand FROM part), l AS (SELECT p.p_partkey AS v, p.p_partkey AS nd FROM part p
      UNION SELECT l.v, q.p_partkey FROM l JOIN part p ON p.p_partkey = l.nd JOIN part q ON q.p_partkey = p.p_partkey // 2 AND q.p_brand = p.p_brand)
    SELECT v AS article_id, min(nd) AS community_id FROM l GROUP BY ALL""",
)
def a18(spark, sf):
    # Parts linked to their parent of the same brand: the root of each such run names the community.
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_brand")
    pair = F.concat_ws("-", F.col("k").cast("string"), F.expr("cast(k div 2 as string)"))
    up = p.select("k", "p_brand", F.expr("k div 2").alias("up"))
    linked = up.join(p.select(F.col("k").alias("up"), "p_brand"), ["up", "p_brand"])
    m = linked.select(F.col("k").alias("article_id"), pair.alias("entity_id")).union(linked.select("up", pair)).union(
        p.select("k", F.concat(F.lit("only-"), F.col("k").cast("string"))))
    comp, _ = G.detect_communities(m)
    return p.select(F.col("k").alias("article_id")).join(comp, "article_id", "left").withColumn("community_id", F.coalesce("community_id", "article_id"))


def _propagated(rounds: int = 5) -> str:
    steps = ["m AS MATERIALIZED (SELECT DISTINCT article_id, entity_id FROM ment)", "wt AS MATERIALIZED (SELECT entity_id, 1000000 // count(*) AS w FROM m GROUP BY ALL)",
             "l0 AS MATERIALIZED (SELECT DISTINCT article_id, article_id AS label FROM m)"]
    for k in range(rounds):
        steps.append(f"""t{k} AS MATERIALIZED (SELECT entity_id, label FROM (SELECT entity_id, label, count(*) AS n FROM m JOIN l{k} USING (article_id) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, label) = 1),
    l{k + 1} AS MATERIALIZED (SELECT article_id, label FROM (SELECT article_id, label, sum(w) AS w FROM m JOIN wt USING (entity_id) JOIN t{k} USING (entity_id) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY w DESC, label) = 1)""")
    return ",\n    ".join(steps)


@query("a18_propagated_communities", f"WITH {MENTIONS}, {_propagated()} SELECT article_id, label AS community_id FROM l5")
def a18_propagated(spark, sf):
    return G.propagate_communities(word_mentions(spark, sf))[0]


@query("a18_largest_communities", f"WITH {MENTIONS}, {_propagated()} SELECT label AS community_id, count(*) AS size FROM l5 GROUP BY ALL ORDER BY size DESC, community_id LIMIT 10")
def a18_largest(spark, sf):
    return G.largest_communities(G.propagate_communities(word_mentions(spark, sf))[1])
