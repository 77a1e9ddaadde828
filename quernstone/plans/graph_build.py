"""Registered queries for entity resolution and graph construction.

Order lines act as entity mentions of their order, orders as modifications.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import extract as X
from quernstone.operators import graph_build as B
from quernstone.plans import sql_parts as S
from quernstone.plans.bindings import table
from quernstone.plans.extract import SNODES, structure_edges, structure_nodes
from quernstone.plans.graph import GEO, NET, customers, geo, network
from quernstone.plans.registry import query

big = lambda c: F.col(c).cast("bigint").alias(c)
KINDS = ["MON_HOC", "KHOA", "QUY_DINH", "TIN_CHI"]

RAW = """raw AS MATERIALIZED (SELECT l_orderkey AS doc_id, 'ent_' || l_orderkey || '_' || l_linenumber AS id, ['MON_HOC','KHOA','QUY_DINH','TIN_CHI'][l_suppkey % 4 + 1] AS type,
  CASE WHEN l_linenumber = 7 THEN '  ' ELSE ' Entity  ' || (l_partkey % 300) || ['.', ' ', '!?', ''][l_quantity::INTEGER % 4 + 1] END AS text,
  round(0.5 + l_discount * 5, 4) AS confidence, 'dieu_' || l_orderkey AS source_article_id, (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + l_quantity::BIGINT AS ord, l_partkey AS start, l_partkey + l_suppkey AS "end", l_suppkey FROM lineitem)"""
NORMED = f"""norm AS MATERIALIZED (SELECT *, lower(regexp_replace({S.strip("regexp_replace(text, '\\s+', ' ', 'g')")}, '^[.,;:!?]+|[.,;:!?]+$', '', 'g')) AS normalized FROM raw)"""


def _place_number(l):
    """A mention's place as one number: a bigint, or a decimal where the keys are too large for one."""
    parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]

    def number(order, line, part, supplier, quantity):
        return (((order * 10 + line) * 100000 + part) * 10000 + supplier) * 100 + quantity

    largest = l.agg(*[F.max(F.abs(c)).alias(c) for c in parts]).first()
    wide = number(*[int(x or 0) for x in largest]) >= 2**63
    order, *others = [F.col(c) for c in parts[:-1]]
    quantity = F.col("l_quantity").cast("bigint")
    if not wide:
        return number(order, *others, quantity)
    return number(order.cast("decimal(20,0)"), *others, quantity).cast("decimal(38,0)")


def raw_mentions(spark, sf):
    l = table(spark, sf, "lineitem")
    s = lambda e: F.expr(f"cast({e} as string)")
    tail = F.element_at(F.array(*[F.lit(x) for x in (".", " ", "!?", "")]), (F.col("l_quantity").cast("int") % 4 + 1))
    return l.select(
        F.col("l_orderkey").alias("doc_id"), F.concat_ws("_", F.lit("ent"), s("l_orderkey"), s("l_linenumber")).alias("id"),
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("type"),
        F.when(F.col("l_linenumber") == 7, "  ").otherwise(F.concat(F.lit(" Entity  "), s("l_partkey % 300"), tail)).alias("text"),
        F.round(0.5 + F.col("l_discount") * 5, 4).alias("confidence"), F.concat(F.lit("dieu_"), s("l_orderkey")).alias("source_article_id"),
        _place_number(l).alias("ord"),
        F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_suppkey")).alias("end"),
        F.create_map(F.lit("code"), s("l_suppkey"), F.concat(F.lit("k"), s("l_linenumber")), s("l_partkey")).alias("metadata"),
    )


def mentions(spark, sf):
    return B.normalize_entities(raw_mentions(spark, sf))


_REASON = """CASE WHEN confidence < 0.7 THEN 'confidence below threshold' WHEN trim(text) = '' THEN 'empty text' WHEN type = 'TIN_CHI' THEN 'invalid category' END"""


@query("g01_validate_entities", f"WITH {RAW} SELECT id, ord, {_REASON} AS reason FROM raw")
def g01(spark, sf):
    return B.validate_entities(raw_mentions(spark, sf)).select("id", "ord", "reason")


@query("g02_normalize_entities", f"WITH {RAW}, {NORMED} SELECT ord, normalized FROM norm")
def g02(spark, sf):
    return mentions(spark, sf).select("ord", "normalized")


@query(
    "g03_dedupe_exact",
    f"""WITH {RAW}, {NORMED}, r AS (SELECT *, row_number() OVER (PARTITION BY type, normalized ORDER BY confidence DESC, ord) AS n, count(*) OVER (PARTITION BY type, normalized) AS c FROM norm)
    SELECT type, normalized, text, confidence, ord, c AS n_merged FROM r WHERE n = 1""",
)
def g03(spark, sf):
    return B.dedupe_exact(mentions(spark, sf)).select("type", "normalized", "text", "confidence", "ord", "n_merged")


# Names of customers and parts, with similar ones among them, as entities of a nation or brand.
def similar_names(spark, sf):
    d = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{10,})"))).alias("w"))
    w2 = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{12,})"))).alias("w"))
    return d.union(w2).distinct().select(
        F.lit("WORD").alias("type"), F.col("w").alias("text"), F.col("w").alias("normalized"), F.lit(0.9).alias("confidence"), F.xxhash64("w").alias("ord"),
    )


_NEAR = """pr AS MATERIALIZED (SELECT a.type, a.w AS a, b.w AS b FROM names a JOIN names b ON a.type = b.type AND abs(length(a.w) - length(b.w)) <= 0.1 * greatest(length(a.w), length(b.w)) + 1e-9
  WHERE a.w <> b.w AND 1 - levenshtein(a.w, b.w) / greatest(length(a.w), length(b.w)) >= 0.9 - 1e-9),
reach AS (SELECT type, w AS n, w AS m FROM names UNION SELECT r.type, r.n, p.b FROM reach r JOIN pr p ON p.type = r.type AND p.a = r.m),
clu AS MATERIALIZED (SELECT type, n AS w, min(m) AS cluster FROM reach GROUP BY ALL)"""


@query(
    "g04_dedupe_fuzzy",
    f"""WITH RECURSIVE names AS MATERIALIZED (SELECT DISTINCT 'WORD' AS type, w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{10,}}')) AS w FROM benchmark UNION ALL SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{12,}}')) FROM documents)), {_NEAR}
    SELECT type, cluster, count(*) AS n_merged FROM clu GROUP BY ALL""",
)
def g04(spark, sf):
    return B.dedupe_fuzzy(similar_names(spark, sf)).select("type", "cluster", "n_merged")


@query(
    "g05_dedupe_hybrid",
    f"""WITH RECURSIVE {RAW}, {NORMED}, ex AS MATERIALIZED (SELECT type, normalized, text, confidence, ord FROM (SELECT *, row_number() OVER (PARTITION BY type, normalized ORDER BY confidence DESC, ord) AS n FROM norm) WHERE n = 1),
    names AS MATERIALIZED (SELECT type, normalized AS w FROM ex), {_NEAR},
    r AS (SELECT e.type, cluster, text, confidence, row_number() OVER (PARTITION BY e.type, cluster ORDER BY confidence DESC, ord) AS n, count(*) OVER (PARTITION BY e.type, cluster) AS n_merged FROM ex e JOIN clu c ON c.type = e.type AND c.w = e.normalized)
    SELECT type, cluster, text, confidence, n_merged FROM r WHERE n = 1""",
)
def g05(spark, sf):
    return B.dedupe_hybrid(mentions(spark, sf), 0.9).select("type", "cluster", "text", "confidence", "n_merged")


@query(
    "g06_merge_policy",
    f"""WITH {RAW}, {NORMED}, r AS (SELECT *, row_number() OVER (PARTITION BY type, normalized ORDER BY confidence DESC, ord) AS best, row_number() OVER (PARTITION BY type, normalized ORDER BY ord) AS fst,
      row_number() OVER (PARTITION BY type, normalized ORDER BY ord DESC) AS lst FROM norm),
    b AS (SELECT type, normalized, arg_max(text, confidence * 1000000000000 - ord / 1000000000.0) AS bt FROM r WHERE lst > 1 GROUP BY ALL),
    m AS (SELECT type, normalized, max(CASE WHEN best = 1 THEN text END) AS text, max(confidence) AS confidence, min(start) AS start, max("end") AS "end", max(CASE WHEN lst = 1 THEN text END) AS lt,
      max(CASE WHEN fst = 1 THEN ord END) AS first_ord, max(CASE WHEN lst = 1 THEN l_suppkey::VARCHAR END) AS code, count(*) AS n FROM r GROUP BY ALL)
    SELECT type, normalized, text, confidence, start, "end", first_ord, code, n AS n_merged, n > 1 AS was_merged FROM m""",
)
def g06(spark, sf):
    out = B.merge_policy(mentions(spark, sf), ["type", "normalized"], "merge")
    return out.select(
        "type", "normalized", "text", "confidence", "start", "end", F.col("ord").alias("first_ord"),
        F.element_at("metadata", F.lit("code")).alias("code"), "n_merged", F.col("merged_from").isNotNull().alias("was_merged"))


@query(
    "g07_entities_to_nodes",
    f"""WITH {RAW}, {NORMED}, r AS (SELECT *, row_number() OVER (PARTITION BY type, normalized ORDER BY confidence DESC, ord) AS n FROM norm WHERE {_REASON} IS NULL)
    SELECT type || ':' || normalized AS id, type AS label, text AS name, CASE WHEN type IN ('MON_HOC', 'KHOA') THEN l_suppkey::VARCHAR END AS code, CASE WHEN type = 'MON_HOC' THEN '0' END AS credits,
      CASE WHEN type = 'QUY_DINH' THEN text END AS title, CASE WHEN type = 'QUY_DINH' THEN '2025' END AS year FROM r WHERE n = 1""",
)
def g07(spark, sf):
    valid = B.validate_entities(mentions(spark, sf)).filter("reason is null").drop("reason")
    n = B.entities_to_nodes(B.dedupe_exact(valid), "2025")
    return n.select("id", "label", *[F.element_at("props", F.lit(k)).alias(k) for k in ("name", "code", "credits", "title", "year")])


_RELS = """rels AS MATERIALIZED (SELECT a.id AS source_id, b.id AS target_id, a.text AS source_text, a.type AS source_type, b.text AS target_text, b.type AS target_type, a.confidence,
  CASE a.l_suppkey % 3 WHEN 0 THEN 'YEU_CAU' WHEN 1 THEN 'LIEN_QUAN' ELSE 'GIOI_HAN' END AS type, a.ord AS ord FROM (SELECT * FROM raw) a JOIN (SELECT doc_id, any_value(id) AS id, min(text) AS text, min(type) AS type FROM raw GROUP BY doc_id) b ON a.doc_id = b.doc_id)"""


def relations(spark, sf):
    """From each mention to one mention of its order: the smallest text and type there."""
    m = raw_mentions(spark, sf)
    to = m.groupBy("doc_id").agg(F.min("id").alias("target_id"), F.min("text").alias("target_text"), F.min("type").alias("target_type"))
    k = (F.col("end") - F.col("start")) % 3
    return m.join(to, "doc_id").select(
        F.col("id").alias("source_id"), "target_id", F.col("text").alias("source_text"), F.col("type").alias("source_type"), "target_text", "target_type", "confidence",
        F.when(k == 0, "YEU_CAU").when(k == 1, "LIEN_QUAN").otherwise("GIOI_HAN").alias("type"), "ord", F.col("source_article_id").alias("evidence"),
    )


@query(
    "g08_relations_to_edges",
    f"""WITH {RAW}, {NORMED}, {_RELS}, ids AS (SELECT DISTINCT type || ':' || normalized AS id FROM norm WHERE {_REASON} IS NULL),
    v AS (SELECT *, source_type || ':' || lower(regexp_replace({S.strip("regexp_replace(source_text, '\\s+', ' ', 'g')")}, '^[.,;:!?]+|[.,;:!?]+$', '', 'g')) AS src,
      target_type || ':' || lower(regexp_replace({S.strip("regexp_replace(target_text, '\\s+', ' ', 'g')")}, '^[.,;:!?]+|[.,;:!?]+$', '', 'g')) AS dst FROM rels
      WHERE confidence >= 0.7 AND type <> 'GIOI_HAN' AND source_text <> '' AND target_text <> '' AND NOT (source_text = target_text AND source_type = target_type))
    SELECT src, dst, type, confidence FROM v WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)""",
)
def g08(spark, sf):
    valid = B.validate_entities(mentions(spark, sf)).filter("reason is null")
    nodes = valid.select(F.concat_ws(":", "type", "normalized").alias("id")).distinct()
    return B.relations_to_edges(relations(spark, sf), nodes)[0]


@query(
    "g09_upsert_nodes",
    """WITH inc AS (SELECT l_suppkey AS k, max(l_orderkey * 10 + l_linenumber) AS last_ord FROM lineitem GROUP BY ALL)
    SELECT 'Supplier' AS label, s_suppkey AS id, s_name AS name, last_ord::VARCHAR AS seen, CASE WHEN last_ord IS NOT NULL THEN 'changed' ELSE 'kept' END AS note, 'updated' AS state FROM supplier LEFT JOIN inc ON k = s_suppkey
    UNION ALL SELECT 'Part', p_partkey, NULL, max(l_orderkey * 10 + l_linenumber)::VARCHAR, 'new', 'created' FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey""",
)
def g09(spark, sf):
    old = table(spark, sf, "supplier").select(
        F.lit("Supplier").alias("label"), F.col("s_suppkey").alias("id"), F.create_map(F.lit("name"), F.col("s_name"), F.lit("note"), F.lit("kept")).alias("props"))
    l = table(spark, sf, "lineitem").withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    inc = lambda label, key, note: l.select(
        F.lit(label).alias("label"), F.col(key).alias("id"), F.create_map(F.lit("seen"), F.col("ord").cast("string"), F.lit("note"), F.lit(note)).alias("props"), "ord")
    out = B.upsert_nodes(old, inc("Supplier", "l_suppkey", "changed").unionByName(inc("Part", "l_partkey", "new")))
    return out.select("label", "id", *[F.element_at("props", F.lit(k)).alias(k) for k in ("name", "seen", "note")], "state")


@query("g10_append_edges", f"WITH {NET} SELECT ref_text AS type, count(*) AS created FROM net JOIN customer a ON a.c_custkey = src JOIN customer b ON b.c_custkey = dst WHERE a.c_acctbal > 0 AND b.c_acctbal > 0 GROUP BY ALL")
def g10(spark, sf):
    rich = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    e = network(spark, sf).select("src", "dst", F.col("ref_text").alias("type"))
    return B.append_edges(e, rich)[1]


_STRUCT = f"""{SNODES}, kept AS (SELECT *, lower(type) AS kind FROM snodes WHERE type IN ('Chapter', 'Article', 'Clause')),
gnodes AS MATERIALIZED (SELECT doc_id || '/' || id AS id, arg_max(type, ord) AS label, arg_max(title, ord) AS title, arg_max(full_text, ord) AS full_text FROM kept GROUP BY doc_id, id),
gedges AS MATERIALIZED (SELECT DISTINCT e.doc_id || '/' || source AS src, e.doc_id || '/' || target AS dst, type FROM sedges e WHERE e.doc_id || '/' || source IN (SELECT id FROM gnodes) AND e.doc_id || '/' || target IN (SELECT id FROM gnodes)
  UNION ALL SELECT id, 'rules', 'BELONGS_TO' FROM gnodes WHERE label IN ('Article', 'Clause'))"""


def corpus(spark, sf):
    return X.partition_nodes(structure_nodes(spark, sf)), structure_edges(spark, sf)


@query(
    "g11_build_structure_graph",
    f"WITH {_STRUCT} SELECT 'node' AS kind, id AS a, label AS b, md5(full_text) AS c FROM gnodes UNION ALL SELECT 'node', 'rules', 'Category', NULL UNION ALL SELECT 'edge', src, type, dst FROM gedges",
)
def g11(spark, sf):
    n, e = B.build_structure_graph(*corpus(spark, sf), "rules")
    return n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"), F.md5("full_text").alias("c")).unionByName(
        e.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("type").alias("b"), F.col("dst").alias("c")))


RESOLVED = "ent AS MATERIALIZED (SELECT normalized AS normalized_text, type, arg_min(text, ord) AS text, count(*) AS mention_count FROM norm GROUP BY ALL)"


@query("g12_resolve_entities", f"WITH {RAW}, {NORMED}, {RESOLVED} SELECT * FROM ent")
def g12(spark, sf):
    return B.resolve_entities(mentions(spark, sf))


@query(
    "g13_build_mentions",
    f"""WITH {RAW}, {NORMED}, src AS (SELECT 'dieu_' || o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P')
    SELECT source_article_id AS source_id, normalized AS normalized_text, type, arg_min(confidence, ord) AS confidence, arg_min(norm.id, ord) AS local_id FROM norm JOIN src ON src.id = source_article_id GROUP BY ALL""",
)
def g13(spark, sf):
    src = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.concat(F.lit("dieu_"), F.col("o_orderkey").cast("string")).alias("id"))
    return B.build_mentions(mentions(spark, sf), src)


@query(
    "g14_resolve_semantic_edges",
    f"""WITH {RAW}, {NORMED}, loc AS MATERIALIZED (SELECT id, arg_max(normalized, ord) AS t, arg_max(type, ord) AS ty FROM norm GROUP BY ALL), mn AS (SELECT doc_id, min(id) AS target_id FROM raw GROUP BY ALL),
    r AS (SELECT raw.id AS source_id, target_id, CASE l_suppkey % 3 WHEN 0 THEN 'YEU_CAU' WHEN 1 THEN 'LIEN_QUAN' ELSE 'GIOI_HAN' END AS type, confidence, source_article_id AS evidence, ord FROM raw JOIN mn USING (doc_id))
    SELECT a.t AS src_text, a.ty AS src_type, b.t AS dst_text, b.ty AS dst_type, r.type, arg_min(confidence, ord) AS confidence, arg_min(evidence, ord) AS evidence FROM r JOIN loc a ON a.id = source_id JOIN loc b ON b.id = target_id GROUP BY ALL""",
)
def g14(spark, sf):
    return B.resolve_semantic_edges(relations(spark, sf), mentions(spark, sf))[0]


# Customers as documents with one article per nation number and clauses; orders as modifications.
_MODS = """gdoc AS (SELECT c_custkey AS doc_id, 'doc_' || c_custkey AS id, 'Document' AS label, 'Quyết định ' || (c_custkey + 100000) || '/QĐ' AS title FROM customer
  UNION ALL SELECT c_custkey, 'd' || c_custkey || '/dieu_' || c_nationkey, 'Article', 'Điều ' || c_nationkey || '. Nội dung' FROM customer
  UNION ALL SELECT c_custkey, 'd' || c_custkey || '/khoan_1_dieu_' || c_nationkey, 'Clause', 'Khoản 1 Điều ' || c_nationkey FROM customer),
m AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 10 = 0 THEN 'REPEALS' WHEN o_orderstatus = 'O' THEN 'AMENDS' WHEN o_orderstatus = 'F' THEN 'REPLACES' ELSE 'SUPPLEMENTS' END AS action,
  'doc_' || o_custkey AS src, CAST(floor(o_totalprice) AS BIGINT) % (SELECT count(*) FROM customer) AS tgt,
  CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) % 25 END AS art, o_orderpriority LIKE '2%' AS has_cl, o_orderdate::VARCHAR AS eff FROM orders),
h AS (SELECT m.*, CASE WHEN c_nationkey = art AND has_cl THEN 'd' || tgt || '/khoan_1_dieu_' || art WHEN c_nationkey = art THEN 'd' || tgt || '/dieu_' || art ELSE 'doc_' || tgt END AS dst FROM m JOIN customer ON c_custkey = tgt)"""


def modification_corpus(spark, sf):
    c = table(spark, sf, "customer")
    s = lambda e: F.expr(f"cast({e} as string)")
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    row = lambda i, lab, t: F.struct(i.alias("id"), F.lit(lab).alias("label"), t.alias("title"))
    k, nk = s("c_custkey"), s("c_nationkey")
    nodes = c.select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(
        row(cat("doc_", k), "Document", cat("Quyết định ", s("c_custkey + 100000"), "/QĐ")),
        row(cat("d", k, "/dieu_", nk), "Article", cat("Điều ", nk, ". Nội dung")),
        row(cat("d", k, "/khoan_1_dieu_", nk), "Clause", cat("Khoản 1 Điều ", nk)),
    )).alias("r")).select("doc_id", "r.*")
    n = c.select(F.count("*")).scalar()
    price = F.floor("o_totalprice").cast("bigint")
    st = F.col("o_orderstatus")
    p = F.col("o_orderpriority")
    mods = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 10 == 0, "REPEALS").when(st == "O", "AMENDS").when(st == "F", "REPLACES").otherwise("SUPPLEMENTS").alias("action"),
        cat("doc_", s("o_custkey")).alias("source_text_id"), cat((price % n + 100000).cast("string"), "/QĐ").alias("target_document_signature"),
        F.when(~p.startswith("1"), cat("Điều ", (price % 25).cast("string"))).alias("target_article"),
        F.when(p.startswith("2"), "Khoản 1").alias("target_clause"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective_date"), p.alias("description"), F.col("o_orderkey").alias("ord"),
    )
    return mods, nodes


@query(
    "g15_apply_modifications",
    f"""WITH {_MODS} SELECT 'edge' AS kind, src AS a, dst AS b, action AS c, substr(arg_min(eff, ord), 1, 10) AS d FROM h GROUP BY src, dst, action
    UNION ALL SELECT 'status', dst, arg_max(CASE WHEN action IN ('AMENDS', 'SUPPLEMENTS') THEN 'amended' ELSE 'expired' END, ord), arg_max(src, ord), substr(arg_max(eff, ord), 1, 10) FROM h GROUP BY dst""",
)
def g15(spark, sf):
    edges, status = B.apply_modifications(*modification_corpus(spark, sf), F.lit("1970-01-01"))
    return edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("type").alias("c"), F.col("effective_date").alias("d")).unionByName(
        status.select(F.lit("status").alias("kind"), F.col("id").alias("a"), F.col("status").alias("b"), F.col("modified_by").alias("c"), F.col("modification_date").alias("d")))


@query("g16_category_routing", f"WITH {_STRUCT} SELECT id, title FROM gnodes WHERE label = 'Article'")
def g16(spark, sf):
    n, e = B.build_structure_graph(*corpus(spark, sf), "rules")
    return B.category_routing(n, e, "rules").select("id", "title")


@query(
    "g17_check_unique",
    """SELECT 'Part' AS label, 'name' AS key, p_name AS value, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'Nation', 'name', n_name, count(*) FROM nation GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'Customer', 'phone', NULL, count(*) FROM customer""",
)
def g17(spark, sf):
    node = lambda t, label, key, name: table(spark, sf, t).select(F.lit(label).alias("label"), F.create_map(F.lit("name"), F.col(name)).alias("props"))
    nodes = node("part", "Part", "p_partkey", "p_name").unionByName(node("nation", "Nation", "n_nationkey", "n_name")).unionByName(node("customer", "Customer", "c_custkey", "c_name"))
    return B.check_unique(nodes, {"Part": "name", "Nation": "name", "Customer": "phone"})


@query(
    "g18_build_report",
    f"""WITH {RAW}, {NORMED}, {_RELS}, r AS (SELECT *, confidence < 0.7 OR type = 'GIOI_HAN' OR source_text = '' OR target_text = '' OR (source_text = target_text AND source_type = target_type) AS bad FROM rels)
    SELECT 'entities' AS kind, count(*) AS total, count(*) FILTER ({_REASON} IS NULL) AS created, count(*) FILTER ({_REASON} IS NOT NULL) AS failed, round(count(*) FILTER ({_REASON} IS NULL) / count(*), 6) AS success_rate FROM raw
    UNION ALL SELECT 'relations', count(*), count(*) FILTER (NOT bad), count(*) FILTER (bad), round(count(*) FILTER (NOT bad) / count(*), 6) FROM r""",
)
def g18(spark, sf):
    bad = F.col("reason").isNotNull()
    report = B.build_report({
        "entities": (B.validate_entities(raw_mentions(spark, sf)), bad), "relations": (B.validate_relations(relations(spark, sf)), bad)})
    return report.withColumn("success_rate", F.round("success_rate", 6))


@query(
    "g19_build_graph",
    f"""WITH {_STRUCT}, {RAW}, {NORMED}, {RESOLVED}, mn AS (SELECT doc_id, min(id) AS target_id FROM raw GROUP BY ALL),
    mt AS (SELECT DISTINCT doc_id || '/dieu_0_' || lang || '_1' AS source_id, normalized, type FROM norm JOIN documents USING (doc_id)),
    loc AS (SELECT id, arg_max(normalized, ord) AS t, arg_max(type, ord) AS ty FROM norm GROUP BY ALL),
    se AS (SELECT DISTINCT a.t, a.ty, b.t AS t2, b.ty AS ty2, raw.l_suppkey % 3 AS k FROM raw JOIN mn USING (doc_id) JOIN loc a ON a.id = raw.id JOIN loc b ON b.id = target_id)
    SELECT 'nodes' AS part, count(*) + 1 AS n FROM gnodes UNION ALL SELECT 'edges', count(*) FROM gedges UNION ALL SELECT 'entities', count(*) FROM ent
    UNION ALL SELECT 'mentions', count(*) FROM mt WHERE source_id IN (SELECT id FROM gnodes) UNION ALL SELECT 'semantic_edges', count(*) FROM se""",
)
def g19(spark, sf):
    lang = table(spark, sf, "documents").select("doc_id", "lang")
    m = mentions(spark, sf).join(lang, "doc_id", "left").withColumn(
        "source_article_id", F.concat(F.col("doc_id").cast("string"), F.lit("/dieu_0_"), F.coalesce("lang", F.lit("?")), F.lit("_1"))).drop("lang")
    mods = modification_corpus(spark, sf)[0]
    parts = B.build_graph(*corpus(spark, sf), m, relations(spark, sf), mods, "rules", F.lit("1970-01-01"))
    counts = [parts[p].agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "n") for p in ("nodes", "edges", "entities", "mentions", "semantic_edges")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(
    "g20_check_edge_schema",
    f"""WITH {GEO} SELECT a.label AS src_label, type, b.label AS dst_label, count(*) AS n FROM ge JOIN gn a ON a.id = src JOIN gn b ON b.id = dst
    WHERE NOT ((a.label = 'Nation' AND type = 'IN_REGION' AND b.label = 'Region') OR (a.label = 'Customer' AND type = 'IN_REGION' AND b.label = 'Nation')) GROUP BY ALL""",
)
def g20(spark, sf):
    nodes, edges = geo(spark, sf)
    return B.check_edge_schema(edges, nodes, [("Nation", "IN_REGION", "Region"), ("Customer", "IN_REGION", "Nation")])
