"""Registered queries for scans, sinks, upserts and deletes.

Formats the given tables lack are written from them by Spark, as files in the shared folder, and come back through
the readers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.plans import sql_parts as S
from quernstone.plans.bindings import chunks, spread, table
from quernstone.plans.extract import SNODES, structure_edges, structure_nodes
from quernstone.plans.graph import GEO, geo
from quernstone.plans.registry import query
from quernstone.plans.search import embed_sql
from quernstone.session import shared_folder
from quernstone.sources import readers as R
from quernstone.sources import writers as W

big = lambda c: F.col(c).cast("bigint").alias(c)


def extraction_json(spark, sf):
    """Every conversation as one extraction result, under the three places a structure may be."""
    c = table(spark, sf, "conversations")
    turn = F.col("turn").cast("string")
    art = F.struct(
        F.concat(F.lit("dieu_"), turn).alias("id"), F.col("text").alias("title"), F.col("text").alias("content"), F.col("turn").cast("int").alias("number"),
        F.array(F.struct(F.concat(F.lit("k_"), turn).alias("id"), F.col("role").alias("title"), F.reverse("text").alias("content"))).alias("clauses"),
    )
    rel = F.struct(F.concat(F.lit("dieu_"), turn).alias("source"), F.concat(F.lit("dieu_"), (F.col("turn") + 1).cast("string")).alias("target"), F.lit("FOLLOWS").alias("type"))
    ent = F.struct(F.concat(F.lit("e_"), turn).alias("id"), F.col("role").alias("type"), F.col("text"), F.lit(0.9).alias("confidence"), F.concat(F.lit("dieu_"), turn).alias("source_article_id"))
    # A conversation has a handful of turns.
    per = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", art.alias("a"), rel.alias("r"), ent.alias("e")))).alias("t"))
    pick = lambda f: F.transform("t", lambda x: x[f])
    st = F.struct(pick("a").alias("articles"), pick("r").alias("relations"))
    sem = F.struct(pick("e").alias("entities")).alias("stage2_semantic")
    k = F.col("conv_id") % 3
    own = F.col("conv_id").alias("doc_id")
    js = F.when(k == 0, F.to_json(F.struct(own, st.alias("stage1_structure"), sem))).when(k == 1, F.to_json(F.struct(own, st.alias("structure"), sem))).otherwise(
        F.to_json(F.struct(own, pick("a").alias("articles"), pick("r").alias("relations"), sem)))
    return per.select(js.alias("value"))


@query(
    "s01_read_extraction",
    """SELECT 'node' AS kind, conv_id AS doc_id, 'dieu_' || turn AS id, md5(text) AS v FROM conversations UNION ALL SELECT 'clause', conv_id, 'k_' || turn, md5(reverse(text)) FROM conversations
    UNION ALL SELECT 'edge', conv_id, 'dieu_' || turn, 'dieu_' || (turn + 1) FROM conversations UNION ALL SELECT 'mention', conv_id, 'e_' || turn, text FROM conversations""",
)
def s01(spark, sf):
    path = shared_folder(spark, "extraction")
    extraction_json(spark, sf).write.text(path)
    t = R.read_extraction(spark, path, lines=True, id_type="long")
    row = lambda df, kind, i, v: df.select(F.lit(kind).alias("kind"), "doc_id", F.col(i).alias("id"), v.alias("v"))
    return (
        row(t["nodes"], "node", "id", F.md5("full_text")).unionByName(row(t["nested_clauses"], "clause", "id", F.md5("full_text")))
        .unionByName(row(t["edges"], "edge", "source", F.col("target"))).unionByName(row(t["mentions"], "mention", "id", F.col("text"))))


@query("s02_read_rules_csv", "SELECT p_partkey::VARCHAR AS concepts, p_name || ', ' || p_type AS doc_title, p_size AS chapter_no, p_brand AS rule_id, 'if x, then \"' || p_name || '\"' AS formula FROM part")
def s02(spark, sf):
    p = table(spark, sf, "part")
    path = shared_folder(spark, "rules")
    one = lambda x: F.lit(x)
    rules = p.select(
        F.concat_ws(", ", "p_name", "p_type").alias("doc_title"), F.col("p_size").alias("chapter_no"), one("t").alias("chapter_title"), one(1).alias("article_no"), one("a").alias("article_title"),
        one(2).alias("clause_no"), F.col("p_brand").alias("rule_id"), one("n").alias("name"), one("LIMIT").alias("rule_type"), one("INFO").alias("severity"), one("d").alias("description_vi"),
        F.concat(F.lit('if x, then "'), "p_name", F.lit('"')).alias("formula"), F.col("p_partkey").cast("string").alias("concepts"))
    rules.write.option("header", True).option("escape", '"').csv(path)
    # A comment and a blank line for every rule.
    p.select(F.explode(F.array(F.concat(F.lit("# "), "p_name"), F.lit(""))).alias("value")).write.mode("append").text(path)
    return R.read_rules_csv(spark, path).select("concepts", "doc_title", "chapter_no", "rule_id", "formula")


@query("s03_read_crawled_text", f"SELECT url, nullif(trim(regexp_extract(html, '<title>(.*?)</title>', 1)), '') AS title, length(html) AS declared_len, md5({S.strip('html')}) AS body_key, TIMESTAMP '2025-01-02 03:04:05' AS crawled_at FROM pages")
def s03(spark, sf):
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    path = shared_folder(spark, "crawled")
    table(spark, sf, "pages").select(F.concat(
        F.lit("URL: "), "url", F.lit("\nTitle: "), title, F.lit("\nCrawled: 2025-01-02T03:04:05\nLength: "), F.format_number(F.length("html"), 0), F.lit(" characters\n" + "=" * 100 + "\n\n"), "html").alias("value")
    ).write.option("lineSep", R.PAGE_END).text(path)
    out = R.read_crawled_text(spark, path, many=True)
    return out.select("url", F.trim("title").alias("title"), big("declared_len"), F.md5("body").alias("body_key"), "crawled_at")


@query("s04_read_chunks", f"WITH {S.CHUNKS} SELECT doc_id, chunk_id, language, doc_type FROM chunks WHERE language IN ('en', 'fr')")
def s04(spark, sf):
    path = shared_folder(spark, "chunks")
    W.write_keyword_index(chunks(spark, sf), path, F.lit("2025-01-01 00:00:00").cast("timestamp"))
    return R.read_chunks(spark, path, ["doc_id", "chunk_id", "language", "doc_type"], ["en", "fr"])


@query("s05_read_graph", f"WITH {GEO} SELECT 'node' AS kind, id AS a, label AS b, name AS c FROM gn UNION ALL SELECT 'edge', src, type, dst FROM ge")
def s05(spark, sf):
    n, e = geo(spark, sf)
    path = shared_folder(spark, "graph")
    n.write.json(f"{path}/nodes")
    e.write.json(f"{path}/edges")
    n, e = R.read_graph(spark, f"{path}/nodes", f"{path}/edges", "json")
    return n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"), F.element_at("props", F.lit("name")).alias("c")).unionByName(
        e.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("type").alias("b"), F.col("dst").alias("c")))


@query("s07_write_keyword_index", f"WITH {S.CHUNKS} SELECT doc_id || '_' || chunk_id AS index_id, CASE WHEN doc_id % 2 = 0 THEN faculty ELSE 'general' END AS faculty, CASE WHEN doc_id % 3 = 0 THEN 'm' || doc_id ELSE '' END AS subject, language, doc_type, year::BIGINT AS year, CASE WHEN doc_id % 3 = 0 THEN chunk_index::VARCHAR END AS char_start FROM chunks")
def s07(spark, sf):
    c = chunks(spark, sf)
    meta = F.when(F.col("doc_id") % 3 == 0, F.create_map(
        F.lit("subject"), F.concat(F.lit("m"), F.col("doc_id").cast("string")), F.lit("char_start"), F.concat(F.col("chunk_index").cast("string"), F.lit(".0"))))
    c = c.withColumns({"faculty": F.when(F.col("doc_id") % 2 == 0, F.col("faculty")), "metadata": meta})
    path = shared_folder(spark, "keyword_index")
    W.write_keyword_index(c, path, F.lit("2025-01-01 00:00:00").cast("timestamp"))
    return R.read_chunks(spark, path).select("index_id", "faculty", "subject", "language", "doc_type", big("year"), F.element_at("metadata", F.lit("char_start")).alias("char_start"))


@query(
    "s08_write_vector_index",
    f"""WITH chunks AS (SELECT doc_id, text FROM documents), {S.positions('chunks', 'doc_id', ('text',))}, {embed_sql('d', '', 'doc_id', 'forms')},
    v AS (SELECT doc_id, round(max(v / n), 6) AS top_value FROM d_v JOIN d_n USING (doc_id) GROUP BY ALL)
    SELECT d.doc_id, d.doc_id || '_0' AS chunk_id, source AS doc_type, lang AS language, 0::BIGINT AS page, '' AS subject, CASE WHEN d.doc_id % 2 = 0 THEN '{{"chapter":"c' || (d.doc_id % 5) || '"}}' ELSE '{{}}' END AS metadata_json,
      CASE WHEN d.doc_id % 2 = 0 THEN 'c' || (d.doc_id % 5) END AS chapter, greatest(top_value, 0) AS top_value FROM documents d LEFT JOIN v USING (doc_id)""",
)
def s08(spark, sf):
    d = spread(table(spark, sf, "documents"), "doc_id").select(
        "doc_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(0).alias("chunk_index"), "text", F.col("source").alias("doc_type"), F.col("lang").alias("language"),
        F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("chapter"), F.concat(F.lit("c"), (F.col("doc_id") % 5).cast("string")))).alias("extra"))
    path = shared_folder(spark, "vector_index")
    W.write_vector_index(d, path)
    return R.read_vectors(spark, path).select("doc_id", "chunk_id", "doc_type", "language", big("page"), "subject", "metadata_json", "chapter", F.round(F.array_max("embedding"), 6).alias("top_value"))


# Documents are indexed; labelled documents come in again with their labels as text.
def stored(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.md5("text").alias("text"), F.lit("2024-01-01").alias("created_at"), F.lit("2024-01-01").alias("updated_at"))


def relabelled(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", F.concat_ws("/", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("text"))
    new = l.select(F.col("doc_id"), F.lit("c").alias("p"), "text").unionByName(l.select("doc_id", F.lit("x").alias("p"), "text"))
    return new.select("doc_id", F.concat("p", F.col("doc_id").cast("string")).alias("chunk_id"), "text", F.lit("2025-01-01").alias("created_at"), F.lit("2025-01-01").alias("updated_at"))


_STORE = """st AS (SELECT doc_id, 'c' || doc_id AS chunk_id, md5(text) AS text, '2024-01-01' AS created_at, '2024-01-01' AS updated_at FROM documents),
inc AS (SELECT doc_id, p || doc_id AS chunk_id, quality || '/' || toxic AS text, '2025-01-01' AS created_at, '2025-01-01' AS updated_at FROM labels, (VALUES ('c'), ('x')) v(p))"""


@query(
    "s09_upsert_chunks",
    f"""WITH {_STORE} SELECT doc_id, chunk_id, CASE WHEN i.text IS NOT NULL THEN i.text ELSE s.text END AS text, coalesce(s.created_at, i.created_at) AS created_at, coalesce(i.updated_at, s.updated_at) AS updated_at,
    CASE WHEN i.text IS NULL THEN 'kept' WHEN s.text IS NULL THEN 'created' ELSE 'updated' END AS state FROM st s FULL JOIN inc i USING (doc_id, chunk_id)""",
)
def s09(spark, sf):
    return W.upsert_chunks(stored(spark, sf), relabelled(spark, sf))


@query("s10_delete_by_doc", f"WITH {S.CHUNKS}, n AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY ALL) SELECT 'left' AS kind, doc_id, n FROM n WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'deleted', l.doc_id, coalesce(n, 0) FROM labels l LEFT JOIN n USING (doc_id)")
def s10(spark, sf):
    left, gone = W.delete_by_doc(chunks(spark, sf).select("doc_id", "chunk_id"), table(spark, sf, "labels"))
    return left.groupBy("doc_id").agg(F.count("*").alias("n")).select(F.lit("left").alias("kind"), "doc_id", "n").unionByName(
        gone.select(F.lit("deleted").alias("kind"), "doc_id", F.col("deleted").alias("n")))


@query("s11_delete_chunk", f"WITH {_STORE} SELECT 'left' AS kind, doc_id, chunk_id, NULL::BOOLEAN AS found FROM st WHERE chunk_id NOT IN (SELECT chunk_id FROM inc) UNION ALL SELECT 'asked', doc_id, chunk_id, chunk_id LIKE 'c%' FROM inc")
def s11(spark, sf):
    left, asked = W.delete_chunks(stored(spark, sf), relabelled(spark, sf))
    return left.select(F.lit("left").alias("kind"), "doc_id", "chunk_id", F.lit(None).cast("boolean").alias("found")).unionByName(
        asked.select(F.lit("asked").alias("kind"), "doc_id", "chunk_id", "found"))


@query("s12_reindex_document", f"WITH {_STORE} SELECT doc_id, chunk_id, text FROM st WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, chunk_id, text FROM inc")
def s12(spark, sf):
    return W.reindex_documents(stored(spark, sf), relabelled(spark, sf)).select("doc_id", "chunk_id", "text")


@query(
    "s13_export_graph",
    f"""WITH {GEO} SELECT 'node' AS kind, id AS a, NULL AS b, '{{"id":"' || id || '","labels":["' || label || '"],"properties":{{' || concat_ws(',', '"name":"' || name || '"', '"title":"' || title || '"') || '}}}}' AS json FROM gn
    UNION ALL SELECT 'edge', src, dst, '{{"source_id":"' || src || '","target_id":"' || dst || '","source_text":"' || src || '","target_text":"' || dst || '","source_label":"' || a.label || '","target_label":"' || b.label || '","type":"' || type || '"}}' FROM ge JOIN gn a ON a.id = src JOIN gn b ON b.id = dst
    UNION ALL SELECT 'stats', (SELECT count(*) FROM gn)::VARCHAR, (SELECT count(*) FROM ge)::VARCHAR, '2025-01-01T00:00:00'""",
)
def s13(spark, sf):
    n, e = geo(spark, sf)
    nodes, edges, stats = W.export_graph(n, e.withColumn("props", F.lit(None).cast("map<string,string>")), F.lit("2025-01-01").cast("timestamp"))
    none = F.lit(None).cast("string").alias("b")
    return (
        nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), none, "json")
        .unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "json"))
        .unionByName(stats.select(F.lit("stats").alias("kind"), F.col("nodes").cast("string").alias("a"), F.col("relationships").cast("string").alias("b"), F.col("exported_at").alias("json"))))


@query(
    "s14_write_extraction_result",
    f"""WITH {SNODES}, u AS (SELECT doc_id, 1 AS n, 0 AS e, 0 AS m, 0 AS r FROM snodes UNION ALL SELECT doc_id, 0, 1, 0, 0 FROM sedges UNION ALL SELECT doc_id, 0, 0, 1, 0 FROM labels UNION ALL SELECT doc_id, 0, 0, 0, 1 FROM labels WHERE quality = 1)
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS total_structural_nodes, CAST(sum(e) AS BIGINT) AS total_structural_relations, CAST(sum(m) AS BIGINT) AS total_semantic_entities, CAST(sum(r) AS BIGINT) AS total_semantic_relations,
      CAST(sum(n) AS BIGINT) AS lines_nodes, CAST(sum(e) AS BIGINT) AS lines_structural_relations, CAST(sum(m) AS BIGINT) AS lines_entities, CAST(sum(r) AS BIGINT) AS lines_relations, 0::BIGINT AS bad FROM u GROUP BY ALL""",
)
def s14(spark, sf):
    l = table(spark, sf, "labels")
    made = W.extraction_result(structure_nodes(spark, sf), structure_edges(spark, sf), l.select("doc_id", "quality"), l.filter("quality = 1").select("doc_id", "toxic"))
    path = shared_folder(spark, "extraction_result")
    W.write_extraction_result(*made, path)
    parts, summary = R.read_extraction_result(spark, path)
    # The summary as it was written, and the lines that came back, which have to agree.
    lines = parts.groupBy("doc_id").agg(*[F.count_if(F.col("section") == s).alias(f"lines_{s}") for s in W.SECTIONS], F.count_if(F.get_json_object("json", "$").isNull()).alias("bad"))
    both = summary.join(lines, "doc_id")
    return both.select(F.col("doc_id").cast("long").alias("doc_id"), *[c for c in summary.columns if c != "doc_id"], *[f"lines_{s}" for s in W.SECTIONS], "bad")


@query("s15_index_stats", f"WITH {S.CHUNKS} SELECT count(*) AS doc_count, CAST(sum(strlen(text)) AS BIGINT) AS size_in_bytes FROM chunks")
def s15(spark, sf):
    return W.index_stats(chunks(spark, sf))
