"""Registered queries for filters, request mapping, projections and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import filters as O
from quernstone.plans import sql_parts as S
from quernstone.plans.bindings import chunks, table
from quernstone.plans.graph import GEO, geo
from quernstone.plans.registry import query

big = lambda c: F.col(c).cast("bigint").alias(c)


@query("f01_filter_terms", f"WITH {S.CHUNKS} SELECT doc_id, chunk_id, faculty, year::BIGINT AS year, language FROM chunks WHERE faculty IN ('science', 'law') AND year IN (2019, 2022, 2024) AND language = 'de'")
def f01(spark, sf):
    kept = O.filter_terms(chunks(spark, sf), [], ["science", "law"], [2019, 2022, 2024], None, "de")
    return kept.select("doc_id", "chunk_id", "faculty", big("year"), "language")


@query("f02_filter_metadata", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND json_extract_string(props, '$.k') IN ('1', '7', '42')")
def f02(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", F.from_json("props", "map<string,string>").alias("metadata"))
    return O.filter_metadata(ev, {"event_type": ["click", "view"], "k": ["1", "7", "42"]}, known=("event_type",)).select("event_id", "event_type")


@query(
    "f03_map_request",
    """SELECT event_id, 8::BIGINT AS top_k, event_type AS text, CASE user_id % 4 WHEN 0 THEN 'vector' WHEN 1 THEN 'bm25' ELSE 'hybrid' END AS mode, (user_id % 3 <> 0 OR event_type = 'click') AS has_filters,
    CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN 'vi' ELSE 'en' END AS language FROM events""",
)
def f03(spark, sf):
    u = F.col("user_id")
    none = F.lit(None).cast("array<string>")
    req = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("query"), F.lit(8).cast("bigint").alias("top_k"), F.when(u % 4 == 0, "vector").when(u % 4 == 1, "bm25").when(u % 4 == 2, "fancy").alias("search_mode"),
        F.when(u % 3 == 1, "vi").when(u % 3 == 2, "fr").alias("language"), none.alias("doc_types"), F.when(F.col("event_type") == "click", F.array(F.lit("law"))).alias("faculties"),
        F.lit(None).cast("array<int>").alias("years"), none.alias("subjects"), F.lit(None).cast("map<string,string>").alias("filters"))
    return O.map_request(req).select("event_id", "top_k", "text", "mode", F.col("filters").isNotNull().alias("has_filters"), "filters.language")


@query("f04_project_hits", f"WITH {S.CHUNKS} SELECT doc_id, chunk_id, title, doc_type, language, round(length(text) / 100.0, 4)::DOUBLE AS score, chunk_index::BIGINT AS fusion_rank, text AS cited FROM chunks")
def f04(spark, sf):
    c = chunks(spark, sf).withColumns({"score": F.round(F.length("text") / 100.0, 4), "rank": F.col("chunk_index"), "highlights": F.array("text")})
    hits = O.project_hits(c)
    return hits.select(F.col("meta.doc_id").alias("doc_id"), F.col("citation.chunk_id").alias("chunk_id"), "title", "doc_type", "language", "score", big("fusion_rank"), F.get("citation.highlighted_text", F.lit(0)).alias("cited"))


@query("f05_nodes_by_category", f"WITH {GEO} SELECT id, label, name FROM gn WHERE label = 'Customer' AND title = 'BUILDING' ORDER BY id LIMIT 100")
def f05(spark, sf):
    nodes, _ = geo(spark, sf)
    return O.nodes_by_category(nodes, "Customer", {"title": "BUILDING"}).select("id", "label", F.element_at("props", F.lit("name")).alias("name"))


@query("f06_lookup_nodes", f"WITH {GEO} SELECT id, label FROM gn WHERE id IN (SELECT 'c' || o_custkey FROM orders WHERE o_orderstatus = 'P')")
def f06(spark, sf):
    nodes, _ = geo(spark, sf)
    keys = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"))
    return O.lookup_nodes(nodes, keys).select("id", "label")


@query(
    "f07_contains_scan",
    """WITH t AS (SELECT DISTINCT p_name AS term FROM part UNION SELECT DISTINCT upper(p_type) FROM part),
    n AS (SELECT p_partkey::VARCHAR AS id, lower(p_name || chr(10) || p_type || chr(10) || p_brand) AS body FROM part), m AS (SELECT term, id, row_number() OVER (PARTITION BY term ORDER BY id) AS rank FROM t JOIN n ON contains(body, lower(term)))
    SELECT term, id, rank FROM m WHERE rank <= 20""",
)
def f07(spark, sf):
    p = table(spark, sf, "part")
    nodes = p.select(F.col("p_partkey").cast("string").alias("id"), F.lit("Part").alias("label"), "p_name", "p_type", "p_brand")
    terms = p.select(F.col("p_name").alias("term")).union(p.select(F.upper("p_type"))).distinct()
    return O.contains_scan(nodes, terms, ["p_name", "p_type", "p_brand"]).select("term", "id", big("rank"))


@query("f08_entity_lookup", "SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')) AND p_type = 'ECONOMY'")
def f08(spark, sf):
    ents = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("text"), F.lower("p_brand").alias("normalized_text"), F.col("p_type").alias("type"))
    return O.entity_lookup(ents, "Ring", "ECONOMY").select("p_partkey", F.col("text").alias("p_name"))


@query("f09_validate_enum", "SELECT c_custkey, c_mktsegment AS kind FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def f09(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.lower("c_mktsegment").alias("kind"))
    return O.validate_enum(c, "kind", ["BUILDING", "MACHINERY"])
