"""Scans: extraction JSON, rule CSV, crawled text, indexed chunks, graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import py_strip
from quernstone.session import stored

_NODE = "id: string, type: string, title: string, full_text: string, content: string, number: int, page: int, page_range: array<int>, chapter: string, parent_id: string"
_CLAUSE = "array<struct<id: string, title: string, full_text: string, content: string>>"
_STRUCTURE = (
    f"document: struct<{_NODE}>, chapters: array<struct<{_NODE}>>, articles: array<struct<{_NODE}, clauses: {_CLAUSE}>>, "
    f"clauses: array<struct<{_NODE}>>, tables: array<struct<{_NODE}>>, relations: array<struct<source: string, target: string, type: string>>"
)
_RELATION = "source_id: string, target_id: string, source_article_id: string, target_article_id: string, type: string, relation_type: string, confidence: double, evidence: string"
_SEMANTIC = (
    "entities: array<struct<id: string, type: string, text: string, normalized: string, confidence: double, source_article_id: string>>, "
    f"relations: array<struct<{_RELATION}>>, "
    "modifications: array<struct<action: string, source_text_id: string, target_document_signature: string, target_article: string, target_clause: string, effective_date: string, description: string>>"
)
EXTRACTION_SCHEMA = (
    f"source_file: string, category: string, stage1_structure: struct<{_STRUCTURE}>, structure: struct<{_STRUCTURE}>, {_STRUCTURE.split(', relations:')[0]}, "
    f"relations: array<struct<source: string, target: string, {_RELATION}>>, stage2_semantic: struct<{_SEMANTIC}>"
)

RULES_SCHEMA = (
    "doc_title string, chapter_no int, chapter_title string, article_no int, article_title string, clause_no int, rule_id string, "
    "name string, rule_type string, severity string, description_vi string, formula string, concepts string"
)
RULE_MAPPING_SCHEMA = (
    "doc_id string, chapter_no int, article_no int, clause_no int, article_id string, clause_id string, rule_id string, rule_name string, "
    "rule_type string, rule_severity string, rule_description_vi string, rule_formula string, concept_id string, concept_name string, "
    "concept_group string, keywords string"
)


def parse_extraction(raw: DataFrame) -> dict[str, DataFrame]:
    """Typed tables from (doc_id, json) rows, one document each.

    The structure is looked for under its two names, then at the top level. Body text may be
    called full_text or content. Each document is parsed once and kept in columns, of which a table reads its own.
    """
    d = stored(raw.select("doc_id", F.from_json("json", "struct<" + EXTRACTION_SCHEMA + ">").alias("j")).select("doc_id", "j.*"), "extraction")
    part = lambda c: F.coalesce(F.col(f"stage1_structure.{c}"), F.col(f"structure.{c}"), F.col(c))
    # A relation at the top level is a structural one if it names a source and target.
    loose = F.transform(
        F.filter("relations", lambda r: r["source"].isNotNull()),
        lambda r: F.struct(r["source"].alias("source"), r["target"].alias("target"), r["type"].alias("type")),
    )
    fields = ["id", "type", "title", "full_text", "content", "number", "page", "page_range", "chapter", "parent_id"]

    def nodes(c: str, kind: str) -> DataFrame:
        return d.select("doc_id", F.posexplode(part(c)).alias("ord", "n")).select(
            "doc_id", F.lit(kind).alias("kind"), "ord", *[F.col(f"n.{f}").alias(f) for f in fields]
        ).withColumn("full_text", F.coalesce("full_text", "content")).drop("content")

    document = d.select("doc_id", F.array(part("document")).alias("ds")).select("doc_id", F.posexplode("ds").alias("ord", "n")).filter("n is not null").select(
        "doc_id", F.lit("document").alias("kind"), "ord", *[F.col(f"n.{f}").alias(f) for f in fields]
    ).withColumn("full_text", F.coalesce("full_text", "content")).drop("content")
    all_nodes = document
    for c, kind in (("chapters", "chapter"), ("articles", "article"), ("clauses", "clause"), ("tables", "table")):
        all_nodes = all_nodes.unionByName(nodes(c, kind))
    nested = (
        d.select("doc_id", F.explode(part("articles")).alias("a"))
        .select("doc_id", F.col("a.id").alias("article_id"), F.posexplode("a.clauses").alias("p", "c"))
        .select("doc_id", "article_id", (F.col("p") + 1).alias("idx"), F.col("c.id").alias("id"), F.col("c.title").alias("title"), F.coalesce("c.full_text", "c.content").alias("full_text"))
    )
    edges = d.select("doc_id", F.posexplode(F.coalesce(F.col("stage1_structure.relations"), F.col("structure.relations"), loose)).alias("ord", "r")).select("doc_id", "ord", "r.*")
    sem = lambda c: d.select("doc_id", F.posexplode(f"stage2_semantic.{c}").alias("ord", "x")).select("doc_id", "ord", "x.*")
    evid = d.select("doc_id", F.posexplode("relations").alias("ord", "r")).select(
        "doc_id", "ord", F.coalesce("r.source_article_id", "r.source_id").alias("source_id"), "r.evidence"
    ).filter("source_id is not null and evidence is not null")
    return {
        "nodes": all_nodes, "nested_clauses": nested, "edges": edges, "mentions": sem("entities"), "relations": sem("relations"),
        "modifications": sem("modifications"), "evidence": evid, "documents": d.select("doc_id", "source_file", "category"),
    }


def read_extraction(spark: SparkSession, path: str, lines: bool = False, id_type: str = "string") -> dict[str, DataFrame]:
    """Extraction files, one JSON document per file; the file's stem is the document id.

    With ``lines`` a file holds a document on every line, which says its ``doc_id`` itself.
    """
    if lines:
        rows = spark.read.text(path).select(F.get_json_object("value", "$.doc_id").cast(id_type).alias("doc_id"), F.col("value").alias("json"))
        return parse_extraction(rows)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    # The reader splits no file, so each is one row whatever their number.
    files = spark.read.text(path, wholetext=True).select(F.url_decode(stem).alias("doc_id"), F.col("value").alias("json"))
    return parse_extraction(files)


def read_rules_csv(spark: SparkSession, path: str, schema: str = RULES_SCHEMA) -> DataFrame:
    """Rule tables; '#' lines and blank lines are skipped, quoted commas kept."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', comment="#", encoding="UTF-8")


def parse_crawled(pages: DataFrame, value: str = "value") -> DataFrame:
    """url, title, crawled_at, declared_len and body of crawled text with a header and a rule of 100 '='."""
    v = F.col(value)
    line = lambda name: F.nullif(F.trim(F.regexp_extract(v, rf"(?m)^{name}: (.*)$", 1)), F.lit(""))
    size = F.regexp_replace(F.regexp_extract(line("Length"), r"([\d,]+)", 1), ",", "")
    return pages.withColumns({
        "url": line("URL"), "title": line("Title"), "crawled_at": F.try_to_timestamp(line("Crawled")),
        "declared_len": F.try_to_number(F.nullif(size, F.lit("")), F.lit("9" * 18)).cast("int"),
        "body": py_strip(F.regexp_extract(v, r"(?s)\n={100}\n(.*)", 1)),
    })


#: Ends a page where a file holds many.
PAGE_END = "\x1e"


def read_crawled_text(spark: SparkSession, path: str, many: bool = False) -> DataFrame:
    """Crawled text files, one page per file, or ``many`` in a file, each ended by ``PAGE_END``."""
    raw = spark.read.text(path, lineSep=PAGE_END) if many else spark.read.text(path, wholetext=True)
    return parse_crawled(raw).drop("value")


def read_chunks(
    spark: SparkSession, path: str, columns: list[str] | None = None, languages: list[str] | None = None, doc_types: list[str] | None = None
) -> DataFrame:
    """Indexed chunks; column lists reach the parquet scan, language and type prune partitions."""
    df = spark.read.parquet(path)
    if languages:
        df = df.filter(F.col("language").isin(languages))
    if doc_types:
        df = df.filter(F.col("doc_type").isin(doc_types))
    return df.select(*columns) if columns else df


read_vectors = read_chunks


def read_graph(spark: SparkSession, nodes_path: str, edges_path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Node and edge tables."""
    if fmt == "json":
        nodes = spark.read.schema("id string, label string, props map<string,string>").json(nodes_path)
        return nodes, spark.read.schema("src string, dst string, type string, props map<string,string>").json(edges_path)
    return spark.read.format(fmt).load(nodes_path), spark.read.format(fmt).load(edges_path)


def read_extraction_result(spark: SparkSession, path: str, section: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(parts, summary) as ``write_extraction_result`` stores them; one section reads its own folders alone."""
    parts = spark.read.schema("doc_id string, json string, bucket int, section string").json(f"{path}/parts")
    summary = spark.read.schema(
        "doc_id string, total_structural_nodes long, total_structural_relations long, total_semantic_entities long, total_semantic_relations long"
    ).json(f"{path}/summary")
    return parts if section is None else parts.filter(F.col("section") == section), summary
