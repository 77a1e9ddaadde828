"""Filters, request mapping, hit projection, node lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.matching import contains_join
from quernstone.operators.ranking import top_k

KNOWN_FIELDS = ("doc_type", "faculty", "year", "subject", "language")


def filter_terms(
    df: DataFrame, doc_types: list | None = None, faculties: list | None = None, years: list | None = None,
    subjects: list | None = None, language: str | None = None,
) -> DataFrame:
    """All given fields must match, any value within a field; an empty list filters nothing."""
    wanted = {"doc_type": doc_types, "faculty": faculties, "year": years, "subject": subjects}
    tests = [F.col(c).isin(v) for c, v in wanted.items() if v]
    if language:
        tests.append(F.col("language") == language)
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def filter_metadata(df: DataFrame, conditions: dict, known: tuple[str, ...] = KNOWN_FIELDS, metadata: str = "metadata") -> DataFrame:
    """Known keys test columns, other keys the metadata map; a list means any of its values."""
    tests = []
    for key, value in conditions.items():
        col = F.col(key) if key in known else F.col(metadata)[key]
        tests.append(col.isin(list(value)) if isinstance(value, (list, tuple)) else col == value)
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def filter_per_query(pairs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Keep (query, row) pairs whose row value is in the query's list; ``fields``: column -> list column."""
    tests = [
        F.col(lst).isNull() | (F.size(lst) == 0) | F.array_contains(F.col(lst), F.col(c)) for c, lst in fields.items()
    ]
    return pairs.filter(reduce(Column.__and__, tests))


def row_kind(fields: tuple[str, ...] = KNOWN_FIELDS) -> Column:
    """One number for the values that a row has in the filter fields."""
    return F.xxhash64(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])


def allowed_kinds(requests: DataFrame, rows: DataFrame, lists: dict[str, str], metadata: str | None = None) -> DataFrame:
    """(query_id, kind): the kinds of rows that each request with any filter lets through.

    ``lists`` maps fields of the rows to the requests' list columns; a null or empty list filters nothing, and all that are given must match.
    ``metadata`` names a map column of the requests whose keys are fields. Filters meet the different kinds, not the rows, and only where they share a
    value. A request that nothing satisfies has one row, of a null kind.
    """
    fields = tuple(lists)
    kinds = rows.select(*fields, row_kind(fields).alias("kind")).distinct()
    held = kinds.select("kind", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("v")).select("kind", "v.*")
    given = [F.struct(F.lit(f).alias("field"), F.lit("list").alias("by"), F.col(c).cast("array<string>").alias("values")) for f, c in lists.items()]
    asked = F.array(*given)
    if metadata:
        own = F.transform(F.map_entries(metadata), lambda e: F.struct(e["key"].alias("field"), F.lit("map").alias("by"), F.array(e["value"].cast("string")).alias("values")))
        asked = F.concat(asked, F.coalesce(own, F.array().cast("array<struct<field:string,by:string,values:array<string>>>")))
    asked = F.filter(asked, lambda a: F.coalesce(F.size(a["values"]), F.lit(0)) > 0)
    wanted = requests.select("query_id", asked.alias("asked")).filter(F.size("asked") > 0)
    each = wanted.select("query_id", F.size("asked").alias("n"), F.explode("asked").alias("a")).select("query_id", "n", "a.field", "a.by", F.explode(F.array_distinct("a.values")).alias("value"))
    met = each.join(held, ["field", "value"]).select("query_id", "n", "kind", "field", "by").distinct()
    full = met.groupBy("query_id", "n", "kind").agg(F.count("*").alias("met")).filter("met = n").select("query_id", "kind")
    return wanted.select("query_id").join(full, "query_id", "left")


def map_request(requests: DataFrame) -> DataFrame:
    """Request rows to query rows: unknown modes become hybrid, languages vi or en, filters if any.

    ``requests``: (query, top_k, search_mode, language, doc_types, faculties, years, subjects, filters).
    """
    lists = ["doc_types", "faculties", "years", "subjects"]
    some = reduce(Column.__or__, [F.coalesce(F.size(c), F.lit(0)) > 0 for c in lists])
    has_language = F.coalesce(F.col("language"), F.lit("")) != ""
    some = some | has_language | (F.coalesce(F.size(F.map_keys("filters")), F.lit(0)) > 0)
    lang = F.when(has_language, F.when(F.col("language") == "vi", "vi").otherwise("en"))
    return requests.select(
        *[c for c in requests.columns if c not in {*lists, "query", "search_mode", "language", "filters"}],
        F.col("query").alias("text"),
        F.when(F.col("search_mode").isin("vector", "bm25", "hybrid"), F.col("search_mode")).otherwise("hybrid").alias("mode"),
        F.when(some, F.struct(*lists, lang.alias("language"), F.col("filters").alias("metadata_filters"))).alias("filters"),
    )


def project_hits(results: DataFrame) -> DataFrame:
    """Result rows as hits with ``meta`` and ``citation`` structs; missing columns become null."""
    have = set(results.columns)

    def col(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind).alias(name)

    spans = col("char_spans", "array<struct<start:int,end:int,text:string,type:string>>")
    marks = col("highlights", "array<string>")
    return results.select(
        *(["query_id"] if "query_id" in have else []),
        "text", col("title"), "score",
        F.struct("doc_id", "chunk_id", col("page", "int").alias("page"), col("extra", "map<string,string>").alias("extra")).alias("meta"),
        F.struct(
            "doc_id", "chunk_id", col("page", "int").alias("page"), spans.alias("char_spans"),
            col("section").alias("section"), col("subsection").alias("subsection"), marks.alias("highlighted_text"),
        ).alias("citation"),
        col("rerank_score", "double"), col("doc_type"), col("faculty"), col("year", "int"), col("subject"),
        F.coalesce(col("language"), F.lit("vi")).alias("language"), col("source_type"),
        col("bm25_score", "double"), col("vector_score", "double"), F.col("rank").alias("fusion_rank"),
    )


def nodes_by_category(
    nodes: DataFrame, label: str, props: dict[str, str] | None = None, limit: int = 100
) -> DataFrame:
    """Nodes of a label with all the given property values, the first ``limit`` by id."""
    tests = [F.col("label") == label, *(F.col("props")[k] == v for k, v in (props or {}).items())]
    return nodes.filter(reduce(Column.__and__, tests)).orderBy("id").limit(limit)


def lookup_nodes(nodes: DataFrame, keys: DataFrame, on: str | list[str] = "id") -> DataFrame:
    """Nodes whose key is listed."""
    return nodes.join(keys.select(*([on] if isinstance(on, str) else on)).distinct(), on, "left_semi")


def contains_scan(
    nodes: DataFrame, terms: DataFrame, columns: list[str], labels: list[str] | None = None, limit: int = 20
) -> DataFrame:
    """First ``limit`` nodes per term whose columns contain it, ignoring case; ``terms``: (term)."""
    rows = nodes if labels is None else nodes.filter(F.col("label").isin(labels))
    body = rows.select("id", "label", F.concat_ws("\n", *[F.lower(c) for c in columns]).alias("_body"))
    pats = terms.select("term", F.lower("term").alias("_pat")).distinct()
    hits = contains_join(body, pats, "_body", "_pat", ["label", "id"]).select("term", "label", "id")
    return top_k(hits, ["term"], [F.col("id"), F.col("label")], limit)


def entity_lookup(entities: DataFrame, text: str, kind: str | None = None) -> DataFrame:
    """Entities whose text or normalized text contains ``text``, optionally of one type."""
    t = text.lower()
    found = F.contains(F.lower("text"), F.lit(t)) | F.contains(F.lower("normalized_text"), F.lit(t))
    return entities.filter(found if kind is None else found & (F.col("type") == kind))


def validate_enum(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose upper-cased value is allowed, with the value upper-cased."""
    return df.withColumn(column, F.upper(column)).filter(F.col(column).isin(allowed))
