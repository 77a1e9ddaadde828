"""Sinks: index rows, upserts, deletes, exports. Each prepares a DataFrame; ``write_*`` stores it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.vector import embed_batch
from quernstone.session import stored

SECTIONS = ("nodes", "structural_relations", "entities", "relations")
# What the keyword index stores where a field is missing.
KEYWORD_DEFAULTS = {"title": "", "doc_type": "document", "faculty": "general", "subject": "", "language": "vi"}


def _meta(df: DataFrame, key: str) -> Column:
    return F.element_at("metadata", F.lit(key)) if "metadata" in df.columns else F.lit(None).cast("string")


def keyword_rows(chunks: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(index rows, counts of ok and failed): a field comes from its column, the metadata, or a default."""
    now = F.current_timestamp() if now is None else now
    own = lambda c: F.col(c) if c in chunks.columns else F.lit(None).cast("string")
    good = F.col("doc_id").isNotNull() & F.col("chunk_id").isNotNull() & F.col("text").isNotNull()
    fields = {c: F.coalesce(own(c), _meta(chunks, c), F.lit(d)) for c, d in KEYWORD_DEFAULTS.items()}
    year = F.coalesce(own("year").cast("int"), _meta(chunks, "year").cast("int"))
    extra = {}
    if "metadata" in chunks.columns:
        whole = lambda k, v: F.when(k.isin("char_start", "char_end"), v.try_cast("double").cast("int").cast("string")).otherwise(v)
        extra["metadata"] = F.transform_values("metadata", whole)
    rows = chunks.filter(good).withColumns({
        "index_id": F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_id").cast("string")), **fields, "year": year, **extra,
        "created_at": now, "updated_at": now,
    })
    return rows, chunks.agg(F.count(F.when(good, 1)).alias("ok"), F.count(F.when(~good, 1)).alias("failed"))


def write_keyword_index(chunks: DataFrame, path: str, now: Column | None = None) -> DataFrame:
    """Store index rows by language and type; returns the counts."""
    rows, counts = keyword_rows(chunks, now)
    rows.write.mode("overwrite").partitionBy("language", "doc_type").parquet(path)
    return counts


def vector_rows(chunks: DataFrame, encoder=None, keys: tuple[str, ...] = ("doc_id", "chunk_id")) -> DataFrame:
    """Flat rows with a JSON of the extra map, zeros and blanks for missing values, and the vector."""
    have = set(chunks.columns)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in have else F.lit(0)
    extra = "extra" in have
    lift = lambda k: F.element_at("extra", F.lit(k)) if extra else F.lit(None).cast("string")
    chunk_id = F.coalesce("chunk_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))
    rows = chunks.withColumn("chunk_id", chunk_id).withColumns({
        **{c: text(c) for c in ("title", "doc_type", "faculty", "subject", "section", "subsection")}, "page": whole("page"), "year": whole("year"),
        "language": F.coalesce(F.col("language"), F.lit("vi")) if "language" in have else F.lit("vi"),
        **{k: lift(k) for k in ("chapter", "article", "article_number", "structure_type", "filename")},
        "metadata_json": F.coalesce(F.to_json("extra"), F.lit("{}")) if extra else F.lit("{}"),
    })
    vectors = embed_batch(rows, list(keys), "text", encoder)
    return rows.join(vectors, list(keys), "left")


def write_vector_index(chunks: DataFrame, path: str, encoder=None) -> None:
    vector_rows(chunks, encoder).write.mode("overwrite").partitionBy("language", "doc_type").parquet(path)


def upsert_chunks(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows over existing ones by (doc_id, chunk_id); created_at is kept, ``state`` says what happened.

    ``incoming`` has one row per key.
    """
    keys = ["doc_id", "chunk_id"]
    rest = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, F.struct(*rest).alias("o"))
    new = incoming.select(*keys, F.struct(*rest).alias("n"))
    both = old.join(new, keys, "full_outer")
    pick = lambda c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    cols = [F.coalesce("o.created_at", "n.created_at").alias(c) if c == "created_at" else pick(c) for c in rest]
    state = F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "created").otherwise("updated")
    return both.select(*keys, *cols, state.alias("state"))


def delete_by_doc(chunks: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows left, deleted rows per listed document)."""
    gone = docs.select("doc_id").distinct()
    counts = gone.join(chunks.join(gone, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("deleted")), "doc_id", "left")
    return chunks.join(gone, "doc_id", "left_anti"), counts.withColumn("deleted", F.coalesce("deleted", F.lit(0)).cast("bigint"))


def delete_from_stores(stores: dict[str, DataFrame], docs: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete documents in several stores; a document counts as deleted if any store had it."""
    left, hits = {}, []
    for name, df in stores.items():
        left[name], n = delete_by_doc(df, docs)
        hits.append(n)
    both = hits[0]
    for h in hits[1:]:
        both = both.unionByName(h)
    return left, both.groupBy("doc_id").agg((F.sum("deleted") > 0).alias("success"), F.sum("deleted").alias("deleted"))


def delete_chunks(chunks: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows left, listed keys with found flag)."""
    listed = keys.select("doc_id", "chunk_id").distinct()
    have = chunks.select("doc_id", "chunk_id", F.lit(True).alias("found")).distinct()
    return chunks.join(listed, ["doc_id", "chunk_id"], "left_anti"), listed.join(have, ["doc_id", "chunk_id"], "left").withColumn(
        "found", F.coalesce("found", F.lit(False)))


def reindex_documents(chunks: DataFrame, incoming: DataFrame) -> DataFrame:
    """The documents of ``incoming`` replaced by its rows."""
    return chunks.join(incoming.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(incoming)


def export_graph(nodes: DataFrame, edges: DataFrame, exported_at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node JSON, edge JSON with both ends' id, text and label, one row of counts).

    ``nodes``: (id, label, props), ``edges``: (src, dst, type, props).
    """
    n = nodes.select("id", F.to_json(F.struct("id", F.array("label").alias("labels"), F.col("props").alias("properties"))).alias("json"))
    end = nodes.select("id", "label", F.coalesce(F.element_at("props", F.lit("text")), F.col("id").cast("string")).alias("text"))
    s = end.select(F.col("id").alias("src"), F.col("label").alias("source_label"), F.col("text").alias("source_text"))
    t = end.select(F.col("id").alias("dst"), F.col("label").alias("target_label"), F.col("text").alias("target_text"))
    e = edges.join(s, "src").join(t, "dst").select(
        "src", "dst", "type",
        F.to_json(F.struct(
            F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "source_text", "target_text", "source_label", "target_label", "type",
            F.col("props").alias("properties"))).alias("json"),
    )
    stats = nodes.agg(F.count("*").alias("nodes")).select(
        "nodes", edges.select(F.count("*")).scalar().alias("relationships"), F.date_format(exported_at, "yyyy-MM-dd'T'HH:mm:ss").alias("exported_at"))
    return n, e, stats


def extraction_result(
    nodes: DataFrame, edges: DataFrame, entities: DataFrame, relations: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(JSON parts of every document, summary per document).

    A document is one folder of JSON lines, a line per node, edge, entity or relation with
    its section, so no document has to fit into a single row.
    """
    sections = dict(zip(SECTIONS, (nodes, edges, entities, relations)))
    parts = None
    for name, df in sections.items():
        body = df.select("doc_id", F.lit(name).alias("section"), F.to_json(F.struct(*[c for c in df.columns if c != "doc_id"])).alias("json"))
        parts = body if parts is None else parts.unionByName(body)
    count = lambda s: F.count(F.when(F.col("section") == s, 1))
    summary = parts.groupBy("doc_id").agg(
        count("nodes").alias("total_structural_nodes"), count("structural_relations").alias("total_structural_relations"),
        count("entities").alias("total_semantic_entities"), count("relations").alias("total_semantic_relations"))
    return parts, summary


def write_extraction_result(parts: DataFrame, summary: DataFrame, path: str, buckets: int = 64) -> None:
    """Parts as JSON lines by a hash bucket of the document and by section, so that folders do not grow with the documents; summary rows beside them."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    parts.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket", "section").json(f"{path}/parts")
    summary.write.mode("overwrite").json(f"{path}/summary")


def index_stats(chunks: DataFrame) -> DataFrame:
    """(doc_count, size_in_bytes)."""
    return chunks.agg(F.count("*").alias("doc_count"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("bigint").alias("size_in_bytes"))


def replace_partitions(rows: DataFrame, folder: str, part: str = "part") -> None:
    """Put ``rows`` in place of the partitions of ``folder`` that they belong to; other partitions stay as they are.

    The rows are written aside first, so they may come from the partitions that are replaced, and survive there if the last step fails.
    """
    aside = stored(rows, "touched")
    aside.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(folder)


def partitioned(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table in ``folder``, None before its first batch. Later batches may have more columns."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.option("mergeSchema", "true").parquet(folder)
