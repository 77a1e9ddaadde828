"""A training corpus in five stages, each written as Parquet and read again by the next.

Quality classifier, line dedup, n-gram Jaccard join, benchmark decontamination, mixing to target weights. All but the
last return the columns of ``documents``; the last adds ``copy``, since it returns a row as often as it is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import decontaminate, factorisation, line_dedup, mixing, signature_tree
from quernstone.llm.queries import quality_model, table
from quernstone.session import stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject.

    A null text counts as empty; empty texts are judged by their statistics, and rows that repeat a text have the same fate. Labels are found by
    ``doc_id``: rows without an id are judged, but teach nothing. An empty table stays empty.
    """
    return factorisation.accepted(docs, quality_model(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one holds; ``n_chars``, where there is one, follows the text.

    A null or empty text comes back empty. Rows without an id count as one document after all others, rows that repeat an id as one
    document, each with its own text. An empty table stays empty.
    """
    done = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast("long"))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: the smallest id, then the smallest hash of its text.

    Rows without an id come last in their group, and of rows that repeat id and text one stays, so every group keeps exactly one row. Texts without
    words link with nothing: all of their rows stay. An empty table stays empty.
    """
    return signature_tree.first_of_each(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item occurs.

    Null and empty texts hold none; rows without an id and repeated rows are searched each. An empty table stays empty, and an empty
    benchmark takes out nothing.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, numbered from 1 in ``copy``, which replaces an input column of that name.

    Null sources are one source, a null text has no words, rows without an id or with a repeated one are documents of their
    own. An empty table stays empty.
    """
    return mixing.mixed_rows(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", keep_one_of_a_kind),
    ("decontamination", drop_test_items),
    ("mixing", mix_sources),
]
#: No SQL can state the classifier or the edit matching; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
