"""How the given tables stand in for the engine's inputs; every rule reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import is_blank
from quernstone.session import settle

FACULTIES = ["science", "arts", "law", "medicine", "economics"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return settle(spark).read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, *keys: str, rows: int = 10_000) -> DataFrame:
    """Hash-partition by ``keys`` when the scan has fewer splits than there are cores, or than parts of ``rows`` rows.

    A task then holds about as many rows of a large table as of a small one.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts, *keys) if df.rdd.getNumPartitions() < parts else df


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Non-blank lines of the documents."""
    docs = spread(table(spark, sf, "documents"), "doc_id")
    faculty = F.element_at(F.array(*[F.lit(f) for f in FACULTIES]), (F.col("doc_id") % 5 + 1).cast("int"))
    return (
        docs.withColumn("lines", F.split("text", "\n"))
        .select(
            "doc_id",
            F.element_at("lines", 1).alias("title"),
            F.col("source").alias("doc_type"),
            F.col("lang").alias("language"),
            (F.lit(2018) + F.col("doc_id") % 8).cast("int").alias("year"),
            faculty.alias("faculty"),
            F.posexplode("lines").alias("chunk_index", "text"),
        )
        .filter(~is_blank(F.col("text")))
        .withColumn("chunk_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))
    )


def queries_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
