"""Ranking helpers shared by the search operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """Number the rows of each group in ``order`` and keep the first ``k``.

    ``row_number() <= k`` lets the optimizer cut every input partition to ``k`` rows per
    group before the shuffle, so one very large group never reaches a task whole.
    """
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)


def by_score(score: str = "score", keys: tuple[str, ...] = ("doc_id", "chunk_id")) -> list[Column]:
    """Score descending, then the keys: a total order."""
    return [F.col(score).desc(), *(F.col(c).asc() for c in keys)]


def number_rows(df: DataFrame, by: list[str], bucket: Column, order: list[Column], out: str = "n") -> DataFrame:
    """Number each group's rows from 1 without bringing a group together.

    ``bucket`` must not decrease along ``order``. Rows are numbered inside (group, bucket)
    and shifted by the size of the buckets before, so a task holds one bucket of a group.
    """
    parts = df.withColumn("_b", bucket)
    sizes = parts.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    before = sizes.withColumn(
        "_base",
        F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("_c")
    inner = parts.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order)))
    return inner.join(before, [*by, "_b"]).withColumn(out, F.col("_base") + F.col("_i")).drop("_b", "_base", "_i")
