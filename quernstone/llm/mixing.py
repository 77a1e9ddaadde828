"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Each document of a source is expected ``target / source size`` times. These expectations are summed up along
the source's documents in the order of their size, one offset is added, and a document is emitted once for every integer
boundary that its own share crosses. In that order the words taken differ from the target by less than the size of
the largest document. The sums need no source in one task: documents are ranked inside small runs of neighbours,
and only the runs' counts are summed up along a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.columns import n_words, whole_row, with_columns

WEIGHTS = (5, 2, 1)
#: Stands in for a missing id where rows are joined.
LAST = (1 << 63) - 1
BEFORE = (Window.unboundedPreceding, -1)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, weigh ``weights``, repeating, and share ``share`` of all sizes. A target stops
    at ``limit`` times its source's size; the excess goes to the others by weight until none is above.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_k", F.row_number().over(order)).withColumn(
        "_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_k") - 1) % len(weights) + 1)
    )
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(limit)).withColumn("_full", F.col("_cap") / F.col("_w"))
    # Along the sources that fill up first: what is left for this one and those after it, by weight.
    along = Window.orderBy("_full", "_k")
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    before = F.coalesce(F.sum("_cap").over(along.rowsBetween(*BEFORE)), F.lit(0.0))
    level = (total - before) / F.sum("_w").over(along.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("_level", level)
    final = F.max(F.when(F.col("_full") > F.col("_level"), F.col("_level"))).over(Window.partitionBy())
    target = F.when(F.col("_full") <= F.col("_level"), F.col("_cap")).otherwise(F.col("_w") * final)
    return ranked.select("source", "source_size", target.alias("target"))


def ranked_in_source(lean: DataFrame, run: int) -> DataFrame:
    """``place`` of every row of (source, size, h, doc_id, text_hash) within its source, by size, then h."""
    keyed = lean.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_null", F.col("source").isNull())
    same = ["_s", "_null", "size"]
    # Rows of one source and size are cut into runs of about ``run`` by ranges of h.
    runs = keyed.groupBy(*same).agg(F.ceil(F.count("*") / run).cast("long").alias("_runs"))
    cut = keyed.join(runs, same).withColumn("_run", F.floor(F.col("h") * F.col("_runs") / F.lit(float(1 << 32))).cast("long"))
    counts = cut.groupBy(*same, "_run").agg(F.count("*").alias("_n"))
    along = Window.partitionBy("_s", "_null").orderBy("size", "_run").rowsBetween(*BEFORE)
    base = counts.select(*same, "_run", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*same, "_run").orderBy("h", F.col("doc_id").asc_nulls_last(), "text_hash"))
    return cut.withColumn("_i", inside).join(base, [*same, "_run"]).withColumn("place", F.col("_base") + F.col("_i")).drop("_s", "_null", "_runs", "_run", "_base", "_i")


def sample_plan(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, share: float = 1.5, limit: float = 2.0, run: int = 10_000) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, copies) of every row of ``docs(doc_id, text, source)``.

    A null text has the size 0; null sources are one source. Rows that repeat an id are documents of their own.
    Documents without words are sampled like others and take nothing. An empty table gives no rows.
    The offset of a source comes from ``seed`` and its name, so that reruns agree.
    """
    text = F.col("text").cast("string")
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(text).alias("size"), text.alias("_t"))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8)
    lean = lean.select("doc_id", "source", "size", F.conv(digits, 16, 10).cast("long").alias("h"), F.xxhash64("_t", "source").alias("text_hash"))
    targets = source_targets(lean.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit)
    named = F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")), F.when(F.col("source").isNull(), "-").otherwise("+"))
    offset = F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    targets = targets.select(
        F.col("source").alias("_source"), "source_size", "target", offset.alias("_u"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_e"),
    )
    placed = ranked_in_source(lean, run)
    placed = placed.join(targets, placed.source.eqNullSafe(targets._source))
    crossed = F.floor(F.col("_e") * F.col("place") + F.col("_u")) - F.floor(F.col("_e") * (F.col("place") - 1) + F.col("_u"))
    copies = F.least(crossed, F.ceil(F.col("_e")))
    return placed.select("doc_id", "text_hash", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixed_rows(docs: DataFrame, limit: float = 2.0, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, numbered from 1 in ``copy``.

    Null, repeated and empty rows as in ``sample_plan``. A column ``copy`` of the input is replaced.
    """
    top = int(-(-limit // 1))
    plan = sample_plan(docs, limit=limit, **options)
    # Rows with the same id, text and source are alike: it is enough to know how many of them are taken how often.
    often = plan.groupBy(F.coalesce("doc_id", F.lit(LAST)).alias("_d"), F.col("text_hash").alias("_h")).agg(*[F.count_if(F.col("copies") >= k).alias(f"_c{k}") for k in range(1, top + 1)])
    base = docs.select(
        whole_row(docs).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_d"),
        F.xxhash64(F.col("text").cast("string"), F.col("source").cast("string")).alias("_h"),
    )
    base = base.withColumn("_i", F.row_number().over(Window.partitionBy("_d", "_h").orderBy("_h")))
    joined = base.join(often, ["_d", "_h"])
    copies = sum([(F.col(f"_c{k}") >= F.col("_i")).cast("int") for k in range(1, top + 1)], F.lit(0))
    out = joined.withColumn("_n", copies).filter("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return with_columns(out, "row", {"copy": F.col("copy")})
