"""Line dedup: levelled sorted runs of line hashes.

Documents come in batches of ascending ids. The key hashes of a batch are anti-joined with the runs kept so far,
and the keys that are new, with the first document that holds each, become a run of their own: a table bucketed and sorted
by key, so that neither the merge joins nor the batch's aggregation shuffle it again. When a level has
``fan_in`` runs they are compacted into one run of the next level. A key stands in the runs once, with the
smallest document that holds it; any other document loses its lines of that key.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.columns import BLANKS, ascii_lower, parts, whole_row, with_columns
from quernstone.session import shared_folder, stored

LAST = (1 << 63) - 1
KEY = ["h1", "h2"]


class Runs:
    """The levels of sorted runs; every run is a bucketed table of (h1, h2, doc)."""

    def __init__(self, buckets: int, fan_in: int):
        self.buckets, self.fan_in, self.levels = buckets, fan_in, [[]]
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.made = 0

    def tables(self) -> list[DataFrame]:
        return [t for level in self.levels for t in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The keys that no run holds."""
        return reduce(lambda left, run: left.join(run, KEY, "left_anti"), self.tables(), keys)

    def _write(self, run: DataFrame) -> DataFrame:
        name = f"{self.name}_{self.made}"
        self.made += 1
        run.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").saveAsTable(name)
        return run.sparkSession.table(name)

    def add(self, run: DataFrame) -> None:
        """Add a batch's new keys as a run; compact every level that is full."""
        self.levels[0].append(self._write(run))
        for k in range(len(self.levels)):
            if len(self.levels[k]) < self.fan_in:
                break
            merged = reduce(DataFrame.union, self.levels[k]).repartition(self.buckets, *KEY)
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._write(merged))
            self.levels[k] = []

    def drop(self, spark) -> None:
        for k in range(self.made):
            spark.sql(f"DROP TABLE IF EXISTS {self.name}_{k}")


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, text_hash, pos, h1, h2) of every line whose key is long enough."""
    lines = docs.select("doc", "text_hash", F.posexplode("lines").alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(BLANKS)))
    return (
        lines.select("doc", "text_hash", "pos", key.alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("doc", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("2"), "key").alias("h2"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """``docs`` with the lines taken out of ``text`` that an earlier document holds, ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of ``min_chars`` code points or more that
    several documents hold stay only in the one of the smallest ``doc_id``, as often as it has them. Shorter lines, and
    keys of one document only, stay. A null or empty text has one empty line and comes back empty. Rows without an id
    count as one document after all others; rows that repeat an id are one document, each with its own text.
    Other columns pass; ``n_lines`` and ``n_dropped`` replace columns of these names. An empty table stays empty.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(whole_row(docs).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), text.alias("text"))
    base = base.withColumn("text_hash", F.xxhash64("text"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc"))
    cuts = sorted(set(ids.approxQuantile("doc", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    batch = sum([(F.col("doc") >= F.lit(int(c))).cast("int") for c in cuts], F.lit(0))
    lined = base.select("doc", "text_hash", F.split("text", "\n", -1).alias("lines"))
    path = shared_folder(spark, "line_keys")
    keyed_lines(lined, min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    keyed = spark.read.schema("doc long, text_hash long, pos int, h1 long, h2 long, batch int").parquet(path)

    runs = Runs(parts(docs), fan_in)
    try:
        for k in range(len(cuts) + 1):
            firsts = keyed.filter(F.col("batch") == k).groupBy(*KEY).agg(F.min("doc").alias("doc"))
            runs.add(runs.unseen(firsts))
        keepers = reduce(DataFrame.union, runs.tables()).repartition(parts(docs), *KEY, "doc")
        gone = keyed.join(keepers, [*KEY, "doc"], "left_anti").groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("gone"))
        gone = stored(gone, "lines_gone")
    finally:
        runs.drop(spark)

    lines = F.split("text", "\n", -1)
    n = F.size(lines)
    left = F.array_except(F.sequence(F.lit(0), n - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    out = base.join(gone, ["doc", "text_hash"], "left")
    return with_columns(out, "row", {
        "text": kept, "n_lines": n.cast("long"), "n_dropped": F.coalesce(n - F.size(left), F.lit(0)).cast("long"),
    })
