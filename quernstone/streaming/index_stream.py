"""Streaming upserts and deletes of chunks into a plain table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources.writers import keyword_rows, partitioned, replace_partitions

KEYS = ["doc_id", "chunk_id"]


class ChunkTable:
    """A parquet table of chunks in hash partitions of the document; a micro-batch rewrites the partitions it touches.

    What counts is the rows' own ``ord``: a row takes the place of one with a smaller ``ord``, and a delete takes out what has no larger one. Both
    are remembered (a delete as a row without a chunk), so a change that comes late or again changes nothing that is newer. One
    query writes to a table at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 32):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(F.col("doc_id")), F.lit(self.buckets)).cast("int")

    def _apply(self, changes: DataFrame) -> None:
        """Merge ``changes``, at most one row per chunk and one per deleted document, into their partitions."""
        changes = changes.withColumn("part", self._part())
        # At most as many numbers as there are partitions.
        touched = sorted(r.part for r in changes.select("part").distinct().collect())
        if not touched:
            return
        now = F.current_timestamp()
        new = changes.withColumns({"created_at": now, "updated_at": now, "state": F.lit("created"), "incoming": F.lit(True)})
        old = partitioned(self.spark, self.folder)
        both = new if old is None else new.unionByName(old.filter(F.col("part").isin(touched)).withColumn("incoming", F.lit(False)), allowMissingColumns=True)
        gone = both.filter("chunk_id is null").groupBy("doc_id").agg(F.max("ord").alias("gone"))
        alive = both.join(gone, "doc_id", "left").filter("chunk_id is null or gone is null or ord > gone").drop("gone")
        rest = [c for c in alive.columns if c not in KEYS]
        # Of equal ord the stored row stays.
        newest = alive.groupBy(*KEYS).agg(
            F.max_by(F.struct(*rest), F.struct("ord", ~F.col("incoming"))).alias("r"), F.min("created_at").alias("_first"), F.count_if(~F.col("incoming")).alias("_old"))
        state = F.when(F.col("incoming") & (F.col("_old") > 0), "updated").otherwise(F.col("state"))
        merged = newest.select(*KEYS, "r.*", "_first", "_old").withColumns({"state": state, "created_at": F.col("_first")}).drop("_first", "_old", "incoming")
        replace_partitions(merged, self.folder)

    def upsert(self, batch: DataFrame) -> None:
        """Take in chunks, one row per key, with an ``ord``."""
        self._apply(keyword_rows(batch)[0].drop("created_at", "updated_at"))

    def delete(self, docs: DataFrame) -> None:
        """Take out the documents' chunks of no larger ``ord``; ``docs``: (doc_id, ord)."""
        last = docs.groupBy("doc_id").agg(F.max("ord").alias("ord"))
        self._apply(last.select("doc_id", F.lit(None).cast("string").alias("chunk_id"), "ord"))

    def read(self) -> DataFrame | None:
        """The newest row of every chunk, ``created_at`` and ``updated_at``, and whether it took another's place; None before the first batch."""
        rows = partitioned(self.spark, self.folder)
        return None if rows is None else rows.filter("chunk_id is not null").drop("part")


def latest_rows(batch: DataFrame) -> DataFrame:
    """The last row per chunk of a batch, by ``ord``."""
    rest = [c for c in batch.columns if c not in KEYS]
    return batch.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "ord").alias("r")).select(*KEYS, "r.*")


def stream_index_upserts(chunks: DataFrame, table: ChunkTable, checkpoint: str, counts: list | None = None):
    """Start the query that upserts a stream of chunks with an ``ord``; call ``awaitTermination`` on the result.

    ``counts`` collects (batch, ok, failed): rows with a key and a text, and the others.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        good = F.col("doc_id").isNotNull() & F.col("chunk_id").isNotNull() & F.col("text").isNotNull()
        if counts is not None:
            row = batch.agg(F.count(F.when(good, 1)), F.count(F.when(~good, 1))).first()
            counts.append((batch_id, row[0], row[1]))
        table.upsert(latest_rows(batch.filter(good)))

    return chunks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_index_deletes(docs: DataFrame, table: ChunkTable, checkpoint: str):
    """Start the query that deletes the chunks of a stream of documents (doc_id, ord); upserts of a larger ``ord`` stay."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        table.delete(batch.filter("doc_id IS NOT NULL"))

    return docs.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
