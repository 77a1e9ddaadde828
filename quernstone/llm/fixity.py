"""Merkle fixity audit of WARC records.

A replica is a table of records in files, each at a byte offset. Records are hashed and combined, ``fanout`` neighbours of the
file's order at a time, into the nodes of a tree over ordered offset ranges; the file roots are combined in the same way into one root. Two
replicas are compared from the root down: of each level only the children of nodes that differ are read, so that an audit of sound
replicas ends at the root, and damage is found along its own branches.

A record's place is its number in the file, not its rank, so a missing or added record changes its own branch
and moves no other record. All levels are small aggregations with partial sums; equal places (a record
written twice) are combined as a set that does not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import stored

LAST = (1 << 62) - 1


def warc_record(uri: Column, payload: Column) -> Column:
    """The record as stored: a header with the payload's length, and the payload."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def _div(number: Column, by: int) -> Column:
    """Whole-number division towards minus infinity."""
    return F.call_function("div", number - F.pmod(number, F.lit(by)), F.lit(by)).cast("long")


def leaves(pages: DataFrame, per_file: int = 4096) -> DataFrame:
    """(file, place, start, stop, digest) of the records of ``pages(page_id, url, html)``.

    A file holds ``per_file`` places, by page id; offsets are running sums of record lengths inside a file, which bounds that window. Rows
    without an id go to places after all others, by their content. Null urls and bodies count as empty.
    """
    record = warc_record(F.col("url").cast("string"), F.col("html").cast("string"))
    text = pages.select(F.col("page_id").cast("long").alias("page_id"), record.alias("record"))
    made = text.select(
        F.coalesce(F.col("page_id"), F.lit(LAST) - F.pmod(F.xxhash64("record"), F.lit(1 << 40))).alias("id"),
        F.octet_length("record").cast("long").alias("bytes"), F.sha2("record", 256).alias("digest"),
    )
    # Records that share an id are one leaf: their number, their bytes and a sum that no order changes.
    one = made.groupBy("id").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("digest").alias("top"),
        F.sum(F.conv(F.substring("digest", 1, 12), 16, 10).cast("long")).alias("s1"), F.sum(F.conv(F.substring("digest", 13, 12), 16, 10).cast("long")).alias("s2"),
    )
    digest = F.when(F.col("n") == 1, F.col("top")).otherwise(F.sha2(F.concat_ws("/", "n", "bytes", "s1", "s2"), 256))
    placed = one.select(
        _div(F.col("id"), per_file).alias("file"), F.pmod(F.col("id"), F.lit(per_file)).cast("long").alias("place"), "n", "bytes", digest.alias("digest")
    )
    before = F.sum("bytes").over(Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("start", F.coalesce(before, F.lit(0))).select("file", "place", "start", (F.col("start") + F.col("bytes")).alias("stop"), "n", "digest")


def _level(nodes: DataFrame, key: list[str], fanout: int, up: Column) -> DataFrame:
    """The level above: each node covers ``fanout`` children and hashes their places and digests in order."""
    parent = nodes.withColumn("_child", F.struct(F.col(key[-1]).alias("k"), "digest")).withColumn(key[-1], up)
    return parent.groupBy(*key).agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n"),
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("_child")), lambda c: F.concat_ws(":", c["k"].cast("string"), c["digest"])), ";"), 256).alias("digest"),
    )


class Replica:
    """The levels of a replica's tree, lowest first: inside the files, then over the files."""

    def __init__(self, records: DataFrame, per_file: int = 4096, fanout: int = 16, files: int | None = None):
        self.fanout, self.per_file = fanout, per_file
        self.inside = [stored(records, "leaves")]
        size = per_file
        while size > 1:
            size = -(-size // fanout)
            self.inside.append(stored(_level(self.inside[-1], ["file", "place"], fanout, _div(F.col("place"), fanout)), "nodes"))
        top = self.inside[-1].drop("place")
        self.over = [top]
        self.span = files if files is not None else (top.agg(F.max("file")).first()[0] or 0) + 1

    def grow(self, files: int) -> None:
        """Build the levels over the files, for file numbers below ``files``."""
        size = files
        while size > 1:
            size = -(-size // self.fanout)
            self.over.append(stored(_level(self.over[-1], ["file"], self.fanout, _div(F.col("file"), self.fanout)), "roots"))


def _differing(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """The keys whose nodes are not the same in both, with both."""
    left = a.select(*key, F.struct("start", "stop", "n", "digest").alias("a"))
    right = b.select(*key, F.struct("start", "stop", "n", "digest").alias("b"))
    return left.join(right, key, "full").filter(~F.col("a.digest").eqNullSafe(F.col("b.digest")))


def audit(first: Replica, second: Replica) -> DataFrame:
    """(file, page_id, kind, start, stop) of every record in which the replicas differ; offsets are the first replica's, or the second's for an added record.

    ``kind`` is ``changed``, ``missing`` (in the second) or ``added``. Equal replicas, empty ones included, give no rows.
    Records without an id have a null ``page_id``. Both replicas need the same ``per_file`` and ``fanout``.
    """
    files = max(first.span, second.span)
    first.grow(files)
    second.grow(files)
    fanout = first.fanout
    found = _differing(first.over[-1], second.over[-1], ["file"]).select("file")
    for a, b in zip(first.over[-2::-1], second.over[-2::-1]):
        wanted = stored(found, "suspects").withColumnRenamed("file", "_up")
        child = _div(F.col("file"), fanout) == F.col("_up")
        found = _differing(a.join(wanted, child, "left_semi"), b.join(wanted, child, "left_semi"), ["file"]).select("file")
    found = found.withColumn("place", F.lit(0).cast("long"))
    for a, b in zip(first.inside[-2::-1], second.inside[-2::-1]):
        wanted = stored(found.select("file", "place"), "suspects").select(F.col("file").alias("_f"), F.col("place").alias("_up"))
        child = (F.col("file") == F.col("_f")) & (_div(F.col("place"), fanout) == F.col("_up"))
        found = _differing(a.join(wanted, child, "left_semi"), b.join(wanted, child, "left_semi"), ["file", "place"])
    page = F.col("file") * first.per_file + F.col("place")
    here = F.coalesce("a", "b")
    return found.select(
        "file", F.when(page < LAST - (1 << 41), page).alias("page_id"),
        F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "missing").otherwise("changed").alias("kind"),
        here["start"].alias("start"), here["stop"].alias("stop"),
    )
