"""Keyed streaming state: the message window of every session, with expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernstone.sources.writers import partitioned, replace_partitions

OUT = "session_id long, version long, seq long, role string, content string"
STATE = "version long, last_ms long, seqs array<long>, roles array<string>, contents array<string>"


def keep(rows: list[tuple], limit: int) -> list[tuple]:
    """(seq, role, content) rows of a session cut to the window, system messages first."""
    rows = sorted(rows, key=lambda r: r[0])
    if len(rows) <= limit:
        return rows
    system = [r for r in rows if r[1] == "system"]
    others = [r for r in rows if r[1] != "system"]
    room = max(limit - len(system), 0)
    return system + (others[-room:] if room else [])


def stream_session_memory(messages: DataFrame, limit: int = 20, hours: int = 24) -> DataFrame:
    """Every session's window after each micro-batch that touched it.

    ``messages``: streaming (session_id, seq, role, content, ts). ``version`` counts the
    messages a session has seen; its highest version is the current window. State holds one
    window, and is dropped once the stream is ``hours`` past a session's last message. The
    clock is the watermark, so an idle stream does nothing and a replay gives the same.
    """
    ttl_ms = hours * 3600 * 1000

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        version, last_ms, seqs, roles, contents = state.get if state.exists else (0, 0, [], [], [])
        rows = list(zip(seqs, roles, contents))
        for pdf in batches:
            rows += list(pdf[["seq", "role", "content"]].itertuples(index=False, name=None))
            version += len(pdf)
            last_ms = max(last_ms, int(pdf["ts"].max().timestamp() * 1000))
            # Cut as rows arrive, so a burst never piles up beyond a batch and a window.
            rows = keep(rows, limit)
        state.update((version, last_ms, [int(r[0]) for r in rows], [r[1] for r in rows], [r[2] for r in rows]))
        state.setTimeoutTimestamp(max(last_ms + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            [(key[0], version, int(r[0]), r[1], r[2]) for r in rows], columns=["session_id", "version", "seq", "role", "content"]
        )

    return messages.withWatermark("ts", f"{hours} hours").groupBy("session_id").applyInPandasWithState(
        update, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout
    )


class WindowTable:
    """The current window of every session, in hash partitions; a micro-batch rewrites those it touches, so no older window is kept.

    The window of the highest ``version`` counts, so a batch that comes again changes nothing. One query writes to a table at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 32):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def take(self, windows: DataFrame, batch_id: int | None = None) -> None:
        """Put a batch's windows in place; fits ``foreachBatch``."""
        new = windows.withColumn("part", F.pmod(F.xxhash64("session_id"), F.lit(self.buckets)).cast("int"))
        # At most as many numbers as there are partitions.
        touched = sorted(r.part for r in new.select("part").distinct().collect())
        if not touched:
            return
        old = partitioned(self.spark, self.folder)
        both = new if old is None else new.unionByName(old.filter(F.col("part").isin(touched)))
        last = both.groupBy("session_id").agg(F.max("version").alias("version"))
        replace_partitions(both.join(last, ["session_id", "version"]).distinct(), self.folder)

    def read(self) -> DataFrame | None:
        rows = partitioned(self.spark, self.folder)
        return None if rows is None else rows.drop("part")
