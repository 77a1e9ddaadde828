"""Conversation memory as batch operators; messages(session_id, seq, role, content, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.ranking import top_k


def _last_others(messages: DataFrame, k: int) -> DataFrame:
    """The last ``k`` messages that are not system ones, per session, numbered from the end."""
    return top_k(messages.filter("role <> 'system'"), ["session_id"], [F.col("seq").desc()], k, "_back")


def prune_window(messages: DataFrame, limit: int = 20) -> DataFrame:
    """System messages and the last others up to ``limit`` in all; short sessions stay whole.

    Only ``limit`` messages of a session pass the first cut, so a very long session is never
    gathered. Read in (is_system descending, seq) order.
    """
    sizes = messages.groupBy("session_id").agg(F.count("*").alias("_n"), F.count(F.when(F.col("role") == "system", 1)).alias("_s"))
    others = _last_others(messages, limit).join(sizes, "session_id")
    kept = others.filter((F.col("_n") <= limit) | (F.col("_back") <= limit - F.col("_s"))).select(*messages.columns, F.lit(False).alias("is_system"))
    system = messages.filter("role = 'system'").select(*messages.columns, F.lit(True).alias("is_system"))
    return system.unionByName(kept)


def history(messages: DataFrame, limit: int = 6) -> DataFrame:
    """All system messages and the last ``limit`` others."""
    kept = _last_others(messages, limit).select(*messages.columns, F.lit(False).alias("is_system"))
    return messages.filter("role = 'system'").select(*messages.columns, F.lit(True).alias("is_system")).unionByName(kept)


def format_history(messages: DataFrame, k: int = 6, cut: int = 500) -> DataFrame:
    """(session_id, history): the last ``k`` messages as 'Role: text' lines, long texts cut."""
    last = top_k(messages, ["session_id"], [F.col("seq").desc()], k, "_back")
    text = F.when(F.length("content") > cut, F.concat(F.substring("content", 1, cut), F.lit("..."))).otherwise(F.col("content"))
    line = F.concat(F.initcap("role"), F.lit(": "), text)
    # At most k lines are gathered per session.
    packed = last.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("ls"))
    return packed.select("session_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("history"))


def session_overview(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per session: messages, created_at, updated_at; number of sessions)."""
    per = messages.groupBy("session_id").agg(F.count("*").alias("n_messages"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
    return per, per.agg(F.count("*").alias("n_sessions"))


def expire_sessions(sessions: DataFrame, now: Column, hours: int = 24, by: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """(sessions kept, number expired); a time that cannot be read counts as expired."""
    at = F.try_to_timestamp(F.col(by).cast("string"))
    age = (now.cast("double") - at.cast("double")) / 3600
    old = at.isNull() | (age > hours)
    judged = sessions.withColumn("_old", old)
    return judged.filter("not _old").drop("_old"), judged.agg(F.count(F.when(F.col("_old"), 1)).alias("n_expired"))


def clear_sessions(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """The listed sessions keep their system messages only."""
    listed = sessions.select("session_id").distinct().withColumn("_listed", F.lit(True))
    return messages.join(listed, "session_id", "left").filter(F.col("_listed").isNull() | (F.col("role") == "system")).drop("_listed")


def delete_sessions(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    return messages.join(sessions.select("session_id").distinct(), "session_id", "left_anti")
