"""Registered queries for conversation memory, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import memory as M
from quernstone.plans.bindings import table
from quernstone.plans.registry import query
from quernstone.session import shared_folder
from quernstone.streaming.index_stream import ChunkTable, stream_index_deletes, stream_index_upserts
from quernstone.streaming.memory_stream import WindowTable, stream_session_memory

big = lambda c: F.col(c).cast("bigint").alias(c)
LIMIT = 3

MSG = "msg AS (SELECT conv_id AS session_id, turn AS seq, role, text AS content FROM conversations)"
PRUNED = f"""{MSG}, sz AS (SELECT session_id, count(*) AS n, count(*) FILTER (role = 'system') AS s FROM msg GROUP BY ALL),
ot AS (SELECT m.*, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS back FROM msg m WHERE role <> 'system'),
pruned AS (SELECT session_id, seq, role, true AS is_system FROM msg WHERE role = 'system' UNION ALL SELECT session_id, seq, role, false FROM ot JOIN sz USING (session_id) WHERE n <= {LIMIT} OR (back <= {LIMIT} AND back <= {LIMIT} - s))"""


def messages(spark, sf):
    return _messages(table(spark, sf, "conversations"))


def _messages(conversations):
    return conversations.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"),
        (F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(F.lit(0), F.expr("cast(conv_id as int)"), F.expr("cast(turn as int)"))).alias("ts"))


@query("w01_prune_window", f"WITH {PRUNED} SELECT * FROM pruned")
def w01(spark, sf):
    return M.prune_window(messages(spark, sf), LIMIT).select("session_id", "seq", "role", "is_system")


@query("w02_history", f"WITH {PRUNED} SELECT session_id, seq, role, true AS is_system FROM msg WHERE role = 'system' UNION ALL SELECT session_id, seq, role, false FROM ot WHERE back <= 2")
def w02(spark, sf):
    return M.history(messages(spark, sf), 2).select("session_id", "seq", "role", "is_system")


@query(
    "w03_format_history",
    f"""WITH {MSG}, l AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS back FROM msg)
    SELECT session_id, string_agg(upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || '...' ELSE content END, chr(10) ORDER BY seq) AS history FROM l WHERE back <= 6 GROUP BY ALL""",
)
def w03(spark, sf):
    return M.format_history(messages(spark, sf))


@query("w04_session_overview", "SELECT user_id AS session_id, count(*) AS n_messages, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY ALL")
def w04(spark, sf):
    return M.session_overview(table(spark, sf, "events").withColumnRenamed("user_id", "session_id"))[0]


@query(
    "w05_expire_sessions",
    "SELECT conv_id AS session_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 7 <> 0 AND conv_id * 60 >= 3600 * 0 AND (2400 - conv_id * 60) <= 24 * 60",
)
def w05(spark, sf):
    # A session begins as many hours after midnight as its number; every seventh time is unreadable.
    at = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(F.lit(0), F.expr("cast(conv_id as int)"))
    s = table(spark, sf, "conversations").select("conv_id").distinct().select(
        F.col("conv_id").alias("session_id"), F.when(F.col("conv_id") % 7 == 0, "unknown").otherwise(at.cast("string")).alias("created_at"))
    now = F.to_timestamp(F.lit("2024-01-02 16:00:00"))
    return M.expire_sessions(s, now)[0].select("session_id")


@query("w06_clear_sessions", f"WITH {MSG}, l AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 20) SELECT 'cleared' AS kind, session_id, seq FROM msg WHERE session_id NOT IN (SELECT user_id FROM l) OR role = 'system' UNION ALL SELECT 'deleted', session_id, seq FROM msg WHERE session_id NOT IN (SELECT user_id FROM l)")
def w06(spark, sf):
    m = messages(spark, sf)
    listed = table(spark, sf, "events").filter("event_type = 'error' and value > 20").select(F.col("user_id").alias("session_id")).distinct()
    out = lambda df, k: df.select(F.lit(k).alias("kind"), "session_id", "seq")
    return out(M.clear_sessions(m, listed), "cleared").unionByName(out(M.delete_sessions(m, listed), "deleted"))


def _stream(spark, sf, name):
    """A table as a stream: the file source wants a pattern rather than one file."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


@query("w07_stream_session_memory", f"WITH {PRUNED} SELECT session_id, seq, role FROM pruned")
def w07(spark, sf):
    folder = shared_folder(spark, "memory")
    msgs = _messages(_stream(spark, sf, "conversations"))

    store = WindowTable(spark, f"{folder}/windows")
    run = stream_session_memory(msgs, LIMIT).writeStream.outputMode("update").foreachBatch(store.take).option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
    run.awaitTermination()
    return store.read().select("session_id", "seq", "role")


# Two feeds of chunks, one after the other, and the documents that are deleted between them.
_LATE = "TIMESTAMP '2024-01-16 00:00:00'"


@query(
    "w08_stream_index_upserts",
    f"""WITH gone AS (SELECT user_id, max(event_id) AS g FROM events WHERE ts < {_LATE} AND value > 200 GROUP BY user_id),
    live AS (SELECT e.*, ts >= {_LATE} AS late FROM events e LEFT JOIN gone USING (user_id) WHERE value > 1 AND (g IS NULL OR event_id > g))
    SELECT user_id AS doc_id, event_type AS chunk_id, arg_max(props, event_id) AS text, 'general' AS faculty, max(event_id) AS ord,
      CASE WHEN max(event_id) FILTER (late) > max(event_id) FILTER (NOT late) THEN 'updated' ELSE 'created' END AS state FROM live GROUP BY user_id, event_type""",
)
def w08(spark, sf):
    folder = shared_folder(spark, "index")
    store = ChunkTable(spark, f"{folder}/table")
    late = F.expr(f"ts >= {_LATE}")
    events = lambda: _stream(spark, sf, "events")
    rows = lambda part: events().filter(part).select(
        F.col("user_id").alias("doc_id"), F.col("event_type").alias("chunk_id"), F.when(F.col("value") > 1, F.col("props")).alias("text"), F.col("event_id").alias("ord"))
    stream_index_upserts(rows(~late), store, f"{folder}/early").awaitTermination()
    stream_index_deletes(events().filter(~late & (F.col("value") > 200)).select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord")), store, f"{folder}/deletes").awaitTermination()
    stream_index_upserts(rows(late), store, f"{folder}/late").awaitTermination()
    # The first feed comes once more: what was deleted or replaced stays so.
    stream_index_upserts(rows(~late), store, f"{folder}/again").awaitTermination()
    return store.read().select("doc_id", "chunk_id", "text", "faculty", "ord", "state")
