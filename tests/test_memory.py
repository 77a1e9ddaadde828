from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quernstone.operators import memory as M
from quernstone.session import shared_folder
from quernstone.streaming.index_stream import ChunkTable, stream_index_deletes, stream_index_upserts
from quernstone.streaming.memory_stream import WindowTable, stream_session_memory

T0 = datetime(2024, 1, 1)
SCHEMA = "session_id long, seq long, role string, content string, ts timestamp"


def rows():
    out = [(1, i, "system" if i in (0, 3) else "user" if i % 2 else "assistant", f"m{i}", T0 + timedelta(minutes=i)) for i in range(25)]
    out += [(2, i, "user", f"n{i}", T0 + timedelta(minutes=i)) for i in range(4)]
    return out + [(3, i, "system", f"s{i}", T0 + timedelta(minutes=i)) for i in range(6)] + [(3, 6, "user", "u", T0 + timedelta(minutes=6))]


def test_windows(spark):
    m = spark.createDataFrame(rows(), SCHEMA)
    kept = {}
    for r in M.prune_window(m, 5).collect():
        kept.setdefault(r.session_id, set()).add(r.seq)
    assert kept == {1: {0, 3, 22, 23, 24}, 2: {0, 1, 2, 3}, 3: set(range(6))}
    hist = {r.seq for r in M.history(m, 6).collect() if r.session_id == 1}
    assert hist == {0, 3, 19, 20, 21, 22, 23, 24}
    text = {r.session_id: r.history for r in M.format_history(m, 2).collect()}
    assert text[1] == "User: m23\nAssistant: m24"


def test_expiry(spark):
    s = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-02 10:00:00"), (3, "?"), (4, None)], "session_id long, created_at string")
    kept, n = M.expire_sessions(s, F.to_timestamp(F.lit("2024-01-02 12:00:00")))
    assert [r.session_id for r in kept.collect()] == [2] and n.first().n_expired == 3


def test_stream_equals_batch(spark):
    folder = shared_folder(spark, "test-memory")
    data = sorted(rows(), key=lambda r: r[4])
    for i in range(0, len(data), 9):
        spark.createDataFrame(data[i:i + 9], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    store = WindowTable(spark, f"{folder}/windows", buckets=4)
    run = stream_session_memory(stream, 5).writeStream.outputMode("update").foreachBatch(store.take).option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    got = [(r.session_id, r.seq) for r in store.read().collect()]
    want = [(r.session_id, r.seq) for r in M.prune_window(spark.createDataFrame(rows(), SCHEMA), 5).collect()]
    # The table holds the current windows and nothing else, also when a batch comes again.
    assert sorted(got) == sorted(want)
    store.take(store.read())
    store.take(store.read().filter("session_id = 1").withColumn("version", F.lit(0).cast("long")))
    assert sorted((r.session_id, r.seq) for r in store.read().collect()) == sorted(want)


def test_stream_upserts(spark):
    folder = shared_folder(spark, "test-index")
    schema = "doc_id long, chunk_id string, text string, ord long"
    batches = [[(1, "a", "v1", 1), (1, "a", "v2", 2), (2, "b", "x", 3)], [(1, "a", "v3", 4), (3, "c", None, 5), (4, "d", "y", 6)]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    store, counts = ChunkTable(spark, f"{folder}/table"), []
    assert stream_index_upserts(stream, store, f"{folder}/ckpt", counts).awaitTermination(120)
    got = {(r.doc_id, r.chunk_id): (r.text, r.state) for r in store.read().collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, "a"): "v3", (2, "b"): "x", (4, "d"): "y"}
    assert sorted(c[1:] for c in counts) == [(2, 1), (3, 0)] and got[1, "a"][1] == "updated"
    # A new checkpoint over the same table, here of deletes and then of chunks, loses nothing.
    spark.createDataFrame([(1, None, None, 10), (None, "a", "x", 11)], schema).write.parquet(f"{folder}/gone")
    docs = spark.readStream.schema(schema).parquet(f"{folder}/gone")
    assert stream_index_deletes(docs, store, f"{folder}/deletes").awaitTermination(120)
    assert {r.doc_id for r in ChunkTable(spark, f"{folder}/table").read().collect()} == {2, 4}
    # The first feed once more, under a new checkpoint: what was deleted stays deleted, and no state changes.
    assert stream_index_upserts(stream, store, f"{folder}/again").awaitTermination(120)
    assert {(r.doc_id, r.text, r.state) for r in store.read().collect()} == {(2, "x", "created"), (4, "y", "created")}
    spark.createDataFrame([(9, "z", "late", 1, "law"), (1, "a", "back", 20, None), (1, "e", "too old", 9, None)], schema + ", faculty string").coalesce(1).write.parquet(f"{folder}/more")
    more = spark.readStream.schema(schema + ", faculty string").parquet(f"{folder}/more")
    assert stream_index_upserts(more, store, f"{folder}/ckpt2").awaitTermination(120)
    left = {(r.doc_id, r.chunk_id): (r.text, r.faculty, r.state) for r in ChunkTable(spark, f"{folder}/table").read().collect()}
    assert left == {
        (2, "b"): ("x", "general", "created"), (4, "d"): ("y", "general", "created"), (9, "z"): ("late", "law", "created"), (1, "a"): ("back", "general", "created"),
    }
    assert ChunkTable(spark, f"{folder}/none").read() is None


def test_a_batch_rewrites_only_the_partitions_it_touches(spark, tmp_path):
    store = ChunkTable(spark, str(tmp_path / "t"), buckets=8)
    rows = lambda ids, ord: spark.createDataFrame([(i, "c", f"t{ord}", ord) for i in ids], "doc_id long, chunk_id string, text string, ord long")
    store.upsert(rows(range(100), 1))
    files = lambda: {p.parent.name: {q.name for q in p.parent.glob("*.parquet")} for p in (tmp_path / "t").glob("part=*/*.parquet")}
    before = files()
    store.upsert(rows([7], 2))
    after = files()
    assert len(before) == 8 and sum(before[k] != after[k] for k in before) == 1
    store.delete(spark.createDataFrame([(i, 5) for i in range(100)], "doc_id long, ord long"))
    assert store.read().count() == 0 and len(files()) == 8
    store.upsert(rows([3, 4], 5))
    assert store.read().count() == 0
    store.upsert(rows([3], 6))
    assert [(r.doc_id, r.text, r.state) for r in store.read().collect()] == [(3, "t6", "created")]
