import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quernstone.operators import graph_build as B
from quernstone.operators import graph_query as G
from quernstone.operators import reach_bits as R

COURSES = [("IT002", "IT001"), ("IT003", "IT002"), ("IT004", "IT003"), ("SE104", "IT002"), ("SE357", "IT004"), ("SE357", "SE104"), ("SE363", "IT003")]


@pytest.fixture(scope="module")
def courses(spark):
    return spark.createDataFrame([(a, b, "REQ") for a, b in COURSES], "src string, dst string, type string")


@pytest.fixture(scope="module")
def net(spark):
    rnd = random.Random(6)
    rows = sorted({(rnd.randint(0, 24), rnd.randint(0, 24)) for _ in range(60)})
    rows = [(a, b, "R") for a, b in rows if a != b]
    return rows, spark.createDataFrame(rows, "src long, dst long, type string")


def test_prerequisites(spark, courses):
    one = spark.createDataFrame([("SE363",)], "id string")
    out = G.prerequisite_chains(one, courses).orderBy("rank").collect()
    assert [r.path for r in out][0] == ["SE363", "IT003", "IT002", "IT001"] and len(out) == 3
    back = G.dependent_chains(spark.createDataFrame([("IT002",)], "id string"), courses).orderBy("rank").collect()
    assert {"->".join(r.path) for r in back} >= {"IT003->IT002", "SE357->SE104->IT002", "SE357->IT004->IT003->IT002"}


def dist(rows, s, both=False):
    adj = {}
    for a, b, _ in rows:
        adj.setdefault(a, set()).add(b)
        if both:
            adj.setdefault(b, set()).add(a)
    d, todo = {s: 0}, deque([s])
    while todo:
        u = todo.popleft()
        for v in adj.get(u, ()):
            if v not in d:
                d[v] = d[u] + 1
                todo.append(v)
    return d


def test_shortest_paths_and_reach(spark, net):
    rows, edges = net
    pairs = spark.createDataFrame([(a, b) for a in range(0, 25, 3) for b in range(25) if a != b], "src long, dst long")
    for direction in ("out", "both"):
        got = {(r.src, r.dst): r for r in G.shortest_path(pairs, edges, None, 6, direction).collect()}
        for a in range(0, 25, 3):
            d = dist(rows, a, direction == "both")
            assert {b: r.hops for (s, b), r in got.items() if s == a} == {b: n for b, n in d.items() if 0 < n <= 6}
        steps = {(a, b) for a, b, _ in rows} | ({(b, a) for a, b, _ in rows} if direction == "both" else set())
        for (a, b), r in got.items():
            assert r.path[0] == a and r.path[-1] == b and len(r.path) == r.hops + 1 and all(x in steps for x in zip(r.path, r.path[1:]))
    starts = spark.createDataFrame([(i,) for i in range(25)], "id long")
    near = {(r.start, r.id): r.hops for r in G.reach(starts, edges, 3).collect()}
    assert near == {(s, v): n for s in range(25) for v, n in dist(rows, s).items() if n <= 3}
    some = G.all_paths(pairs, edges, None, 3).groupBy("start", "end").agg(F.min("hops").alias("h")).collect()
    short = {(r.src, r.dst): r.hops for r in G.shortest_path(pairs, edges, None, 3).collect()}
    assert {(r.start, r.end): r.h for r in some} == short


def test_paths_never_reuse_an_edge(spark, net):
    rows, edges = net
    one = spark.createDataFrame([(rows[0][0],)], "id long")
    for r in G.expand_paths(one, edges, 5).collect():
        used = list(zip(r.path, r.path[1:]))
        assert len(used) == len(set(used))


def test_chain_counts(spark):
    rows = [(0, 1, "R"), (0, 1, "R"), (1, 0, "R"), (1, 2, "R"), (2, 0, "R")]
    edges = spark.createDataFrame(rows, "src long, dst long, type string")
    got = {(r.start, r.end): r.n for r in G.citation_chain_counts(spark.createDataFrame([(i,) for i in range(3)], "id long"), edges).collect()}
    want = {}
    n = range(len(rows))
    for i in n:
        for j in n:
            for k in n:
                if len({i, j, k}) == 3 and rows[i][1] == rows[j][0] and rows[j][1] == rows[k][0]:
                    key = (rows[i][0], rows[k][1])
                    want[key] = want.get(key, 0) + 1
    assert got == want


def test_citation_chain_sums_equal_the_counted_pairs(spark):
    rnd = random.Random(12)
    edges = spark.createDataFrame([(rnd.randrange(8), rnd.randrange(8)) for _ in range(40)], "src long, dst long")
    starts = spark.createDataFrame([(i,) for i in range(10)], "id long")
    for hops in (1, 2, 3):
        pairs = G.citation_chain_counts(starts, edges, hops).collect()
        want = {}
        for r in pairs:
            n, total = want.get(r.start, (0, 0))
            want[r.start] = (n + r.n, total + r.n * r.end)
        sums = G.citation_chain_counts(starts, edges, hops, {"ends": F.col("end")})
        assert {r.start: (r.n_chains, r.ends) for r in sums.collect()} == want


def test_impact_includes_cycles(spark):
    edges = spark.createDataFrame([(1, 2, "R"), (2, 1, "R"), (3, 1, "R")], "src long, dst long, type string")
    got = {(r.target, r.id) for r in G.impact(spark.createDataFrame([(1,)], "id long"), edges).collect()}
    assert got == {(1, 2), (1, 3), (1, 1)}


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 260)]
    got = {r.node: r.component for r in B.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    assert got == {x: root(x) for x in parent}


def test_similar_pairs_equal_brute_force(spark):
    from tests.test_keyword import lev

    rnd = random.Random(7)
    base = ["".join(rnd.choices("abcd", k=rnd.randint(4, 24))) for _ in range(25)]
    names = set(base)
    for w in base:
        for _ in range(4):
            i = rnd.randrange(len(w))
            names.add(rnd.choice([w[:i] + w[i + 1:], w[:i] + "z" + w[i:], w[:i] + "q" + w[i + 1:]]))
    names = sorted(x for x in names if x)
    df = spark.createDataFrame([("T", x) for x in names], "type string, name string")
    for t in (0.9, 0.8):
        got = {(r.a, r.b) for r in B.similar_pairs(df, t).collect()}
        want = {(a, b) for i, a in enumerate(names) for b in names[i + 1:] if 1 - lev(a, b) / max(len(a), len(b)) >= t - 1e-9}
        assert got == want


def test_fuzzy_and_hybrid_dedupe(spark):
    rows = [("KHOA", "công nghệ thông tin", 0.8, 1), ("KHOA", "công nghệ thông tln", 0.9, 2), ("KHOA", "khoa học máy tính", 0.7, 3), ("MON_HOC", "công nghệ thông tin", 0.7, 4), ("KHOA", "công nghệ thông tin", 0.6, 5)]
    m = spark.createDataFrame([(a, b, b, c, d) for a, b, c, d in rows], "type string, text string, normalized string, confidence double, ord long")
    for f in (B.dedupe_fuzzy, B.dedupe_hybrid):
        got = {(r.type, r.text) for r in f(m).collect()}
        assert got == {("KHOA", "công nghệ thông tln"), ("KHOA", "khoa học máy tính"), ("MON_HOC", "công nghệ thông tin")}


def test_merge_policies(spark):
    rows = [("K", "a", "A", 0.8, 1, 5, 9, {"x": "1", "y": "1"}), ("K", "a", "B", 0.9, 2, 3, 7, {"x": "2"}), ("K", "a", "C", 0.9, 3, 4, 12, {"z": "3"})]
    m = spark.createDataFrame(rows, "type string, normalized string, text string, confidence double, ord long, start int, end int, metadata map<string,string>")
    pick = lambda p: B.merge_policy(m, ["type", "normalized"], p).first()
    assert pick("highest").text == "B" and pick("first").text == "A" and pick("manual_review").needs_review
    r = pick("merge")
    assert (r.text, r.start, r.end, r.confidence, r.metadata, r.merged_from) == ("B", 3, 12, 0.9, {"x": "2", "y": "1", "z": "3"}, ["B", "C"])


def test_delete_nodes_and_edges(spark, net):
    rows, edges = net
    nodes = spark.createDataFrame([(i, "N") for i in range(25)], "id long, label string")
    gone = spark.createDataFrame([(1,), (2,)], "id long")
    n, e = B.delete_nodes(nodes, edges, gone)
    assert n.count() == 23 and e.count() == sum(not {a, b} & {1, 2} for a, b, _ in rows)
    soft, same = B.delete_nodes(nodes, edges, gone, F.lit("2025-01-01"))
    assert soft.filter("deleted_at is not null").count() == 2 and same.count() == len(rows)
    assert B.delete_edges(edges, edges.limit(3)).count() == len(rows) - 3


def test_amendment_section(spark):
    text = "--- Mục b khoản 1 Điều 14 ---\nNội dung mới\n--- Điều 23 ---\nkhác"
    df = spark.createDataFrame([(text, "Điều 14. Đăng ký"), (text, "Điều 23"), (text, "Điều 9"), (text, "không")], "t string, h string")
    assert [r[0] for r in df.select(G.extract_amendment_section(F.col("t"), F.col("h"))).collect()] == ["Nội dung mới", "khác", None, None]


def test_bit_search_counts_what_the_plain_search_finds(spark):
    rnd = random.Random(12)
    edges = spark.createDataFrame([(rnd.randrange(90), rnd.randrange(90), rnd.choice("ab")) for _ in range(220)], "src long, dst long, type string")
    starts = spark.createDataFrame([(i,) for i in range(95)] + [(3,)], "id long")
    for direction in ("out", "in", "both"):
        for types in (None, ["a"]):
            near, on = G.traverse(starts.distinct(), edges, types, 3, direction)
            nodes = {r.start: (r.n, r.s, r.h) for r in near.groupBy("start").agg(F.count("*").alias("n"), F.sum("id").alias("s"), F.sum("hops").alias("h")).collect()}
            n_edges = {r.start: r["count"] for r in on.groupBy("start").count().collect()}
            got = R.traverse_counts(starts, edges, types, 3, direction, {"s": F.col("id"), "h": F.col("hops")}).collect()
            assert {r.start: (r.n_nodes, r.s, r.h) for r in got} == nodes
            assert {r.start: r.n_edges for r in got if r.n_edges} == n_edges
    want = {r.target: r["count"] for r in G.impact(starts.distinct(), edges, 3).groupBy("target").count().collect()}
    assert {r.target: r.n_dependents for r in R.impact_counts(starts, edges, 3).collect()} == want


def test_bit_search_from_and_to_a_hub(spark):
    hub = spark.range(1, 100_001).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit("r").alias("type"))
    edges = hub.unionByName(spark.createDataFrame([(0, 100_001, "r"), (0, 100_002, "r")], hub.schema))
    starts = spark.range(0, 1000)
    got = R.traverse_counts(starts, edges, depth=2)
    rows = {r.start: (r.n_nodes, r.n_edges) for r in got.collect()}
    assert rows[0] == (3, 2) and set(rows.values()) == {(3, 2), (4, 3)} and len(rows) == 1000
    assert [(r.target, r.n_dependents) for r in R.impact_counts(spark.createDataFrame([(100_001,)], "id long"), edges).collect()] == [(100_001, 100_001)]
    words = R.reach_bits(R.numbered_starts(starts), edges, 2)
    assert words.filter("id = 0").count() <= 1 + 2 * (1000 // 64 + 8)
    assert R.traverse_counts(starts.limit(0), edges).collect() == []


def test_a_common_entity_does_not_join_communities(spark):
    groups = [(a, f"e{a // 10}_{k}") for a in range(60) for k in range(3)]
    m = spark.createDataFrame(groups + [(a, "common") for a in range(60)], "article_id long, entity_id string")
    found, sizes = G.propagate_communities(m)
    assert {r.article_id: r.community_id for r in found.collect()} == {a: a // 10 * 10 for a in range(60)}
    assert [(r.community_id, r["size"]) for r in G.largest_communities(sizes, 2).collect()] == [(0, 10), (10, 10)]
    joined, _ = G.detect_communities(m)
    assert {r.community_id for r in joined.collect()} == {0}


def test_similar_names_with_one_long_prefix(spark):
    rnd = random.Random(4)
    names = sorted({"department of applied science and " + "".join(rnd.choices("abcdefgh", k=14)) for _ in range(150)})
    names += [n[:-1] + "z" for n in names[:20]]
    df = spark.createDataFrame([("t", n) for n in sorted(set(names))], "type string, name string")
    for t in (0.9, 0.95):
        got = {(r.a, r.b) for r in B.similar_pairs(df, t, piece_rows=5).collect()}
        assert got == {(r.a, r.b) for r in df.select(F.col("name").alias("a")).crossJoin(df.select(F.col("name").alias("b"))).filter("a < b").filter(B.ratio(F.col("a"), F.col("b")) >= t - 1e-9).collect()}


def test_paths_follow_their_target(spark):
    rnd = random.Random(21)
    rows = [(rnd.randrange(14), rnd.randrange(14), rnd.choice("ab")) for _ in range(45)]
    edges = spark.createDataFrame(rows, "src long, dst long, type string")
    pairs = spark.createDataFrame([(rnd.randrange(14), rnd.randrange(14)) for _ in range(25)] + [(0, 99)], "src long, dst long")
    wanted = pairs.select(F.col("src").alias("start"), F.col("dst").alias("end")).distinct()
    plain = G.expand_paths(pairs.select(F.col("src").alias("id")), edges, 3).join(wanted, ["start", "end"])
    want = {}
    for r in plain.collect():
        want.setdefault((r.start, r.end), []).append((r.hops, list(r.path)))
    got = {}
    for r in G.all_paths(pairs, edges, None, 3, 6).collect():
        got.setdefault((r.start, r.end), []).append((r["rank"], r.hops, list(r.path)))
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == {k: sorted(v)[:6] for k, v in want.items()}


def test_paths_past_a_hub_expand_only_what_arrives(spark, monkeypatch):
    sizes = []
    real = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: sizes.append(real(df).count()) or real(df))
    edges = spark.range(1000).select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"), F.lit("r").alias("type"))
    edges = edges.unionByName(spark.createDataFrame([(-2, -1, "r"), (7, 5000, "r")], "src long, dst long, type string"))
    got = G.all_paths(spark.createDataFrame([(-2, 5000)], "src long, dst long"), edges).collect()
    assert [list(r.path) for r in got] == [[-2, -1, 7, 5000]] and max(sizes) <= 4


def test_propagated_communities_keep_the_mentions_in_place(spark):
    rnd = random.Random(5)
    rows = [(rnd.randrange(30), rnd.choice([None, *"abcdefghijkl"])) for _ in range(120)] + [(None, "a"), (99, "alone"), (98, None)]
    pairs = {(a, e) for a, e in rows}
    label = {a: a for a, _ in pairs}
    per = {e: 1_000_000 // sum(x == e for _, x in pairs) for _, e in pairs if e is not None}
    for _ in range(3):
        told = {}
        for e in per:
            heard = [label[a] for a, x in pairs if x == e and a is not None and a in label]
            if heard:
                told[e] = min(heard, key=lambda v: (-heard.count(v), v))
        nxt = {}
        for a, e in pairs:
            if e in told:
                nxt.setdefault(a, {}).setdefault(told[e], 0)
                nxt[a][told[e]] += per[e]
        label = {a: min(w, key=lambda v: (-w[v], v)) for a, w in nxt.items()}
    found, _ = G.propagate_communities(spark.createDataFrame(rows, "article_id long, entity_id string"), 3)
    assert {r.article_id: r.community_id for r in found.collect()} == label
    kept = G._bucketed(spark.range(100).withColumnRenamed("id", "e"), "e")
    other = spark.range(1000).select((F.col("id") % 100).alias("e"), "id").hint("merge")
    assert kept.join(other, "e")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def _read_again(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "ExistingRDD[type" in plan or "LocalTableScan" in plan


def test_similar_names_of_two_and_three_edits_read_once(spark):
    rnd = random.Random(11)
    base = ["".join(rnd.choices("abc", k=rnd.randint(20, 38))) for _ in range(12)]
    names = set(base)
    for w in base:
        for _ in range(6):
            v = w
            for _ in range(rnd.randint(1, 3)):
                i = rnd.randrange(len(v))
                v = rnd.choice([v[:i] + v[i + 1:], v[:i] + "z" + v[i:], v[:i] + "q" + v[i + 1:]])
            names.add(v)
    df = spark.createDataFrame([("t", n) for n in sorted(names)], "type string, name string")
    pairs = B.similar_pairs(df, 0.9)
    want = df.select(F.col("name").alias("a")).crossJoin(df.select(F.col("name").alias("b"))).filter("a < b").filter(B.ratio(F.col("a"), F.col("b")) >= 0.9 - 1e-9)
    assert {(r.a, r.b) for r in pairs.collect()} == {(r.a, r.b) for r in want.collect()}
    assert not _read_again(pairs)


def test_hybrid_dedupe_reads_mentions_once(spark):
    m = spark.createDataFrame([("K", "abcdefghijkl", "abcdefghijkl", 0.8, 1), ("K", "abcdefghijkm", "abcdefghijkm", 0.9, 2)], "type string, text string, normalized string, confidence double, ord long")
    out = B.dedupe_hybrid(m)
    assert [(r.text, r.n_merged) for r in out.collect()] == [("abcdefghijkm", 2)]
    assert not _read_again(out)


def test_structure_graph_nodes_are_made_once(spark):
    nodes = spark.createDataFrame([(1, "dieu_1", "article", "A", "x", 0), (1, "khoan_1", "clause", "B", "y", 1)], "doc_id long, id string, kind string, title string, full_text string, ord long")
    edges = spark.createDataFrame([(1, "dieu_1", "khoan_1", "CONTAINS")], "doc_id long, source string, target string, type string")
    n, e = B.build_structure_graph(nodes, edges, "rules")
    assert n.count() == 3 and e.count() == 3
    # Only the category's own row is not read back.
    assert n._jdf.queryExecution().executedPlan().toString().count("ExistingRDD") <= 1


def test_mentions_of_far_orders_are_numbered(spark, tmp_path):
    from quernstone.plans import graph_build as P

    rows = [(1, 1, 4, 8, 3.0, 0.05), (54_000_000, 1, 4, 8, 3.0, 0.04), (54_000_000, 2, 5, 9, 3.0, 0.04)]
    write = lambda rs, d: spark.createDataFrame(
        rs, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{d}/lineitem.parquet")
    place = lambda o, n, p, s, q: (((o * 10 + n) * 100000 + p) * 10000 + s) * 100 + q
    write(rows, tmp_path / "far")
    write(rows[:1], tmp_path / "near")
    got = {r.normalized: (int(r.first_ord), r.n_merged, r.was_merged) for r in P.g06(spark, str(tmp_path / "far")).collect()}
    assert got == {"entity 4": (place(1, 1, 4, 8, 3), 2, True), "entity 5": (place(54_000_000, 2, 5, 9, 3), 1, False)}
    edges = B.resolve_semantic_edges(P.relations(spark, str(tmp_path / "far")), P.mentions(spark, str(tmp_path / "far")))[0]
    assert sorted((r.src_text, r.dst_text) for r in edges.collect()) == [("entity 4", "entity 4"), ("entity 5", "entity 4")]
    assert P.g06(spark, str(tmp_path / "near")).schema["first_ord"].dataType.simpleString() == "bigint"
