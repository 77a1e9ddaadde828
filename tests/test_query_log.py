import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import TABLES, rows
from quernstone.operators import context as C
from quernstone.operators import lookup as P
from quernstone.operators import query_log as Q
from quernstone.plans.query_log import asked


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text,kind", [
    ("Môn IT003 cần học môn gì trước?", "local"),
    ("Các môn tiên quyết của SE363 là gì?", "local"),
    ("Môn học thuộc khoa CNTT?", "local"),
    ("So sánh chương trình đào tạo CNTT và KHMT?", "global"),
    ("Tóm tắt các quy định về học vụ", "global"),
    ("Tổng quan về các môn học AI", "global"),
    ("Nếu tôi rớt IT001 thì tôi sẽ bị trễ những môn đồ án nào?", "multi_hop"),
    ("Rớt môn IT002 ảnh hưởng đến năm cuối như thế nào?", "multi_hop"),
    ("Chuỗi môn học từ cơ sở đến chuyên ngành AI?", "multi_hop"),
])
def test_graph_query_type(spark, text, kind):
    assert one(spark, text, Q.graph_query_type) == kind


@pytest.mark.parametrize("text,want", [
    ("Quy chế đào tạo ngành CNTT năm 2024", (["regulation"], ["CNTT"], [2024], [])),
    ("Đề cương môn SE101 khoa học máy tính", (["syllabus"], ["KHMT"], [], ["SE101"])),
    ("Thông báo học phí 2023", (["announcement"], [], [2023], [])),
])
def test_filters(spark, text, want):
    f = one(spark, text, lambda c: Q.extract_filters(c, True))
    assert (f.doc_types, f.faculties, f.years, f.subjects) == want


def test_tool_actions(spark):
    rows = [
        ("Thought: Cần tìm nội dung Điều 14\nAction: get_article(14)", "Cần tìm nội dung Điều 14", "get_article(14)", ["14"]),
        ('Thought: Tìm các điều khoản\nAction: search_articles("đăng ký, học phần")', "Tìm các điều khoản", 'search_articles("đăng ký, học phần")', ["đăng ký, học phần"]),
        ('Thought: Xong\nAction: f(10, 25)\nObservation: x', "Xong", "f(10, 25)", ["10", "25"]),
        ("Action: done()", None, "done()", []),
    ]
    got = Q.parse_tool_actions(spark.createDataFrame([(r[0],) for r in rows], "raw string")).collect()
    assert [(r.raw, r.thought, r.action, r.args) for r in got] == rows


def test_rewrites(spark):
    f = lambda c: Q.rewrite_queries(c, " tại trường", {"abc": "đại học mẫu"})
    assert one(spark, "đkhp cho sv", f) == ["đkhp cho sv", "đăng ký học phần cho sinh viên", "đkhp cho sv tại trường"]
    assert one(spark, "abc ở đâu", f) == ["abc ở đâu", "đại học mẫu ở đâu"]
    assert one(spark, "svx", lambda c: Q.rewrite_queries(c, " ở", None, strict=True))[1] == "sinh viênx"


def test_plan_overlaid_with_json(spark):
    q = spark.createDataFrame([(1, "So sánh quy chế", '```json\n{"intent": "custom", "top_k": 7}\n```'), (2, "So sánh quy chế", "oops")], "query_id long, text string, raw string")
    out = {r.query_id: r for r in Q.plan_from_json(q, "raw", " x").collect()}
    assert (out[1].intent, out[1].top_k) == ("custom", 7) and out[2].intent == "comparative"


def test_context_scoring(spark):
    ctx = spark.createDataFrame(
        [(1, 1, "Điều 14", "cũ: ĐTBC >= 7", 0.5, False, "index"), (1, 2, "Mục b Điều 14", "mới", 0.4, True, "index"), (1, 3, "Điều 14", "khác", 0.3, False, "index"), (1, 4, "Phụ lục", "p", 0.2, False, "index")],
        "query_id long, rank long, title string, content string, score double, is_amended boolean, source string")
    assert [r.title for r in C.prefer_amended(ctx).orderBy("position").collect()] == ["Mục b Điều 14", "Phụ lục"]
    text = C.assemble_prompt_context(ctx).first().prompt_context
    assert text == "[1] Mục b Điều 14 [UPDATED VERSION] (Score: 0.40)\nmới\n[2] Phụ lục (Score: 0.20)\np"
    ans = spark.createDataFrame([(1, "Theo quy định " + "x" * 100), (2, "ngắn")], "query_id long, answer string")
    conf = {r.query_id: round(r.confidence, 6) for r in C.answer_confidence(ans, ctx).collect()}
    assert conf == {1: 0.95, 2: 0.5}


def test_extract_answer_and_reasoning(spark):
    raw = spark.createDataFrame([('```json\n{"answer": "42"}\n```',), ("```text\nđược\n```",)], "raw string")
    assert [r.answer for r in C.extract_answer(raw).collect()] == ["42", C.ANSWER_PREFIX + "được"]
    step = spark.createDataFrame([('x {"reasoning_step": "s", "confidence": 0.9, "can_answer_now": true} y',), ("Như vậy là xong",), ("chưa rõ",)], "raw string")
    got = [(r.step, r.confidence, r.can_answer) for r in C.parse_reasoning(step).collect()]
    assert got == [("s", 0.9, True), ("Như vậy là xong", 0.75, True), ("chưa rõ", 0.5, False)]


def test_every_question_is_looked_up(spark, sf):
    got = entry.queries()["p24_local_graph_lookup"](spark, sf).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()["p24_local_graph_lookup"]).df()
    assert rows(got) == rows(want)
    assert sorted(got["query_id"]) == sorted(r.query_id for r in asked(spark, sf).select("query_id").collect())


def test_all_six_routes(spark):
    texts = ["Môn học trước của IT101?", "Môn thuộc khoa CNTT", "chương trình KHMT", "Điều 5 về IT101", "quy định về SE202", "học bổng"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    edge = "src string, dst string"
    found = P.local_graph_lookup(
        queries, spark.createDataFrame([("IT101", "IT100", "P")], edge + ", type string"), spark.createDataFrame([("c1", "CNTT"), ("c2", "CNTT")], edge),
        spark.createDataFrame([("c1", "KHMT_A", 1)], edge + ", semester int"), spark.createDataFrame([("c1", "one"), ("c2", "two")], "code string, name string"),
        spark.createDataFrame([("a", "Điều 5. X", "mức học bổng"), ("b", "Điều 6. Y", "khác")], "id string, title string, full_text string"),
        spark.createDataFrame([(1, "SE202 phần mềm", "t", "d"), (2, "học bổng", "t", "d")], "entity_id long, name string, type string, description string"),
        spark.createDataFrame([(1, "a"), (1, "b")], "entity_id long, article_id string"),
    )
    assert [(r.branch, r.n_nodes, r.confidence) for r in found.orderBy("query_id").collect()] == [
        ("prerequisite", 1, 0.9), ("department", 2, 0.85), ("program", 1, 0.85), ("article", 1, 0.95), ("entity_related", 2, 0.85), ("general", 2, 0.7)]


def test_compound_keywords_read_the_text_once(spark):
    df = spark.createDataFrame([("Môn học Giải tích cần học phần nào? HỌC PHẦN",), ("hello world môn Giải Tích Hai",), (None,)], "t string")
    got = df.select(Q.compound_keywords(F.col("t")).alias("k"))
    assert [r.k for r in got.collect()] == [["học phần", "môn học", "giải", "tích", "nào?"], ["hello", "world", "môn", "giải", "tích", "Giải Tích Hai"], None]
    assert got._jdf.queryExecution().analyzed().toString().count("lower(") == 1
