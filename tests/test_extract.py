import json
import random

import pytest

from pyspark.sql import functions as F

from quernstone.functions.json_repair import repair_json
from quernstone.operators import extract as X
from quernstone.operators import labels as L

NODES = "doc_id long, id string, type string, title string, full_text string, page long, ord long"


def test_json_repair_cases(spark):
    cases = [
        ('```json\n{"key": "value"}\n```', {"key": "value"}),
        ('{"key": "value",}', {"key": "value"}),
        ('Here is the result:\n{"data": 123}\nEnd.', {"data": 123}),
        ('```json\n[{"id": 1}, {"id": 2}]\n```', {"items": [{"id": 1}, {"id": 2}]}),
        ('Response:\n```json\n{"nodes": [{"id": "a"}], "relations": []}\n```', {"nodes": [{"id": "a"}], "relations": []}),
        ("{'a': 'b'}", {"a": "b"}),
        ('{"a": "two\nlines", "b": 1}', {"a": "two\nlines", "b": 1}),
        ("no json at all", {}),
        ("", {}),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, raw string")
    got = {r.i: r.repaired for r in repair_json(df, "raw").collect()}
    assert [json.loads(got[i].json) for i in range(len(cases))] == [c[1] for c in cases]
    assert [got[i].error for i in range(len(cases))][-2:] == ["unparsable", "empty"]
    arr = spark.createDataFrame([('{"data": [1, 2]}',), ('{"x": 1}',), ("[3]",), ("{}",)], "raw string")
    assert [json.loads(r.repaired.json) for r in repair_json(arr, "raw", "array").collect()] == [[1, 2], [{"x": 1}], [3], []]


def test_merge_pages(spark):
    rows = [
        (1, "dieu_1", "Article", "Điều 1", "Phần đầu của điều", 1, 0), (1, "dieu_2", "Article", "Điều 2", "Khác.", 1, 1),
        (1, "dieu_1", "Article", "Điều 1. Phạm vi", "phần tiếp theo.", 2, 0), (1, "chuong_1", "Chapter", "Chương", "", 2, 1),
    ]
    df = spark.createDataFrame(rows, NODES)
    out = {r.id: r for r in X.merge_pages(df).collect()}
    assert len(out) == 3
    d = out["dieu_1"]
    assert (d.full_text, d.page_range, d.title) == ("Phần đầu của điều phần tiếp theo.", [1, 2], "Điều 1. Phạm vi")
    again = X.merge_pages(df.unionByName(df.withColumn("page", F.col("page") + 10))).collect()
    assert {r.id: r.full_text for r in again} == {k: v.full_text for k, v in out.items()}


def test_merge_equals_plain_fold(spark):
    rnd = random.Random(4)
    rows = [(d, f"n{rnd.randint(0, 3)}", "Article", "", " ".join(rnd.choices(["ab", "cd.", "(ef", "x\n"], k=rnd.randint(0, 3))), p, o)
            for d in range(5) for p in range(6) for o in range(4)]
    want = {}
    for d, i, _, _, t, p, o in sorted(rows, key=lambda r: (r[0], r[5], r[6])):
        if (d, i) not in want:
            want[d, i] = t
        elif t.strip() not in want[d, i]:
            old, new = want[d, i].rstrip(), t.lstrip()
            gap = " " if old and new and old[-1] not in ".!?:;,)]\n" and new[0] not in ".!?:;,([" else ""
            want[d, i] = old + gap + new
    got = {(r.doc_id, r.id): r.full_text for r in X.merge_pages(spark.createDataFrame(rows, NODES)).collect()}
    assert got == want


def plain_tables(rows, first=3, header=10):
    """The rule, walked page by page over a whole document."""
    out, last, pages = [], None, sorted({r["page"] for r in rows})
    for p in pages:
        here = [dict(r, pages=[p]) for r in sorted((r for r in rows if r["page"] == p), key=lambda r: r["ord"])]
        if last is not None:
            for n in here[:first]:
                cont = (n["title"] in ("", last["title"]) or "tiếp" in n["title"].lower()) if n["type"] == "Table" else n["full_text"].strip().startswith("|")
                if cont:
                    new, old = n["full_text"].strip().split("\n"), last["full_text"].strip().split("\n")
                    if new[0] in old[:header]:
                        new = new[1:]
                        if new and new[0].strip().startswith("|-"):
                            new = new[1:]
                    last["full_text"] += "\n" + "\n".join(new)
                    last["pages"].append(p)
                    here.remove(n)
                    break
        tables = [n for n in here if n["type"] == "Table"]
        out += here
        if tables:
            last = tables[-1]
        elif here:
            last = None
    return out


@pytest.mark.parametrize("first,header", [(3, 10), (None, None), (1, 2)])
def test_split_tables_equal_plain_walk(spark, first, header):
    rnd = random.Random(8)
    rows = []
    for d in range(12):
        for p in range(1, 25):
            for o in range(rnd.choice([0, 1, 1, 2, 5])):
                table = rnd.random() < 0.5
                head = rnd.choice(["| a | b |", "| c |"])
                text = f"{head}\n|---|\n| {rnd.randint(0, 9)} |" if table or rnd.random() < 0.2 else "văn bản"
                rows.append((d, f"{p}_{o}", "Table" if table else "Article", rnd.choice(["", "B1", "B2", "B1 (tiếp)"]), text, p, o))
    got = {(r.doc_id, r.id): (r.full_text, r.page_range) for r in X.merge_split_tables(spark.createDataFrame(rows, NODES), bucket=5, first_nodes=first, header_lines=header).collect()}
    want = {}
    names = ["doc_id", "id", "type", "title", "full_text", "page", "ord"]
    for d in range(12):
        for n in plain_tables([dict(zip(names, r)) for r in rows if r[0] == d], first, header):
            want[d, n["id"]] = (n["full_text"], n["pages"])
    assert got == want


def test_normalized_ids(spark):
    pairs = [("chuong_2_to_chuc", "chuong_2"), ("CHUONG_II", "chuong_2"), (" dieu_7_abc", "dieu_7"), ("khoan_1_dieu_2_x", "khoan_1_dieu_2"), ("chuong_iv_q", "chuong_4"), ("bang_1", "bang_1")]
    df = spark.createDataFrame([(a,) for a, _ in pairs], "id string")
    assert [r[0] for r in df.select(X.normalize_node_id(F.col("id"))).collect()] == [b for _, b in pairs]


def test_chunks_of_nested_clauses(spark):
    arts = spark.createDataFrame(
        [("f", "dieu_19", "Điều 19. A", None, 10, "C3", "", 0), ("f", "dieu_20", "Điều 20. B", 20, 11, "C3", "", 1), ("f", "dieu_21", "Điều 21. C", None, 11, "C3", "thân", 2)],
        "doc_id string, id string, title string, number int, page int, chapter string, full_text string, ord int")
    clauses = spark.createDataFrame(
        [("f", "dieu_19", 1, "khoan_1_dieu_19", None, "một"), ("f", "dieu_19", 2, None, None, "hai"), ("f", "dieu_20", 1, "khoan_1_dieu_20", None, "ba"), ("f", "dieu_20", 2, "khoan_2_dieu_20", None, "bốn")],
        "doc_id string, article_id string, idx int, id string, title string, full_text string")
    none = spark.createDataFrame([], "doc_id string, id string, title string, page int, chapter string, full_text string, ord int")
    rel = spark.createDataFrame([("f", "khoan_1_dieu_19", 0, "e1"), ("f", "khoan_2_dieu_20", 1, "e2")], "doc_id string, source_id string, ord int, evidence string")
    ch = X.build_chunks(arts, clauses, none, X.evidence_lists(rel))
    got = {r.source_id: r for r in ch.collect()}
    assert len(got) == 5 and got["khoan_2_dieu_19"].content == "Điều 19. A\nhai"
    assert got["khoan_1_dieu_19"].content == "Điều 19. A\nmột\n[Ngữ cảnh: e1]" and got["khoan_1_dieu_19"].article_number == 19
    assert got["dieu_21"].content == "Điều 21. C\nthân" and got["dieu_21"].structure_type == "article"
    docs = X.chunks_to_documents(ch).orderBy("chunk_index").collect()
    assert [d.chunk_id for d in docs] == ["khoan_1_dieu_19", "khoan_2_dieu_19", "khoan_1_dieu_20", "khoan_2_dieu_20", "dieu_21"]
    assert docs[0].extra["source_id"] == "khoan_1_dieu_19" and docs[0].section == "C3"


def test_labels(spark):
    df = spark.createDataFrame([("MON_HOC_IT003", "MonHoc", {"code": "MON_HOC_IT003", "name": "Cấu trúc"}), ("x", "khoa", {"id": "(CNTT)_"})], "id string, label string, props map<string,string>")
    out = {r.id: r for r in L.validate_props(L.standardize_props(df)).collect()}
    assert out["MON_HOC_IT003"].props == {"ma_mon": "IT003", "ten_mon": "Cấu trúc"} and out["MON_HOC_IT003"].missing == ["so_tin_chi"]
    assert out["x"].props == {"ma_khoa": "CNTT", "ten_khoa": "CNTT"} and out["x"].is_valid
    ents = spark.createDataFrame([("IT003", None, "MON_HOC", {"title": "CTDL"})], "text string, name string, type string, metadata map<string,string>")
    assert L.standardize_entities(ents).first().props == {"ma_mon": "IT003", "ten_mon": "CTDL", "so_tin_chi": "4"}


def test_tables_find_articles_by_equal_windows(spark):
    node = lambda rows: spark.createDataFrame([(d, i, "T", t, t, 1, o) for d, i, t, o in rows], NODES)
    arts = node([(1, "dieu_1", "a", 5), (1, "dieu_12", "b", 3), (2, "dieu_1", "c", 1)])
    tables = node([(1, "bang_dieu_12_t", "t1", 7), (1, "bang_9", "t2", 8), (2, "bang_dieu_12_t", "t3", 2)])
    edges = spark.createDataFrame([], "doc_id long, source string, target string, type string, ord long")
    folded, _ = X.fold_children_into_articles(arts, node([(9, "k", "k", 1)]), tables, edges)
    got = {(r.doc_id, r.id): r.full_text for r in folded.collect()}
    assert "t1" in got[1, "dieu_12"] and got[1, "dieu_1"] == "a" and "t3" in got[2, "dieu_1"]
    assert "Python" not in folded._jdf.queryExecution().executedPlan().toString()


def test_ids_are_normalised_once_for_both_ends(spark):
    from quernstone.functions.text import is_blank

    blanks = spark.createDataFrame([(None,), ("",), (" \n\u3000\x1c",), ("\n x",)], "t string")
    assert [r[0] for r in blanks.select(is_blank(F.col("t"))).collect()] == [True, True, True, False]
    docs = spark.createDataFrame([(1, "the", "the", "1-qd-abc")], "doc_id long, title string, full_text string, source_file string")
    nodes = spark.createDataFrame([(1, "DIEU_1_x", "Article", "a", "b", 1, 0), (1, "khoan_1_dieu_1_y", "Clause", "a", "c", 1, 1)], NODES)
    edges = spark.createDataFrame([(1, "DIEU_1_x", "khoan_1_dieu_1_y", "CONTAINS", 0)], "doc_id long, source string, target string, type string, ord long")
    mods = spark.createDataFrame([(1, "s", "2/Q", 0)], "doc_id long, source_text_id string, target_document_signature string, ord int")
    fixed = X.clean_extraction(docs, nodes, edges, mods, "ABC", "abc", ["the"])["edges"]
    assert [(r.source, r.target) for r in fixed.collect()] == [("dieu_1", "khoan_1_dieu_1")]
    assert fixed._jdf.queryExecution().optimizedPlan().toString().count("RLIKE ^khoan") <= 2
