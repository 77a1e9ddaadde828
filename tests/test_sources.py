import json

from pyspark.sql import functions as F

from quernstone.sources import readers as R
from quernstone.sources import writers as W


def test_extraction_files(spark, tmp_path):
    art = {"id": "dieu_19", "number": 19, "title": "Điều 19", "page": 10, "chapter": "Chương 3", "clauses": [{"id": "khoan_1_dieu_19", "content": "một"}]}
    one = {"stage1_structure": {"articles": [art]}, "relations": [{"source_article_id": "khoan_1_dieu_19", "target_article_id": "dieu_20", "relation_type": "YEU_CAU", "evidence": "e"}]}
    two = {"structure": {"document": {"id": "doc", "title": "T"}, "articles": [{"id": "dieu_1", "title": "A", "full_text": "x"}], "relations": [{"source": "doc", "target": "dieu_1", "type": "CONTAINS"}]},
           "stage2_semantic": {"entities": [{"id": "e1", "type": "KHOA", "text": "k", "confidence": 0.8}], "modifications": [{"action": "AMENDS", "source_text_id": "dieu_1"}]}}
    three = {"articles": [{"id": "dieu_7", "title": "B"}], "relations": [{"source": "a", "target": "b", "type": "FOLLOWS"}]}
    for name, d in (("one", one), ("two", two), ("three", three)):
        (tmp_path / f"{name}.json").write_text(json.dumps(d, ensure_ascii=False), encoding="utf-8")
    t = R.read_extraction(spark, str(tmp_path))
    ids = {(r.doc_id, r.kind, r.id) for r in t["nodes"].collect()}
    assert ids == {("one", "article", "dieu_19"), ("two", "document", "doc"), ("two", "article", "dieu_1"), ("three", "article", "dieu_7")}
    assert t["nested_clauses"].first().full_text == "một" and t["evidence"].first().source_id == "khoan_1_dieu_19"
    assert {(r.doc_id, r.type) for r in t["edges"].collect()} == {("two", "CONTAINS"), ("three", "FOLLOWS")}
    assert t["mentions"].first().text == "k" and t["modifications"].first().action == "AMENDS"


def test_rules_csv(spark, tmp_path):
    f = tmp_path / "rules.csv"
    f.write_text(
        "doc_id,chapter_no,article_no,clause_no,article_id,clause_id,rule_id,rule_name,rule_type,rule_severity,rule_description_vi,rule_formula,concept_id,concept_name,concept_group,keywords\n"
        '# Example rows\n\nQD,2,14,1,A14,C1,R1,Giới hạn,LIMIT,INFO,"tối thiểu 14, tối đa 24","credits >= 14",C,Sinh viên,G,"tín chỉ; đăng ký"\n', encoding="utf-8")
    rows = R.read_rules_csv(spark, str(f), R.RULE_MAPPING_SCHEMA).collect()
    assert len(rows) == 1 and rows[0].article_no == 14 and rows[0].rule_description_vi == "tối thiểu 14, tối đa 24"


def test_crawled_text(spark, tmp_path):
    (tmp_path / "p.txt").write_text("URL: https://example.org/a\nTitle: Trang\nCrawled: 2025-10-13T20:48:47.226197\nLength: 22,598 characters\n" + "=" * 100 + "\n\nThân bài\n", encoding="utf-8")
    r = R.read_crawled_text(spark, str(tmp_path)).first()
    assert (r.url, r.title, r.declared_len, r.body, r.crawled_at.year) == ("https://example.org/a", "Trang", 22598, "Thân bài", 2025)


def test_keyword_index_round_trip_prunes(spark, tmp_path):
    c = spark.createDataFrame([(1, "a", "x", "en", None), (2, "b", "y", None, "law"), (3, None, "z", "en", None)], "doc_id long, chunk_id string, text string, language string, doc_type string")
    path = str(tmp_path / "index")
    n = W.write_keyword_index(c, path).first()
    assert (n.ok, n.failed) == (2, 1)
    got = R.read_chunks(spark, path, ["doc_id", "language", "doc_type"], languages=["vi"])
    assert [(r.doc_id, r.language, r.doc_type) for r in got.collect()] == [(2, "vi", "law")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(language" in plan and "ReadSchema: struct<doc_id:bigint>" in plan


def test_vector_rows_defaults(spark):
    c = spark.createDataFrame([(1, None, 4, "văn bản", None, {"chapter": "C"})], "doc_id long, chunk_id string, chunk_index int, text string, year int, extra map<string,string>")
    r = W.vector_rows(c).first()
    assert (r.chunk_id, r.year, r.page, r.title, r.language, r.chapter, r.metadata_json) == ("1_4", 0, 0, "", "vi", "C", '{"chapter":"C"}')
    assert abs(sum(x * x for x in r.embedding) - 1) < 1e-9


def test_delete_from_either_store(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, chunk_id string")
    b = spark.createDataFrame([(1, "x")], "doc_id long, chunk_id string")
    left, done = W.delete_from_stores({"keyword": a, "vector": b}, spark.createDataFrame([(1,), (2,), (9,)], "doc_id long"))
    assert {r.doc_id: (r.success, r.deleted) for r in done.collect()} == {1: (True, 2), 2: (True, 1), 9: (False, 0)}
    assert left["keyword"].count() == 0 and left["vector"].count() == 0


def test_extraction_result_written(spark, tmp_path):
    n = spark.createDataFrame([("d", "a")], "doc_id string, id string")
    parts, summary = W.extraction_result(n, n, n, n.limit(0))
    W.write_extraction_result(parts, summary, str(tmp_path / "out"))
    got, back = R.read_extraction_result(spark, str(tmp_path / "out"))
    assert got.count() == 3 and back.first().total_structural_nodes == 1
    nodes, _ = R.read_extraction_result(spark, str(tmp_path / "out"), "nodes")
    assert [(r.doc_id, json.loads(r.json)) for r in nodes.collect()] == [("d", {"id": "a"})]
    assert "PartitionFilters: [isnotnull(section" in nodes._jdf.queryExecution().executedPlan().toString()
    many = spark.range(500).select(F.col("id").cast("string").alias("doc_id"), F.lit("x").alias("id"))
    W.write_extraction_result(*W.extraction_result(many, many, many, many), str(tmp_path / "many"), buckets=8)
    assert len([p for p in (tmp_path / "many/parts").iterdir() if p.is_dir()]) == 8
    assert spark.read.json(str(tmp_path / "out/summary")).first().total_semantic_entities == 1
    assert summary.select(F.sum("total_structural_nodes")).first()[0] == 1


def test_extraction_lines_are_parsed_once(spark, tmp_path):
    docs = [{"doc_id": i, "structure": {"articles": [{"id": f"a{i}", "title": "T", "content": "x" * i}]}} for i in range(30)] + [{"doc_id": 99}]
    (tmp_path / "all.json").write_text("\n".join(json.dumps(d) for d in docs), encoding="utf-8")
    t = R.read_extraction(spark, str(tmp_path), lines=True, id_type="long")
    assert {(r.doc_id, r.id, len(r.full_text)) for r in t["nodes"].collect()} == {(i, f"a{i}", i) for i in range(30)}
    plan = t["edges"]._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan and "full_text" not in plan


def test_many_pages_in_a_file(spark, tmp_path):
    pages = [f"URL: https://example.org/{i}\nTitle: T{i}\nCrawled: 2025-10-13T20:48:47\nLength: 1,000 characters\n" + "=" * 100 + f"\n\nBody {i}\nmore\n" for i in range(5)]
    (tmp_path / "p.txt").write_text(R.PAGE_END.join(pages), encoding="utf-8")
    got = {r.url: (r.title, r.declared_len, r.body) for r in R.read_crawled_text(spark, str(tmp_path), many=True).collect()}
    assert got == {f"https://example.org/{i}": (f"T{i}", 1000, f"Body {i}\nmore") for i in range(5)}
