"""Registered queries for context assembly and answer scoring: an order's lines act as its retrieved rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import context as C
from quernstone.operators.ranking import number_rows, top_k
from quernstone.plans import sql_parts as S
from quernstone.plans.bindings import table
from quernstone.plans.query_log import has
from quernstone.plans.registry import query

big = lambda c: F.col(c).cast("bigint").alias(c)
r6 = lambda c: F.round(c, 6).alias(c)

CTX = """ctx AS MATERIALIZED (SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rank,
  CASE WHEN l_suppkey % 5 = 0 THEN 'Phụ lục ' || l_partkey WHEN l_suppkey % 5 = 1 THEN 'Mục b khoản 1 Điều ' || (l_partkey % 3) ELSE 'Điều ' || (l_partkey % 3) END AS title,
  CASE l_linenumber % 4 WHEN 0 THEN 'ĐTBC >= 7 ' || l_partkey WHEN 1 THEN ' ' || l_partkey || ' ' WHEN 2 THEN repeat('nội dung ', l_linenumber) || l_partkey ELSE 'Quy định số ' || l_partkey || ' về học phần' END AS content,
  round(l_discount * 10, 4) AS score, l_returnflag = 'R' AS is_amended, CASE WHEN l_tax > 0.06 THEN 'knowledge_graph' ELSE 'index' END AS source FROM lineitem)"""


def contexts(spark, sf):
    l = number_rows(
        table(spark, sf, "lineitem"), ["l_orderkey"], F.col("l_linenumber"),
        [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")], "rank")
    s = lambda e: F.expr(f"cast({e} as string)")
    c = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    m, k = F.col("l_linenumber") % 4, F.col("l_suppkey") % 5
    return l.select(
        F.col("l_orderkey").alias("query_id"), big("rank"),
        F.when(k == 0, c("Phụ lục ", s("l_partkey"))).when(k == 1, c("Mục b khoản 1 Điều ", s("l_partkey % 3"))).otherwise(c("Điều ", s("l_partkey % 3"))).alias("title"),
        F.when(m == 0, c("ĐTBC >= 7 ", s("l_partkey"))).when(m == 1, c(" ", s("l_partkey"), " ")).when(m == 2, F.concat(F.repeat(F.lit("nội dung "), F.col("l_linenumber")), s("l_partkey")))
        .otherwise(c("Quy định số ", s("l_partkey"), " về học phần")).alias("content"),
        F.round(F.col("l_discount") * 10, 4).alias("score"), (F.col("l_returnflag") == "R").alias("is_amended"),
        F.when(F.col("l_tax") > 0.06, "knowledge_graph").otherwise("index").alias("source"),
    )


@query("c01_relevant_documents", f"WITH {CTX} SELECT query_id, rank, title, {S.strip('content')} AS content, score FROM ctx WHERE rank <= 5 AND length({S.strip('content')}) > 10")
def c01(spark, sf):
    return C.relevant_documents(contexts(spark, sf)).select("query_id", "rank", "title", "content", "score")


@query(
    "c02_context_quality",
    f"""WITH {CTX}, a AS (SELECT query_id, avg(score) AS r, sum(length(content)) AS n, count(*) AS c FROM ctx GROUP BY ALL)
    SELECT o_orderkey AS query_id, round(coalesce(r, 0), 6) AS average_relevance, CAST(coalesce(n, 0) AS BIGINT) AS total_length, coalesce(c, 0) AS n_docs, round(least(coalesce(r, 0) * 0.6 + least(coalesce(n, 0) / 1000, 1) * 0.4, 1), 6) AS quality, coalesce(n, 0) > 100 AS sufficient
    FROM orders LEFT JOIN a ON query_id = o_orderkey""",
)
def c02(spark, sf):
    q = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"))
    return C.context_quality(q, contexts(spark, sf)).select("query_id", r6("average_relevance"), big("total_length"), big("n_docs"), r6("quality"), "sufficient")


BEST = f"""mk AS MATERIALIZED (SELECT *, nullif(regexp_extract(title, '(?i)điều\\s*(\\d+)', 1), '') AS no, is_amended OR (contains(title, 'Mục') AND contains(title, 'Điều')) OR source = 'knowledge_graph' AS is_new,
  {has('content', C.OLD_WORDING)} OR {has('lower(content)', C.OLD_WORDING_LOWER)} AS old FROM ctx),
us AS (SELECT * FROM mk WHERE no IS NULL OR NOT old OR is_new),
bst AS (SELECT *, min(rank) OVER (PARTITION BY query_id, no) AS place, row_number() OVER (PARTITION BY query_id, no ORDER BY is_new DESC, rank) AS n FROM us WHERE no IS NOT NULL),
pick AS MATERIALIZED (SELECT query_id, rank, title, content, score, is_amended, row_number() OVER (PARTITION BY query_id ORDER BY g, place) AS position FROM (
  SELECT query_id, rank, title, content, score, is_amended, 0 AS g, place FROM bst WHERE n = 1 UNION ALL SELECT query_id, rank, title, content, score, is_amended, 1, rank FROM us WHERE no IS NULL))"""


@query("c03_prefer_amended", f"WITH {CTX}, {BEST} SELECT query_id, rank, title, content, position FROM pick")
def c03(spark, sf):
    return C.prefer_amended(contexts(spark, sf)).select("query_id", "rank", "title", "content", big("position"))


_GRAPH = """gr AS (SELECT o_orderkey AS query_id, repeat('đồ thị ', (o_custkey % 20)::INTEGER) AS text, (o_orderkey % 10) / 10.0 AS confidence, o_custkey % 3 AS n_nodes FROM orders),
uf AS (SELECT * FROM gr WHERE length(text) > 50 AND confidence >= 0.5 AND n_nodes > 0)"""


def graph_rows(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("query_id"), F.repeat(F.lit("đồ thị "), (F.col("o_custkey") % 20).cast("int")).alias("text"),
        ((F.col("o_orderkey") % 10) / 10.0).alias("confidence"), (F.col("o_custkey") % 3).alias("n_nodes"))


@query(
    "c04_merge_graph_context",
    f"""WITH {CTX}, {_GRAPH} SELECT query_id, 1::BIGINT AS rank, 'Graph Reasoning Context' AS title, text AS content, 1.0::DOUBLE AS score, 'Knowledge Graph' AS source FROM uf
    UNION ALL SELECT c.query_id, rank + CASE WHEN uf.query_id IS NULL THEN 0 ELSE 1 END, title, content, score, source FROM ctx c LEFT JOIN uf USING (query_id)""",
)
def c04(spark, sf):
    return C.merge_graph_context(contexts(spark, sf), graph_rows(spark, sf))


@query(
    "c05_synthesize_context",
    f"""WITH {CTX}, st AS (SELECT query_id, 0 AS s, '=== Graph Reasoning Steps ===' || chr(10) || string_agg(rank || '. ' || title, chr(10) ORDER BY rank) || chr(10) AS t FROM ctx WHERE source = 'index' GROUP BY ALL),
    pa AS (SELECT query_id, 2 AS s, '=== Discovered Paths ===' || chr(10) || string_agg('• ' || title || ' → ' || score, chr(10) ORDER BY rank) || chr(10) AS t FROM ctx WHERE is_amended GROUP BY ALL),
    nd AS (SELECT query_id, 3 AS s, '=== Related Nodes ===' || chr(10) || string_agg('• [Article] ' || title || chr(10) || '  Content: ' || content || chr(10), chr(10) ORDER BY rank) AS t FROM ctx WHERE rank <= 10 GROUP BY ALL),
    su AS (SELECT o_orderkey AS query_id, 1 AS s, '=== Relevant Community Summaries ===' || chr(10) || '• ' || o_orderpriority || chr(10) AS t FROM orders),
    u AS (SELECT * FROM st UNION ALL SELECT * FROM pa UNION ALL SELECT * FROM nd UNION ALL SELECT * FROM su) SELECT query_id, md5(string_agg(t, chr(10) ORDER BY s)) AS context_key, CAST(sum(length(t) + 1) - 1 AS BIGINT) AS n_chars FROM u GROUP BY ALL""",
)
def c05(spark, sf):
    ctx = contexts(spark, sf).withColumn("pos", F.col("rank"))
    steps = ctx.filter("source = 'index'").select("query_id", "pos", F.col("title").alias("text"))
    paths = ctx.filter("is_amended").select("query_id", "pos", F.array("title", F.col("score").cast("string")).alias("names"))
    nodes = ctx.select("query_id", "pos", F.lit("Article").alias("type"), F.col("title").alias("name"), "content")
    summaries = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.lit(1).cast("bigint").alias("pos"), F.col("o_orderpriority").alias("text"))
    return C.synthesize_context(steps, summaries, paths, nodes).select("query_id", F.md5("context").alias("context_key"), F.length("context").cast("bigint").alias("n_chars"))


@query(
    "c06_assemble_prompt_context",
    f"""WITH {CTX}, {BEST} SELECT query_id, string_agg('[' || position || '] ' || title || CASE WHEN is_amended THEN ' [UPDATED VERSION]' ELSE '' END || ' (Score: ' || printf('%.2f', score) || ')' || chr(10) || content, chr(10) ORDER BY position) AS prompt_context FROM pick GROUP BY ALL""",
)
def c06(spark, sf):
    return C.assemble_prompt_context(contexts(spark, sf))


@query("c07_detailed_sources", f"WITH {CTX} SELECT query_id, rank, title, CASE WHEN is_amended THEN 'h' || rank WHEN source = 'index' THEN content END AS citation_text FROM ctx WHERE rank <= 5")
def c07(spark, sf):
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.col("content").alias("text"), F.lit("content").alias("type")))
    ctx = contexts(spark, sf).withColumns({
        "highlighted_text": F.when(F.col("is_amended"), F.array(F.concat(F.lit("h"), F.col("rank").cast("string")))),
        "char_spans": F.when(F.col("source") == "index", spans)})
    return C.detailed_sources(ctx).select("query_id", "rank", "title", "citation_text")


_ANS = """ans AS MATERIALIZED (SELECT -conv_id * 100 - turn - 1 AS query_id, text AS answer FROM conversations
  UNION ALL SELECT o_orderkey, ['Có thể, thường thì tùy thuộc vào quy định, nói chung là vậy.', 'Ngắn', 'Chào bạn, mình hỗ trợ nhé 😊. Đầu tiên, ví dụ ', 'Theo trường: '][o_orderkey % 4 + 1] || repeat(o_orderpriority || ' ', (o_custkey % 40)::INTEGER) FROM orders)"""


def answers(spark, sf):
    opening = F.element_at(F.array(*[F.lit(x) for x in ("Có thể, thường thì tùy thuộc vào quy định, nói chung là vậy.", "Ngắn", "Chào bạn, mình hỗ trợ nhé 😊. Đầu tiên, ví dụ ", "Theo trường: ")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    made = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("query_id"), F.concat(opening, F.repeat(F.concat("o_orderpriority", F.lit(" ")), (F.col("o_custkey") % 40).cast("int"))).alias("answer"))
    return table(spark, sf, "conversations").select((-F.col("conv_id") * 100 - F.col("turn") - 1).alias("query_id"), F.col("text").alias("answer")).unionByName(made)


@query(
    "c08_answer_confidence",
    f"""WITH {CTX}, {_ANS}, a AS (SELECT query_id, count(*) AS n, avg(score) AS s FROM ctx GROUP BY ALL)
    SELECT query_id, round(least(0.95, greatest(0.1, 0.5 + coalesce(least(0.2, n * 0.05) + s * 0.3, 0) + CASE WHEN length(answer) > 100 THEN 0.1 ELSE 0 END + CASE WHEN {has('lower(answer)', C.TRUSTED_WORDS)} THEN 0.1 ELSE 0 END)), 6) AS confidence FROM ans LEFT JOIN a USING (query_id)""",
)
def c08(spark, sf):
    return C.answer_confidence(answers(spark, sf), contexts(spark, sf)).select("query_id", r6("confidence"))


@query(
    "c09_answer_type",
    f"""WITH {_ANS}, t AS (SELECT query_id, answer, query_id % 7 AS n_docs FROM ans)
    SELECT query_id, CASE WHEN {has('lower(answer)', C.ANSWER_TYPES['procedural'])} THEN 'procedural' WHEN {has('lower(answer)', C.ANSWER_TYPES['comparative'])} THEN 'comparative' ELSE 'informative' END AS answer_type,
      CASE WHEN n_docs = 0 THEN 'insufficient_data' WHEN length(answer) < 100 THEN 'partial' WHEN {has('lower(answer)', C.ASPECT_WORDS)} THEN 'complete' WHEN length(answer) < 300 THEN 'partial' ELSE 'complete' END AS completeness FROM t""",
)
def c09(spark, sf):
    a = F.col("answer")
    return answers(spark, sf).select("query_id", C.answer_type(a).alias("answer_type"), C.completeness(a, F.col("query_id") % 7).alias("completeness"))


def _sum(c, words):
    return "(" + " + ".join(f"contains({c}, '{w}')::INTEGER" for w in words) + ")"


@query(
    "c10_answer_quality",
    f"""WITH {_ANS}, t AS (SELECT query_id, answer AS a, lower(answer) AS l FROM ans),
    s AS (SELECT query_id, (length({S.strip('a')}) < 30)::INTEGER + ({_sum('l', C.VAGUE_PHRASES)} > 3)::INTEGER AS n_issues,
      CASE WHEN a = '' THEN 0 ELSE least(10, 5 + CASE WHEN length(a) > 200 THEN 2 WHEN length(a) > 100 THEN 1 ELSE 0 END + {has('l', C.ORDER_WORDS)}::INTEGER + contains(l, 'ví dụ')::INTEGER) END AS completeness_score,
      least(10, 5 + least(3, {_sum('l', C.FRIENDLY_WORDS)}) + {has('a', C.FRIENDLY_SIGNS)}::INTEGER + {has('l', C.GREETING_WORDS)}::INTEGER) AS friendliness FROM t)
    SELECT query_id, n_issues::BIGINT AS n_issues, greatest(5, 8 - n_issues)::BIGINT AS accuracy, completeness_score::BIGINT AS completeness_score, friendliness::BIGINT AS friendliness,
      round((greatest(5, 8 - n_issues) * 0.4 + completeness_score * 0.35 + friendliness * 0.25)::DOUBLE, 6) AS overall, n_issues > 1 AS needs_improvement FROM s""",
)
def c10(spark, sf):
    return C.answer_quality(answers(spark, sf)).select("query_id", big("n_issues"), big("accuracy"), big("completeness_score"), big("friendliness"), "overall", "needs_improvement")


@query(
    "c11_best_attempt",
    """WITH a AS (SELECT user_id AS request, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, least(value / 8, 10)::DOUBLE AS overall, least(value / 6, 10)::DOUBLE AS accuracy, event_type = 'error' AS bad FROM events),
    t AS (SELECT *, NOT bad AND overall >= 7 AND accuracy >= 7 AS ok FROM a WHERE attempt <= 3)
    SELECT request, coalesce(min(CASE WHEN ok THEN attempt END), arg_max(attempt, overall * 1000 - attempt)) AS attempt, bool_or(ok) AS accepted, round(max(overall), 6) AS best_overall FROM t GROUP BY ALL""",
)
def c11(spark, sf):
    ev = top_k(table(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 3, "attempt")
    a = ev.select(
        F.col("user_id").alias("request"), big("attempt"), F.least(F.col("value") / 8, F.lit(10.0)).alias("overall"),
        F.least(F.col("value") / 6, F.lit(10.0)).alias("accuracy"), (F.col("event_type") == "error").alias("needs_improvement"))
    return C.best_attempt(a).withColumn("best_overall", F.round("best_overall", 6))


@query(
    "c12_extract_answer",
    f"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || ' ' || user_id WHEN 1 THEN CASE WHEN length('Kết quả ' || event_type) < 50 THEN '{C.ANSWER_PREFIX}' ELSE '' END || 'Kết quả ' || event_type
      ELSE repeat('dòng ' || event_type || ' ', 12) || 'hết' END AS answer FROM events""",
)
def c12(spark, sf):
    k = F.col("event_id") % 3
    js = F.concat(F.lit('```json\n{"answer": "'), "event_type", F.lit(" "), F.col("user_id").cast("string"), F.lit('", "n": 1}\n```'))
    fenced = F.concat(F.lit("```text\nKết quả "), F.col("event_type"), F.lit("\n```"))
    long = F.concat(F.lit("  "), F.repeat(F.concat(F.lit("dòng "), "event_type", F.lit(" ")), F.lit(12)), F.lit("hết "))
    raw = table(spark, sf, "events").select("event_id", F.when(k == 0, js).when(k == 1, fenced).otherwise(long).alias("raw"))
    return C.extract_answer(raw).select("event_id", "answer")


@query(
    "c14_parse_reasoning",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'bước ' || event_type WHEN 1 THEN 'Tóm lại, ' || event_type ELSE '{hỏng ' || event_type END AS step, CASE WHEN event_id % 3 = 0 THEN 'thiếu ' || user_id ELSE '' END AS gaps,
    CASE WHEN event_id % 3 = 0 AND event_type <> 'view' THEN 'tìm ' || user_id END AS next_query, CASE event_id % 3 WHEN 0 THEN round(value, 2) WHEN 1 THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence, CASE event_id % 3 WHEN 0 THEN user_id % 2 = 0 WHEN 1 THEN true ELSE false END AS can_answer FROM events""",
)
def c14(spark, sf):
    k = F.col("event_id") % 3
    u = F.col("user_id").cast("string")
    js = F.concat(
        F.lit('Kết quả: {"reasoning_step": "bước '), "event_type", F.lit('", "information_gaps": ["thiếu '), u, F.lit('"], "next_search_query": '),
        F.when(F.col("event_type") == "view", "null").otherwise(F.concat(F.lit('"tìm '), u, F.lit('"'))), F.lit(', "confidence": '), F.round("value", 2).cast("string"),
        F.lit(', "can_answer_now": '), (F.col("user_id") % 2 == 0).cast("string"), F.lit("} hết"))
    raw = table(spark, sf, "events").select("event_id", F.when(k == 0, js).when(k == 1, F.concat(F.lit("Tóm lại, "), "event_type")).otherwise(F.concat(F.lit("{hỏng "), "event_type")).alias("raw"))
    return C.parse_reasoning(raw).select("event_id", "step", F.array_join("gaps", "|").alias("gaps"), "next_query", "confidence", "can_answer")
