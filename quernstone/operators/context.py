"""Context assembly and answer scoring as batch columns.

context(query_id, rank, title, content, score, ...): the rows retrieved for a query, in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import py_strip
from quernstone.operators.query_log import any_of
from quernstone.operators.ranking import number_rows, top_k

# Wording superseded by an amendment.
OLD_WORDING = ["ĐTBC ≥ 7", "ĐTBC >= 7", "học vượt chỉ dành cho sinh viên có ĐTBC"]
OLD_WORDING_LOWER = ["điểm trung bình chung ≥ 7"]

# Phrases used in scoring answers.
TRUSTED_WORDS = ["trường", "đại học", "quy định"]
ANSWER_TYPES = {
    "procedural": ["làm thế nào", "hướng dẫn", "cách", "thủ tục", "quy trình"],
    "comparative": ["so sánh", "khác nhau", "giống", "phân biệt"],
}
ASPECT_WORDS = ["đầu tiên", "thứ hai", "cuối cùng", "ngoài ra", "bên cạnh đó"]
VAGUE_PHRASES = ["tùy thuộc vào", "có thể", "thường thì", "nói chung"]
ORDER_WORDS = ["đầu tiên", "thứ hai", "cuối cùng"]
FRIENDLY_WORDS = ["bạn", "mình", "hỗ trợ", "giúp", "nhé"]
FRIENDLY_SIGNS = ["👋", "✅", "💡", "🎓", "😊"]
GREETING_WORDS = ["chào bạn", "xin chào", "hello", "hi"]
DONE_WORDS = ["đủ thông tin", "có thể trả lời", "kết luận", "tóm lại", "như vậy", "câu trả lời"]
ANSWER_PREFIX = "Dựa trên thông tin có sẵn: "


def count_of(text: Column, words: list[str]) -> Column:
    return reduce(Column.__add__, [F.contains(text, F.lit(w)).cast("int") for w in words])


def relevant_documents(context: DataFrame, k: int = 5, min_chars: int = 10) -> DataFrame:
    """The first ``k`` rows, then those with more than ``min_chars`` characters of text."""
    return context.filter(F.col("rank") <= k).withColumn("content", py_strip(F.coalesce("content", F.lit("")))).filter(F.length("content") > min_chars)


def context_quality(queries: DataFrame, context: DataFrame) -> DataFrame:
    """(query_id, average_relevance, total_length, n_docs, quality, sufficient); zeros for empty contexts."""
    agg = context.groupBy("query_id").agg(
        F.avg(F.coalesce("score", F.lit(0.0))).alias("average_relevance"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("total_length"), F.count("*").alias("n_docs"))
    out = queries.select("query_id").join(agg, "query_id", "left").fillna(0, ["average_relevance", "total_length", "n_docs"])
    quality = F.least(F.col("average_relevance") * 0.6 + F.least(F.col("total_length") / 1000, F.lit(1.0)) * 0.4, F.lit(1.0))
    return out.withColumns({"quality": quality, "sufficient": F.col("total_length") > 100})


def prefer_amended(context: DataFrame) -> DataFrame:
    """One row per article and query, the amended version if there is one; other rows stay.

    Rows with superseded wording only count when they are amended themselves. Articles keep
    the place of their first usable row and come before the rest (``position``).
    """
    title, content = F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))
    number = F.nullif(F.regexp_extract(title, r"(?iu)điều\s*(\d+)", 1), F.lit(""))
    old = any_of(content, OLD_WORDING) | any_of(F.lower(content), OLD_WORDING_LOWER)
    new = (
        F.coalesce("is_amended", F.lit(False)) | (F.contains(title, F.lit("Mục")) & F.contains(title, F.lit("Điều")))
        | (F.coalesce("source", F.lit("")) == "knowledge_graph")
    )
    marked = context.withColumns({"article_no": number, "is_new": new}).filter(number.isNull() | ~old | F.col("is_new"))
    articles = marked.filter("article_no is not null")
    place = articles.groupBy("query_id", "article_no").agg(F.min("rank").alias("_place"))
    best = top_k(articles, ["query_id", "article_no"], [F.col("is_new").desc(), F.col("rank")], 1, "_n").drop("_n")
    kept = best.join(place, ["query_id", "article_no"]).withColumn("_group", F.lit(0)).unionByName(
        marked.filter("article_no is null").withColumns({"_place": F.col("rank"), "_group": F.lit(1)})
    )
    bucket = F.struct("_group", F.floor(F.col("_place") / 1000))
    return number_rows(kept, ["query_id"], bucket, [F.col("_group"), F.col("_place")], "position").drop("_group", "_place")


def merge_graph_context(context: DataFrame, graph: DataFrame) -> DataFrame:
    """A graph row in front where it is worth it; ``graph``: (query_id, text, confidence, n_nodes)."""
    useful = graph.filter((F.length("text") > 50) & (F.col("confidence") >= 0.5) & (F.col("n_nodes") > 0))
    front = useful.select(
        "query_id", F.lit(1).cast("bigint").alias("rank"), F.lit("Graph Reasoning Context").alias("title"), F.col("text").alias("content"),
        F.lit(1.0).alias("score"), F.lit("Knowledge Graph").alias("source"),
    )
    has = useful.select("query_id", F.lit(1).alias("_shift"))
    title = F.coalesce("title", F.concat(F.lit("Document "), F.col("rank").cast("string")))
    rest = context.join(has, "query_id", "left").select(
        "query_id", (F.col("rank") + F.coalesce("_shift", F.lit(0))).cast("bigint").alias("rank"), title.alias("title"), "content",
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("source", F.lit("Unknown")).alias("source"),
    )
    return front.unionByName(rest)


def _joined(rows: DataFrame, order: list[str], text: Column, sep: str, out: str) -> DataFrame:
    """Texts of a query in order, as one text."""
    packed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*order, text.alias("_t")))).alias("_ts"))
    return packed.select("query_id", F.array_join(F.transform("_ts", lambda x: x["_t"]), sep).alias(out))


def synthesize_context(steps: DataFrame, summaries: DataFrame, paths: DataFrame, nodes: DataFrame, max_nodes: int = 10) -> DataFrame:
    """(query_id, context): steps, community summaries, paths with arrows, and up to ten nodes.

    Each input is (query_id, pos, ...): text for steps and summaries, names for paths, type,
    name and content for nodes.
    """
    bullet = F.concat(F.lit("• "), "text")
    content = F.nullif("content", F.lit(""))
    node = F.concat(F.lit("• ["), "type", F.lit("] "), "name", F.coalesce(F.concat(F.lit("\n  Content: "), content, F.lit("\n")), F.lit("")))
    lines = [
        ("=== Graph Reasoning Steps ===", 0, steps, F.concat(F.col("pos").cast("string"), F.lit(". "), "text")),
        ("=== Relevant Community Summaries ===", 1, summaries, bullet),
        ("=== Discovered Paths ===", 2, paths, F.concat(F.lit("• "), F.array_join("names", " → "))),
        ("=== Related Nodes ===", 3, nodes.filter(F.col("pos") <= max_nodes), node),
    ]
    parts = []
    for head, no, df, text in lines:
        block = _joined(df, ["pos"], text, "\n", "_b")
        end = "\n" if no < 3 else ""
        parts.append(block.select("query_id", F.lit(no).alias("pos"), F.concat(F.lit(head + "\n"), "_b", F.lit(end)).alias("t")))
    return _joined(reduce(DataFrame.unionByName, parts), ["pos"], F.col("t"), "\n", "context")


def assemble_prompt_context(context: DataFrame) -> DataFrame:
    """(query_id, prompt_context): numbered documents after superseded versions are dropped."""
    kept = prefer_amended(context)
    mark = F.when(F.coalesce("is_amended", F.lit(False)), " [UPDATED VERSION]").otherwise("")
    title = F.coalesce("title", F.concat(F.lit("Document "), F.col("position").cast("string")))
    text = F.concat(F.format_string("[%d] %s%s (Score: %.2f)\n", "position", title, mark, F.coalesce("score", F.lit(0.0))), F.coalesce("content", F.lit("")))
    return _joined(kept, ["position"], text, "\n", "prompt_context")


def short_context(context: DataFrame, k: int = 10, cut: int = 500) -> DataFrame:
    """(query_id, short_context): the first ``k`` documents, texts cut."""
    text = F.concat(F.format_string("[%d] %s:\n", "rank", F.coalesce("title", F.concat(F.lit("Tài liệu "), F.col("rank").cast("string")))), F.substring(F.coalesce("content", F.lit("")), 1, cut))
    return _joined(context.filter(F.col("rank") <= k), ["rank"], text, "\n\n", "short_context")


def detailed_sources(context: DataFrame, k: int | None = 5) -> DataFrame:
    """Sources with a citation text: the first highlight, else the first span's text."""
    rows = context if k is None else context.filter(F.col("rank") <= k)
    cited = F.coalesce(F.get("highlighted_text", F.lit(0)), F.get("char_spans", F.lit(0))["text"])
    return rows.withColumn("citation_text", cited).withColumn("title", F.coalesce("title", F.lit("Unknown")))


def answer_confidence(answers: DataFrame, context: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Adds ``confidence`` from the context's size and scores and the answer's length and wording."""
    agg = context.groupBy("query_id").agg(F.count("*").alias("_n"), F.avg(F.coalesce("score", F.lit(0.0))).alias("_avg"))
    base = (
        F.lit(0.5) + F.coalesce(F.least(F.lit(0.2), F.col("_n") * 0.05) + F.col("_avg") * 0.3, F.lit(0.0))
        + F.when(F.length("answer") > 100, 0.1).otherwise(0.0) + F.when(any_of(F.lower("answer"), words or TRUSTED_WORDS), 0.1).otherwise(0.0)
    )
    return answers.join(agg, "query_id", "left").withColumn("confidence", F.least(F.lit(0.95), F.greatest(F.lit(0.1), base))).drop("_n", "_avg")


def answer_type(query: Column) -> Column:
    t = F.lower(query)
    return F.coalesce(*[F.when(any_of(t, ws), F.lit(k)) for k, ws in ANSWER_TYPES.items()], F.lit("informative"))


def completeness(answer: Column, n_docs: Column, min_length: int = 50) -> Column:
    n = F.length(answer)
    return (
        F.when(F.coalesce(n_docs, F.lit(0)) == 0, "insufficient_data").when(n < 2 * min_length, "partial")
        .when(any_of(F.lower(answer), ASPECT_WORDS), "complete").when(n < 6 * min_length, "partial").otherwise("complete")
    )


def answer_quality(answers: DataFrame) -> DataFrame:
    """Adds n_issues, accuracy, completeness_score, friendliness, overall and needs_improvement."""
    a = F.coalesce("answer", F.lit(""))
    t = F.lower(a)
    issues = (F.length(py_strip(a)) < 30).cast("int") + (count_of(t, VAGUE_PHRASES) > 3).cast("int")
    complete = F.when(a == "", 0).otherwise(F.least(F.lit(10), (
        F.lit(5) + F.when(F.length(a) > 200, 2).when(F.length(a) > 100, 1).otherwise(0) + any_of(t, ORDER_WORDS).cast("int") + F.contains(t, F.lit("ví dụ")).cast("int"))))
    friendly = F.least(F.lit(10), (
        F.lit(5) + F.least(F.lit(3), count_of(t, FRIENDLY_WORDS)) + any_of(a, FRIENDLY_SIGNS).cast("int") + any_of(t, GREETING_WORDS).cast("int")))
    out = answers.withColumns({"n_issues": issues, "completeness_score": complete, "friendliness": friendly})
    out = out.withColumn("accuracy", F.greatest(F.lit(5), F.lit(8) - F.col("n_issues")))
    return out.withColumns({
        "overall": F.round(F.col("accuracy") * 0.4 + F.col("completeness_score") * 0.35 + F.col("friendliness") * 0.25, 6),
        "needs_improvement": F.col("n_issues") > 1,
    })


def best_attempt(attempts: DataFrame, threshold: float = 7.0, max_attempts: int = 3) -> DataFrame:
    """(request, attempt, accepted): the first good enough attempt, else the best of the first ``max_attempts``.

    ``attempts``: (request, attempt, overall, accuracy, needs_improvement).
    """
    tried = attempts.filter(F.col("attempt") <= max_attempts)
    ok = ~F.col("needs_improvement") & (F.col("accuracy") >= threshold) & (F.col("overall") >= threshold)
    return tried.groupBy("request").agg(
        F.min(F.when(ok, F.col("attempt"))).alias("_ok"), F.max_by("attempt", F.struct("overall", -F.col("attempt"))).alias("_best"), F.max("overall").alias("best_overall"),
    ).select("request", F.coalesce("_ok", "_best").alias("attempt"), F.col("_ok").isNotNull().alias("accepted"), "best_overall")


def extract_answer(raw: DataFrame, col: str = "raw", min_length: int = 50, out: str = "answer") -> DataFrame:
    """Adds the answer: the JSON's answer field, else the text without fences; short ones get a lead-in."""
    r = F.col(col)
    found = F.coalesce(
        F.nullif(F.regexp_extract(r, r"(?s)```json\s*(\{.*?\})\s*```", 1), F.lit("")), F.nullif(F.regexp_extract(r, r"(?s)(\{.*?\})", 1), F.lit(""))
    )
    plain = F.regexp_replace(F.regexp_replace(py_strip(r), r"^```[a-zA-Z]*\s*\n", ""), r"\n\s*```\s*$", "")
    field = F.get_json_object(found, "$.answer")
    lead = F.when(F.length(plain) < min_length, F.concat(F.lit(ANSWER_PREFIX), plain)).otherwise(plain)
    return raw.withColumn(out, F.coalesce(field, lead))


def parse_reasoning(raw: DataFrame, col: str = "raw") -> DataFrame:
    """Adds step, gaps, next_query, confidence and can_answer from a JSON step, else from plain text."""
    r = F.col(col)
    schema = "reasoning_step string, information_gaps array<string>, next_search_query string, confidence double, can_answer_now boolean"
    staged = raw.withColumn("_body", F.nullif(F.regexp_extract(r, r"(?s)(\{.*\})", 1), F.lit("")))
    staged = staged.withColumn("_ok", F.coalesce(F.try_parse_json("_body").isNotNull(), F.lit(False))).withColumn("_j", F.when(F.col("_ok"), F.from_json("_body", schema)))
    done = any_of(F.lower(r), DONE_WORDS)
    j = lambda f, default: F.coalesce(F.col(f"_j.{f}"), default)
    none = F.expr("cast(array() as array<string>)")
    return staged.withColumns({
        "step": F.when(F.col("_ok"), j("reasoning_step", F.lit(""))).otherwise(F.substring(r, 1, 500)),
        "gaps": F.when(F.col("_ok"), j("information_gaps", none)).otherwise(none),
        "next_query": F.col("_j.next_search_query"),
        "confidence": F.when(F.col("_ok"), j("confidence", F.lit(0.5))).otherwise(F.when(done, 0.75).otherwise(0.5)),
        "can_answer": F.when(F.col("_ok"), j("can_answer_now", F.lit(False))).otherwise(done),
    }).drop("_body", "_ok", "_j")
