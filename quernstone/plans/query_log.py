"""Registered queries over a query log: orders give templated questions, conversations free text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import graph_query as G
from quernstone.operators import keyword as K
from quernstone.operators import lookup as P
from quernstone.operators import query_log as Q
from quernstone.operators.ranking import top_k
from quernstone.plans import sql_parts as S
from quernstone.plans.bindings import spread, table
from quernstone.plans.graph import AMENDS, COMM, NET, TREE, amended_articles, communities, courses, tree
from quernstone.plans.registry import query

big = lambda c: F.col(c).cast("bigint").alias(c)
SUFFIX = " tại trường"
OWN = {"abc": "đại học mẫu"}

# {k} is the order's number, {c} its customer; both are spliced in as digits.
TEMPLATES = [
    "Xin chào bạn {c}",
    "So sánh chương trình CNTT và KHMT năm 20{d}?",
    "Môn IT{e} cần học môn gì trước?",
    "Điều {f} và điều {d} quy định gì về học phí?",
    "Nếu tôi rớt SE{e} thì tôi sẽ bị trễ những môn đồ án nào?",
    "Tóm tắt các quy định về học vụ khóa 20{d}",
    "Cách đkhp cho sv niên khóa 20{d}-2030 như thế nào? Có cần hồ sơ gì không?",
    "ok",
    "Môn học thuộc khoa khmt của ngành, gồm IT{e} SE{e} và cấu trúc dữ liệu",
    "Chuỗi môn học từ cơ sở đến chuyên ngành AI của ABC",
    "Bạn là ai? Tôi là {k}",
    "Quy chế đào tạo liên quan đến sinh viên {c}: phân tích, đánh giá các bước xét tốt nghiệp và khen thưởng trong năm cuối",
    "hello world {k}, tiên quyết là gì?",
    "môn Giải Tích Hai, mức học bổng. Tiền?",
]


def _sql_template(t: str) -> str:
    parts = {"{k}": "o_orderkey", "{c}": "o_custkey", "{d}": "(10 + o_orderkey % 90)", "{e}": "(100 + o_custkey % 900)", "{f}": "(o_custkey % 40)"}
    out = "'" + t + "'"
    for k, v in parts.items():
        out = out.replace(k, f"' || {v} || '")
    return out


ASKED = "asked AS MATERIALIZED (SELECT o_orderkey AS query_id, CASE o_orderkey % 14 " + " ".join(
    f"WHEN {i} THEN {_sql_template(t)}" for i, t in enumerate(TEMPLATES)
) + " END AS text FROM orders UNION ALL SELECT -(conv_id * 100 + turn) - 1, text FROM conversations)"


def asked(spark, sf):
    o = spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", rows=100_000)
    parts = {"{k}": "o_orderkey", "{c}": "o_custkey", "{d}": "10 + o_orderkey % 90", "{e}": "100 + o_custkey % 900", "{f}": "o_custkey % 40"}

    def made(t: str):
        out = F.lit(t)
        for k, e in parts.items():
            if k in t:
                out = F.replace(out, F.lit(k), F.expr(f"cast({e} as string)"))
        return out

    text = F.when(F.col("o_orderkey") % 14 == 0, made(TEMPLATES[0]))
    for i, t in enumerate(TEMPLATES[1:], 1):
        text = text.when(F.col("o_orderkey") % 14 == i, made(t))
    talk = table(spark, sf, "conversations").select((-(F.col("conv_id") * 100 + F.col("turn")) - 1).alias("query_id"), "text")
    return o.select(F.col("o_orderkey").alias("query_id"), text.alias("text")).unionByName(talk)


def has(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {S.lit(w)})" for w in words) + ")"


def first(c: str, tab, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(c, ws)} THEN '{k}'" for k, ws in tab.items()) + f" ELSE '{default}' END"


def found(c: str, tab) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {has(c, ws)} THEN '{k}' END" for k, ws in tab.items()) + "], lambda x: x IS NOT NULL)"


def starts(c: str, words, seps=(" ",)) -> str:
    return "(" + " OR ".join([f"{c} = {S.lit(w)}" for w in words] + [f"starts_with({c}, {S.lit(w + s)})" for w in words for s in seps]) + ")"


T = "lower(text)"
ST = S.strip(T)


@query(
    "q01_classify_social",
    f"""WITH {ASKED}, t AS (SELECT query_id, {ST} AS t FROM asked) SELECT query_id, CASE WHEN {has('t', Q.IDENTITY)} THEN 'identity' WHEN {starts('t', Q.SOCIAL)} THEN 'social' END AS kind,
    CASE WHEN {has('t', Q.IDENTITY[:-1])} THEN 'identity' WHEN {starts('t', Q.GREETING, (' ', ','))} THEN 'greeting' WHEN {has('t', Q.THANKS)} THEN 'thanks' WHEN {has('t', Q.GOODBYE)} THEN 'goodbye' WHEN t IN {S.in_list(Q.ACKNOWLEDGE)} THEN 'acknowledge' END AS reply FROM t""",
)
def q01(spark, sf):
    return asked(spark, sf).select("query_id", Q.classify_social(F.col("text")).alias("kind"), Q.direct_response(F.col("text")).alias("reply"))


SCORE = f"""(CASE WHEN {has(T, Q.SIMPLE_WORDS)} THEN 1.0::DOUBLE ELSE greatest(0, least(10, 5.0 + CASE WHEN length(text) < 20 THEN -2 WHEN length(text) < 40 THEN -1 ELSE 0 END + CASE WHEN {has(T, Q.COMPLEX_WORDS)} THEN 2.5 ELSE 0 END
  + CASE WHEN length(text) - length(replace(text, '?', '')) > 1 THEN 1 ELSE 0 END + CASE WHEN length(text) > 100 THEN 1.5 WHEN length(text) > 60 THEN 0.5 ELSE 0 END))::DOUBLE END)"""
LABEL = "CASE WHEN score <= 3.5 THEN 'simple' WHEN score >= 6.5 THEN 'complex' ELSE 'medium' END"


@query("q02_complexity_score", f"WITH {ASKED}, s AS (SELECT query_id, {SCORE} AS score FROM asked) SELECT *, {LABEL} AS complexity FROM s")
def q02(spark, sf):
    s = asked(spark, sf).select("query_id", Q.complexity_score(F.col("text")).alias("score"))
    return s.withColumn("complexity", Q.complexity_label(F.col("score")))


@query("q03_detect_intent", f"WITH {ASKED} SELECT query_id, {first(T, Q.INTENTS, 'informational')} AS intent, {first(T, Q.TOPIC_INTENTS, 'general_inquiry')} AS topic FROM asked")
def q03(spark, sf):
    return asked(spark, sf).select("query_id", Q.detect_intent(F.col("text")).alias("intent"), Q.topic_intent(F.col("text")).alias("topic"))


N_ARTICLES = f"len(list_distinct(regexp_extract_all({T}, 'điều\\s+(\\d+)', 1)))"
NEEDS = f"({has(T, Q.RELATION_WORDS)} OR {N_ARTICLES} >= 1 OR {has(T, Q.STRUCTURE_WORDS)} OR {has(T, Q.RULE_QUESTIONS)})"


@query("q04_needs_graph", f"WITH {ASKED} SELECT query_id, {NEEDS} AS needs_graph, {N_ARTICLES} AS n_articles FROM asked")
def q04(spark, sf):
    return asked(spark, sf).select("query_id", Q.needs_graph(F.col("text")).alias("needs_graph"), Q.article_count(F.col("text")).cast("bigint").alias("n_articles"))


KIND = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"regexp_matches({T}, {S.lit(p)})" for p in ps) + f" THEN '{kind}'" for kind, ps in Q.GRAPH_PATTERNS) + " ELSE 'local' END"


@query("q05_graph_query_type", f"WITH {ASKED} SELECT query_id, {KIND} AS graph_query_type FROM asked")
def q05(spark, sf):
    return asked(spark, sf).select("query_id", Q.graph_query_type(F.col("text")).alias("graph_query_type"))


_W = "list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"
_COMMA = _W.format(c=f"translate({T}, ',.', '  ')")
KW1 = f"list_slice(list_filter(list_transform({_COMMA}, lambda w: regexp_replace(w, '^[?!.,;:]+|[?!.,;:]+$', '', 'g')), lambda w: length(w) > 2 AND w NOT IN {S.in_list(Q.KEYWORD_STOPS)}), 1, 10)"
KW3 = f"list_slice(list_filter({_COMMA}, lambda w: length(w) > 2 AND w NOT IN {S.in_list(Q.SHORT_STOPS)}), 1, 5)"
_SINGLE = f"list_filter({_W.format(c=T)}, lambda w: length(w) > 2 AND w NOT IN {S.in_list(Q.COMPOUND_STOPS)})"
_FOUND = "list_filter([" + ", ".join(f"CASE WHEN contains({T}, {S.lit(c)}) THEN {S.lit(c)} END" for c in Q.COMPOUNDS) + "], lambda x: x IS NOT NULL)"
_LET = "a-zđàáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"
COMPOUND = f"""kc0 AS (SELECT query_id, {_SINGLE} AS single, {_FOUND} AS found, list_transform(regexp_extract_all(text, '(?i)môn\\s+([{_LET}][{_LET}\\s]+)', 1), lambda x: {S.strip('x')}) AS names FROM asked),
kc AS (SELECT query_id, CASE WHEN len(found) > 0 THEN list_concat(found, list_slice(list_filter(single, lambda w: NOT list_bool_or(list_transform(found, lambda c: contains(c, w)))), 1, 5)) ELSE list_concat(single, names) END AS kws FROM kc0),
ku AS (SELECT query_id, unnest(kws) AS k, generate_subscripts(kws, 1) AS i FROM kc), kd AS (SELECT query_id, k, min(i) AS i FROM ku GROUP BY ALL),
compound AS MATERIALIZED (SELECT query_id, k, row_number() OVER (PARTITION BY query_id ORDER BY i) AS n FROM kd QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i) <= 15)"""


@query(
    "q06_keywords",
    f"""WITH {ASKED}, {COMPOUND}, c AS (SELECT query_id, string_agg(k, '|' ORDER BY n) AS compound FROM compound GROUP BY ALL)
    SELECT a.query_id, array_to_string({KW1}, '|') AS keywords, array_to_string({KW3}, '|') AS short, coalesce(compound, '') AS compound FROM asked a LEFT JOIN c USING (query_id)""",
)
def q06(spark, sf):
    t = F.col("text")
    return asked(spark, sf).select(
        "query_id", F.array_join(Q.keywords(t), "|").alias("keywords"), F.array_join(Q.short_keywords(t), "|").alias("short"),
        F.array_join(Q.compound_keywords(t), "|").alias("compound"))


_UP = f"regexp_extract_all(upper(text), '{S.T.TOKEN}')"
_YEARS = "list_concat(" + ", ".join([f"list_concat(regexp_extract_all({T}, '{Q.YEAR_PATTERNS[0]}', 1), regexp_extract_all({T}, '{Q.YEAR_PATTERNS[1]}', 1))",
                                     f"list_concat(list_concat(regexp_extract_all({T}, '{Q.YEAR_PATTERNS[2]}', 1), regexp_extract_all({T}, '{Q.YEAR_PATTERNS[3]}', 1)), list_filter({_UP}, lambda w: regexp_full_match(w, '20\\d{{2}}')))"]) + ")"
FILTERS = f"""{found(T, Q.DOC_TYPES)} AS doc_types, {found(T, Q.FACULTIES)} AS faculties,
  list_sort(list_distinct(list_filter(list_transform({_YEARS}, lambda y: y::INTEGER), lambda y: y BETWEEN 2000 AND 2100))) AS years,
  list_sort(list_distinct(list_concat(list_filter({_UP}, lambda w: regexp_full_match(w, '[A-Z]{{2,4}}\\d{{3}}')), {found(T, Q.SUBJECT_NAMES)}))) AS subjects"""


@query(
    "q07_extract_filters",
    f"""WITH {ASKED}, f AS (SELECT query_id, {FILTERS} FROM asked) SELECT query_id, array_to_string(doc_types, '|') AS doc_types, array_to_string(faculties, '|') AS faculties, array_to_string(years, '|') AS years, array_to_string(subjects, '|') AS subjects FROM f""",
)
def q07(spark, sf):
    f = asked(spark, sf).select("query_id", Q.extract_filters(F.col("text"), True).alias("f")).select("query_id", "f.*")
    return f.select(
        "query_id", F.array_join("doc_types", "|").alias("doc_types"), F.array_join("faculties", "|").alias("faculties"),
        F.array_join(F.transform(F.array_sort("years"), lambda y: y.cast("string")), "|").alias("years"), F.array_join(F.array_sort("subjects"), "|").alias("subjects"))


def _rewrite_sql() -> str:
    full = T
    for a, b in {**Q.ABBREVIATIONS, **OWN}.items():
        # Twice, because the letter after one hit may be the letter before the next.
        for _ in range(2):
            full = f"regexp_replace({full}, '(^|[^\\p{{L}}\\p{{N}}_]){a}($|[^\\p{{L}}\\p{{N}}_])', '\\1{b}\\2', 'g')"
    return full


@query(
    "q08_rewrite_queries",
    f"""WITH {ASKED}, r AS (SELECT query_id, text, {_rewrite_sql()} AS full_text FROM asked)
    SELECT query_id, concat_ws('|', CASE WHEN full_text = text AND full_text <> lower(text) THEN NULL ELSE text END, CASE WHEN full_text <> lower(text) THEN full_text END, CASE WHEN NOT {has(T, [x for kv in OWN.items() for x in kv])} THEN text || '{SUFFIX}' END) AS rewrites FROM r""",
)
def q08(spark, sf):
    return asked(spark, sf).select("query_id", F.array_join(Q.rewrite_queries(F.col("text"), SUFFIX, OWN), "|").alias("rewrites"))


@query(
    "q09_plan",
    f"""WITH {ASKED}, s AS (SELECT *, {SCORE} AS score, {first(T, Q.INTENTS, 'informational')} AS intent, {NEEDS} AS relational, {KIND} AS kind FROM asked), c AS (SELECT *, {LABEL} AS complexity FROM s),
    g AS (SELECT *, complexity <> 'simple' AND (complexity = 'complex' OR relational OR intent = 'comparative') AS graph FROM c)
    SELECT query_id, intent, complexity, score, complexity <> 'simple' AS requires_rag, CASE complexity WHEN 'simple' THEN 'direct_response' WHEN 'complex' THEN 'advanced_rag' ELSE 'standard_rag' END AS strategy,
      CASE WHEN complexity = 'simple' THEN 0 WHEN complexity = 'complex' AND score > 7 THEN 10 WHEN complexity = 'complex' THEN 8 ELSE 5 END::BIGINT AS top_k, complexity = 'complex' AS hybrid_search, complexity = 'complex' AND score > 7 AS reranking,
      graph AS use_knowledge_graph, CASE WHEN graph THEN kind ELSE 'local' END AS graph_query_type FROM g""",
)
def q09(spark, sf):
    return Q.plan(asked(spark, sf), SUFFIX, OWN).select(
        "query_id", "intent", "complexity", "score", "requires_rag", "strategy", big("top_k"), "hybrid_search", "reranking", "use_knowledge_graph", "graph_query_type")


CODES = f"list_filter({_UP}, lambda w: regexp_full_match(w, '[A-Z]{{2}}\\d{{3}}'))"
CODE = f"coalesce(({CODES})[1], CASE " + " ".join(f"WHEN contains({T}, '{k}') THEN '{v}'" for k, v in Q.DEPARTMENTS.items()) + " END)"
ARTICLE = f"coalesce(nullif(regexp_extract({T}, 'điều\\s*(\\d+)', 1), ''), nullif(regexp_extract({T}, 'điều\\s*số\\s*(\\d+)', 1), ''), nullif(regexp_extract({T}, 'article\\s*(\\d+)', 1), ''))::BIGINT"
PATTERN = f"CASE WHEN regexp_matches({T}, 'điều\\s*\\d+|điều\\s*số\\s*\\d+|article\\s*\\d+') THEN 'article' WHEN {has(T, Q.ENTITY_WORDS)} THEN 'entity_related' ELSE {first(T, Q.QUESTION_PATTERNS, 'general')} END"
CONCEPTS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({T}, '{p}') THEN '{c}' END" for p, c in Q.CONCEPTS) + "], lambda x: x IS NOT NULL)"


@query("q10_extract_code", f"WITH {ASKED} SELECT query_id, {CODE} AS code, {ARTICLE} AS article_no, {PATTERN} AS pattern, array_to_string({CONCEPTS}, '|') AS concepts FROM asked")
def q10(spark, sf):
    t = F.col("text")
    return asked(spark, sf).select(
        "query_id", Q.extract_code(t).alias("code"), Q.asked_article(t).alias("article_no"), Q.question_pattern(t).alias("pattern"), F.array_join(Q.target_concepts(t), "|").alias("concepts"))


@query(
    "q11_complexity_v2",
    f"""WITH {ASKED}, c AS (SELECT query_id, text, (length(text) - length(replace(text, '?', ''))) + (length(text) - length(replace(text, 'là gì', ''))) // 5 + (length(text) - length(replace(text, 'như thế nào', ''))) // 11 AS n, len({_W.format(c='text')}) AS words FROM asked)
    SELECT query_id, CASE WHEN n > 2 OR {has(T, Q.CONNECTIVES)} OR words > 20 THEN 'complex' WHEN n > 1 OR words > 10 THEN 'medium' ELSE 'simple' END AS complexity, CAST(100 + 50 * words AS BIGINT) AS tokens FROM c""",
)
def q11(spark, sf):
    t = F.col("text")
    return asked(spark, sf).select("query_id", Q.complexity_v2(t).alias("complexity"), Q.estimate_tokens(F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))).cast("bigint").alias("tokens"))


@query(
    "q12_query_log_stats",
    """SELECT md5(event_type || '|' || (user_id % 10)) AS key, count(*) AS executions, round(sum(value), 4) AS total_time, round(avg(value), 6) AS avg_time, count(*) FILTER (event_id % 2 = 0) AS hits, count(*) FILTER (event_id % 2 = 1) AS misses,
    round(count(*) FILTER (event_id % 2 = 0) / count(*), 6) AS hit_rate FROM events GROUP BY ALL""",
)
def q12(spark, sf):
    key = Q.log_key(F.concat(F.lit("  "), "event_type", F.lit(" ")), (F.col("user_id") % 10).cast("string"))
    log = table(spark, sf, "events").select(key.alias("key"), F.col("value").alias("seconds"), (F.col("event_id") % 2 == 0).alias("hit"), "ts")
    per, _ = Q.query_log_stats(log)
    return per.select("key", "executions", F.round("total_time", 4).alias("total_time"), F.round("avg_time", 6).alias("avg_time"), "hits", "misses", F.round("hit_rate", 6).alias("hit_rate"))


@query(
    "q13_usage_stats",
    """SELECT event_type AS model, count(*) AS calls, CAST(sum(floor(value * 100)) AS BIGINT) AS input_tokens, CAST(sum(user_id) AS BIGINT) AS output_tokens, CAST(sum(floor(value * 100)) + sum(user_id) AS BIGINT) AS total_tokens,
    round(sum(floor(value * 100)) / 1000 * CASE event_type WHEN 'click' THEN 0.03 WHEN 'view' THEN 0.01 ELSE 0.002 END + sum(user_id) / 1000 * CASE event_type WHEN 'click' THEN 0.06 WHEN 'view' THEN 0.02 ELSE 0.004 END, 6) AS cost FROM events GROUP BY event_type""",
)
def q13(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_type").alias("model"), F.floor(F.col("value") * 100).alias("input_tokens"), F.col("user_id").alias("output_tokens"))
    return Q.usage_stats(log, {"click": (0.03, 0.06), "view": (0.01, 0.02)}, (0.002, 0.004)).withColumn("cost", F.round("cost", 6))


@query(
    "q14_parse_tool_actions",
    """SELECT event_id, 'Xem xét ' || event_type AS thought, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'search_' || event_type || '("' || event_type || ', ' || user_id || '", ' || event_id || ')' END AS action,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'search_' || event_type END AS tool, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type || ', ' || user_id || '|' || event_id END AS args FROM events""",
)
def q14(spark, sf):
    s = lambda c: F.col(c).cast("string")
    call = F.concat(F.lit("\nAction: search_"), "event_type", F.lit('("'), "event_type", F.lit(", "), s("user_id"), F.lit('", '), s("event_id"), F.lit(")\nObservation: none"))
    raw = F.concat(F.lit("Thought: Xem xét "), F.col("event_type"), F.when(F.col("event_id") % 3 == 0, "").otherwise(call))
    out = Q.parse_tool_actions(table(spark, sf, "events").select("event_id", raw.alias("raw")))
    return out.select("event_id", "thought", "action", "tool", F.coalesce(F.array_join("args", "|"), F.lit("")).alias("args"))


_ROUTE = "CASE " + " ".join(f"WHEN {has(T, ws)} THEN '{r}'" for ws, r in Q.ROUTES.values()) + " ELSE 'vector_search' END"


@query(
    "q15_route_flags",
    f"""WITH {ASKED}, r AS (SELECT query_id, {first(T, {k: v[0] for k, v in Q.ROUTES.items()}, 'general')} AS intent, {_ROUTE} AS route FROM asked)
    SELECT *, route IN ('graph_traversal', 'multi_hop_graph', 'hybrid_search') AS use_graph, route IN ('vector_search', 'hybrid_search') AS use_vector FROM r""",
)
def q15(spark, sf):
    return asked(spark, sf).select("query_id", Q.route_flags(F.col("text")).alias("r")).select("query_id", "r.*")


# -- graph lookups routed by question ----------------------------------------

_LABELED = """nodes AS (SELECT p_partkey::VARCHAR AS doc_id, p_partkey::VARCHAR AS chunk_id, concat_ws(' ', p_name, p_type, p_brand) AS text FROM part)"""


@query(
    "p23_aggregate_by_terms",
    f"""WITH b AS (SELECT p_size AS query_id, unnest(string_split(p_name, ' ')) AS w FROM part), {_LABELED},
    k AS (SELECT query_id, w, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, w) AS n FROM b GROUP BY query_id, w),
    queries AS (SELECT query_id, string_agg(w, ' ' ORDER BY n) AS text FROM k WHERE n <= 5 GROUP BY query_id), chunks AS (SELECT * FROM nodes),
    {S.positions('chunks', 'doc_id, chunk_id', ('text',))}, {S.QUERY_FORMS},
    sc AS (SELECT query_id, chunk_id AS id, round(sum(weight * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 9) AS score FROM q_terms JOIN postings USING (term) JOIN term_stats USING (term) JOIN totals ON true GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""",
)
def p23(spark, sf):
    p = table(spark, sf, "part")
    # The five most frequent words of a size are its keywords; nothing else of a size is gathered.
    often = p.select(big("p_size").alias("query_id"), F.explode(F.split("p_name", " ")).alias("k")).groupBy("query_id", "k").agg(F.count("*").alias("n"))
    kw = top_k(often, ["query_id"], [F.col("n").desc(), F.col("k")], 5).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "k"))), lambda x: x["k"]).alias("keywords"))
    nodes = p.select(F.col("p_partkey").cast("string").alias("id"), F.lit("part").alias("label"), "p_name", "p_type", "p_brand")
    return G.aggregate_by_terms(kw, nodes, ["p_name", "p_type", "p_brand"]).select("query_id", "id", big("rank"), F.round("score", 6).alias("score"))


def lookup_tables(spark, sf):
    """Graph tables the routed lookups read: articles of order lines, parts as courses, customers in nations."""
    la, _ = amended_articles(spark, sf)
    c = table(spark, sf, "customer")
    p = table(spark, sf, "part")
    code = F.concat(F.element_at(F.array(F.lit("IT"), F.lit("SE")), (F.col("p_partkey") % 2 + 1).cast("int")), F.lpad((F.col("p_partkey") % 900 + 100).cast("string"), 3, "0"))
    course = p.select(code.alias("code"), "p_partkey").groupBy("code").agg(F.min("p_partkey").alias("k"))
    return la, c, p, course


# All six routes: every question has its row. The programmes are a customer's faculty and segment, the entities parts named by
# their course code, mentioned by their order lines; the general route's courses are the customers, by name.
P24 = (
    f"""WITH {ASKED}, {AMENDS}, {COMPOUND}, r AS (SELECT query_id, {CODE} AS code, {ARTICLE} AS no, {PATTERN} AS pattern FROM asked),
    b AS MATERIALIZED (SELECT query_id, code, no, CASE WHEN code IS NOT NULL THEN pattern ELSE 'general' END AS branch FROM r),
    cs AS (SELECT ['IT','SE'][p_partkey % 2 + 1] || (p_partkey % 900 + 100) AS code, min(p_partkey) AS k FROM part GROUP BY ALL),
    pre AS (SELECT a.code AS src, b.code AS dst FROM cs a JOIN cs b ON b.k = a.k // 2 WHERE a.code <> b.code),
    hop AS (SELECT src AS code, dst FROM pre UNION ALL SELECT x.src, y.dst FROM pre x JOIN pre y ON y.src = x.dst
      UNION ALL SELECT x.src, z.dst FROM pre x JOIN pre y ON y.src = x.dst JOIN pre z ON z.src = y.dst),
    fac AS (SELECT c_custkey, ['CNTT','KHMT','HTTT','MMT'][c_nationkey % 4 + 1] AS code, c_mktsegment FROM customer),
    codes AS (SELECT DISTINCT branch, code FROM b),
    ent AS (SELECT p_partkey AS entity_id, ['IT','SE'][p_partkey % 2 + 1] || (p_partkey % 900 + 100) || ' ' || p_name AS name, p_type AS description FROM part),
    fst AS (SELECT code, arg_min(entity_id, {{'n': name, 'e': entity_id}}) AS entity_id FROM codes JOIN ent ON contains(lower(name), lower(code)) WHERE branch = 'entity_related' GROUP BY ALL),
    kw AS (SELECT DISTINCT query_id, lower(k) AS kw FROM compound JOIN b USING (query_id) WHERE branch = 'general' AND k <> ''), ks AS (SELECT DISTINCT kw FROM kw),
    words AS (SELECT query_id, string_agg(kw, chr(10) ORDER BY kw) AS kws FROM kw GROUP BY ALL), sets AS (SELECT DISTINCT kws, unnest(string_split(kws, chr(10))) AS kw FROM words),
    queries AS (SELECT a.query_id, a.text FROM asked a JOIN b USING (query_id) WHERE branch = 'general'), {S.QUERY_FORMS},
    chunks AS (SELECT c_custkey::VARCHAR AS code, c_name AS name FROM customer), {S.positions('chunks', 'code', ('name',))},
    ct AS (SELECT term, code FROM (SELECT DISTINCT term, code FROM forms) QUALIFY row_number() OVER (PARTITION BY term ORDER BY code) <= 10),
    cn AS (SELECT query_id, least(10, count(DISTINCT code)) AS n FROM q_terms JOIN ct USING (term) GROUP BY ALL),
    ah AS (SELECT kw, id FROM ks JOIN la ON contains(lower(title), kw) OR contains(lower(full_text), kw)),
    eh AS (SELECT kw, entity_id FROM ks JOIN ent ON contains(lower(name), kw) OR contains(lower(description), kw)),
    an AS (SELECT kws, least(5, count(DISTINCT id)) AS n FROM sets JOIN ah USING (kw) GROUP BY ALL),
    en AS (SELECT kws, least(5, count(DISTINCT entity_id)) AS n FROM sets JOIN eh USING (kw) GROUP BY ALL),
    n AS (SELECT query_id, count(*) AS n FROM b JOIN hop USING (code) WHERE branch = 'prerequisite' GROUP BY ALL
      UNION ALL SELECT query_id, least(20, count(*)) FROM b JOIN fac USING (code) WHERE branch = 'department' GROUP BY ALL
      UNION ALL SELECT query_id, least(30, m) FROM b JOIN (SELECT c.code, count(*) AS m FROM codes c JOIN fac f ON contains(f.code || '_' || f.c_mktsegment, c.code) WHERE branch = 'program' GROUP BY ALL) USING (code) WHERE branch = 'program'
      UNION ALL SELECT query_id, m FROM b JOIN (SELECT regexp_extract(title, 'Điều (\\d+)', 1)::BIGINT AS no, count(*) AS m FROM la GROUP BY ALL) USING (no) WHERE branch = 'article'
      UNION ALL SELECT query_id, m FROM b JOIN (SELECT code, least(5, count(DISTINCT l_orderkey)) AS m FROM fst JOIN lineitem ON l_partkey = entity_id GROUP BY ALL) USING (code) WHERE branch = 'entity_related'
      UNION ALL SELECT b.query_id, coalesce(an.n, 0) + coalesce(en.n, 0) + coalesce(cn.n, 0) FROM b LEFT JOIN words USING (query_id) LEFT JOIN an USING (kws) LEFT JOIN en USING (kws) LEFT JOIN cn ON cn.query_id = b.query_id WHERE branch = 'general'),
    a AS (SELECT query_id, branch, coalesce(n, 0) AS n_nodes FROM b LEFT JOIN n USING (query_id))
    SELECT query_id, branch, n_nodes, CASE branch {" ".join(f"WHEN '{k}' THEN CASE WHEN n_nodes > 0 THEN {yes} ELSE {no} END" for k, (yes, no) in P.CONFIDENCE.items())} END::DOUBLE AS confidence FROM a"""
)


@query("p24_local_graph_lookup", P24)
def p24(spark, sf):
    la, c, p, course = lookup_tables(spark, sf)
    up = course.select(F.expr("k div 2").alias("pk"), F.col("code").alias("src")).join(course.select(F.col("k").alias("pk"), F.col("code").alias("dst")), "pk").filter("src <> dst")
    fac = F.element_at(F.array(*[F.lit(x) for x in ("CNTT", "KHMT", "HTTT", "MMT")]), (F.col("c_nationkey") % 4 + 1).cast("int"))
    key = F.col("c_custkey").cast("string")
    code = F.concat(F.element_at(F.array(F.lit("IT"), F.lit("SE")), (F.col("p_partkey") % 2 + 1).cast("int")), (F.col("p_partkey") % 900 + 100).cast("string"))
    found = P.local_graph_lookup(
        asked(spark, sf), prerequisites=up.select("src", "dst", F.lit("PREREQUISITE").alias("type")), departments=c.select(key.alias("src"), fac.alias("dst")),
        programs=c.select(key.alias("src"), F.concat(fac, F.lit("_"), "c_mktsegment").alias("dst"), F.col("c_nationkey").alias("semester")),
        courses=c.select(key.alias("code"), F.col("c_name").alias("name")), articles=la,
        entities=p.select(F.col("p_partkey").alias("entity_id"), F.concat(code, F.lit(" "), "p_name").alias("name"), F.col("p_brand").alias("type"), F.col("p_type").alias("description")),
        mentions=table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("article_id")),
    )
    return found.select("query_id", "branch", big("n_nodes"), "confidence")


@query(
    "p25_global_graph_lookup",
    f"""WITH {COMM}, big AS (SELECT * FROM comm),
    docs AS (SELECT doc_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS ws FROM documents),
    w AS (SELECT community_id, size, unnest(list_distinct(list_filter(regexp_split_to_array(lower(full_summary), '\\s+'), lambda x: x <> ''))) AS word, 2 AS points FROM big
      UNION ALL SELECT community_id, size, unnest(list_distinct(regexp_split_to_array(lower(label), '\\s+'))), 3 FROM big),
    sc AS (SELECT query_id, community_id, size, sum(points) AS score FROM (SELECT query_id, unnest(ws) AS word FROM docs) JOIN w USING (word) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, size DESC, community_id) AS rank FROM sc),
    named AS MATERIALIZED (SELECT d.doc_id AS query_id, d.text, string_agg(community_id, '|' ORDER BY rank) AS communities FROM documents d LEFT JOIN (SELECT * FROM r WHERE rank <= 3) r ON r.query_id = d.doc_id GROUP BY ALL),
    queries AS (SELECT query_id, array_to_string({KW3}, ' ') AS text FROM named WHERE communities IS NULL), {_LABELED}, chunks AS (SELECT * FROM nodes),
    {S.positions('chunks', 'doc_id, chunk_id', ('text',))}, {S.QUERY_FORMS},
    fall AS (SELECT query_id, least(10, count(DISTINCT chunk_id)) AS n FROM q_terms JOIN postings USING (term) GROUP BY ALL)
    SELECT n.query_id, communities, coalesce(f.n, 0) AS n_nodes, CASE WHEN communities IS NOT NULL THEN 0.8 WHEN f.n > 0 THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence FROM named n LEFT JOIN fall f USING (query_id)""",
)
def p25(spark, sf):
    q = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "text")
    p = table(spark, sf, "part")
    nodes = p.select(F.col("p_partkey").cast("string").alias("id"), F.lit("part").alias("label"), "p_name", "p_type", "p_brand")
    return P.global_graph_lookup(q, communities(spark, sf), nodes, ["p_name", "p_type", "p_brand"]).select("query_id", "communities", "n_nodes", "confidence")


@query(
    "p25_multi_hop_lookup",
    f"""WITH {ASKED}, cs AS (SELECT ['IT','SE'][p_partkey % 2 + 1] || (p_partkey % 900 + 100) AS code, min(p_partkey) AS k FROM part GROUP BY ALL),
    e AS (SELECT a.code AS src, b.code AS dst FROM cs a JOIN cs b ON b.k = a.k // 2 WHERE a.code <> b.code),
    st AS (SELECT DISTINCT query_id, unnest({CODES}) AS code, {CONCEPTS} AS concepts FROM asked),
    st2 AS (SELECT st.* FROM st JOIN cs USING (code)),
    w1 AS (SELECT query_id, code, concepts, src AS a, [src, code] AS path FROM st2 JOIN e ON dst = code),
    w2 AS (SELECT query_id, code, concepts, e.src AS a, list_prepend(e.src, path) AS path FROM w1 JOIN e ON e.dst = w1.a),
    w AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2), n AS (SELECT query_id, count(*) AS n, count(*) FILTER (len(concepts) = 0 OR len(list_filter(concepts, lambda c: contains(lower('môn ' || array_to_string(path, chr(10) || 'môn ')), lower(c)))) > 0) AS kept FROM w GROUP BY ALL)
    SELECT a.query_id, len({CODES}) > 0 AS has_start, coalesce(n.n, 0) AS n_found, coalesce(n.kept, 0) AS n_kept, CASE WHEN n.kept > 0 THEN 0.85 WHEN n.n > 0 THEN 0.7 WHEN EXISTS (SELECT 1 FROM st2 s WHERE s.query_id = a.query_id) THEN 0.4 ELSE 0.3 END::DOUBLE AS confidence
    FROM asked a LEFT JOIN n USING (query_id)""",
)
def p25b(spark, sf):
    la, c, p, course = lookup_tables(spark, sf)
    e = course.select((F.expr("k div 2")).alias("pk"), F.col("code").alias("src")).join(course.select(F.col("k").alias("pk"), F.col("code").alias("dst")), "pk").filter("src <> dst")
    names = course.select("code", F.concat(F.lit("môn "), "code").alias("name"))
    out = P.multi_hop_lookup(asked(spark, sf), e.select("src", "dst", F.lit("PREREQUISITE").alias("type")), names, 2)
    return out.select("query_id", "has_start", big("n_found"), big("n_kept"), "confidence")
