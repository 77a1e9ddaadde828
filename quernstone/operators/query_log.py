"""Rule-based columns over a table of queries: intent, complexity, keywords, filters, plans, logs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.json_repair import repair_json
from quernstone.functions.text import TOKEN, py_strip

# Phrases that mark a question about the assistant, and small talk.
IDENTITY = ["bạn là ai", "bạn là gì", "mày là ai", "who are you", "bạn tên gì", "tên bạn là gì", "bạn là chatbot gì"]
SOCIAL = [
    "xin chào", "hello", "hi", "chào", "cảm ơn", "thanks", "thank you", "tạm biệt", "bye", "ok", "được", "vâng", "dạ", "ừ", "oke",
]
GREETING = ["xin chào", "hello", "hi", "chào bạn", "chào"]
THANKS = ["cảm ơn", "thanks", "thank you", "cám ơn"]
GOODBYE = ["tạm biệt", "bye", "goodbye", "chào tạm biệt"]
ACKNOWLEDGE = ["ok", "oke", "được", "vâng", "dạ", "ừ"]

# Complexity and intent phrases.
SIMPLE_WORDS = ["xin chào", "hello", "cảm ơn", "tạm biệt", "ok"]
COMPLEX_WORDS = ["so sánh", "phân tích", "đánh giá", "quy trình chi tiết", "hướng dẫn", "các bước", "làm thế nào", "khác biệt"]
SIMPLE_MAX, COMPLEX_MIN = 3.5, 6.5
INTENTS = {
    "social_greeting": ["xin chào", "hello", "cảm ơn", "tạm biệt"],
    "comparative": ["so sánh", "khác biệt", "giống nhau", "vs"],
    "procedural": ["cách", "làm sao", "thế nào", "quy trình", "hướng dẫn"],
}
TOPIC_INTENTS = {
    "fee_inquiry": ["học phí", "chi phí", "tiền"],
    "registration": ["đăng ký", "đky", "môn học"],
    "schedule_inquiry": ["lịch", "thời gian", "khi nào"],
    "policy_inquiry": ["quy định", "luật", "chính sách"],
}

# Phrases that call for the graph.
RELATION_WORDS = [
    "mối quan hệ", "quan hệ", "liên quan", "liên kết", "kết nối", "ảnh hưởng", "tác động", "phụ thuộc", "dẫn đến", "gây ra", "bắt nguồn từ",
]
STRUCTURE_WORDS = ["khoản", "mục", "chương", "quy chế", "nghị định", "thông tư"]
RULE_QUESTIONS = [
    "điều kiện", "yêu cầu", "quy định", "thủ tục", "hồ sơ", "chuyển ngành", "chuyển trường", "chuyển chương trình", "bảo lưu", "thôi học",
    "tốt nghiệp", "xét tốt nghiệp", "khen thưởng", "kỷ luật", "học bổng",
]

# Patterns deciding the kind of graph question, tried in this order.
GRAPH_PATTERNS = [
    ("multi_hop", [
        r"nếu.*(rớt|trượt|không qua|fail).*thì", r"nếu.*(không học|bỏ qua|skip).*thì", r"(rớt|trượt).*ảnh hưởng", r"(rớt|trượt).*bị trễ",
        r"chuỗi.*(môn|học phần)", r"từ.*(cơ sở|nền tảng).*đến.*(chuyên ngành|nâng cao)", r"đường đi.*học", r"lộ trình.*học",
        r"ảnh hưởng.*như thế nào.*tốt nghiệp", r"tác động.*đến.*năm (cuối|\d)",
    ]),
    ("local", [
        r"liệt kê.*(có|với).*(quan hệ|mối quan hệ).*(yeu_cau|quy_dinh|điều kiện)", r"(các điều|điều khoản).*(có|với).*(quan hệ|relationship)",
        r"scan.*relationship", r"tìm.*(các cặp|cặp).*(có|với).*quan hệ",
    ]),
    ("global", [
        r"so sánh.*(chương trình|ngành|khoa)", r"khác biệt.*(giữa|của).*(chương trình|ngành|khoa)",
        r"(cntt|khmt|httt|mmt).*(vs|so với|và).*(cntt|khmt|httt|mmt)", r"tóm tắt.*(quy định|chương trình|môn học)", r"tổng quan.*(về|của)",
        r"liệt kê tất cả.*(môn|chương trình)", r"có bao nhiêu (môn|quy định|điều)", r"phân loại.*(môn|quy định)", r"nhóm.*(môn học|quy định)",
    ]),
]

# Stop words of the three keyword rules.
KEYWORD_STOPS = [
    "là", "của", "và", "có", "trong", "với", "để", "về", "tại", "từ", "này", "đó", "những", "các", "một", "như", "được", "sẽ", "đã",
    "đang", "thì", "nếu", "khi", "mà", "hay", "hoặc", "gì", "nào",
]
COMPOUND_STOPS = [
    "là", "gì", "như", "thế", "nào", "và", "hoặc", "hay", "của", "cho", "với", "để", "từ", "đến", "trong", "ngoài", "các", "những", "một",
    "hai", "ba", "có", "không", "được", "phải", "cần", "nên", "hỏi", "về", "tôi", "bạn", "em", "anh",
]
SHORT_STOPS = [*KEYWORD_STOPS, "so", "sánh", "khác", "biệt", "giữa", "tôi", "bạn"]

# Compound terms kept whole.
COMPOUNDS = [
    "học phần", "môn học", "sinh viên", "tín chỉ", "điểm trung bình", "đăng ký", "xét tốt nghiệp", "tốt nghiệp", "buộc thôi học",
    "cảnh báo học tập", "kết quả", "chương trình đào tạo", "tiên quyết", "học trước", "môn cơ sở", "môn chuyên ngành",
    "nhập môn lập trình", "lập trình hướng đối tượng", "cấu trúc dữ liệu", "giải thuật", "cơ sở dữ liệu", "mạng máy tính", "hệ điều hành",
    "công nghệ phần mềm", "trí tuệ nhân tạo", "machine learning", "deep learning", "tiếng anh", "tiếng nhật", "tiếng pháp", "ngoại ngữ",
    "quy định", "quy chế", "điều kiện", "yêu cầu", "miễn học", "xét miễn", "chứng chỉ", "toeic", "đào tạo ngoại ngữ", "giảng dạy tiếng anh",
]

# Filter vocabularies.
DOC_TYPES = {
    "regulation": ["quy chế", "quy định", "điều lệ", "nội quy"],
    "syllabus": ["đề cương", "chương trình đào tạo", "ctđt"],
    "announcement": ["thông báo", "công văn", "hướng dẫn"],
}
FACULTIES = {
    "CNTT": ["công nghệ thông tin", "cntt", "khoa cntt"],
    "KHMT": ["khoa học máy tính", "khmt", "computer science"],
    "HTTT": ["hệ thống thông tin", "httt", "information systems"],
    "MMT": ["mạng máy tính", "mmt", "mmtt", "truyền thông", "network"],
    "KTMT": ["kỹ thuật máy tính", "ktmt", "computer engineering"],
    "KHTN": ["khoa học tự nhiên", "khtn"],
    "CTDA": ["công trình đa âm", "ctda"],
}
SUBJECT_NAMES = {
    "IT001": ["nhập môn lập trình", "intro to programming"],
    "IT002": ["lập trình hướng đối tượng", "oop"],
    "IT003": ["cấu trúc dữ liệu", "data structures"],
    "SE100": ["nhập môn công nghệ phần mềm"],
    "SE101": ["công nghệ phần mềm"],
}
YEAR_PATTERNS = [r"năm\s*(\d{4})", r"khóa\s*(\d{4})", r"niên khóa\s*(\d{4})", r"(\d{4})\s*[-–]\s*\d{4}"]

# Abbreviations written out when a query is rewritten. An institution adds its own.
ABBREVIATIONS = {
    "hp": "học phần", "đkhp": "đăng ký học phần", "khmt": "khoa học máy tính", "cntt": "công nghệ thông tin",
    "httt": "hệ thống thông tin", "mmt": "mạng máy tính và truyền thông", "mmtt": "mạng máy tính và truyền thông", "sv": "sinh viên",
    "gv": "giảng viên", "đtbc": "điểm trung bình chung", "ctđt": "chương trình đào tạo", "đhqg": "đại học quốc gia", "hcm": "hồ chí minh",
}

# Department names, question patterns and target concepts of graph questions.
DEPARTMENTS = {
    "cntt": "CNTT", "công nghệ thông tin": "CNTT", "khmt": "KHMT", "khoa học máy tính": "KHMT", "httt": "HTTT",
    "hệ thống thông tin": "HTTT", "mmt": "MMT", "mạng máy tính": "MMT",
}
ENTITY_WORDS = ["liên quan đến", "liên quan tới", "quy định về", "các điều khoản về", "nói về", "đề cập đến"]
QUESTION_PATTERNS = {
    "prerequisite": ["tiên quyết", "học trước", "cần học", "môn trước"],
    "department": ["thuộc khoa", "của khoa", "trong khoa"],
    "program": ["chương trình", "ngành học", "ctđt"],
}
CONCEPTS = [
    (r"đồ\s*án", "đồ án"), (r"chuyên\s*ngành", "chuyên ngành"), (r"tốt\s*nghiệp", "tốt nghiệp"), (r"năm\s*cuối", "năm cuối"),
    (r"năm\s*(\d+)", "năm"), (r"học\s*kỳ\s*(\d+)", "học kỳ"),
]

# Words that join several topics in one query.
CONNECTIVES = ["và", "hoặc", "ngoài ra", "thêm", "khác"]

# Intents, their keywords and where each is routed.
ROUTES = {
    "tien_quyet": (["tiên quyết", "học trước", "điều kiện học"], "graph_traversal"),
    "mo_ta_mon_hoc": (["học về gì", "nội dung", "mô tả môn"], "vector_search"),
    "dieu_kien_tot_nghiep": (["tốt nghiệp", "điều kiện ra trường", "yêu cầu tốt nghiệp"], "multi_hop_graph"),
    "chuong_trinh_dao_tao": (["chương trình", "khung chương trình", "danh sách môn"], "graph_traversal"),
    "quy_dinh_hoc_vu": (["quy định", "quy chế", "chính sách"], "hybrid_search"),
    "hoc_phi": (["học phí", "chi phí", "đóng tiền"], "hybrid_search"),
}


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])


def any_match(text: Column, patterns: list[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def first_label(text: Column, table: dict[str, list[str]], default: str) -> Column:
    """The first entry any of whose phrases occurs."""
    return F.coalesce(*[F.when(any_of(text, ws), F.lit(k)) for k, ws in table.items()], F.lit(default))


def labels_found(text: Column, table: dict[str, list[str]]) -> Column:
    return F.array_compact(F.array(*[F.when(any_of(text, ws), F.lit(k)) for k, ws in table.items()]))


def _starts(text: Column, words: list[str], seps: tuple[str, ...] = (" ",)) -> Column:
    tests = [text == w for w in words] + [F.startswith(text, F.lit(w + s)) for w in words for s in seps]
    return reduce(Column.__or__, tests)


def classify_social(q: Column) -> Column:
    """'identity', 'social' or null."""
    t = py_strip(F.lower(q))
    return F.when(any_of(t, IDENTITY), "identity").when(_starts(t, SOCIAL), "social")


def direct_response(q: Column) -> Column:
    """Which ready reply fits: identity, greeting, thanks, goodbye, acknowledge, or null."""
    t = py_strip(F.lower(q))
    return (
        F.when(any_of(t, IDENTITY[:-1]), "identity").when(_starts(t, GREETING, (" ", ",")), "greeting")
        .when(any_of(t, THANKS), "thanks").when(any_of(t, GOODBYE), "goodbye").when(t.isin(ACKNOWLEDGE), "acknowledge")
    )


def complexity_score(q: Column) -> Column:
    t, n = F.lower(q), F.length(q)
    marks = n - F.length(F.replace(q, F.lit("?"), F.lit("")))
    score = (
        F.lit(5.0)
        + F.when(n < 20, -2.0).when(n < 40, -1.0).otherwise(0.0)
        + F.when(any_of(t, COMPLEX_WORDS), 2.5).otherwise(0.0)
        + F.when(marks > 1, 1.0).otherwise(0.0)
        + F.when(n > 100, 1.5).when(n > 60, 0.5).otherwise(0.0)
    )
    return F.when(any_of(t, SIMPLE_WORDS), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(10.0), score)))


def complexity_label(score: Column) -> Column:
    return F.when(score <= SIMPLE_MAX, "simple").when(score >= COMPLEX_MIN, "complex").otherwise("medium")


def detect_intent(q: Column) -> Column:
    return first_label(F.lower(q), INTENTS, "informational")


def topic_intent(q: Column) -> Column:
    return first_label(F.lower(q), TOPIC_INTENTS, "general_inquiry")


def article_count(q: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(F.lower(q), F.lit(r"điều\s+(\d+)"), F.lit(1))))


def needs_graph(q: Column) -> Column:
    t = F.lower(q)
    return any_of(t, RELATION_WORDS) | (article_count(q) >= 1) | any_of(t, STRUCTURE_WORDS) | any_of(t, RULE_QUESTIONS)


def graph_query_type(q: Column) -> Column:
    t = F.lower(q)
    return F.coalesce(*[F.when(any_match(t, ps), F.lit(kind)) for kind, ps in GRAPH_PATTERNS], F.lit("local"))


def _blank_split(t: Column) -> Column:
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def keywords(q: Column, limit: int = 10, stops: list[str] | None = None) -> Column:
    """Words longer than two letters without stop words, punctuation stripped, in order."""
    parts = F.transform(_blank_split(F.translate(F.lower(q), ",.", "  ")), lambda w: F.regexp_replace(w, "^[?!.,;:]+|[?!.,;:]+$", ""))
    stop = stops or KEYWORD_STOPS
    return F.slice(F.filter(parts, lambda w: (F.length(w) > 2) & ~w.isin(stop)), 1, limit)


def short_keywords(q: Column, limit: int = 5) -> Column:
    parts = _blank_split(F.translate(F.lower(q), ",.", "  "))
    return F.slice(F.filter(parts, lambda w: ~w.isin(SHORT_STOPS) & (F.length(w) > 2)), 1, limit)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often it is read there, in functions for each element too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def compound_keywords(q: Column, limit: int = 15, compounds: list[str] | None = None) -> Column:
    """Compound terms first, then up to five other words; without compounds, words and course names."""

    def from_lists(x: Column) -> Column:
        single, found = x["single"], x["found"]
        rest = F.slice(F.filter(single, lambda w: ~F.exists(found, lambda c: F.contains(c, w))), 1, 5)
        letters = "a-zđàáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"
        names = F.transform(
            F.regexp_extract_all(x["q"], F.lit(rf"(?iu)môn\s+([{letters}][{letters}\s]+)"), F.lit(1)), py_strip
        )
        return F.slice(
            F.array_distinct(F.when(F.size(found) > 0, F.concat(found, rest)).otherwise(F.concat(single, names))), 1, limit
        )

    def lists(x: Column) -> Column:
        single = F.filter(_blank_split(x["t"]), lambda w: (F.length(w) > 2) & ~w.isin(COMPOUND_STOPS))
        found = F.array_compact(F.array(*[F.when(F.contains(x["t"], F.lit(c)), F.lit(c)) for c in (compounds or COMPOUNDS)]))
        return _once(F.struct(x["q"].alias("q"), single.alias("single"), found.alias("found")), from_lists)

    return _once(F.struct(q.alias("q"), F.lower(q).alias("t")), lists)


def _whole_tokens(q: Column, pattern: str) -> Column:
    """Word runs that match ``pattern`` as a whole."""
    return F.filter(F.regexp_extract_all(F.upper(q), F.lit(f"({TOKEN})"), F.lit(1)), lambda w: w.rlike(f"^{pattern}$"))


def extract_filters(q: Column, doc_types: bool = False) -> Column:
    """struct(doc_types, faculties, years, subjects); document types only on request."""
    t = F.lower(q)
    years = F.concat(
        *[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in YEAR_PATTERNS], _whole_tokens(q, r"20\d{2}")
    )
    numbers = F.filter(F.transform(years, lambda y: y.cast("int")), lambda y: (y >= 2000) & (y <= 2100))
    return F.struct(
        (labels_found(t, DOC_TYPES) if doc_types else F.expr("cast(array() as array<string>)")).alias("doc_types"),
        labels_found(t, FACULTIES).alias("faculties"),
        F.array_distinct(numbers).alias("years"),
        F.array_distinct(F.concat(_whole_tokens(q, r"[A-Z]{2,4}\d{3}"), labels_found(t, SUBJECT_NAMES))).alias("subjects"),
    )


def rewrite_queries(
    q: Column, suffix: str, own_names: dict[str, str] | None = None, limit: int = 3, strict: bool = False
) -> Column:
    """The query, its abbreviations written out, and the query with the institution's ``suffix``.

    ``own_names`` maps the institution's abbreviation to its name; a query with either in it
    gets no suffix. ``strict`` also expands inside words, as plain replacement does.
    """
    own = own_names or {}
    t = F.lower(q)
    full = t
    for short, long in {**ABBREVIATIONS, **own}.items():
        if strict:
            full = F.replace(full, F.lit(short), F.lit(long))
        else:
            full = F.regexp_replace(full, rf"(?<![\p{{L}}\p{{N}}_]){short}(?![\p{{L}}\p{{N}}_])", long)
    named = any_of(t, [x for kv in own.items() for x in kv]) if own else F.lit(False)
    extra = F.array_compact(F.array(F.when(full != t, full), F.when(~named, F.concat(q, F.lit(suffix)))))
    return F.slice(F.when(F.array_contains(extra, q), extra).otherwise(F.concat(F.array(q), extra)), 1, limit)


def plan(queries: DataFrame, suffix: str, own_names: dict[str, str] | None = None) -> DataFrame:
    """Plan columns for every query; ``queries``: (query_id, text, ...)."""
    q = F.col("text")
    scored = queries.withColumns({"score": complexity_score(q), "intent": detect_intent(q), "relational": needs_graph(q)})
    scored = scored.withColumn("complexity", complexity_label(F.col("score")))
    rag = F.col("complexity") != "simple"
    hard = F.col("complexity") == "complex"
    very = hard & (F.col("score") > 7.0)
    graph = rag & (hard | F.col("relational") | (F.col("intent") == "comparative"))
    none = F.expr("cast(array() as array<string>)")
    return scored.withColumns({
        "requires_rag": rag,
        "strategy": F.when(~rag, "direct_response").when(hard, "advanced_rag").otherwise("standard_rag"),
        "top_k": F.when(~rag, 0).when(very, 10).when(hard, 8).otherwise(5),
        "hybrid_search": hard, "reranking": very, "use_knowledge_graph": graph, "use_vector_search": rag,
        "graph_query_type": F.when(graph, graph_query_type(q)).otherwise("local"),
        "rewritten_queries": F.when(rag, rewrite_queries(q, suffix, own_names)).otherwise(none),
        "search_terms": F.when(rag, keywords(q)).otherwise(none),
        "filters": F.when(rag, extract_filters(q)),
    }).drop("relational")


def plan_from_json(plans: DataFrame, raw: str, suffix: str, own_names: dict[str, str] | None = None) -> DataFrame:
    """Rule-based plans overlaid with the fields a model's JSON answer gives."""
    schema = "intent string, complexity string, complexity_score double, requires_rag boolean, strategy string, rewritten_queries array<string>, top_k int"
    ruled = repair_json(plan(plans, suffix, own_names), raw, out="_r").withColumn("_j", F.from_json("_r.json", schema))
    over = {c: F.coalesce(F.col(f"_j.{c}"), F.col(c)) for c in ("intent", "complexity", "requires_rag", "strategy", "rewritten_queries", "top_k")}
    over["score"] = F.coalesce(F.col("_j.complexity_score"), F.col("score"))
    return ruled.withColumns(over).drop("_r", "_j")


def course_codes(q: Column) -> Column:
    return _whole_tokens(q, r"[A-Z]{2}\d{3}")


def extract_code(q: Column) -> Column:
    """Course code, else the code of a department named in the query."""
    t = F.lower(q)
    return F.coalesce(F.get(course_codes(q), F.lit(0)), *[F.when(F.contains(t, F.lit(name)), F.lit(code)) for name, code in DEPARTMENTS.items()])


def asked_article(q: Column) -> Column:
    t = F.lower(q)
    found = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (r"điều\s*(\d+)", r"điều\s*số\s*(\d+)", r"article\s*(\d+)")]
    return F.coalesce(*found).cast("bigint")


def question_pattern(q: Column) -> Column:
    t = F.lower(q)
    return (
        F.when(any_match(t, [r"điều\s*\d+", r"điều\s*số\s*\d+", r"article\s*\d+"]), "article")
        .when(any_of(t, ENTITY_WORDS), "entity_related").otherwise(first_label(t, QUESTION_PATTERNS, "general"))
    )


def target_concepts(q: Column) -> Column:
    t = F.lower(q)
    return F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(c)) for p, c in CONCEPTS]))


def complexity_v2(q: Column) -> Column:
    count = lambda c, w: (F.length(c) - F.length(F.replace(c, F.lit(w), F.lit("")))) / F.lit(len(w))
    asked = count(q, "?") + count(q, "là gì") + count(q, "như thế nào")
    n_words = F.size(_blank_split(q))
    return F.when((asked > 2) | any_of(F.lower(q), CONNECTIVES) | (n_words > 20), "complex").when((asked > 1) | (n_words > 10), "medium").otherwise("simple")


def estimate_tokens(steps: Column) -> Column:
    return F.lit(100) + steps * 50


def log_key(query: Column, params: Column) -> Column:
    """Normalised key of a logged query: blanks collapsed, parameters attached."""
    text = F.regexp_replace(py_strip(query), r"\s+", " ")
    return F.md5(F.concat(text, F.lit("|"), F.coalesce(params, F.lit(""))))


def query_log_stats(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per key, overall); ``log``: (key, seconds, hit, ts)."""
    per = log.groupBy("key").agg(
        F.count("*").alias("executions"), F.sum("seconds").alias("total_time"), F.avg("seconds").alias("avg_time"),
        F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.when(~F.col("hit"), 1)).alias("misses"), F.max("ts").alias("last_execution"),
    )
    per = per.withColumn("hit_rate", F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)))
    overall = per.agg(
        F.count("*").alias("unique_queries"), F.sum("executions").alias("executions"), F.sum("hits").alias("hits"), F.sum("misses").alias("misses"),
        F.try_divide(F.sum("total_time"), F.sum("executions")).alias("avg_time"),
    )
    return per, overall.withColumn("hit_rate", F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)))


def usage_stats(log: DataFrame, prices: dict[str, tuple[float, float]], default: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Calls, tokens and cost per model; ``log``: (model, input_tokens, output_tokens), prices per 1000 tokens."""
    price = lambda i: F.coalesce(*[F.when(F.col("model") == m, F.lit(float(p[i]))) for m, p in prices.items()], F.lit(float(default[i])))
    per = log.groupBy("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return per.withColumns({
        "total_tokens": F.col("input_tokens") + F.col("output_tokens"),
        "cost": F.col("input_tokens") / 1000 * price(0) + F.col("output_tokens") / 1000 * price(1),
    })


def parse_tool_actions(log: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds thought, action, tool and args (quotes removed, commas in quotes kept)."""
    r = F.col(raw)
    part = lambda p: F.nullif(py_strip(F.regexp_extract(r, p, 1)), F.lit(""))
    action = part(r"(?is)action:\s*(.+?)(?=observation:|thought:|\z)")
    out = log.withColumns({"thought": part(r"(?is)thought:\s*(.+?)(?=action:|\z)"), "action": py_strip(F.element_at(F.split(action, "\n"), 1))})
    call = r"^([\p{L}\p{N}_]+)\s*\(([^)]*)\)"
    pieces = F.regexp_extract_all(
        F.regexp_extract("action", call, 2), F.lit("((?:\"[^\"]*\"|'[^']*'|[^,\"'])+)"), F.lit(1)
    )
    clean = F.transform(pieces, lambda p: py_strip(F.regexp_replace(py_strip(p), "\"([^\"]*)\"|'([^']*)'", "$1$2")))
    return out.withColumns({
        "tool": F.nullif(F.regexp_extract("action", call, 1), F.lit("")), "args": F.when(F.col("action").rlike(call), clean),
    })


def route_flags(q: Column) -> Column:
    """struct(intent, route, use_graph, use_vector)."""
    t = F.lower(q)
    intent = first_label(t, {k: v[0] for k, v in ROUTES.items()}, "general")
    route = F.coalesce(*[F.when(any_of(t, ws), F.lit(r)) for ws, r in ROUTES.values()], F.lit("vector_search"))
    return F.struct(
        intent.alias("intent"), route.alias("route"),
        route.isin("graph_traversal", "multi_hop_graph", "hybrid_search").alias("use_graph"), route.isin("vector_search", "hybrid_search").alias("use_vector"),
    )
