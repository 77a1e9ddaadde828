"""Registered queries for cleaning and structuring extraction results."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions.json_repair import repair_json
from quernstone.operators import extract as X
from quernstone.operators import labels as L
from quernstone.plans import sql_parts as S
from quernstone.plans.bindings import spread, table
from quernstone.plans.registry import query

big = lambda c: F.col(c).cast("bigint").alias(c)
NUMERALS = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"]

# -- documents' lines as structure nodes ------------------------------------

SNODES = f"""
lines AS MATERIALIZED (SELECT doc_id, lang, source, i, line FROM (SELECT doc_id, lang, source, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i
  FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents)) WHERE {S.strip('line')} <> ''),
snodes AS MATERIALIZED (SELECT doc_id,
  CASE i % 5 WHEN 0 THEN 'CHUONG_' || ['I','II','III','IV','V','VI','VII','VIII','IX','X'][(i // 10) % 10 + 1] || '_' || lang
             WHEN 3 THEN 'khoan_' || (i % 5) || '_dieu_' || (i // 10) || '_' || lang
             WHEN 4 THEN CASE WHEN i % 10 = 9 THEN 'bang_' || i ELSE 'bang_dieu_' || (i // 10) || '_' || lang || '_1_t' END
             ELSE 'dieu_' || (i // 10) || '_' || lang || '_' || (i % 5) END AS id,
  CASE i % 5 WHEN 0 THEN 'Chapter' WHEN 3 THEN 'Clause' WHEN 4 THEN 'Table' ELSE 'Article' END AS type,
  line AS title, line AS full_text, i // 3 + 1 AS page, i AS ord FROM lines),
sedges AS MATERIALIZED (
  SELECT doc_id, 'dieu_' || (i // 10) || '_' || lang || '_1' AS source, 'khoan_' || (i % 5) || '_dieu_' || (i // 10) || '_' || lang AS target, 'CONTAINS' AS type, i AS ord FROM lines WHERE i % 5 = 3
  UNION ALL SELECT doc_id, 'dieu_' || (i // 10) || '_' || lang || '_2', 'bang_' || i, 'CONTAINS', i FROM lines WHERE i % 10 = 9
  UNION ALL SELECT doc_id, 'dieu_' || (i // 10) || '_' || lang || '_' || (i % 5), 'chuong_' || (i // 10 + 1), 'FOLLOWS', i FROM lines WHERE i % 5 IN (1, 2))"""


def lines(spark, sf):
    from quernstone.functions.text import is_blank

    d = spread(table(spark, sf, "documents"), "doc_id")
    return d.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("i", "line")).filter(~is_blank(F.col("line")))


def _ids():
    tens, five = F.expr("cast(i div 10 as string)"), F.expr("cast(i % 5 as string)")
    numeral = F.element_at(F.array(*[F.lit(n) for n in NUMERALS]), F.expr("cast((i div 10) % 10 + 1 as int)"))
    u = lambda *xs: F.concat_ws("_", *xs)
    chapter = u(F.lit("CHUONG"), numeral, "lang")
    article = u(F.lit("dieu"), tens, "lang", five)
    clause = u(F.lit("khoan"), five, F.lit("dieu"), tens, "lang")
    loose = u(F.lit("bang"), F.col("i").cast("string"))
    held = u(F.lit("bang_dieu"), tens, "lang", F.lit("1_t"))
    return u, tens, five, chapter, article, clause, loose, held


def structure_nodes(spark, sf):
    u, tens, five, chapter, article, clause, loose, held = _ids()
    m = F.col("i") % 5
    return lines(spark, sf).select(
        "doc_id",
        F.when(m == 0, chapter).when(m == 3, clause).when(m == 4, F.when(F.col("i") % 10 == 9, loose).otherwise(held)).otherwise(article).alias("id"),
        F.when(m == 0, "Chapter").when(m == 3, "Clause").when(m == 4, "Table").otherwise("Article").alias("type"),
        F.col("line").alias("title"), F.col("line").alias("full_text"),
        F.expr("cast(i div 3 + 1 as bigint)").alias("page"), F.col("i").cast("bigint").alias("ord"),
    )


def structure_edges(spark, sf):
    u, tens, five, chapter, article, clause, loose, held = _ids()
    m = F.col("i") % 5
    clause_row, loose_row = m == 3, F.col("i") % 10 == 9
    pick = lambda a, b, c: F.when(clause_row, a).when(loose_row, b).when(m.isin(1, 2), c)
    return lines(spark, sf).select(
        "doc_id",
        pick(u(F.lit("dieu"), tens, "lang", F.lit("1")), u(F.lit("dieu"), tens, "lang", F.lit("2")), article).alias("source"),
        pick(clause, loose, u(F.lit("chuong"), F.expr("cast(i div 10 + 1 as string)"))).alias("target"),
        pick(F.lit("CONTAINS"), F.lit("CONTAINS"), F.lit("FOLLOWS")).alias("type"),
        F.col("i").cast("bigint").alias("ord"),
    ).filter("type is not null")


# -- T01 --------------------------------------------------------------------


@query("t01_repair_json", "SELECT event_id, props AS json, NULL::VARCHAR AS error FROM events")
def t01(spark, sf):
    p = F.col("props")
    raw = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```")))
        .when(F.col("event_id") % 3 == 1, F.regexp_replace(p, r"\}$", ",}"))
        .otherwise(F.concat(F.lit("Here is the result:\n"), p, F.lit("\nEnd.")))
    )
    logged = table(spark, sf, "events").select("event_id", raw.alias("raw"))
    return repair_json(logged, "raw", out="r").select("event_id", "r.json", "r.error")


# -- pages: conversations as documents, turns as pages -----------------------

_WS = S.T.WS
_JOIN = f"""CASE WHEN regexp_replace(a, '{_WS}+$', '') = '' OR regexp_replace(x, '^{_WS}+', '') = ''
  OR regexp_matches(regexp_replace(a, '{_WS}+$', ''), '[.!?:;,)\\]\\n]$') OR regexp_matches(regexp_replace(x, '^{_WS}+', ''), '^[.!?:;,(\\[]')
  THEN regexp_replace(a, '{_WS}+$', '') || regexp_replace(x, '^{_WS}+', '')
  ELSE regexp_replace(a, '{_WS}+$', '') || ' ' || regexp_replace(x, '^{_WS}+', '') END"""
_FOLD = f"list_reduce(list(full_text ORDER BY page, ord), lambda a, x: CASE WHEN contains(a, {S.strip('x')}) THEN a ELSE {_JOIN} END)"
_FRAGS = """frags AS (SELECT conv_id // 5 AS doc_id, role || '_' || (conv_id % 5) AS id, CASE WHEN role = 'system' THEN 'Chapter' ELSE 'Article' END AS type,
  string_split(text, chr(10))[1] AS title, text AS full_text, turn + 1 AS page, turn AS ord FROM conversations)"""


def fragments(spark, sf):
    return table(spark, sf, "conversations").select(
        F.expr("conv_id div 5").alias("doc_id"), F.concat_ws("_", "role", F.expr("cast(conv_id % 5 as string)")).alias("id"),
        F.when(F.col("role") == "system", "Chapter").otherwise("Article").alias("type"),
        F.element_at(F.split("text", "\n"), 1).alias("title"), F.col("text").alias("full_text"), (F.col("turn") + 1).alias("page"), F.col("turn").alias("ord"),
    )


def _page_text(df):
    return df.withColumn("page_range", F.concat_ws(",", F.transform("page_range", lambda p: p.cast("string"))))


_MERGED = f"""SELECT doc_id, id, arg_min(type, page * 100000 + ord) AS type, {_FOLD} AS full_text,
  arg_max(title, length(title) * 10000000000 - page * 100000 - ord) AS title, string_agg(DISTINCT page, ',' ORDER BY page) AS page_range"""


@query("t02_merge_pages", f"WITH {_FRAGS} {_MERGED} FROM frags GROUP BY doc_id, id")
def t02(spark, sf):
    return _page_text(X.merge_pages(fragments(spark, sf))).drop("ord")


# The text of every third turn is left pending for the assistant node of the next page.
_PENDING = f"""{_FRAGS},
ctx AS (SELECT conv_id // 5 AS doc_id, turn + 2 AS page, 'assistant_' || (conv_id % 5) AS id, '+' || reverse(text) AS full_text FROM conversations),
seen AS (SELECT doc_id, id, min(page) AS first_page, arg_min(type, page * 100000 + ord) AS type FROM frags GROUP BY ALL),
alls AS (SELECT * FROM frags UNION ALL SELECT c.doc_id, c.id, s.type, '' AS title, c.full_text, c.page, -1 AS ord FROM ctx c JOIN seen s USING (doc_id, id) WHERE s.first_page < c.page)"""


@query("t03_attach_pending", f"WITH {_PENDING} SELECT doc_id, id, full_text, page, ord FROM alls")
def t03(spark, sf):
    ctx = table(spark, sf, "conversations").select(
        F.expr("conv_id div 5").alias("doc_id"), (F.col("turn") + 2).alias("page"),
        F.concat_ws("_", F.lit("assistant"), F.expr("cast(conv_id % 5 as string)")).alias("pending_node_id"), F.concat(F.lit("+"), F.reverse("text")).alias("pending_text"),
    )
    return X.attach_pending(ctx, fragments(spark, sf)).select("doc_id", "id", "full_text", "page", "ord")


_LEDGES = "ledges AS (SELECT l_orderkey % 100 AS doc_id, l_suppkey AS source, l_partkey % 97 AS target, l_returnflag AS type, l_orderkey * 10 + l_linenumber AS ord FROM lineitem)"


@query("t04_dedupe_edges", f"WITH {_LEDGES} SELECT doc_id, source, target, type, min(ord) AS ord FROM ledges GROUP BY ALL")
def t04(spark, sf):
    return X.dedupe_edges(table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 100).alias("doc_id"), F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 97).alias("target"),
        F.col("l_returnflag").alias("type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    ))


@query(
    "t05_merge_summary",
    f"""WITH {_FRAGS}, m AS (SELECT doc_id, id, arg_min(type, page * 100000 + ord) AS type, count(DISTINCT page) AS pages FROM frags GROUP BY doc_id, id),
    t AS (SELECT doc_id, type, count(*) AS n_nodes, count(*) FILTER (pages > 1) AS n_cross_page FROM m GROUP BY ALL),
    e AS (SELECT conv_id // 5 AS doc_id, count(*) AS n_edges FROM conversations GROUP BY ALL)
    SELECT t.doc_id, type, n_nodes, n_cross_page, CAST(sum(n_nodes) OVER (PARTITION BY t.doc_id) AS BIGINT) AS total_nodes,
      CAST(sum(n_cross_page) OVER (PARTITION BY t.doc_id) AS BIGINT) AS total_cross_page, n_edges FROM t JOIN e USING (doc_id)""",
)
def t05(spark, sf):
    edges = table(spark, sf, "conversations").select(F.expr("conv_id div 5").alias("doc_id"))
    return X.merge_summary(X.merge_pages(fragments(spark, sf)), edges)[0]


def page_tables(spark, sf):
    """Orders as documents, order lines as pages; some lines are table rows."""
    l = table(spark, sf, "lineitem")
    is_table = F.col("l_returnflag").isin("A", "R")
    row = F.concat_ws(" ", F.lit("|"), "l_partkey", F.lit("|"), "l_quantity", F.lit("|"))
    return l.select(
        F.col("l_orderkey").alias("doc_id"), F.concat_ws("_", F.lit("n"), "l_linenumber", "l_suppkey").alias("id"),
        F.when(is_table, "Table").otherwise("Article").alias("type"),
        F.when(F.col("l_quantity") > 25, "").otherwise(F.concat_ws(" ", F.lit("Bảng"), F.col("l_linestatus"))).alias("title"),
        F.when(is_table | (F.col("l_tax") > 0.04), F.concat(F.lit("| part | qty |\n|---|---|\n"), row)).otherwise(F.col("l_returnflag")).alias("full_text"),
        F.col("l_linenumber").cast("bigint").alias("page"), F.col("l_partkey").alias("ord"),
    )


_T06_SQL = f"""WITH RECURSIVE src AS (
    SELECT l_orderkey AS doc_id, 'n_' || l_linenumber || '_' || l_suppkey AS id, CASE WHEN l_returnflag IN ('A', 'R') THEN 'Table' ELSE 'Article' END AS type,
      CASE WHEN l_quantity > 25 THEN '' ELSE 'Bảng ' || l_linestatus END AS title,
      CASE WHEN l_returnflag IN ('A', 'R') OR l_tax > 0.04 THEN '| part | qty |' || chr(10) || '|---|---|' || chr(10) || '| ' || l_partkey || ' | ' || l_quantity || ' |'
        ELSE l_returnflag END AS full_text,
      CAST(l_linenumber AS BIGINT) AS page, l_partkey AS ord FROM lineitem),
  nodes AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord, id) AS n FROM src),
  pages AS (SELECT doc_id, page, list({{'n': n, 'type': type, 'title': title, 'text': full_text}} ORDER BY n) AS ns,
      row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k FROM nodes GROUP BY doc_id, page),
  walk AS (
    SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS at, CAST(NULL AS BIGINT) AS moved,
      CAST(NULL AS STRUCT(page BIGINT, n BIGINT, title VARCHAR, body VARCHAR, pages VARCHAR)) AS grown,
      CAST(NULL AS STRUCT(page BIGINT, n BIGINT, title VARCHAR, body VARCHAR, pages VARCHAR)) AS o FROM pages WHERE k = 1
    UNION ALL
    SELECT doc_id, k, page, f.n, CASE WHEN f IS NOT NULL THEN u END, CASE WHEN len(tables) > 0
        THEN {{'page': page, 'n': tables[-1].n, 'title': tables[-1].title, 'body': tables[-1].text, 'pages': CAST(page AS VARCHAR)}}
        WHEN len(rest) = 0 THEN u END
    FROM (
      SELECT *, list_filter(rest, lambda c: c.type = 'Table') AS tables,
        CASE WHEN f IS NULL THEN o ELSE {{'page': o.page, 'n': o.n, 'title': o.title, 'pages': o.pages || ',' || page,
          'body': o.body || chr(10) || array_to_string(CASE WHEN NOT list_contains(above[1:10], ls[1]) THEN ls
            WHEN starts_with({S.strip("array_to_string(ls[2:], chr(10))")}, '|-') THEN ls[3:] ELSE ls[2:] END, chr(10))}} END AS u
      FROM (
        SELECT *, string_split({S.strip("f.text")}, chr(10)) AS ls, string_split({S.strip("o.body")}, chr(10)) AS above,
          CASE WHEN f IS NULL THEN ns ELSE list_filter(ns, lambda c: c.n <> f.n) END AS rest
        FROM (
          SELECT p.doc_id, p.k, p.page, p.ns, w.o, CASE WHEN w.o IS NOT NULL THEN list_filter(p.ns[1:3], lambda c: CASE WHEN c.type = 'Table'
              THEN c.title IN ('', w.o.title) OR contains(lower(c.title), 'tiếp') OR contains(lower(c.title), 'cont')
              ELSE starts_with({S.strip("c.text")}, '|') END)[1] END AS f
          FROM walk w JOIN pages p ON p.doc_id = w.doc_id AND p.k = w.k + 1)))),
  parts AS (SELECT doc_id, grown.page AS page, grown.n AS n, arg_max(grown.body, k) AS body, arg_max(grown.pages, k) AS pages
      FROM walk WHERE grown IS NOT NULL GROUP BY ALL)
  SELECT x.doc_id, id, type, title, coalesce(body, full_text) AS full_text, x.page, ord, coalesce(pages, CAST(x.page AS VARCHAR)) AS page_range
  FROM nodes x LEFT JOIN parts USING (doc_id, page, n)
  WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.doc_id = x.doc_id AND w.at = x.page AND w.moved = x.n)"""


@query("t06_merge_split_tables", _T06_SQL)
def t06(spark, sf):
    return _page_text(X.merge_split_tables(page_tables(spark, sf), first_nodes=3, header_lines=10))


@query(
    "t07_fold_children_into_articles",
    f"""WITH {SNODES},
    arts AS (SELECT * FROM snodes WHERE type = 'Article'),
    up AS (SELECT doc_id, target AS id, arg_max(source, ord) AS parent FROM sedges WHERE type = 'CONTAINS' GROUP BY ALL),
    c AS (SELECT n.*, parent FROM snodes n LEFT JOIN up USING (doc_id, id) WHERE type = 'Clause'),
    t0 AS (SELECT n.*, parent FROM snodes n LEFT JOIN up USING (doc_id, id) WHERE type = 'Table'),
    g AS (SELECT t0.doc_id, t0.id, t0.ord, arg_min(a.id, a.ord) AS guess FROM t0 JOIN arts a ON a.doc_id = t0.doc_id AND contains(t0.id, a.id) WHERE parent IS NULL GROUP BY ALL),
    t AS (SELECT t0.* EXCLUDE (parent), coalesce(parent, guess) AS parent FROM t0 LEFT JOIN g USING (doc_id, id, ord)),
    p AS (SELECT doc_id, parent, 'clause' AS kind, ord, chr(10) || chr(10) || '--- ' || title || ' ---' || chr(10) || full_text || chr(10) AS piece FROM c
          UNION ALL SELECT doc_id, parent, 'table', ord, chr(10) || chr(10) || '=== BẢNG THAM CHIẾU (' || title || ') ===' || chr(10) || full_text || chr(10) || '========================' || chr(10) FROM t),
    tail AS (SELECT doc_id, parent AS id, string_agg(piece, '' ORDER BY kind, ord, piece) AS tail FROM p WHERE parent IS NOT NULL GROUP BY ALL)
    SELECT doc_id, id, ord, md5(full_text || coalesce(tail, '')) AS text_key, length(full_text || coalesce(tail, '')) AS n_chars FROM arts LEFT JOIN tail USING (doc_id, id)""",
)
def t07(spark, sf):
    nodes, edges = structure_nodes(spark, sf), structure_edges(spark, sf)
    kind = lambda t: nodes.filter(F.col("type") == t)
    folded, _ = X.fold_children_into_articles(kind("Article"), kind("Clause"), kind("Table"), edges)
    return folded.select("doc_id", "id", "ord", F.md5("full_text").alias("text_key"), F.length("full_text").cast("bigint").alias("n_chars"))


@query(
    "t08_partition_nodes",
    """WITH n AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, CASE l_suppkey % 7 WHEN 0 THEN 'document' WHEN 1 THEN 'CHAPTER' WHEN 2 THEN 'Article' WHEN 3 THEN 'point'
      WHEN 4 THEN 'DataTable' WHEN 5 THEN 'Footnote' ELSE 'Table' END AS raw FROM lineitem),
    t AS (SELECT *, upper(substr(raw, 1, 1)) || lower(substr(raw, 2)) AS c FROM n),
    k AS (SELECT doc_id, ord, CASE WHEN c IN ('Document','Chapter','Article','Clause','Point','Table') THEN c WHEN contains(lower(raw), 'table') THEN 'Table' ELSE 'Clause' END AS type FROM t),
    f AS (SELECT doc_id, min(ord) AS first_doc FROM k WHERE type = 'Document' GROUP BY ALL)
    SELECT k.doc_id, ord, type, CASE WHEN type IN ('Clause','Point') THEN 'clause' ELSE lower(type) END AS kind FROM k LEFT JOIN f USING (doc_id) WHERE type <> 'Document' OR ord = first_doc""",
)
def t08(spark, sf):
    raw = F.element_at(
        F.array(*[F.lit(x) for x in ("document", "CHAPTER", "Article", "point", "DataTable", "Footnote", "Table")]),
        (F.col("l_suppkey") % 7 + 1).cast("int"),
    )
    n = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), big("l_linenumber").alias("ord"), raw.alias("type"))
    return X.partition_nodes(n)


# -- orders as legal documents, order lines as their modifications ------------

LAW_DOCS = """law AS (SELECT o_orderkey AS doc_id,
  CASE o_orderstatus WHEN 'O' THEN 'Quyết định số ' || (o_orderkey % 1000) || ' sửa đổi, bổ sung quy chế' WHEN 'F' THEN 'Quy chế ' || o_custkey || '/QĐ-ABC' ELSE 'Thông báo' END AS title,
  o_orderpriority AS full_text, o_orderkey || '-qd-abc.pdf' AS source_file FROM orders),
law_sig AS (SELECT *, regexp_matches(lower(title || ' ' || full_text || ' ' || source_file), 'sửa đổi|bổ sung|cập nhật|thay thế|điều chỉnh|1393') AS is_amendment,
  coalesce(nullif(regexp_extract(title, '(?i)(\\d+)/QĐ-ABC', 1), ''), nullif(regexp_extract(title, '(?i)Quyết định (?:số )?(\\d+)', 1), ''),
    nullif(regexp_extract(source_file, '(?i)(\\d+)[_-]?qd[_-]?abc', 1), '')) || '/QĐ-ABC' AS signature FROM law),
law_mods AS (SELECT l_orderkey AS doc_id, 'dieu_' || l_linenumber AS source_text_id, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_suppkey || '/QĐ-ABC' END AS target_document_signature,
  l_linenumber AS ord FROM lineitem)"""


def law_documents(spark, sf):
    o = table(spark, sf, "orders")
    s = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("doc_id"),
        F.when(s == "O", F.concat(F.lit("Quyết định số "), (F.col("o_orderkey") % 1000).cast("string"), F.lit(" sửa đổi, bổ sung quy chế")))
        .when(s == "F", F.concat(F.lit("Quy chế "), F.col("o_custkey").cast("string"), F.lit("/QĐ-ABC"))).otherwise("Thông báo").alias("title"),
        F.col("o_orderpriority").alias("full_text"), F.concat(F.col("o_orderkey").cast("string"), F.lit("-qd-abc.pdf")).alias("source_file"),
    )


def law_modifications(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("dieu_"), F.col("l_linenumber").cast("string")).alias("source_text_id"),
        F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.col("l_suppkey").cast("string"), F.lit("/QĐ-ABC"))).alias("target_document_signature"),
        big("l_linenumber").alias("ord"),
    )


@query("t09_is_amendment", f"WITH {LAW_DOCS} SELECT doc_id, is_amendment FROM law_sig")
def t09(spark, sf):
    return X.is_amendment(law_documents(spark, sf)).select("doc_id", "is_amendment")


@query("t10_document_signature", f"WITH {LAW_DOCS} SELECT doc_id, signature FROM law_sig")
def t10(spark, sf):
    return X.document_signature(law_documents(spark, sf), "ABC", "abc").select("doc_id", "signature")


@query(
    "t11_clean_modifications",
    f"""WITH {LAW_DOCS} SELECT m.doc_id, m.source_text_id, m.target_document_signature, m.ord FROM law_mods m JOIN law_sig d USING (doc_id)
    WHERE is_amendment AND target_document_signature <> '' AND regexp_extract(target_document_signature, '\\d+') <> regexp_extract(signature, '\\d+')""",
)
def t11(spark, sf):
    docs = X.document_signature(X.is_amendment(law_documents(spark, sf)), "ABC", "abc")
    return X.clean_modifications(law_modifications(spark, sf), docs)[0]


NORM = """CASE WHEN regexp_matches({c}, '^chuong_[ivxlcdm]+_.*$') THEN regexp_extract({c}, '^(chuong_[ivxlcdm]+)_', 1)
  WHEN regexp_matches({c}, '^chuong_\\d+_.*$') THEN regexp_extract({c}, '^(chuong_\\d+)_', 1)
  WHEN regexp_matches({c}, '^dieu_\\d+_.*$') THEN regexp_extract({c}, '^(dieu_\\d+)_', 1)
  WHEN regexp_matches({c}, '^khoan_\\d+_dieu_\\d+_.*$') THEN regexp_extract({c}, '^(khoan_\\d+_dieu_\\d+)_', 1) ELSE {c} END"""


def norm_sql(c: str) -> str:
    t = f"({NORM.format(c=f'trim(lower({c}))')})"
    cases = " ".join(f"WHEN 'chuong_{r}' THEN 'chuong_{a}'" for r, a in X.ROMAN.items())
    return f"(CASE {t} {cases} ELSE {t} END)"


@query(
    "t12_normalize_node_id",
    f"""WITH {SNODES} SELECT doc_id, ord, id, {norm_sql('id')} AS norm_id, TRY_CAST(nullif(regexp_extract(id, 'dieu_(\\d+)', 1), '') AS BIGINT) AS article_number FROM snodes""",
)
def t12(spark, sf):
    return structure_nodes(spark, sf).select(
        "doc_id", "ord", "id", X.normalize_node_id(F.col("id")).alias("norm_id"), X.article_number(F.col("id")).alias("article_number")
    )


DEDUP = f"""
normed AS MATERIALIZED (SELECT *, {norm_sql('id')} AS norm_id FROM snodes),
best AS MATERIALIZED (SELECT doc_id, norm_id AS id, type, title, full_text, page, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, norm_id ORDER BY length(full_text) DESC, ord) AS n FROM normed) WHERE n = 1)"""


@query("t13_dedupe_nodes_longest", f"WITH {SNODES}, {DEDUP} SELECT doc_id, id, type, title, md5(full_text) AS text_key, page, ord FROM best")
def t13(spark, sf):
    best, _ = X.dedupe_nodes_longest(structure_nodes(spark, sf))
    return best.select("doc_id", "id", "type", "title", F.md5("full_text").alias("text_key"), "page", "ord")


FIXED = f"""
ends AS MATERIALIZED (SELECT doc_id, {norm_sql('source')} AS source, {norm_sql('target')} AS target, type, ord FROM sedges),
judged AS MATERIALIZED (SELECT e.*, (a.id IS NOT NULL AND b.id IS NOT NULL) AS ok FROM ends e LEFT JOIN best a ON a.doc_id = e.doc_id AND a.id = e.source LEFT JOIN best b ON b.doc_id = e.doc_id AND b.id = e.target)"""


@query("t14_fix_edges", f"WITH {SNODES}, {DEDUP}, {FIXED} SELECT doc_id, source, target, type, min(ord) AS ord FROM judged WHERE ok GROUP BY ALL")
def t14(spark, sf):
    best, id_map = X.dedupe_nodes_longest(structure_nodes(spark, sf))
    return X.fix_edges(structure_edges(spark, sf), id_map, best)[0]


WORD_TOPICS = {"fr": ["que", "aux", "eau"], "de": ["sch", "und", "der"], "en": ["the", "and", "hou"], "es": ["los", "con", "ado"]}


def _bleed_sql(src: str) -> str:
    has = lambda c, ws: " OR ".join(f"contains({c}, '{w}')" for w in ws)
    num = lambda c, ws: " + ".join(f"CAST(contains({c}, '{w}') AS INTEGER)" for w in ws)
    exp = "CASE " + " ".join(f"WHEN {has('t', ws)} THEN '{t}'" for t, ws in WORD_TOPICS.items()) + " END"
    det = "CASE " + " ".join(f"WHEN expected_topic <> '{t}' AND n_{t} >= 2 THEN '{t}'" for t in WORD_TOPICS) + " END"
    nd = "CASE detected_topic " + " ".join(f"WHEN '{t}' THEN n_{t}" for t in WORD_TOPICS) + " END"
    return f"""bl0 AS (SELECT doc_id, id, lower(title) AS t, substr(lower(full_text), 1, 500) AS b FROM {src}),
    bl1 AS (SELECT doc_id, id, {exp} AS expected_topic, {', '.join(f"({num('b', ws)}) AS n_{t}" for t, ws in WORD_TOPICS.items())} FROM bl0),
    bl2 AS (SELECT *, {det} AS detected_topic FROM bl1 WHERE expected_topic IS NOT NULL),
    bleed AS (SELECT doc_id, id, expected_topic, detected_topic, CASE WHEN {nd} >= 3 THEN 'high' ELSE 'medium' END AS severity FROM bl2 WHERE detected_topic IS NOT NULL)"""


@query("t15_detect_content_bleed", f"WITH arts AS (SELECT doc_id, 'd' AS id, string_split(text, chr(10))[1] AS title, text AS full_text FROM documents), {_bleed_sql('arts')} SELECT * FROM bleed")
def t15(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.lit("d").alias("id"), F.element_at(F.split("text", "\n"), 1).alias("title"), F.col("text").alias("full_text"))
    return X.detect_content_bleed(docs, WORD_TOPICS)


def _trunc_sql(c: str) -> str:
    t = S.strip(c)
    return f"({t} <> '' AND (" + " OR ".join(f"regexp_matches({t}, '{p}')" for p in X.TRUNCATED) + "))"


@query(
    "t16_detect_truncation",
    f"""WITH {SNODES}, l AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'Điểm bằng với' WHEN 2 THEN 'Sinh viên và ' WHEN 3 THEN 'Quy định...' WHEN 4 THEN 'Hoàn thành học phần.' WHEN 5 THEN 'gồm:' ELSE 'số ' || l_suppkey END AS t FROM lineitem)
    SELECT doc_id AS k1, ord AS k2, {_trunc_sql('full_text')} AS truncated FROM snodes UNION ALL SELECT -l_orderkey - 1, l_linenumber, {_trunc_sql('t')} FROM l""",
)
def t16(spark, sf):
    n = F.col("l_linenumber")
    t = F.when(n == 1, "Điểm bằng với").when(n == 2, "Sinh viên và ").when(n == 3, "Quy định...").when(n == 4, "Hoàn thành học phần.").when(n == 5, "gồm:").otherwise(
        F.concat(F.lit("số "), F.col("l_suppkey").cast("string")))
    l = table(spark, sf, "lineitem").select((-F.col("l_orderkey") - 1).alias("k1"), n.cast("bigint").alias("k2"), t.alias("t"))
    s = structure_nodes(spark, sf).select(F.col("doc_id").alias("k1"), F.col("ord").alias("k2"), F.col("full_text").alias("t"))
    return s.unionByName(l).select("k1", "k2", X.is_truncated(F.col("t")).alias("truncated"))


@query(
    "t17_clean_extraction",
    f"""WITH {SNODES}, {DEDUP}, {FIXED},
    docs AS (SELECT doc_id, regexp_matches(lower(string_split(text, chr(10))[1] || ' ' || text || ' ' || source || '-' || doc_id || '-qd-abc'), '(?i)the|sch') AS is_amendment, doc_id || '/QĐ-ABC' AS signature FROM documents),
    arts AS (SELECT * FROM best WHERE type = 'Article'), {_bleed_sql('arts')},
    mods AS (SELECT doc_id, CASE WHEN quality = 1 THEN (doc_id * (1 + toxic)) || '/QĐ-ABC' ELSE '' END AS target FROM labels),
    mr AS (SELECT doc_id, count(*) FILTER (NOT (is_amendment AND target <> '' AND target <> signature)) AS n FROM mods JOIN docs USING (doc_id) GROUP BY ALL),
    a AS (SELECT doc_id, count(*) AS n FROM snodes GROUP BY ALL), b AS (SELECT doc_id, count(*) AS n FROM best GROUP BY ALL),
    o AS (SELECT doc_id, count(*) FILTER (NOT ok) AS n FROM judged GROUP BY ALL), bl AS (SELECT doc_id, count(*) AS n FROM bleed GROUP BY ALL),
    tr AS (SELECT doc_id, count(*) AS n FROM arts WHERE {_trunc_sql('full_text')} GROUP BY ALL)
    SELECT d.doc_id, d.is_amendment, coalesce(a.n, 0) AS original_nodes, coalesce(b.n, 0) AS cleaned_nodes, coalesce(o.n, 0) AS n_orphans, coalesce(mr.n, 0) AS n_removed,
      coalesce(bl.n, 0) AS n_bleed, coalesce(tr.n, 0) AS n_truncated, coalesce(a.n, 0) - coalesce(b.n, 0) AS duplicates_removed
    FROM docs d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN mr USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN tr USING (doc_id)""",
)
def t17(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.element_at(F.split("text", "\n"), 1).alias("title"), F.col("text").alias("full_text"),
        F.concat_ws("-", "source", F.col("doc_id").cast("string"), F.lit("qd-abc")).alias("source_file"),
    )
    mods = table(spark, sf, "labels").select(
        "doc_id", F.lit("a").alias("source_text_id"),
        F.when(F.col("quality") == 1, F.concat((F.col("doc_id") * (1 + F.col("toxic"))).cast("string"), F.lit("/QĐ-ABC"))).otherwise("").alias("target_document_signature"),
        F.lit(0).alias("ord"),
    )
    return X.clean_extraction(d, structure_nodes(spark, sf), structure_edges(spark, sf), mods, "ABC", "abc", ["the", "sch"], WORD_TOPICS)["stats"]


@query(
    "t18_link_orphan_clauses",
    f"""WITH {LAW_DOCS},
    arts AS (SELECT l_orderkey AS doc_id, 'dieu_' || l_linenumber AS id, CASE WHEN l_quantity > 25 THEN 'Cập nhật ' || l_partkey ELSE 'Nội dung' END AS full_text, l_linenumber AS ord FROM lineitem),
    main AS (SELECT doc_id, arg_min(id, CASE WHEN regexp_matches(lower(arts.full_text), 'cập nhật|sửa đổi|bổ sung|như sau') THEN 0 ELSE 1000 END + ord) AS source FROM arts JOIN law USING (doc_id)
             WHERE regexp_matches(lower(title), 'sửa đổi|bổ sung|cập nhật|thay thế') GROUP BY ALL),
    cl AS (SELECT l_orderkey AS doc_id, 'khoan_' || l_linenumber AS id, 'Khoản ' || min(l_suppkey % 9) || ' Điều ' || l_linenumber AS title, l_linenumber AS ord FROM lineitem GROUP BY l_orderkey, l_linenumber),
    held AS (SELECT DISTINCT l_orderkey AS doc_id, 'khoan_' || (l_linenumber + 1) AS id FROM lineitem WHERE l_discount > 0.05)
    SELECT c.doc_id, source, c.id AS target, 'CONTAINS' AS type, ord, title AS modifies FROM cl c JOIN main USING (doc_id) LEFT JOIN held h USING (doc_id, id) WHERE h.id IS NULL""",
)
def t18(spark, sf):
    l = table(spark, sf, "lineitem")
    num = F.col("l_linenumber").cast("string")
    arts = l.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("dieu_"), num).alias("id"),
                    F.when(F.col("l_quantity") > 25, F.concat(F.lit("Cập nhật "), F.col("l_partkey").cast("string"))).otherwise("Nội dung").alias("full_text"), big("l_linenumber").alias("ord"))
    clauses = l.groupBy(F.col("l_orderkey").alias("doc_id"), "l_linenumber").agg(F.min(F.col("l_suppkey") % 9).alias("no")).select(
        "doc_id", F.concat(F.lit("khoan_"), num).alias("id"), F.concat(F.lit("Khoản "), F.col("no").cast("string"), F.lit(" Điều "), num).alias("title"), big("l_linenumber").alias("ord"))
    edges = l.filter("l_discount > 0.05").select(F.col("l_orderkey").alias("doc_id"), F.lit("x").alias("source"),
                                                F.concat(F.lit("khoan_"), (F.col("l_linenumber") + 1).cast("string")).alias("target"), F.lit("CONTAINS").alias("type"), big("l_linenumber").alias("ord"))
    return X.link_orphan_clauses(law_documents(spark, sf), arts, clauses, edges)


@query(
    "t19_qualify_ids",
    """SELECT 'entity' AS kind, l_orderkey AS k, 'dieu_' || l_orderkey || '_ent_' || l_linenumber AS a, NULL AS b FROM lineitem
    UNION ALL SELECT 'relation', l_orderkey, 'dieu_' || l_orderkey || '_ent_' || l_linenumber, 'dieu_' || l_orderkey || '_ent_' || (l_suppkey % 8) FROM lineitem
    UNION ALL SELECT 'modification', l_orderkey, CASE WHEN l_returnflag = 'N' THEN 'dieu_' || l_orderkey ELSE 'src_' || l_linenumber END, NULL FROM lineitem""",
)
def t19(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("article_id", F.concat(F.lit("dieu_"), F.col("l_orderkey").cast("string")))
    k = F.col("l_orderkey").alias("k")
    ents = l.select("article_id", k, F.col("l_linenumber").alias("id"))
    rels = l.select("article_id", k, F.col("l_linenumber").alias("source_id"), (F.col("l_suppkey") % 8).alias("target_id"))
    mods = l.select("article_id", k, F.when(F.col("l_returnflag") != "N", F.concat(F.lit("src_"), F.col("l_linenumber").cast("string"))).otherwise("").alias("source_text_id"))
    e, r, m = X.qualify_ids(ents, rels, mods)
    none = F.lit(None).cast("string").alias("b")
    return (
        e.select(F.lit("entity").alias("kind"), "k", F.col("id").alias("a"), none)
        .unionByName(r.select(F.lit("relation").alias("kind"), "k", F.col("source_id").alias("a"), F.col("target_id").alias("b")))
        .unionByName(m.select(F.lit("modification").alias("kind"), "k", F.col("source_text_id").alias("a"), none))
    )


LAW_ARTICLES = """law_articles AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, 'Điều ' || (l_partkey % 50) || '. Nội dung' AS title,
  CASE l_linenumber % 4 WHEN 0 THEN 'Sửa đổi Khoản ' || (l_suppkey % 9) || ' Điều ' || (l_partkey % 40) || ' Quyết định số ' || l_orderkey || ' và Khoản 2 Điều ' || l_linenumber
    WHEN 1 THEN 'Điểm ' || chr(CAST(97 + l_suppkey % 5 AS INTEGER)) || ' Khoản ' || (l_suppkey % 9) || ' Điều ' || (l_partkey % 40) || ' được giữ nguyên.'
    WHEN 2 THEN 'Áp dụng cho sinh viên khóa ' || l_suppkey ELSE 'Điều chỉnh mức ' || l_quantity END AS full_text FROM lineitem)"""


def law_articles(spark, sf):
    l = table(spark, sf, "lineitem")
    s = lambda e: F.expr(f"cast({e} as string)")
    c = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    m = F.col("l_linenumber") % 4
    text = (
        F.when(m == 0, c("Sửa đổi Khoản ", s("l_suppkey % 9"), " Điều ", s("l_partkey % 40"), " Quyết định số ", s("l_orderkey"), " và Khoản 2 Điều ", s("l_linenumber")))
        .when(m == 1, c("Điểm ", F.expr("char(97 + l_suppkey % 5)"), " Khoản ", s("l_suppkey % 9"), " Điều ", s("l_partkey % 40"), " được giữ nguyên."))
        .when(m == 2, c("Áp dụng cho sinh viên khóa ", s("l_suppkey"))).otherwise(c("Điều chỉnh mức ", s("l_quantity")))
    )
    return l.select(F.col("l_orderkey").alias("doc_id"), big("l_linenumber").alias("ord"), c("Điều ", s("l_partkey % 50"), ". Nội dung").alias("title"), text.alias("full_text"))


@query(
    "t20_amendment_references",
    f"""WITH {LAW_ARTICLES}, b AS (SELECT *, title || ' ' || full_text AS t FROM law_articles),
    r AS (SELECT doc_id, ord, regexp_extract_all(t, '(?i)khoản\\s+\\d+\\s+điều\\s+\\d+') AS cr, regexp_extract_all(t, '(?i)điểm\\s+[a-z]\\s+khoản\\s+\\d+\\s+điều\\s+\\d+') AS pr,
      regexp_matches(lower(t), 'sửa đổi|bổ sung|cập nhật|thay thế|điều chỉnh') AS kw, nullif(regexp_extract(t, '(?i)quyết\\s+định\\s+(?:số\\s+)?(\\d+)', 1), '') AS dd FROM b)
    SELECT doc_id, ord, array_to_string(cr, '|') AS clause_refs, array_to_string(pr, '|') AS point_refs, kw AS has_keyword, coalesce(dd, '790') AS target_document, (kw OR len(cr) > 0 OR len(pr) > 0) AS is_amendment FROM r""",
)
def t20(spark, sf):
    return X.amendment_references(law_articles(spark, sf)).select(
        "doc_id", "ord", F.concat_ws("|", "clause_refs").alias("clause_refs"), F.concat_ws("|", "point_refs").alias("point_refs"),
        "has_keyword", "target_document", "is_amendment",
    )


@query(
    "t21_aggregate_extraction",
    """SELECT conv_id AS doc_id, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS entities, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS relations,
    CAST(sum(len(string_split(text, '. '))) AS BIGINT) AS modifications, count(*) FILTER (role = 'system') AS errors, count(*) AS articles, round(avg(length(text)), 6) AS elapsed_per_article FROM conversations GROUP BY ALL""",
)
def t21(spark, sf):
    st = lambda sep: F.transform(F.split("text", sep), lambda x: F.struct(x.alias("text")))
    res = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("article_id"), st(" ").alias("entities"), st("\n").alias("relations"), st(r"\. ").alias("modifications"),
        F.when(F.col("role") == "system", F.array(F.lit("skipped"))).otherwise(F.expr("cast(array() as array<string>)")).alias("errors"), F.length("text").alias("elapsed"),
    )
    return X.aggregate_extraction(res)[1].withColumn("elapsed_per_article", F.round("elapsed_per_article", 6))


def chunk_inputs(spark, sf):
    b = lines(spark, sf).withColumns({"aid": F.concat_ws("_", F.lit("dieu"), F.col("i").cast("string"))})
    m = F.col("i") % 5
    arts = b.filter(m.isin(0, 1, 2)).select(
        "doc_id", F.col("aid").alias("id"), F.concat(F.lit("Điều "), F.col("i").cast("string"), F.lit(". "), F.col("line")).alias("title"),
        F.when(m == 0, F.col("i")).cast("int").alias("number"), F.expr("cast(i div 3 as int)").alias("page"), F.concat(F.lit("Chương "), F.expr("cast(i div 20 as string)")).alias("chapter"),
        F.col("line").alias("full_text"), F.col("i").alias("ord"),
    )
    pieces = b.filter(m == 1).select("doc_id", F.col("aid").alias("article_id"), F.posexplode(F.split("line", r"\. ")).alias("p", "full_text"))
    clauses = pieces.select(
        "doc_id", "article_id", (F.col("p") + 1).alias("idx"), F.when(F.col("p") % 2 == 0, F.concat_ws("_", F.lit("k"), F.col("p").cast("string"), "article_id")).alias("id"),
        F.when(F.col("p") % 3 == 0, F.col("full_text")).otherwise("").alias("title"), "full_text",
    )
    alone = b.filter(m == 4).select(
        "doc_id", F.concat_ws("_", F.lit("khoan"), F.col("i").cast("string")).alias("id"), F.concat(F.lit("Khoản 1 Điều "), F.expr("cast(i div 5 as string)")).alias("title"),
        F.expr("cast(i div 3 as int)").alias("page"), F.lit(None).cast("string").alias("chapter"), F.col("line").alias("full_text"), F.col("i").alias("ord"),
    )
    rel = b.filter(m == 3).select(
        "doc_id", F.concat_ws("_", F.lit("dieu"), (F.col("i") - 1).cast("string")).alias("source_id"), F.col("line").alias("evidence"), F.col("i").alias("ord"),
    ).unionByName(b.filter(m == 2).select("doc_id", F.concat_ws("_", F.lit("k_0_dieu"), (F.col("i") - 1).cast("string")).alias("source_id"), F.col("line").alias("evidence"), F.col("i").alias("ord")))
    return arts, clauses, alone, X.evidence_lists(rel)


_T22 = SNODES + """,
arts AS (SELECT doc_id, 'dieu_' || i AS article_id, 'Điều ' || i || '. ' || line AS article_title, i AS number, i // 3 AS page, 'Chương ' || (i // 20) AS chapter, line, i FROM lines WHERE i % 5 IN (0, 1, 2)),
pieces AS (SELECT doc_id, 'dieu_' || i AS article_id, unnest(ps) AS full_text, generate_subscripts(ps, 1) AS idx FROM (SELECT doc_id, i, string_split(line, '. ') AS ps FROM lines WHERE i % 5 = 1)),
cl AS (SELECT doc_id, article_id, idx, CASE WHEN idx % 2 = 1 THEN 'k_' || (idx - 1) || '_' || article_id ELSE 'khoan_' || idx || '_' || article_id END AS id, CASE WHEN idx % 3 = 1 THEN full_text ELSE '' END AS title, full_text FROM pieces),
ev AS (SELECT doc_id, source_id, string_agg(e, ' | ' ORDER BY i, e) AS evidence FROM (SELECT doc_id, 'dieu_' || (i - 1) AS source_id, line AS e, i FROM lines WHERE i % 5 = 3
   UNION ALL SELECT doc_id, 'k_0_dieu_' || (i - 1), line, i FROM lines WHERE i % 5 = 2) GROUP BY ALL),
rws AS (SELECT a.doc_id, coalesce(c.id, a.article_id) AS source_id, a.number AS article_number, article_title, page, chapter, CASE WHEN c.idx IS NULL THEN 'article' ELSE 'clause' END AS structure_type, c.idx AS clause_index,
    concat_ws(chr(10), article_title, CASE WHEN c.title <> article_title AND c.title <> '' THEN c.title END, nullif(CASE WHEN c.idx IS NULL THEN line ELSE c.full_text END, '')) AS body, 0 AS o1, i AS o2
  FROM arts a LEFT JOIN cl c USING (doc_id, article_id)
  UNION ALL SELECT doc_id, 'khoan_' || i, i // 5, 'Khoản 1 Điều ' || (i // 5), i // 3, NULL, 'clause', NULL, 'Khoản 1 Điều ' || (i // 5) || chr(10) || line, 1, i FROM lines WHERE i % 5 = 4),
built AS MATERIALIZED (SELECT r.*, CASE WHEN evidence IS NULL THEN body ELSE body || chr(10) || '[Ngữ cảnh: ' || evidence || ']' END AS content FROM rws r LEFT JOIN ev USING (doc_id, source_id))"""


@query(
    "t22_build_chunks",
    f"WITH {_T22} SELECT doc_id, source_id, md5(content) AS content_key, article_number, article_title, page AS page_number, chapter, structure_type, clause_index FROM built",
)
def t22(spark, sf):
    return X.build_chunks(*chunk_inputs(spark, sf)).select(
        "doc_id", "source_id", F.md5("content").alias("content_key"), big("article_number"), "article_title", big("page_number"), "chapter", "structure_type", big("clause_index")
    )


@query(
    "t23_chunks_to_documents",
    f"""WITH {_T22} SELECT doc_id, source_id AS chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY o1, o2, coalesce(clause_index, 0), source_id) - 1 AS chunk_index, chapter AS section, page,
    concat_ws('|', source_id, article_number, structure_type, doc_id, chapter, clause_index) AS extra FROM built""",
)
def t23(spark, sf):
    d = X.chunks_to_documents(X.build_chunks(*chunk_inputs(spark, sf)))
    extra = F.concat_ws("|", *[F.element_at("extra", F.lit(k)) for k in ("source_id", "article_number", "structure_type", "filename", "chapter", "clause_index")])
    return d.select("doc_id", "chunk_id", big("chunk_index"), "section", big("page"), extra.alias("extra"))


_LABELS = "['MonHoc','khoa','NGANH','QuyDinh','dieu_kien','Other Thing']"


@query(
    "t24_standardize_label",
    f"""WITH p AS (SELECT p_partkey, {_LABELS}[p_size % 6 + 1] AS label FROM part)
    SELECT p_partkey, CASE label WHEN 'MonHoc' THEN 'MON_HOC' WHEN 'QuyDinh' THEN 'QUY_DINH' ELSE upper(label) END AS label FROM p""",
)
def t24(spark, sf):
    return graph_parts(spark, sf).select(F.col("id").alias("p_partkey"), L.standardize_label(F.col("label")).alias("label"))


def graph_parts(spark, sf):
    labels = F.array(*[F.lit(x) for x in ("MonHoc", "khoa", "NGANH", "QuyDinh", "dieu_kien", "Other Thing")])
    key = F.col("p_partkey").cast("string")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.element_at(labels, F.col("p_size") % 6 + 1).alias("label"), "p_name", "p_brand", "p_type", "p_size",
        F.map_from_arrays(
            F.array(F.lit("code"), F.lit("name"), F.lit("so_tin_chi"), F.lit("brand")),
            F.array(F.concat(F.lit("MON_HOC_("), key, F.lit(")_")), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_name")), (F.col("p_size") % 3).cast("string"), F.col("p_brand")),
        ).alias("props"),
    )


@query("t25_clean_id", "SELECT p_partkey, trim(replace(replace(regexp_replace(['MON_HOC_','KHOA_','X_',''][p_size % 4 + 1] || '_(' || p_brand || ')_', '^(MON_HOC_|KHOA_|NGANH_|QUY_DINH_|DIEU_KIEN_)', ''), '(', ''), ')', ''), '_') AS clean FROM part")
def t25(spark, sf):
    pre = F.element_at(F.array(*[F.lit(x) for x in ("MON_HOC_", "KHOA_", "X_", "")]), F.col("p_size") % 4 + 1)
    return table(spark, sf, "part").select("p_partkey", L.clean_id(F.concat(pre, F.lit("_("), "p_brand", F.lit(")_"))).alias("clean"))


_STD = f"""p AS (SELECT p_partkey AS id, CASE {_LABELS}[p_size % 6 + 1] WHEN 'MonHoc' THEN 'MON_HOC' WHEN 'QuyDinh' THEN 'QUY_DINH' ELSE upper({_LABELS}[p_size % 6 + 1]) END AS label,
    p_partkey::VARCHAR AS cid, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_name END AS name, (p_size % 3)::VARCHAR AS credits, p_brand FROM part),
std AS (SELECT id, label, CASE label WHEN 'MON_HOC' THEN 'ma_mon' WHEN 'KHOA' THEN 'ma_khoa' WHEN 'NGANH' THEN 'ma_nganh' WHEN 'QUY_DINH' THEN 'ma_quy_dinh' WHEN 'DIEU_KIEN' THEN 'ma_dieu_kien' ELSE 'id' END AS key, cid AS value FROM p
  UNION ALL SELECT id, label, CASE label WHEN 'MON_HOC' THEN 'ten_mon' WHEN 'KHOA' THEN 'ten_khoa' WHEN 'NGANH' THEN 'ten_nganh' WHEN 'QUY_DINH' THEN 'tieu_de' WHEN 'DIEU_KIEN' THEN 'mo_ta' ELSE 'name' END, CASE WHEN name = '' THEN cid ELSE name END FROM p
  UNION ALL SELECT id, label, 'so_tin_chi', credits FROM p UNION ALL SELECT id, label, 'brand', p_brand FROM p)"""


@query("t26_standardize_props", f"WITH {_STD} SELECT * FROM std")
def t26(spark, sf):
    return L.standardize_props(graph_parts(spark, sf)).select("id", "label", F.explode("props").alias("key", "value"))


@query(
    "t27_validate_props",
    f"""WITH {_STD}, d AS (SELECT id, label, max(CASE WHEN key = 'so_tin_chi' THEN value END) AS c FROM std GROUP BY ALL)
    SELECT id, label, CASE WHEN label = 'MON_HOC' AND c = '0' THEN 'so_tin_chi' ELSE '' END AS missing, NOT (label = 'MON_HOC' AND c = '0') AS is_valid FROM d""",
)
def t27(spark, sf):
    return L.validate_props(L.standardize_props(graph_parts(spark, sf))).select("id", "label", F.concat_ws(",", "missing").alias("missing"), "is_valid")


@query(
    "t28_to_graph_models",
    """WITH c AS (SELECT p_partkey, ['MON_HOC','TIN_CHI','KHOA','THOI_GIAN'][p_size % 4 + 1] AS t FROM part)
    SELECT 'node' AS kind, 'a' || o_orderkey AS a, 'QUY_DINH' AS label, o_orderpriority AS b FROM orders
    UNION ALL SELECT 'node', 'e' || p_partkey, CASE WHEN t IN ('MON_HOC', 'KHOA') THEN t ELSE 'DIEU_KIEN' END, NULL FROM c
    UNION ALL SELECT 'edge', 'a' || l_orderkey, CASE l_returnflag WHEN 'A' THEN 'YEU_CAU' WHEN 'N' THEN 'LIEN_QUAN_NOI_DUNG' ELSE 'THAY_THE' END, 'e' || l_partkey FROM lineitem""",
)
def t28(spark, sf):
    arts = table(spark, sf, "orders").select(F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("full_text"))
    kinds = F.array(*[F.lit(x) for x in ("MON_HOC", "TIN_CHI", "KHOA", "THOI_GIAN")])
    ents = table(spark, sf, "part").select(
        F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("id"), F.element_at(kinds, F.col("p_size") % 4 + 1).alias("type"),
        F.col("p_name").alias("text"), F.lower("p_name").alias("normalized"), F.lit(None).cast("string").alias("source_article_id"))
    rel_type = F.when(F.col("l_returnflag") == "A", "YEU_CAU").when(F.col("l_returnflag") == "N", "GIOI_HAN").otherwise("THAY_THE")
    rels = table(spark, sf, "lineitem").select(
        F.concat(F.lit("a"), F.col("l_orderkey").cast("string")).alias("source_id"), F.concat(F.lit("e"), F.col("l_partkey").cast("string")).alias("target_id"),
        rel_type.alias("type"), F.lit("x").alias("evidence"))
    n, e = L.to_graph_models(arts, ents, rels)
    return n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), "label", F.element_at("props", F.lit("title")).alias("b")).unionByName(
        e.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("type").alias("label"), F.col("dst").alias("b")))


@query(
    "t29_extraction_items",
    f"""WITH {SNODES} SELECT doc_id, id, title, md5(full_text) AS text_key, type AS kind FROM snodes WHERE type IN ('Article', 'Clause')""",
)
def t29(spark, sf):
    items = X.extraction_items(X.partition_nodes(structure_nodes(spark, sf)))
    return items.select("doc_id", "id", "title", F.md5("text").alias("text_key"), "kind")
