"""SQL fragments shared by the check queries (DuckDB dialect)."""

from __future__ import annotations

from quernstone.functions import text as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def strip(c: str) -> str:
    return f"regexp_replace({c}, {lit('^' + T.WS + '+|' + T.WS + '+$')}, '', 'g')"


def fold(c: str) -> str:
    src, dst = T.fold_tables()
    return f"translate({c}, {lit(src)}, {lit(dst)})"


def mapped_lower(c: str) -> str:
    return f"lower(translate({c}, {lit(T.CHAR_MAP_FROM)}, {lit(T.CHAR_MAP_TO)}))"


def tokens(c: str) -> str:
    return f"regexp_extract_all({mapped_lower(c)}, {lit(T.TOKEN)})"


STOPS = in_list(T.stop_list())

CHUNKS = f"""
chunks AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) || '_' || CAST(chunk_index AS VARCHAR) AS chunk_id, chunk_index, text,
         title, doc_type, language, year, faculty
  FROM (SELECT doc_id, source AS doc_type, lang AS language, CAST(2018 + doc_id % 8 AS INTEGER) AS year,
               ['science','arts','law','medicine','economics'][CAST(doc_id % 5 + 1 AS INTEGER)] AS faculty,
               lines[1] AS title, unnest(lines) AS text,
               generate_subscripts(lines, 1) - 1 AS chunk_index
        FROM (SELECT *, string_split(text, chr(10)) AS lines FROM documents))
  WHERE {strip('text')} <> ''
)"""

QUERIES = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"


def positions(src: str, keys: str, fields: tuple[str, ...] = ("text", "title")) -> str:
    """CTEs pos_tokens (keys, field, pos, tok) and forms (keys, field, pos, term)."""
    parts = " UNION ALL ".join(
        f"SELECT {keys}, '{f}' AS field, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos "
        f"FROM (SELECT {keys}, {tokens(f)} AS toks FROM {src})"
        for f in fields
    )
    return f"""
pos_tokens AS MATERIALIZED (SELECT *, {fold('tok')} AS folded FROM ({parts})),
forms AS MATERIALIZED (
  SELECT {keys}, field, pos, folded AS term FROM pos_tokens WHERE folded NOT IN {STOPS}
  UNION ALL
  SELECT {keys}, field, pos, tok AS term FROM pos_tokens WHERE tok <> folded AND tok NOT IN {STOPS}
),
lens AS MATERIALIZED (SELECT {keys}, field, count(DISTINCT pos) AS dl FROM forms GROUP BY ALL),
postings AS MATERIALIZED (
  SELECT {keys}, field, term, dl, count(*) AS tf FROM forms JOIN lens USING ({keys}, field) GROUP BY ALL
),
term_stats AS MATERIALIZED (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL),
totals AS MATERIALIZED (SELECT field, count(*) AS n_docs, avg(dl) AS avg_dl FROM lens GROUP BY ALL)"""


QUERY_FORMS = f"""
q_tokens AS MATERIALIZED (
  SELECT query_id, tok, {fold('tok')} AS folded, pos
  FROM (SELECT query_id, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos
        FROM (SELECT query_id, {tokens('text')} AS toks FROM queries))
),
q_forms AS MATERIALIZED (
  SELECT query_id, pos, folded AS term FROM q_tokens WHERE folded NOT IN {STOPS}
  UNION ALL SELECT query_id, pos, tok FROM q_tokens WHERE tok <> folded AND tok NOT IN {STOPS}
),
q_terms AS MATERIALIZED (SELECT query_id, term, count(*) AS weight FROM q_forms GROUP BY ALL)"""

BM25 = """
field_scores AS MATERIALIZED (
  SELECT query_id, doc_id, chunk_id, field,
         sum(weight * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS s
  FROM q_terms JOIN postings USING (term) JOIN term_stats USING (field, term) JOIN totals USING (field)
  GROUP BY ALL
),
match_scores AS MATERIALIZED (
  SELECT query_id, doc_id, chunk_id,
         greatest(coalesce(max(CASE WHEN field = 'text' THEN s END), 0),
                  1.5 * coalesce(max(CASE WHEN field = 'title' THEN s END), 0)) AS score
  FROM field_scores GROUP BY ALL
)"""

PHRASE = f"""
q_slots AS MATERIALIZED (
  SELECT query_id, pos, folded FROM q_tokens WHERE folded NOT IN {STOPS} AND tok NOT IN {STOPS}
),
q_need AS (
  SELECT query_id, count(*) AS n, max(pos) AS last_slot FROM q_slots GROUP BY ALL
),
q_len AS (SELECT query_id, max(pos) + 1 AS qlen FROM q_tokens GROUP BY ALL),
d_len AS (SELECT doc_id, chunk_id, max(pos) + 1 AS dlen FROM pos_tokens WHERE field = 'text' GROUP BY ALL),
q_idf AS (
  SELECT query_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5))) AS sum_idf
  FROM q_slots JOIN term_stats ON term = folded AND term_stats.field = 'text' JOIN totals ON totals.field = 'text'
  GROUP BY ALL
),
q_rare AS (
  SELECT query_id, arg_min(folded, df * 100000 + pos) AS folded, arg_min(pos, df * 100000 + pos) AS pos
  FROM q_slots JOIN term_stats ON term = folded AND field = 'text' GROUP BY ALL
),
cand AS MATERIALIZED (
  SELECT r.query_id, t.doc_id, t.chunk_id, t.pos - r.pos AS start
  FROM q_rare r JOIN pos_tokens t ON t.folded = r.folded AND t.field = 'text'
),
phrase_at AS (
  SELECT c.query_id, c.doc_id, c.chunk_id, c.start
  FROM cand c JOIN q_slots s USING (query_id)
  JOIN pos_tokens t ON t.field = 'text' AND t.doc_id = c.doc_id AND t.chunk_id = c.chunk_id
       AND t.pos = c.start + s.pos AND t.folded = s.folded
       AND t.folded NOT IN {STOPS} AND t.tok NOT IN {STOPS}
  JOIN q_need n ON n.query_id = c.query_id
  JOIN q_len l ON l.query_id = c.query_id JOIN d_len d ON d.doc_id = c.doc_id AND d.chunk_id = c.chunk_id
  WHERE c.start >= 0 AND c.start + qlen <= dlen
  GROUP BY c.query_id, c.doc_id, c.chunk_id, c.start, n.n HAVING count(*) = n.n
),
phrases AS MATERIALIZED (
  SELECT query_id, doc_id, chunk_id, count(*) AS freq FROM phrase_at GROUP BY ALL
),
phrase_scores AS (
  SELECT p.query_id, p.doc_id, p.chunk_id, freq,
         1.2 * sum_idf * freq / (freq + 1.2 * (0.25 + 0.75 * dl / avg_dl)) AS phrase_score
  FROM phrases p JOIN q_idf USING (query_id)
  JOIN lens l ON l.doc_id = p.doc_id AND l.chunk_id = p.chunk_id AND l.field = 'text'
  JOIN totals ON totals.field = 'text'
)"""

SEARCH = f"{CHUNKS}, {QUERIES}, {positions('chunks', 'doc_id, chunk_id')}, {QUERY_FORMS}, {BM25}, {PHRASE}"

BM25_RANKED = """
bm25 AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_id) AS rank
  FROM (SELECT query_id, doc_id, chunk_id, round(score + coalesce(phrase_score, 0), 9) AS score
        FROM match_scores LEFT JOIN phrase_scores USING (query_id, doc_id, chunk_id))
)"""
