"""Registered queries of this package: each operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import decontaminate, divergence, factorisation, fixity, language_id, line_dedup, lloyd_codes, mixing, nn_descent, periodic_runs, pseudonyms, signature_tree, token_counts
from quernstone.llm.columns import WORD
from quernstone.session import stored

KEY = "demonstration key"


def fold(n: int) -> Column:
    """The remainder by ``n`` of the CRC-32 of the id as text; null for rows without id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op2_fixity(spark: SparkSession, sf: str) -> DataFrame:
    """Two replicas of the pages' records, damaged where a hash of the address says so, and what the audit finds."""
    pages = table(spark, sf, "pages")
    fate = F.coalesce(F.substring(F.md5("url"), 1, 2), F.lit(""))
    first = pages.filter(fate != "02")
    second = pages.filter(fate != "01").withColumn("html", F.when(fate == "00", F.concat(F.coalesce("html", F.lit("")), F.lit("\x00"))).otherwise(F.col("html")))
    return fixity.audit(fixity.Replica(fixity.leaves(first)), fixity.Replica(fixity.leaves(second)))


def op3_signature_trees(spark: SparkSession, sf: str) -> DataFrame:
    return signature_tree.link_documents(table(spark, sf, "documents"))


def op4_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    done = pseudonyms.pseudonymise(table(spark, sf, "documents"), KEY)
    return done.select("doc_id", "text", "n_values", *(f"n_{k}" for k in pseudonyms.KINDS))


def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    plan = mixing.sample_plan(table(spark, sf, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = language_id.fit_languages(docs.filter(fold(4) != 2))
    found = language_id.identify_languages(docs, model)
    return found.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def quality_model(docs: DataFrame, labels: DataFrame) -> factorisation.QualityModel:
    return factorisation.fit_quality(docs, labels.filter(fold(5) != 0))


def op9_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scored = factorisation.score_quality(docs, quality_model(docs, table(spark, sf, "labels")))
    return scored.select(
        "doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op10_divergence(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return divergence.judge(docs, divergence.fit_references(docs))


def op11_nearest(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    graph = nn_descent.build_graph(vectors)
    try:
        return nn_descent.search(graph, vectors.filter(F.col("vec_id") % 50 == 0))
    finally:
        graph.drop()


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """The texts of a tenth of all ids, chosen by a hash, with a part that repeats from some word on; the others as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w")
    a = (F.col("g") % F.nullif(n, F.lit(0))).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    block = F.slice("w", a + 1, p)
    whole = F.flatten(F.array_repeat(block, F.floor((n - a) / p).cast("int")))
    words = F.concat(F.slice("w", 1, a), whole, F.slice("w", a + 1, (n - a) % p))
    return split.select("doc_id", F.when(n > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_periods(table(spark, sf, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    done = found.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
    return done.select(
        "doc_id", "n_runs", (-F.col("r.s")).alias("start"), F.col("r.n").alias("length"), (-F.col("r.p")).alias("period"),
        F.expr("1000 * r.n div -r.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op13_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    found, books = lloyd_codes.compress(table(spark, sf, "embeddings"))
    digits = F.array_join(F.transform("code", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    codes = stored(found.select("vec_id", "label", digits.alias("code"), F.aggregate("errors", F.lit(0).cast("long"), lambda a, x: a + x).alias("error")), "op13")
    by_label = codes.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_fixity, op3_signature_trees, op4_pseudonyms, op5_token_counts, op6_mixing, op7_language_id, op8_line_dedup,
        op9_quality, op10_divergence, op11_nearest, op12_periodic_runs, op13_vector_codes,
    )
}

OP2_SQL = r"""
WITH p AS (SELECT page_id, url, html, substr(md5(url), 1, 2) AS fate FROM pages),
a AS (SELECT page_id, page_id // 4096 AS file,
        strlen('WARC/1.1__WARC-Type: response__WARC-Target-URI: ') + strlen(url) + strlen('__Content-Length: ') + strlen(CAST(strlen(html) AS VARCHAR))
        + 4 + strlen(html) + 4 AS bytes, fate FROM p WHERE fate <> '02'),
b AS (SELECT page_id, page_id // 4096 AS file,
        strlen('WARC/1.1__WARC-Type: response__WARC-Target-URI: ') + strlen(url) + strlen('__Content-Length: ')
        + strlen(CAST(strlen(html) + CASE WHEN fate = '00' THEN 1 ELSE 0 END AS VARCHAR)) + 4 + strlen(html) + CASE WHEN fate = '00' THEN 1 ELSE 0 END + 4 AS bytes,
        fate FROM p WHERE fate <> '01'),
ao AS (SELECT *, sum(bytes) OVER (PARTITION BY file ORDER BY page_id) AS stop FROM a),
bo AS (SELECT *, sum(bytes) OVER (PARTITION BY file ORDER BY page_id) AS stop FROM b)
SELECT file, page_id, CASE WHEN fate = '00' THEN 'changed' ELSE 'missing' END AS kind, CAST(stop - bytes AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop
FROM ao WHERE fate IN ('00', '01')
UNION ALL SELECT file, page_id, 'added', CAST(stop - bytes AS BIGINT), CAST(stop AS BIGINT) FROM bo WHERE fate = '02'
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        ('0x' || substr(md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(k - 1) % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, cap / w AS fill FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY fill, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY fill, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN fill <= level THEN cap ELSE w * (SELECT max(level) FROM l WHERE fill > level) END AS target,
        ('0x' || substr(md5('mix:' || coalesce(source, '') || CASE WHEN source IS NULL THEN '-' ELSE '+' END), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS e,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.h, d.doc_id NULLS LAST) AS i
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * CAST(least(floor(e * i + u) - floor(e * (i - 1) + u), ceil(e)) AS BIGINT) AS taken FROM r
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, o.owner IS NULL OR o.owner = k.doc_id AS stays FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


#: The exact neighbours: at the size that SQL is compared at, the graph search finds them all.
OP11_SQL = r"""
WITH ok AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score
    FROM ok AS q JOIN ok AS c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def _op12_sql(levels: int = 14) -> str:
    """Candidate periods are the distances between equal groups of m words, m / 2 < distance <= m; every stretch that keeps a candidate is then measured.

    A group of m >= q words that lies in a run of period q was seen last exactly q words before.
    """
    steps = [r"""
WITH RECURSIVE bits AS (
    SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 1 AS k, 0 AS b, xor(4294967295::BIGINT, ascii(substr(CAST(doc_id AS VARCHAR), 1, 1))::BIGINT) AS c FROM documents WHERE doc_id IS NOT NULL
    UNION ALL
    SELECT doc_id, s, k + CASE WHEN b = 7 THEN 1 ELSE 0 END, (b + 1) % 8,
        xor(xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END),
            CASE WHEN b = 7 AND k < length(s) THEN ascii(substr(s, k + 1, 1))::BIGINT ELSE 0::BIGINT END) FROM bits WHERE k <= length(s)),
crc AS (SELECT DISTINCT doc_id, xor(c, 4294967295::BIGINT) AS h FROM bits WHERE k > length(s)),
d AS (SELECT doc_id, h, h // 10 AS g, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents LEFT JOIN crc USING (doc_id)),
e AS (SELECT *, len(ws)::BIGINT AS n, g % nullif(len(ws), 0) AS a FROM d),
f AS (SELECT *, CASE WHEN h % 10 = 0 THEN 1 + (n - a) // (3 + g % 8) END AS p FROM e),
w AS MATERIALIZED (SELECT doc_id, i, ws[1 + CASE WHEN p IS NOT NULL AND i >= a THEN a + (i - a) % p ELSE i END] AS word
    FROM (SELECT *, unnest(range(n)) AS i FROM f)),
g0 AS MATERIALIZED (SELECT doc_id, i, hash(word) AS v FROM w)"""]
    for k in range(levels):
        m = 2**k
        if k:
            steps.append(f"""
g{k} AS MATERIALIZED (SELECT doc_id, i, hash(v, u) AS v FROM (SELECT doc_id, i, v, lag(v, {m // 2}) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM g{k - 1}) WHERE u IS NOT NULL)""")
        steps.append(f"""
q{k} AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, i - lag(i) OVER (PARTITION BY doc_id, v ORDER BY i) AS q FROM g{k}) WHERE q > {m // 2 if k else 0} AND q <= {m})""")
    union = " UNION ALL ".join(f"SELECT * FROM q{k}" for k in range(levels))
    return ",".join(steps) + f""",
m AS (SELECT x.doc_id, c.q, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, c.q ORDER BY x.i) AS island
    FROM ({union}) AS c JOIN w AS x ON x.doc_id = c.doc_id JOIN w AS y ON y.doc_id = x.doc_id AND y.i = x.i - c.q AND y.word = x.word),
s AS (SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length FROM m GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s AS t WHERE t.doc_id = s.doc_id AND t.q < s.q AND s.q % t.q = 0
    AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
o AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM r GROUP BY doc_id),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, q) = 1),
z AS (SELECT DISTINCT r.doc_id, w.i FROM r JOIN w ON w.doc_id = r.doc_id AND w.i >= r.start + r.q AND w.i < r.start + r.length),
t AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text FROM w LEFT JOIN z ON z.doc_id = w.doc_id AND z.i = w.i WHERE z.i IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(o.n_runs, 0) AS n_runs, CAST(l.start AS BIGINT) AS start, CAST(l.length AS BIGINT) AS length, CAST(l.q AS BIGINT) AS period,
    CAST(1000 * l.length // l.q AS BIGINT) AS exponent_milli, sha256(coalesce(o.lines, '')) AS runs_sha256, sha256(coalesce(t.text, '')) AS collapsed_sha256
FROM d LEFT JOIN o ON o.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


def _op13_sql(rounds: int = 6) -> str:
    """One pair of steps for each round: distances of all parts to all entries, then the means of what is nearest."""
    steps = [r"""
WITH ok AS (SELECT vec_id, label, embedding FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
f AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k, len(embedding) // 8 AS w FROM ok),
c AS MATERIALIZED (SELECT vec_id, label, k // w AS p, k % w AS j, CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM f),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM ok ORDER BY vec_id LIMIT 16),
b0 AS MATERIALIZED (SELECT s.e, c.p, c.j, c.x FROM c JOIN s USING (vec_id))"""]
    for k in range(rounds + 1):
        steps.append(f"""
d{k} AS (SELECT c.vec_id, c.p, b.e, sum((c.x - b.x) * (c.x - b.x)) AS err FROM c JOIN b{k} AS b USING (p, j) GROUP BY c.vec_id, c.p, b.e),
a{k} AS MATERIALIZED (SELECT vec_id, p, min(err) AS err, arg_min(e, err * 16 + e) AS e FROM d{k} GROUP BY vec_id, p)""")
        if k < rounds:
            steps.append(f"""
m{k} AS (SELECT a.p, a.e, c.j, floor(CAST(sum(c.x) AS DOUBLE) / count(*)) AS x FROM c JOIN a{k} AS a USING (vec_id, p) GROUP BY a.p, a.e, c.j),
b{k + 1} AS MATERIALIZED (SELECT b.e, b.p, b.j, CAST(coalesce(m.x, b.x) AS BIGINT) AS x FROM b{k} AS b LEFT JOIN m{k} AS m USING (p, e, j))""")
    return ",".join(steps) + f""",
r AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(err) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT r.vec_id, r.code, r.error, CAST(sum(r.error) OVER (PARTITION BY ok.label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) FROM b{rounds}) AS codebooks_sha256
FROM r JOIN ok USING (vec_id)
"""


ORACLES = {"op2_fixity": OP2_SQL, "op6_mixing": OP6_SQL, "op8_line_dedup": OP8_SQL, "op11_nearest": OP11_SQL, "op12_periodic_runs": _op12_sql(), "op13_vector_codes": _op13_sql()}
