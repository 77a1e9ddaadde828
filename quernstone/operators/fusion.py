"""Fusion of ranked lists, reranking, hybrid search, and retrieval over several queries or rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import analyze, signature
from quernstone.operators import keyword as K
from quernstone.operators.filters import allowed_kinds, row_kind
from quernstone.operators.ranking import by_score, top_k
from quernstone.operators.vector import embed_batch, knn_exact
from quernstone.session import stored

KEYS = ("doc_id", "chunk_id")

# Letters whose presence marks a text as Vietnamese.
VIETNAMESE_LETTERS = "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"


def _last_per_key(hits: DataFrame, keys: tuple[str, ...], side: str) -> DataFrame:
    """One row per (query, key): the one with the highest rank number, as a struct."""
    return hits.groupBy("query_id", *keys).agg(F.max_by(F.struct("rank", "score"), "rank").alias(side))


def rrf(
    vector_hits: DataFrame, keyword_hits: DataFrame, vector_weight: float | Column = 0.5,
    keyword_weight: float | Column = 0.5, k: int = 60, keys: tuple[str, ...] = KEYS, limit: int | None = None,
    weights: DataFrame | None = None,
) -> DataFrame:
    """Reciprocal rank fusion of two hit lists (query_id, keys, rank, score).

    ``weights`` (query_id, vector_weight, bm25_weight) takes the place of the two weights for the queries in it.
    """
    both = _last_per_key(vector_hits, keys, "v").join(
        _last_per_key(keyword_hits, keys, "w"), ["query_id", *keys], "full_outer"
    )
    both, wv, wk = _weighted(both, vector_weight, keyword_weight, weights)
    part = lambda w, c: F.coalesce(w / (F.lit(k) + F.col(f"{c}.rank")), F.lit(0.0))
    fused = both.select(
        "query_id", *keys, F.round(part(wk, "w") + part(wv, "v"), 12).alias("score"),
        F.col("w.score").alias("bm25_score"), F.col("v.score").alias("vector_score"),
        F.when(F.col("w").isNotNull(), "keyword").otherwise("vector").alias("payload"),
    )
    return top_k(fused, ["query_id"], by_score("score", keys), limit)


def _weighted(both: DataFrame, vector_weight: float | Column, keyword_weight: float | Column, weights: DataFrame | None) -> tuple[DataFrame, Column, Column]:
    """The rows with the weights of their query, if it has its own, and the two weights to use."""
    wv, wk = (w if isinstance(w, Column) else F.lit(float(w)) for w in (vector_weight, keyword_weight))
    if weights is None:
        return both, wv, wk
    own = weights.select("query_id", F.col("vector_weight").alias("_wv"), F.col("bm25_weight").alias("_wk"))
    return both.join(own, "query_id", "left"), F.coalesce("_wv", wv), F.coalesce("_wk", wk)


def weighted_fusion(
    vector_hits: DataFrame, keyword_hits: DataFrame, vector_weight: float | Column = 0.5,
    keyword_weight: float | Column = 0.5, keys: tuple[str, ...] = KEYS, limit: int | None = None, weights: DataFrame | None = None,
) -> DataFrame:
    """Weighted sum of min-max scaled scores; a list whose scores are all equal scales to 1. ``weights`` as in ``rrf``."""

    def scaled(hits: DataFrame, side: str) -> DataFrame:
        span = hits.groupBy("query_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        one = _last_per_key(hits, keys, side).join(span, "query_id")
        unit = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise(
            (F.col(f"{side}.score") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        )
        return one.select("query_id", *keys, F.col(f"{side}.score").alias(f"{side}_score"), unit.alias(f"{side}_unit"))

    both = scaled(vector_hits, "v").join(scaled(keyword_hits, "w"), ["query_id", *keys], "full_outer")
    both, wv, wk = _weighted(both, vector_weight, keyword_weight, weights)
    total = wv * F.coalesce("v_unit", F.lit(0.0)) + wk * F.coalesce("w_unit", F.lit(0.0))
    fused = both.select(
        "query_id", *keys, F.round(total, 12).alias("score"),
        F.col("w_score").alias("bm25_score"), F.col("v_score").alias("vector_score"),
        F.when(F.col("v_score").isNotNull(), "vector").otherwise("keyword").alias("payload"),
    )
    return top_k(fused, ["query_id"], by_score("score", keys), limit)


def union_fallback(vector_hits: DataFrame, keyword_hits: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Both lists together by score, cut to the length of the longer one."""
    cols = ["query_id", *keys, "score"]
    both = vector_hits.select(*cols, F.lit(0).alias("src")).unionByName(keyword_hits.select(*cols, F.lit(1).alias("src")))
    sizes = both.groupBy("query_id").agg(
        F.greatest(F.count(F.when(F.col("src") == 0, 1)), F.count(F.when(F.col("src") == 1, 1))).alias("n")
    )
    ranked = top_k(both, ["query_id"], [*by_score("score", keys), F.col("src")], None)
    return ranked.join(sizes, "query_id").filter(F.col("rank") <= F.col("n")).drop("n")


def overlap_score(query: Column, text: Column) -> Column:
    """Share of distinct analysed terms two texts have in common: the scorer used without a model."""
    a, b = F.array_distinct(analyze(query)), F.array_distinct(analyze(text))
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.round(F.size(F.array_intersect(a, b)) / either, 9)).otherwise(F.lit(0.0))


def rerank(
    hits: DataFrame, queries: DataFrame, top: int | None = None,
    scorer: Callable[[list[str], list[str]], list[float]] | None = None, keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """Replace scores by a scorer's, keep the old rank and score, renumber and cut.

    ``hits``: (query_id, keys, text, rank, score, ...). ``scorer`` gets batches of query and
    text lists. Where it fails, that query's rows keep their order and scores.
    """
    pairs = hits.join(queries.select("query_id", F.col("text").alias("_query")), "query_id")
    if scorer is None:
        scored = pairs.withColumn("rerank_score", overlap_score(F.col("_query"), F.col("text")))
    else:

        def alone(texts: pd.Series) -> pd.Series:
            try:
                scores = [float(s) for s in scorer([texts.name] * len(texts), texts.tolist())]
            except Exception:
                scores = [None] * len(texts)
            return pd.Series(scores, index=texts.index, dtype="float64")

        @F.pandas_udf("double")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for q, t in batches:
                try:
                    yield pd.Series([float(s) for s in scorer(q.tolist(), t.tolist())])
                except Exception:
                    # One query's rows may be at fault: each query of the batch is tried by itself.
                    yield t.groupby(q, sort=False, group_keys=False).apply(alone).reindex(t.index)

        scored = pairs.withColumn("rerank_score", run("_query", "text"))
    per_query = Window.partitionBy("query_id")
    failed = F.max(F.when(F.col("rerank_score").isNull(), 1).otherwise(0)).over(per_query) == 1
    out = scored.drop("_query").withColumn("_failed", failed).withColumns(
        {"original_rank": F.col("rank"), "original_score": F.col("score")}
    ).withColumn("score", F.when(F.col("_failed"), F.col("score")).otherwise(F.col("rerank_score")))
    order = [
        F.when(F.col("_failed"), F.col("original_rank")), F.col("score").desc(), F.col("original_rank"),
        *(F.col(c) for c in keys),
    ]
    return top_k(out.drop("rank"), ["query_id"], order, top).drop("_failed")


def rerank_noop(hits: DataFrame, top: int | None = None) -> DataFrame:
    """Input order, cut."""
    return hits if top is None else hits.filter(F.col("rank") <= top)


def detect_language(text: Column) -> Column:
    """'vi' if any Vietnamese letter occurs, else 'en'."""
    found = F.lower(text).rlike(f"[{VIETNAMESE_LETTERS}]")
    return F.when(found, "vi").otherwise("en")


def route_rerank_model(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, model): 'vi' if more than half of the query and its first three texts are Vietnamese."""
    is_vi = lambda c: F.when(detect_language(F.col(c)) == "vi", 1).otherwise(0)
    samples = queries.select("query_id", is_vi("text").alias("vi")).unionByName(
        hits.filter(F.col("rank") <= 3).select("query_id", is_vi("text").alias("vi"))
    )
    return samples.groupBy("query_id").agg(
        F.when(F.sum("vi") > F.count("*") / 2, "vi").otherwise("default").alias("model")
    )


def candidate_count(mode: str, k: int) -> int:
    return {"vector": max(4 * k, 16), "bm25": max(2 * k, 12), "hybrid": max(4 * k, 20)}[mode]


def search(
    queries: DataFrame, chunks: DataFrame, mode: str = "hybrid", k: int = 8, use_rerank: bool = True,
    fusion: str = "rrf", vector_weight: float = 0.5, bm25_weight: float = 0.5, highlight: bool = False,
    encoder=None, scorer=None, fuzzy: bool = False, phrase: bool = True,
    index: K.KeywordIndex | None = None, vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None, keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """Vector, keyword or hybrid search of every query over every chunk, top ``k`` each.

    All candidates are scored by the reranker, then cut to twice ``k``, then to ``k``.
    ``index`` and ``vectors`` may be given ready-made; a weight of 0 means the default 0.5.
    ``queries`` may carry a ``filters`` predicate beforehand by filtering ``chunks``.
    """
    n = candidate_count(mode, k)
    cols = list(keys)
    vec_hits = key_hits = None
    if mode in ("vector", "hybrid"):
        qv = query_vectors if query_vectors is not None else embed_batch(queries, ["query_id"], "text", encoder)
        dv = vectors if vectors is not None else embed_batch(chunks, cols, "text", encoder)
        vec_hits = stored(knn_exact(qv, dv, n, cols), "vector_hits")
    if mode in ("bm25", "hybrid"):
        key_hits = stored(K.bm25_search(queries, chunks, n, index, fuzzy, phrase, keys=keys), "keyword_hits")
    if mode == "hybrid":
        fuse = rrf if fusion == "rrf" else weighted_fusion
        hits = fuse(vec_hits, key_hits, vector_weight or 0.5, bm25_weight or 0.5, keys=keys).withColumn(
            "source_type", F.lit("fused")
        )
    elif mode == "vector":
        hits = vec_hits.withColumn("source_type", F.lit("vector"))
    else:
        hits = key_hits.withColumn("source_type", F.lit("bm25"))
    if use_rerank or highlight:
        # At most a few dozen candidates per query meet their texts again.
        hits = K.with_texts(hits, chunks, keys)
    if use_rerank:
        hits = rerank(hits, queries, 2 * k, scorer, keys)
    if highlight:
        hits = K.highlight(hits, queries)
    return hits.filter(F.col("rank") <= k)


#: The filter fields of a request and its list columns.
REQUEST_LISTS = {"doc_type": "doc_types", "faculty": "faculties", "year": "years", "subject": "subjects", "language": "languages"}


def search_requests(
    requests: DataFrame, chunks: DataFrame, fusion: str = "rrf", fuzzy: bool = True, phrase: bool = True, encoder=None, scorer=None,
    index: K.KeywordIndex | None = None, vectors: DataFrame | None = None, keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """One search for a whole table of requests, each with its own mode, number of hits, weights and filters.

    ``requests``: (query_id, text, mode, k, vector_weight, bm25_weight, use_rerank, filters), as ``map_request`` makes them: ``filters`` holds
    doc_types, faculties, years, subjects, language and metadata_filters, or is null. Weights that are null or 0 count as a half, other modes than vector and
    bm25 as hybrid. Filters let through kinds of rows, which is what the index and the vectors are tested by before anything is
    scored. A request that is reranked gets its candidates scored anew. An ``index`` or ``vectors`` made beforehand carry the column ``kind`` of ``filters.row_kind`` over the
    fields of ``REQUEST_LISTS`` that the chunks have.
    """
    cols = list(keys)
    lists = {f: c for f, c in REQUEST_LISTS.items() if f in chunks.columns}
    f = lambda name: F.col(f"filters.{name}")
    mode = F.when(F.col("mode").isin("vector", "bm25"), F.col("mode")).otherwise("hybrid")
    n = F.when(mode == "vector", F.greatest(4 * F.col("k"), F.lit(16))).when(mode == "bm25", F.greatest(2 * F.col("k"), F.lit(12))).otherwise(F.greatest(4 * F.col("k"), F.lit(20)))
    half = lambda c: F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.5)).alias(c)
    asked = stored(requests.select(
        "query_id", "text", mode.alias("mode"), "k", n.alias("n"), half("vector_weight"), half("bm25_weight"), F.coalesce("use_rerank", F.lit(True)).alias("use_rerank"),
        f("doc_types").alias("doc_types"), f("faculties").alias("faculties"), f("years").alias("years"), f("subjects").alias("subjects"),
        F.when(f("language").isNotNull(), F.array(f("language"))).alias("languages"), f("metadata_filters").alias("metadata_filters"),
    ), "requests")
    rows = chunks.withColumn("kind", row_kind(tuple(lists)))
    allowed = stored(allowed_kinds(asked, chunks, lists, "metadata_filters"), "allowed")
    most = asked.agg(F.max("n")).first()[0] or 0
    own = asked.select("query_id", "n")
    cut = lambda hits: hits.join(own, "query_id").filter(F.col("rank") <= F.col("n")).drop("n")

    near = asked.filter("mode <> 'bm25'").select("query_id", "text")
    vecs = vectors if vectors is not None else embed_batch(rows, [*cols, "kind"], "text", encoder)
    # A list of no kind at all would let everything through.
    lets = allowed.groupBy("query_id").agg(F.collect_list(F.coalesce("kind", F.lit(0))).alias("allow"))
    qv = embed_batch(near, ["query_id"], "text", encoder).join(lets, "query_id", "left")
    vec_hits = stored(cut(knn_exact(qv, vecs, most, cols, filter_col="kind")), "vector_hits")
    index = index or K.build_index(rows, keys=keys, carry=("kind",))
    key_hits = stored(cut(K.bm25_search(asked.filter("mode <> 'vector'").select("query_id", "text"), rows, most, index, fuzzy, phrase, keys=keys, allowed=allowed)), "keyword_hits")

    part = lambda hits, m: hits.join(asked.filter(F.col("mode") == m).select("query_id"), "query_id", "left_semi")
    plain = ["query_id", *cols, "score", "rank"]
    fuse = rrf if fusion == "rrf" else weighted_fusion
    weights = asked.select("query_id", "vector_weight", "bm25_weight")
    fused = fuse(part(vec_hits, "hybrid"), part(key_hits, "hybrid"), keys=keys, weights=weights).select(*plain, F.lit("fused").alias("source_type"))
    found = part(vec_hits, "vector").select(*plain, F.lit("vector").alias("source_type")).unionByName(
        part(key_hits, "bm25").select(*plain, F.lit("bm25").alias("source_type"))).unionByName(fused)
    # At most a few dozen candidates per query meet their texts again.
    texts = stored(K.with_texts(found, chunks, keys), "found")
    again = asked.filter("use_rerank").select("query_id", "text")
    ranked = rerank(texts.join(again.select("query_id"), "query_id", "left_semi"), again, None, scorer, keys)
    rest = texts.join(again.select("query_id"), "query_id", "left_anti")
    both = ranked.unionByName(rest, allowMissingColumns=True)
    return both.join(asked.select("query_id", "k", "mode"), "query_id").filter(F.col("rank") <= F.col("k")).drop("k")


def _first_by_signature(rows: DataFrame, group: list[str], order: list[Column], text: str, head: int | None) -> DataFrame:
    sig = rows.withColumn("_sig", signature(F.col(text), head)).filter(F.col("_sig") != "")
    return top_k(sig, [*group, "_sig"], order, 1, "_n").drop("_n", "_sig")


def multi_query_retrieve(hits: DataFrame, k: int, head: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Merge the hits of each plan's rewritten queries.

    ``hits``: (plan_id, qpos, rank, text, score, ...). The first copy of a passage in query
    order is kept, then the rows are ordered by score and cut. Returns (rows, counts). Passages are the same if their whole texts are, or, with
    ``head``, if their first so many characters are.
    """
    unique = _first_by_signature(hits, ["plan_id"], [F.col("qpos"), F.col("rank")], "text", head)
    rows = top_k(
        unique.withColumnRenamed("rank", "source_rank"), ["plan_id"],
        [F.col("score").desc(), F.col("qpos"), F.col("source_rank")], k,
    )
    counts = (
        hits.groupBy("plan_id").agg(F.countDistinct("qpos").alias("queries_used"), F.count("*").alias("total_results"))
        .join(unique.groupBy("plan_id").agg(F.count("*").alias("unique_results")), "plan_id", "left")
        .withColumn("unique_results", F.coalesce("unique_results", F.lit(0)).cast("bigint"))
        .withColumn("final_results", F.least("unique_results", F.lit(k)).cast("bigint"))
    )
    return rows, counts


def context_accumulate(rounds: DataFrame, cap: int = 15, head: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Passages gathered over retrieval rounds, each once, up to ``cap``.

    ``rounds``: (query_id, iteration, rank, text, ...). Returns (rows with position,
    new passages per round). Once full, the list keeps its first ``cap`` entries; a passage
    cut off earlier is no longer known and counts as new when it comes again. ``head`` as in ``multi_query_retrieve``.
    """
    signed = rounds.withColumn("_sig", signature(F.col("text"), head)).filter(F.col("_sig") != "")
    order = [F.col("iteration"), F.col("rank")]
    first = top_k(signed, ["query_id", "_sig"], order, 1, "_n").drop("_n")
    kept = top_k(first, ["query_id"], order, cap, "position")
    held = kept.select("query_id", "_sig", F.col("iteration").alias("held_from"))
    new = (
        signed.select("query_id", "iteration", "_sig").distinct()
        .join(held, ["query_id", "_sig"], "left")
        .groupBy("query_id", "iteration")
        .agg(F.count(F.when(F.col("held_from").isNull() | (F.col("held_from") >= F.col("iteration")), 1)).alias("new_unique"))
    )
    return kept.drop("_sig"), new


def early_stop(
    rounds: DataFrame, threshold: float = 0.70, min_rounds: int = 1, sure: float = 0.80, enabled: bool = True
) -> DataFrame:
    """(query_id, stop_round): the first round that ends the search, null if none does.

    ``rounds``: (query_id, iteration, confidence, can_answer, gaps, next_query).
    """
    gaps_left = F.coalesce(F.size("gaps"), F.lit(0)) > 0
    done = (F.col("iteration") >= min_rounds) & F.lit(enabled) & (
        (F.col("can_answer") & (F.col("confidence") >= threshold))
        | (F.col("can_answer") & ~gaps_left)
        | (F.col("can_answer") & F.col("next_query").isNull())
        | (F.col("confidence") >= sure)
    )
    return rounds.groupBy("query_id").agg(F.min(F.when(done, F.col("iteration"))).alias("stop_round"))


def iterative_gate(
    df: DataFrame, mode: str = "automatic", threshold: float = 6.5, long_at: float = 7.0, enabled: bool = True
) -> DataFrame:
    """Adds use_iterative and max_iterations from ``complexity`` and ``score``."""
    if not enabled or mode == "disabled":
        use = F.lit(False)
    elif mode == "forced":
        use = F.lit(True)
    else:
        use = (F.col("complexity") == "complex") | (F.col("score") >= threshold)
    return df.withColumn("use_iterative", use).withColumn(
        "max_iterations", F.when(F.col("score") >= long_at, 3).otherwise(2)
    )


def retrieval_quality(
    results: DataFrame, relevance: DataFrame, modes: list[str], k_precision: int = 5, k_recall: int = 10
) -> DataFrame:
    """Mean precision and recall per mode over the queries with any relevant row.

    ``results``: (mode, query_id, doc_id, rank); ``relevance``: (query_id, doc_id).
    """
    rel = relevance.select("query_id", "doc_id").distinct()
    n_rel = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    # Several chunks of one document count once, at its best rank.
    best = results.groupBy("mode", "query_id", "doc_id").agg(F.min("rank").alias("rank"))
    hit = best.join(rel, ["query_id", "doc_id"], "left_semi")
    found = hit.groupBy("mode", "query_id").agg(
        F.count(F.when(F.col("rank") <= k_precision, 1)).alias("p_hits"),
        F.count(F.when(F.col("rank") <= k_recall, 1)).alias("r_hits"),
    )
    grid = n_rel.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    return (
        grid.join(found, ["mode", "query_id"], "left")
        .groupBy("mode")
        .agg(
            F.avg(F.coalesce("p_hits", F.lit(0)) / F.lit(k_precision)).alias("precision"),
            F.avg(F.coalesce("r_hits", F.lit(0)) / F.col("n_rel")).alias("recall"),
            F.count("*").alias("n_queries"),
        )
    )
