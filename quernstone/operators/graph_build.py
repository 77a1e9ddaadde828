"""Entity resolution and construction of the property graph as node and edge tables.

mentions(doc_id, id, type, text, normalized, confidence, source_article_id, ord[, start, end, metadata]),
nodes(id, label, props MAP<STRING,STRING>), edges(src, dst, type, props).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import py_strip
from quernstone.operators.extract import article_number
from quernstone.operators.labels import CATEGORIES, EDGE_TYPES, clean_id
from quernstone.operators.matching import contains_join
from quernstone.session import cut_lineage, stored

MIN_CONFIDENCE = 0.7
HIGH_QUALITY_CONFIDENCE = 0.8
FUZZY_THRESHOLD = 0.9

# What a modification makes of its target.
ACTION_STATUS = {"AMENDS": "amended", "REPLACES": "expired", "SUPPLEMENTS": "amended", "REPEALS": "expired"}

# Id property of each label in node upserts.
ID_KEYS = {"MON_HOC": "ma_mon", "KHOA": "ma_khoa", "NGANH": "ma_nganh", "QUY_DINH": "ma_quy_dinh", "DIEU_KIEN": "ma_dieu_kien"}


# -- entities ---------------------------------------------------------------


def validate_entities(mentions: DataFrame, min_confidence: float = MIN_CONFIDENCE, categories: list[str] | None = None) -> DataFrame:
    """Adds ``reason``: null for a valid mention, else what is wrong with it first."""
    reason = (
        F.when(F.col("confidence") < min_confidence, "confidence below threshold")
        .when(F.coalesce(py_strip(F.col("text")), F.lit("")) == "", "empty text")
        .when(~F.col("type").isin(categories or CATEGORIES), "invalid category")
    )
    return mentions.withColumn("reason", reason)


def normalized_text(text: Column, case_sensitive: bool = False) -> Column:
    """Single blanks, outer punctuation stripped, lower case."""
    t = F.regexp_replace(py_strip(F.regexp_replace(text, r"\s+", " ")), "^[.,;:!?]+|[.,;:!?]+$", "")
    return t if case_sensitive else F.lower(t)


def normalize_entities(mentions: DataFrame, case_sensitive: bool = False) -> DataFrame:
    return mentions.withColumn("normalized", normalized_text(F.col("text"), case_sensitive))


def merge_policy(mentions: DataFrame, keys: list[str], policy: str = "highest") -> DataFrame:
    """One row per key by ``policy``: highest, first, merge or manual_review.

    Every policy is an aggregation with map-side combining; no group is gathered. ``merge``
    takes the text of the highest confidence, the widest span, and for each metadata key
    the value of the last row that has it.
    """
    rest = [c for c in mentions.columns if c not in keys]
    row = F.struct(*rest)
    best = F.struct("confidence", -F.col("ord"))
    n = F.count("*").alias("n_merged")
    if policy == "highest":
        return mentions.groupBy(*keys).agg(F.max_by(row, best).alias("r"), n).select(*keys, "r.*", "n_merged")
    if policy == "first":
        return mentions.groupBy(*keys).agg(F.min_by(row, "ord").alias("r"), n).select(*keys, "r.*", "n_merged")
    if policy == "manual_review":
        out = mentions.groupBy(*keys).agg(F.min_by(row, "ord").alias("r"), n).select(*keys, "r.*", "n_merged")
        return out.withColumn("needs_review", F.col("n_merged") > 1)
    if policy != "merge":
        raise ValueError(f"unknown policy {policy}")
    has_meta = "metadata" in mentions.columns
    spans = [c for c in ("start", "end") if c in mentions.columns]
    last = mentions.groupBy(*keys).agg(
        F.max("ord").alias("_last"), F.max_by("text", "ord").alias("_last_text"), n,
        F.max_by("text", best).alias("text"), F.max("confidence").alias("confidence"),
        F.min_by(F.struct(*[c for c in rest if c not in {"text", "confidence", "metadata", *spans}]), "ord").alias("r"),
        *[(F.min if c == "start" else F.max)(c).alias(c) for c in spans],
    )
    before = (
        mentions.join(last.select(*keys, "_last"), keys).filter(F.col("ord") < F.col("_last"))
        .groupBy(*keys).agg(F.max_by("text", best).alias("_before_text"))
    )
    out = last.join(before, keys, "left")
    merged_from = F.when(F.col("_before_text").isNotNull(), F.array("_before_text", "_last_text"))
    if has_meta:
        meta = (
            mentions.select(*keys, "ord", F.explode("metadata").alias("k", "v"))
            .groupBy(*keys, "k").agg(F.max_by("v", "ord").alias("v"))
            .groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("metadata"))
        )
        out = out.join(meta, keys, "left")
    return out.withColumn("merged_from", merged_from).select(
        *keys, "text", "confidence", "r.*", *spans, *(["metadata"] if has_meta else []), "merged_from", "n_merged"
    )


def dedupe_exact(mentions: DataFrame, policy: str = "highest") -> DataFrame:
    """One row per (type, normalized text)."""
    keyed = mentions.withColumn("normalized", F.coalesce("normalized", "text"))
    return merge_policy(keyed, ["type", "normalized"], policy)


def ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


#: Rows of one piece that meet in one task.
PIECE_ROWS = 1000
#: Characters of a piece, where a name has enough of them.
PIECE = 8


def _less_one(piece: Column, mark: str = "") -> Column:
    """(number, rest) for every character of a piece: the piece with that character replaced by ``mark``."""
    n = F.length(piece)
    return F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(i.alias("i"), F.concat(piece.substr(F.lit(1), i - 1), F.lit(mark), piece.substr(i + 1, n)).alias("rest")),
    )


def similar_pairs(names: DataFrame, threshold: float = FUZZY_THRESHOLD, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(type, a, b) with a < b: distinct names whose ratio reaches ``threshold``.

    A ratio of t leaves at most d = (1 - t) * length edits. Of any d // 2 + 1 pieces of one name there is one that holds at most one of them,
    and stands in the other name shifted by at most d: the rarest pieces are taken, counted over all names, so that a prefix that many
    names share is left alone where the rest tells them apart. A piece is looked up as it is and without each of its characters in turn,
    so two names meet only where a whole piece of them is alike but for one edit; an equality join on these strings finds every pair, and
    only those are compared. A string of many names is dealt to several tasks. ``names``: (type, name), each once.
    """
    slack = 1.0 - threshold
    edits = lambda n: F.floor(F.col(n) * F.lit(slack) + F.lit(1e-9)).cast("int")
    need = F.floor(F.col("d") / 2).cast("int") + 1
    many = lambda n: F.greatest(need, F.floor(F.col(n) / PIECE).cast("int"))
    place = lambda n: {
        "at": F.floor(F.col("p") * F.col(n) / F.col("k")).cast("int"), "to": F.floor((F.col("p") + 1) * F.col(n) / F.col("k")).cast("int"),
    }
    # Read several times below, made once.
    base = stored(names.select("type", "name", F.length("name").alias("n")).filter("n > 0"), "names")
    # The longer name is cut; the shorter is probed. Piece p of k of a name of n characters covers [p*n/k, (p+1)*n/k).
    cut = (
        base.select("type", F.col("name").alias("long"), F.col("n").alias("ln")).withColumn("d", edits("ln")).filter("d > 0").withColumn("k", many("ln"))
        .withColumn("p", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumns(place("ln"))
        .withColumn("piece", F.col("long").substr(F.col("at") + 1, F.col("to") - F.col("at"))).select("type", "long", "ln", "d", "p", "piece")
    )
    counts = cut.groupBy("type", "ln", "p", "piece").agg(F.count("*").alias("c"))
    # A name has a few pieces, of which the rarest are kept.
    rare = cut.join(counts, ["type", "ln", "p", "piece"]).groupBy("type", "long", "ln", "d").agg(F.array_sort(F.collect_list(F.struct("c", "p", "piece"))).alias("ps"))
    taken = stored(rare.select("type", "long", "ln", F.explode(F.slice("ps", F.lit(1), need)).alias("x")).select("type", "long", "ln", "x.p", "x.piece"), "pieces")
    # i: the character replaced (from 1), 0 where the other name has one character less in this place, -1 where it has one more.
    as_it_is = lambda c, i: F.array(F.struct(F.lit(i).alias("i"), c.alias("rest")))
    shorter = lambda c, i: F.transform(_less_one(c), lambda x: F.struct(F.lit(i).alias("i"), x["rest"].alias("rest")))
    piece = F.col("piece")
    key = ["type", "ln", "p", "i", "rest"]
    held = taken.select(
        "type", "long", "ln", "p", F.explode(F.array_distinct(F.concat(_less_one(piece, "\0"), shorter(piece, 0), as_it_is(piece, -1)))).alias("x")
    ).select("type", "long", "ln", "p", "x.*")
    # A shorter name of m characters can meet longer ones of m .. m / threshold characters. Edits before, in and after the piece are d at most.
    off, more = F.col("shift"), F.col("more")
    after = F.col("m") - F.col("ln") - off - more
    seg = F.col("short").substr(F.col("at") + off + 1, F.col("to") - F.col("at") + more)
    probe = (
        base.select("type", F.col("name").alias("short"), F.col("n").alias("m"))
        .withColumn("ln", F.explode(F.sequence(F.col("m"), F.least(F.floor(F.col("m") / F.lit(max(threshold, 1e-3)) + F.lit(1e-9)), F.lit(1 << 20)).cast("int"))))
        .withColumn("d", edits("ln")).filter("d > 0").withColumn("k", many("ln"))
        .withColumn("p", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumns(place("ln"))
        .withColumn("shift", F.explode(F.sequence(F.when(F.col("p") == 0, 0).otherwise(-F.col("d")), F.when(F.col("p") == 0, 0).otherwise(F.col("d")))))
        .withColumn("more", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
        .filter((F.abs(off) + F.abs(more) + F.abs(after) <= F.col("d")) & ((F.col("p") < F.col("k") - 1) | (after == 0)))
        .filter((F.col("at") + off >= 0) & (F.col("to") + off + more <= F.col("m")))
        .withColumn("seg", seg)
        .select("type", "short", "ln", "p", F.explode(
            F.when(more == -1, as_it_is(F.col("seg"), 0)).when(more == 0, _less_one(F.col("seg"), "\0")).otherwise(shorter(F.col("seg"), -1))).alias("x"))
        .select("type", "short", "ln", "p", "x.*")
    )
    hot = stored(held.groupBy(*key).agg(F.count("*").alias("c")).filter(F.col("c") > piece_rows).select(*key, F.ceil(F.col("c") / piece_rows).cast("int").alias("parts")), "hot")
    if hot.isEmpty():
        pairs = probe.join(held.hint("merge"), key)
    else:
        dealt = lambda df: df.join(hot.hint("merge"), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        asked = dealt(probe).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        pairs = asked.drop("parts").join(dealt(held).withColumn("_s", F.pmod(F.xxhash64("long"), F.col("parts")).cast("int")).drop("parts").hint("merge"), [*key, "_s"])
    return (
        pairs.filter(F.col("short") != F.col("long")).select("type", F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b")).distinct()
        .filter(ratio(F.col("a"), F.col("b")) >= threshold - 1e-9)
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable; ``edges``: (a, b).

    Alternating large-star and small-star steps: each only takes minima per node and joins
    them back, so a node with very many edges is combined map-side, and the number of
    rounds grows with the logarithm of the diameter. It ends when nothing changes.
    """
    e = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Each node now points down; link all it points to with the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        )
        e = cut_lineage(small)
        # Same edge set as the round before: the stars are final.
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    comp = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = e.select(F.col("v").alias("node")).distinct().join(comp.select("node"), "node", "left_anti")
    return comp.unionByName(roots.select("node", F.col("node").alias("component")))


def dedupe_fuzzy(mentions: DataFrame, threshold: float = FUZZY_THRESHOLD, policy: str = "highest") -> DataFrame:
    """One row per cluster of similar names of a type; adds ``cluster``, its smallest name.

    Clusters are connected components of the similarity pairs, so the result does not depend
    on the order of the rows; a chain of similar names is one cluster.
    """
    keyed = mentions.withColumn("normalized", F.coalesce("normalized", "text"))
    names = keyed.select("type", F.col("normalized").alias("name")).distinct()
    pairs = similar_pairs(names, threshold).select(
        F.struct("type", F.col("a").alias("name")).alias("a"), F.struct("type", F.col("b").alias("name")).alias("b")
    )
    comp = connected_components(pairs).select(
        F.col("node.type").alias("type"), F.col("node.name").alias("normalized"), F.col("component.name").alias("cluster")
    )
    labelled = keyed.join(comp, ["type", "normalized"], "left").withColumn("cluster", F.coalesce("cluster", "normalized"))
    return merge_policy(labelled, ["type", "cluster"], policy)


def dedupe_hybrid(mentions: DataFrame, threshold: float = FUZZY_THRESHOLD, policy: str = "highest") -> DataFrame:
    """Exact, then fuzzy."""
    # Names, pairs and clusters all read the few rows left, so the mentions are gone through once.
    exact = stored(dedupe_exact(mentions, policy).drop("n_merged", "merged_from", "needs_review"), "exact")
    return dedupe_fuzzy(exact, threshold, policy)


def entities_to_nodes(entities: DataFrame, default_year: str) -> DataFrame:
    """Resolved entities as nodes; courses, regulations and faculties get their own properties."""
    m = lambda k: F.element_at("metadata", F.lit(k))
    kind = F.col("type")
    pairs = {
        "name": F.col("text"), "normalized_name": F.coalesce("normalized", "text"), "confidence": F.col("confidence").cast("string"),
        "code": F.when(kind.isin("MON_HOC", "KHOA"), F.coalesce(m("code"), "text")),
        "credits": F.when(kind == "MON_HOC", F.coalesce(m("credits"), F.lit("0"))),
        "id": F.when(kind == "QUY_DINH", F.coalesce(m("id"), "text")),
        "title": F.when(kind == "QUY_DINH", F.col("text")),
        "year": F.when(kind == "QUY_DINH", F.coalesce(m("year"), F.lit(default_year))),
    }
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in pairs.items()]), lambda x: x["v"].isNotNull())
    return entities.select(
        F.concat_ws(":", "type", F.coalesce("normalized", "text")).alias("id"), kind.alias("label"), F.map_from_entries(entries).alias("props")
    )


# -- relations --------------------------------------------------------------


def validate_relations(relations: DataFrame, min_confidence: float = MIN_CONFIDENCE, types: list[str] | None = None) -> DataFrame:
    """Adds ``reason``; relations carry source_text, source_type, target_text, target_type."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = (
        F.when(F.col("confidence") < min_confidence, "confidence below threshold")
        .when(~F.col("type").isin(types or EDGE_TYPES), "invalid type")
        .when(blank("source_text") | blank("target_text"), "missing end")
        .when((F.col("source_text") == F.col("target_text")) & (F.col("source_type") == F.col("target_type")), "self reference")
    )
    return relations.withColumn("reason", reason)


def relations_to_edges(relations: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges between nodes keyed ``type:normalized``, relations with an unknown end)."""
    key = lambda end: F.concat_ws(":", f"{end}_type", normalized_text(F.col(f"{end}_text")))
    valid = validate_relations(relations).filter("reason is null").withColumns({"src": key("source"), "dst": key("target")})
    ids = nodes.select("id").distinct()
    edges = valid.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    unmapped = (
        valid.join(ids.select(F.col("id").alias("src")), "src", "left_anti")
        .unionByName(valid.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti"))
    )
    return edges.select("src", "dst", "type", "confidence"), unmapped


# -- upserts ----------------------------------------------------------------


def node_key(label: Column, props: Column, fallback: Column) -> Column:
    """Id of a node: its label's key, else code, id or name cleaned, else the given one."""
    get = lambda k: F.nullif(F.element_at(props, F.lit(k)), F.lit(""))
    own = F.coalesce(*[F.when(label == lab, get(k)) for lab, k in ID_KEYS.items()])
    return F.coalesce(clean_id(F.coalesce(own, get("code"), get("id"), get("name"))), fallback)


def upsert_nodes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Nodes with incoming properties laid over existing ones; ``incoming`` has ``ord``.

    Each property is reduced to its latest value before a node's few properties meet, so
    many versions of one node cost a combine, not a group.
    """
    rows = existing.select("label", "id", "props", F.lit(None).cast("bigint").alias("ord")).unionByName(
        incoming.select("label", "id", "props", F.col("ord").cast("bigint").alias("ord"))
    )
    latest = (
        rows.select("label", "id", "ord", F.explode_outer("props").alias("k", "v"))
        .groupBy("label", "id", "k").agg(F.max_by("v", F.coalesce("ord", F.lit(-1))).alias("v"), F.min(F.coalesce("ord", F.lit(-1))).alias("o"))
    )
    return latest.groupBy("label", "id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))).alias("props"),
        F.when(F.min("o") < 0, "updated").otherwise("created").alias("state"),
    )


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame, soft_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes without the listed ones, and edges not touching them; ``soft_at`` marks instead."""
    gone = ids.select("id").distinct()
    if soft_at is not None:
        marked = nodes.join(gone.withColumn("_gone", F.lit(True)), "id", "left")
        return marked.withColumn("deleted_at", F.when(F.col("_gone"), soft_at)).drop("_gone"), edges
    kept = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), kept.select(*edges.columns)


def append_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges whose ends both exist, number created per type)."""
    ids = nodes.select("id").distinct()
    ok = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return ok.select(*edges.columns), ok.groupBy("type").agg(F.count("*").alias("created"))


def delete_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys.select("src", "dst", "type").distinct(), ["src", "dst", "type"], "left_anti")


# -- whole graph ------------------------------------------------------------


def build_structure_graph(nodes: DataFrame, edges: DataFrame, category: str) -> tuple[DataFrame, DataFrame]:
    """(graph nodes, graph edges) of a structured corpus.

    ``nodes``: (doc_id, id, kind, title, full_text, ord). Ids repeat across documents, so a
    graph id is ``doc_id/id``. Articles and clauses belong to the category; structural edges
    stay only where both ends exist.
    """
    gid = lambda c: F.concat_ws("/", F.col("doc_id").cast("string"), c)
    kept = nodes.filter(F.col("kind").isin("document", "chapter", "article", "clause"))
    body = (
        kept.groupBy("doc_id", "id").agg(F.max_by(F.struct("kind", "title", "full_text"), "ord").alias("r"))
        .select(gid("id").alias("id"), F.initcap("r.kind").alias("label"), F.col("r.title").alias("title"), F.col("r.full_text").alias("full_text"))
    )
    # Ids, members, ends of edges and targets of modifications are read from it, mostly without the texts.
    body = stored(body, "graph-nodes")
    cat = nodes.sparkSession.createDataFrame([(category, "Category", category, None)], "id string, label string, title string, full_text string")
    belongs = body.filter(F.col("label").isin("Article", "Clause")).select(
        F.col("id").alias("src"), F.lit(category).alias("dst"), F.lit("BELONGS_TO").alias("type")
    )
    inner = edges.select(gid("source").alias("src"), gid("target").alias("dst"), "type").distinct()
    ids = body.select("id")
    inner = inner.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return body.unionByName(cat), inner.select("src", "dst", "type").unionByName(belongs)


def entity_key() -> Column:
    return F.lower(py_strip(F.coalesce("normalized", "text")))


def resolve_entities(mentions: DataFrame) -> DataFrame:
    """(normalized_text, type, text, mention_count): one entity per key, text of the first mention."""
    return (
        mentions.withColumn("normalized_text", entity_key())
        .groupBy("normalized_text", "type")
        .agg(F.min_by("text", "ord").alias("text"), F.count("*").alias("mention_count"))
    )


def resolution_counts(entities: DataFrame) -> DataFrame:
    return entities.agg(
        F.count("*").alias("created"), F.sum(F.col("mention_count") - 1).alias("merged"), F.sum("mention_count").alias("mentions")
    )


def build_mentions(mentions: DataFrame, sources: DataFrame) -> DataFrame:
    """MENTIONS edges (source_id, normalized_text, type, confidence, local_id) from existing sources."""
    first = (
        mentions.withColumn("normalized_text", entity_key())
        .groupBy(F.col("source_article_id").alias("source_id"), "normalized_text", "type")
        .agg(F.min_by(F.struct("confidence", F.col("id").alias("local_id")), "ord").alias("r"))
    )
    return first.join(sources.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi").select(
        "source_id", "normalized_text", "type", "r.*"
    )


def mentions_from_json(articles: DataFrame) -> DataFrame:
    """(id, name, type) from a JSON column ``entities_json`` of name and type objects."""
    parsed = F.from_json("entities_json", "array<struct<name:string,type:string>>")
    return (
        articles.select("id", F.explode(parsed).alias("e"))
        .select("id", F.trim("e.name").alias("name"), F.trim(F.coalesce("e.type", F.lit("Unknown"))).alias("type"))
        .filter("name <> ''").distinct()
    )


def resolve_semantic_edges(relations: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges between resolved entities, skipped and kept counts).

    ``relations``: (source_id, target_id, type, confidence, evidence, ord) on local ids. One
    edge per pair of entities and type, with the first relation's evidence.
    """
    # A local id given twice means its last entity.
    local = mentions.groupBy("id").agg(F.max_by(F.struct(entity_key().alias("text"), "type"), "ord").alias("e"))
    ends = (
        relations.join(local.select(F.col("id").alias("source_id"), F.col("e").alias("s")), "source_id", "left")
        .join(local.select(F.col("id").alias("target_id"), F.col("e").alias("t")), "target_id", "left")
    )
    ok = F.col("s").isNotNull() & F.col("t").isNotNull()
    edges = ends.filter(ok).groupBy(
        F.col("s.text").alias("src_text"), F.col("s.type").alias("src_type"), F.col("t.text").alias("dst_text"), F.col("t.type").alias("dst_type"), "type"
    ).agg(F.min_by(F.struct("confidence", "evidence"), "ord").alias("r")).select("src_text", "src_type", "dst_text", "dst_type", "type", "r.*")
    return edges, ends.agg(F.count(F.when(ok, 1)).alias("n_used"), F.count(F.when(~ok, 1)).alias("n_skipped"))


def apply_modifications(mods: DataFrame, nodes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(modification edges, target nodes with new status).

    ``mods``: (action, source_text_id, target_document_signature, target_article,
    target_clause, effective_date, description, ord); ``nodes``: (doc_id, id, label, title).
    The target document has the signature in its id or title; within it the clause or article
    of the given number is preferred. The last action on a target decides its status.
    """
    number = lambda c, word: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?iu){word}\s*(\d+)", 1), F.lit(""))
    usable = mods.filter((F.coalesce("source_text_id", F.lit("")) != "") & (F.coalesce("target_document_signature", F.lit("")) != ""))
    usable = usable.withColumns({
        "sig": F.col("target_document_signature"), "art_no": number("target_article", "điều").cast("bigint"), "cl_no": number("target_clause", "khoản").cast("bigint"),
    })
    sources = nodes.filter(F.col("label").isin("Article", "Clause", "Document")).select(F.col("id").alias("source_text_id")).distinct()
    usable = usable.join(sources, "source_text_id", "left_semi")
    docs = nodes.filter("label = 'Document'").select(
        "doc_id", F.col("id").alias("doc_node"), F.concat_ws("\n", "id", "title").alias("body")
    )
    found = contains_join(docs, usable.select("sig").distinct(), "body", "sig", ["doc_id", "doc_node"]).select("doc_id", "doc_node", "sig")
    place = usable.join(found, "sig")
    arts = nodes.filter("label = 'Article'").select(
        "doc_id", F.col("id").alias("art_node"), F.coalesce(article_number(F.col("title")), article_number(F.col("id"))).alias("art_no")
    )
    clause_no = F.coalesce(number("title", "khoản"), F.nullif(F.regexp_extract("id", r"(?i)khoan_(\d+)", 1), F.lit(""))).cast("bigint")
    clauses = nodes.filter("label = 'Clause'").select(
        "doc_id", F.col("id").alias("cl_node"), clause_no.alias("cl_no"),
        F.coalesce(article_number(F.col("title")), article_number(F.col("id"))).alias("art_no"),
    )
    hits = place.join(arts, ["doc_id", "art_no"], "left").join(clauses, ["doc_id", "art_no", "cl_no"], "left")
    target = F.coalesce("cl_node", "art_node", "doc_node")
    linked = hits.select("source_text_id", target.alias("target_id"), "action", "effective_date", "description", "ord")
    edges = linked.groupBy(F.col("source_text_id").alias("src"), F.col("target_id").alias("dst"), F.col("action").alias("type")).agg(
        F.min_by(F.struct("description", "effective_date"), "ord").alias("r")
    ).select("src", "dst", "type", "r.*")
    status = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ACTION_STATUS.items() for x in kv]), F.col("action")), F.lit("amended"))
    marked = linked.groupBy(F.col("target_id").alias("id")).agg(
        F.max_by(F.struct(status.alias("status"), F.col("source_text_id").alias("modified_by"), F.coalesce("effective_date", now).alias("modification_date")), F.struct("ord", "source_text_id")).alias("r")
    ).select("id", "r.*")
    return edges, marked


def category_routing(nodes: DataFrame, edges: DataFrame, category: str) -> DataFrame:
    """Articles belonging to a category, by id."""
    members = edges.filter((F.col("type") == "BELONGS_TO") & (F.col("dst") == category)).select(F.col("src").alias("id"))
    return nodes.filter("label = 'Article'").join(members, "id", "left_semi").orderBy("id")


def check_unique(nodes: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(label, key, value, n): repeated or missing values of each label's key property; ``nodes`` has props."""
    key = F.element_at(F.create_map(*[F.lit(x) for kv in keys.items() for x in kv]), F.col("label"))
    valued = nodes.filter(F.col("label").isin(list(keys))).withColumn("key", key).withColumn("value", F.element_at("props", F.col("key")))
    counts = valued.groupBy("label", "key", "value").agg(F.count("*").alias("n"))
    return counts.filter((F.col("n") > 1) | F.col("value").isNull())


def build_report(stages: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(kind, total, created, failed, success_rate) from stage outputs and what counts as failed."""
    parts = [
        df.agg(F.count("*").alias("total"), F.count(F.when(bad, 1)).alias("failed")).withColumn("kind", F.lit(kind))
        for kind, (df, bad) in stages.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(
        "kind", "total", (F.col("total") - F.col("failed")).alias("created"), "failed",
        F.when(F.col("total") > 0, (F.col("total") - F.col("failed")) / F.col("total")).otherwise(F.lit(1.0)).alias("success_rate"),
    )


def check_edge_schema(edges: DataFrame, nodes: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(src_label, type, dst_label, n): combinations of existing edges that no rule allows."""
    label = nodes.select("id", "label")
    named = (
        edges.join(label.select(F.col("id").alias("src"), F.col("label").alias("src_label")), "src")
        .join(label.select(F.col("id").alias("dst"), F.col("label").alias("dst_label")), "dst")
    )
    # Counted first: the rules meet one row per combination of labels.
    counts = named.groupBy("src_label", "type", "dst_label").agg(F.count("*").alias("n"))
    allowed = F.array(*[F.lit("|".join(r)) for r in rules])
    return counts.filter(~F.array_contains(allowed, F.concat_ws("|", "src_label", "type", "dst_label")))


def build_graph(
    nodes: DataFrame, edges: DataFrame, mentions: DataFrame, relations: DataFrame, mods: DataFrame, category: str, now: Column
) -> dict[str, DataFrame]:
    """Structure, entities, mentions, semantic edges and modifications of a corpus."""
    g_nodes, g_edges = build_structure_graph(nodes, edges, category)
    semantic, semantic_counts = resolve_semantic_edges(relations, mentions)
    doc_of = g_nodes.withColumn("doc_id", F.substring_index("id", "/", 1))
    mod_edges, status = apply_modifications(mods, doc_of, now)
    return {
        "nodes": g_nodes.join(status, "id", "left").withColumn("status", F.coalesce("status", F.lit("active"))),
        "edges": g_edges, "entities": resolve_entities(mentions),
        "mentions": build_mentions(mentions, g_nodes.filter(F.col("label").isin("Article", "Clause"))),
        "semantic_edges": semantic, "semantic_counts": semantic_counts, "modification_edges": mod_edges,
    }
