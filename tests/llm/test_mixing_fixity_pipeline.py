import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from check import TABLES, rows
from quernstone.llm import fixity, mixing, queries
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    rel = con.sql(queries.ORACLES[name])
    want = pd.DataFrame(rel.fetchall(), columns=rel.columns)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def targets(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    """Water-filling round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    out, free, left = {}, list(order), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * level >= limit * sizes[s]]
        if not over:
            return out | {s: w[s] * level for s in free}
        for s in over:
            out[s] = limit * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def test_targets_and_samples(spark):
    rng = random.Random(5)
    names = ["b", "a", "é", None, "Z", "zz", "empty"]
    docs = []
    for k in range(900):
        s = "a" if k % 3 == 0 else rng.choice(names)
        n = 0 if s == "empty" else rng.choice([0, 1, 7, 7, 7, rng.randint(1, 60)])
        docs.append((k, " ".join(["w"] * n) or rng.choice([None, "", " \t"]), s, "c"))
    docs += [docs[4], docs[4], (None, "w w", "a", "c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, copy string")
    plan = mixing.sample_plan(frame, run=20).toPandas()
    size = {s: sum(len((t or "").split()) for _, t, x, _ in docs if x == s) for s in names}
    want = targets(size)
    assert len(plan) == len(docs) and plan.copies.max() <= 2
    largest = plan["size"].max()
    for s in names:
        own = plan[plan.source.isna() if s is None else plan.source == s]
        assert (own.source_size == size[s]).all() and (abs(own.target - want[s]) < 1e-6 * max(1, want[s])).all()
        assert abs((own["size"] * own.copies).sum() - want[s]) <= largest + 1e-6
    again = mixing.sample_plan(frame.repartition(7), run=20).toPandas()
    key = ["doc_id", "text_hash", "copies"]
    assert sorted(map(str, again[key].values.tolist())) == sorted(map(str, plan[key].values.tolist()))
    mixed = mixing.mixed_rows(frame, run=20)
    assert mixed.columns == frame.columns and mixed.count() == plan.copies.sum()
    taken = mixed.groupBy("doc_id").count().toPandas()
    per_id = plan.groupby("doc_id", dropna=False).copies.sum()
    assert {(str(a), int(n)) for a, n in zip(taken.doc_id, taken["count"])} == {(str(a), int(n)) for a, n in per_id.items() if n}


def test_mixing_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.sample_plan(empty).collect() == [] and mixing.mixed_rows(empty).collect() == []
    wordless = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert {(r.target, r.copies) for r in mixing.sample_plan(wordless).collect()} == {(0.0, 0)}


def replica(spark, pages, fanout=64):
    return fixity.Replica(fixity.leaves(spark.createDataFrame(pages, "page_id long, url string, html string, digest int"), per_file=64), per_file=64, fanout=fanout)


def test_audit_finds_what_differs(spark):
    rng = random.Random(1)
    first = {k: f"<p>{rng.random()}</p>" for k in rng.sample(range(5000), 300)}
    second = dict(first)
    keys = sorted(first)
    changed, gone, new = keys[5:9], keys[40:43], [6001, 6002]
    for k in changed:
        second[k] += "x"
    for k in gone:
        del second[k]
    for k in new:
        second[k] = "new"
    made = lambda d: [(k, f"u{k}", v, 1) for k, v in d.items()]
    a, b = replica(spark, made(first), 4), replica(spark, made(second), 4)
    got = fixity.audit(a, b).collect()
    assert sorted((r.page_id, r.kind) for r in got) == sorted([(k, "changed") for k in changed] + [(k, "missing") for k in gone] + [(k, "added") for k in new])
    assert all(r.stop > r.start and r.file == r.page_id // 64 for r in got)


def test_audit_of_odd_replicas(spark):
    pages = [(1, "u", "a", 0), (1, "u", "b", 0), (None, None, None, 0), (None, "v", "", 0), (2**40, "u", "z", 0)]
    same = fixity.audit(replica(spark, pages), replica(spark, pages[::-1])).collect()
    assert same == []
    differ = fixity.audit(replica(spark, pages), replica(spark, [pages[0], *pages[3:]])).collect()
    assert sorted((str(r.page_id), r.kind) for r in differ) == [("1", "changed"), ("None", "missing")]
    nothing = replica(spark, [])
    assert fixity.audit(nothing, replica(spark, [])).collect() == []
    assert {(r.kind) for r in fixity.audit(replica(spark, pages[:1]), nothing).collect()} == {"missing"}


@pytest.mark.skipif(not os.path.exists(os.path.join(os.path.dirname(__file__), "../../corpus_pipeline.py")), reason="the pipeline is not part of this checkout")
def test_pipeline_equals_its_parts(spark):
    import corpus_pipeline as P
    from quernstone.llm import decontaminate, factorisation
    from tests.llm.test_signature_tree import brute
    from tests.llm.test_text_operators import best_match, dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    model = queries.quality_model(docs, labels)
    good = {r.doc_id for r in factorisation.score_quality(docs, model).filter("score >= 0.3").collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    texts = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    lined = [(int(i), t) for i, t, _, _ in dedup(texts)]
    linked = brute(lined)
    left = [(i, t) for i, t in lined if linked[i][1] == i]

    def dirty(text):
        plain = decontaminate.normalise(text)
        for r in items:
            p = decontaminate.normalise(r.text).strip()
            # A piece must be there at all, before the slow comparison.
            k = int(len(p) * 0.05)
            if any(x in plain for _, x in decontaminate.pieces(p, k)) and best_match(p, plain) <= k:
                return True
        return False

    clean = {i: t for i, t in left if not dirty(t)}
    got = P.run(spark, SF)
    assert got.columns == [*docs.columns, "copy"]
    found = got.groupBy("doc_id").agg(F.first("text").alias("text"), F.max("copy").alias("n"), F.count("*").alias("rows")).collect()
    frame = spark.createDataFrame([(i, t, source[i]) for i, t in clean.items()], "doc_id long, text string, source string")
    plan = {r.doc_id: r.copies for r in mixing.sample_plan(frame).collect()}
    assert {r.doc_id: (r.text, r.n, r.rows) for r in found} == {i: (t, plan[i], plan[i]) for i, t in clean.items() if plan[i]}


@pytest.mark.skipif(not os.path.exists(os.path.join(os.path.dirname(__file__), "../../corpus_pipeline.py")), reason="the pipeline is not part of this checkout")
def test_every_stage_on_odd_tables(spark):
    """Nulls, repeated rows and clashing names: each stage keeps what its docstring says."""
    import corpus_pipeline as P

    line = "this line is held by two documents of the table"
    text = " ".join(f"w{k}" for k in range(40))
    rows = [
        (1, text, "en", "a", 3), (1, text, "en", "a", 3), (None, text, "en", "a", 3), (None, text, None, None, None), (2, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0),
        (3, f"{line}\nown words of the third", "en", None, 9), (4, f"{line}\nother words of the fourth", "en", None, 9), (None, "no id here but words", "de", "b", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copy int, label string, root long"
    docs = spark.createDataFrame([(*r, 7, "x", 9) for r in rows], schema)
    stages = dict(P.STAGES)
    for name, stage in P.STAGES:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).collect() == []
        if name != "mixing":
            assert got.filter("copy != 7 or label != 'x' or root != 9").count() == 0
    ids = lambda name: sorted((r.doc_id or 0, (r.text or "")[:9]) for r in stages[name](spark, docs, SF).collect())
    everything = sorted((r[0] or 0, (r[1] or "")[:9]) for r in rows)
    assert ids("decontamination") == everything
    lined = {(r.doc_id, r.n_chars): r.text for r in stages["line_dedup"](spark, docs, SF).collect() if r.doc_id in (3, 4)}
    assert lined == {(3, len(rows[7][1])): rows[7][1], (4, 25): "other words of the fourth"}
    gone = [(1, text[:9]), (0, text[:9]), (0, text[:9])]
    for x in gone:
        everything.remove(x)
    assert ids("near_duplicates") == everything
    narrow = docs.drop("n_chars", "copy")
    assert stages["line_dedup"](spark, narrow, SF).columns == narrow.columns
