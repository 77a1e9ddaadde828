import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quernstone.llm import signature_tree as S
from quernstone.llm.components import components
from quernstone.llm.hashing import shingle_sets


def words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, threshold=75):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed):
    """Originals, exact and near copies, passages shared by many, and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts = [None, "", " \n ", "one", "one", "one two", "a b c d e", "A b C d E"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        texts.append(" ".join(base) + (f" {passage}" if rng.random() < 0.5 else ""))
        for _ in range(rng.randint(0, 4)):
            copy = texts[-1].split()
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append("  ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 3), (3, 2048)])
def test_components_equal_brute_force(spark, seed, block):
    rows = corpus(seed)
    got = S.link_documents(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int"), block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_many_near_copies_of_one_text(spark):
    rng = random.Random(9)
    base = [f"x{k}" for k in range(80)]
    rows = []
    for i in range(400):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(80)] = f"y{rng.randrange(1000)}"
        rows.append((i, " ".join(copy)))
    got = S.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), block=64).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def cluster(n, seed):
    """Near copies of one text, some too far from all others to link, and texts that only share a passage with them."""
    rng = random.Random(seed)
    base = [f"x{k}" for k in range(120)]
    texts = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 12, 20])):
            copy[rng.randrange(120)] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(copy if i % 5 else base[:40] + copy[40:80] + [f"z{rng.randrange(10**6)}" for _ in range(10)]))
    return list(enumerate(texts))


def test_pairs_compared_follow_the_size_of_a_cluster(spark, monkeypatch):
    made = []
    real = S._linked

    def counted(pairs, sets, threshold):
        made.append(pairs.count())
        return real(pairs, sets, threshold)

    monkeypatch.setattr(S, "_linked", counted)
    counts = []
    for n in (150, 600):
        made.clear()
        rows = cluster(n, 3)
        got = S.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), block=128).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
        counts.append(sum(made))
    assert counts[1] < 8 * counts[0]


def test_a_pair_counts_in_one_group_only():
    masks = S.first_masks([np.array([5, 9], np.int64), np.array([9], np.int64), np.array([], np.int64), np.array([7], np.int64)])
    assert [bool((masks[0] & masks[k]).any()) for k in (1, 2, 3)] == [True, False, False]
    assert S.first_masks([np.array([], np.int64)] * 2).any() == False  # noqa: E712


def first_rows(rows, threshold=75):
    """Row by row: of each component the row with the smallest id, nulls last; one row if several are equal."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k])
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def test_one_row_of_each_component_stays(spark):
    rows = corpus(6)
    text = "p q r s t u v"
    rows += [(None, text), (None, text), (1000, text), (1000, text), (1001, text.upper()), (None, "alone with no id at all"), (None, "alone with no id at all"), (3, rows[3][1]), (3, "")]
    rows += [(2000, "same id other text one two"), (2000, "quite another text of the same id"), (2001, None), (2001, None), (2001, " ")]
    frame = spark.createDataFrame([(i, t, k % 2, "r") for k, (i, t) in enumerate(rows)], "doc_id long, text string, _h int, root string")
    got = S.first_of_each(frame)
    assert got.columns == frame.columns
    assert sorted(((r.doc_id, (r.text or "").lower().split()) for r in got.collect()), key=repr) == sorted(((i, (t or "").lower().split()) for i, t in first_rows(rows)), key=repr)
    assert S.first_of_each(frame.limit(0)).collect() == []


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.link_documents(empty).collect() == []
    text = "p q r s t u v"
    rows = spark.createDataFrame([(None, text), (7, text), (7, text), (3, text), (None, "alone here")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in S.link_documents(rows).collect())
    assert got == [(0, 0), (0, 3), (3, 3), (7, 3), (7, 3)]
    long = spark.createDataFrame([(1, "ab " * 700_000), (2, "ab " * 600_000), (3, "z" * 3_000_000)], "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in S.link_documents(long).collect()} == {1: (1, 1), 2: (1, 1), 3: (1, 3)}


def test_traversal_loses_no_pair():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 60, rng.integers(4, 60)).astype(np.uint64)
        sets += [np.unique(base)] + [np.unique(np.r_[base[rng.random(len(base)) < 0.9], rng.integers(0, 1 << 60, 3).astype(np.uint64)]) for _ in range(3)]
    sizes = np.array([len(s) for s in sets])
    bits = np.stack([S.bitmap(s) for s in sets]).view(np.uint64).reshape(len(sets), S.BITS // 64)
    labels = np.arange(len(sets))
    want = set()
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 175 * both >= 75 * (sizes[a] + sizes[b]):
                want.add((a, b))
    tree = S.Tree(sizes, labels, bits)
    found = {(min(a, b), max(a, b)) for x, y in S.dual_traversal(tree, tree, 75) for a, b in zip(x, y)}
    assert want <= found and len(found) < len(sets) * (len(sets) - 1) / 8
    half = len(sets) // 2
    left, right = S.Tree(sizes[:half], labels[:half], bits[:half]), S.Tree(sizes[half:], labels[half:], bits[half:])
    across = {(a, b + half) for x, y in S.dual_traversal(left, right, 75) for a, b in zip(x, y)}
    assert {p for p in want if p[0] < half <= p[1]} <= across
    alike = S.Tree(sizes, np.zeros(len(sets), int), bits)
    assert list(S.dual_traversal(alike, alike, 75)) == []


def test_shingles_of_odd_blanks():
    texts = ["a\tb\x0bc  d\ne f", "été Ünter", None, "", "\r"]
    assert [len(s) for _, s in shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 3), (5, 4), (5, 4), (9, 1), (10, 11)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 10: 10, 11: 10}
    chain = [(k, k + 1) for k in range(200)]
    assert {r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()} == {0}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
