import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import periodic_runs as P
from quernstone.llm import queries as Q
from quernstone.llm.hashing import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, min_length=6, min_exponent=4):
    """Every period tried on every word."""
    out = []
    for q in range(1, len(w) // min_exponent + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            s, n = i - q, j - i + q
            if j > i and n >= max(min_length, min_exponent * q) and not any(all(w[k] == w[k - d] for k in range(s + d, s + n)) for d in range(1, q)):
                out.append((s, n, q))
            i = j + 1
    return sorted(out)


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic(rng, n, letters):
    w = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 2) if n else 0):
        s = rng.randrange(n)
        p = rng.randint(1, max(1, (n - s) // 3))
        for i in range(s, min(n, s + rng.randint(1, 7) * p)):
            w[i] = w[s + (i - s) % p]
    return w


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(2, 4))
def test_runs_of_any_sequence(w, exponent):
    assert P.runs_in(w, 6, exponent) == brute(w, 6, exponent)


@pytest.mark.parametrize("seed", range(4))
def test_zones_lose_no_run(seed):
    rng = random.Random(seed)
    rows = [periodic(rng, rng.randint(0, 150), rng.choice([2, 4, 40])) for _ in range(150)]
    first = np.cumsum([0] + [len(w) for w in rows])
    hashes = mix(np.array([x for w in rows for x in w], np.uint64) + np.uint64(9))
    for exponent in (3, 4):
        got = {r: [] for r in range(len(rows))}
        for r, x, y in P.zones(hashes, first, 6, exponent):
            assert first[r] <= x < y <= first[r + 1]
            got[r] += [(int(x - first[r]) + s, n, q) for s, n, q in P.runs_in(hashes[x:y].tolist(), 6, exponent)]
        assert {r: sorted(v) for r, v in got.items()} == {r: brute(w, 6, exponent) for r, w in enumerate(rows)}


def test_text_without_repeats_needs_no_automaton():
    rng = np.random.default_rng(1)
    hashes = mix(rng.integers(0, 500, 50_000).astype(np.uint64))
    assert P.zones(hashes, np.array([0, 50_000])) == []


def test_square_ends_and_links():
    length, link, prefix = P.suffix_automaton([0, 1, 1])
    assert [length[v] for v in prefix] == [1, 2, 3] and all(length[link[v]] < length[v] for v in range(1, len(length)))
    assert P.squares([5, 5]) == {(0, 1): 1}
    assert P.squares([]) == {}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, runs string, n_words int")


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 6), (4, "a " * 5), (None, "A a A a A a A a"), (5, "é\x0bü " * 4 + "end"), (6, "a b " * 7), (4, "a " * 6)]
    got = P.periodic_runs(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, rows):
        w = WORD.findall(t or "")
        runs = brute(w)
        assert (r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) == (i, len(w), runs, collapsed(w, runs))
    assert P.periodic_runs(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        P.periodic_runs(frame(spark, rows), min_exponent=1)


def test_very_long_texts(spark):
    rng = random.Random(2)
    block = [f"w{rng.randrange(900)}" for _ in range(30_000)]
    rows = [(1, " ".join(block * 5)), (2, "z" * 3_000_000), (3, "ab " * 400_000)]
    got = {r.doc_id: r for r in P.periodic_runs(frame(spark, rows)).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 150_000, 30_000)] and got[1].text == " ".join(block)
    assert got[2].runs == [] and got[2].text == "z" * 3_000_000
    assert [tuple(x) for x in got[3].runs] == [(0, 400_000, 1)] and got[3].text == "ab"


def test_slices_and_batches():
    """Texts of several slices keep their ids."""
    rng = random.Random(5)
    texts = [" ".join(str(x) for x in periodic(rng, rng.randint(0, 3000), 50)) for _ in range(600)]
    out = pa.Table.from_batches(P.find(6, 4)(iter([pa.record_batch([pa.array(range(600)), pa.array(texts)], ["doc_id", "text"])])))
    assert out["doc_id"].to_pylist() == list(range(600))
    for k, (runs, text) in enumerate(zip(out["runs"].to_pylist(), out["text"].to_pylist())):
        w = texts[k].split()
        if k % 20 == 0:
            assert [tuple(r.values()) for r in runs] == brute(w)
        assert text == collapsed(w, [tuple(r.values()) for r in runs])


def contract(doc_id, text):
    """The registered query, word by word."""
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), collapsed(w, runs))]
    return doc_id, len(runs), *head, *sha


def test_query(spark, tmp_path):
    rng = random.Random(11)
    rows = [(k, " ".join(f"w{x}" for x in periodic(rng, rng.choice([0, 1, 5, 60, 200]), 30))) for k in range(-40, 160)] + [(None, "b " * 9), (7, None), (7, "")]
    planted = next(k for k in range(200, 400) if zlib.crc32(str(k).encode()) % 10 == 0)
    rows += [(planted, None), (planted, " \n"), (planted, "one"), (planted, "one")]
    frame(spark, rows).drop("n_words").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in Q.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((contract(*r) for r in rows), key=repr)
