import random
import re

import numpy as np
import pytest

from textsieve.llm import near_dedup as N
from textsieve.llm.graph import connected_components
from textsieve.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, num, den):
    """component of each row, on whole sets of shingles."""
    sets = {}
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(3, 160))]
        for copy in range(rng.choice([1, 1, 2, 5, 12])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25)) if copy else 0):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((n, " ".join(own)))
            n += 1
    rng.shuffle(rows)
    return [*rows, (n, ""), (n + 1, None), (n + 2, " \n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two")]


@pytest.mark.parametrize(("k", "num", "den", "block"), [(3, 85, 100, 256), (5, 80, 100, 256), (3, 85, 100, 2)])
def test_components_equal_brute_force(spark, monkeypatch, k, num, den, block):
    monkeypatch.setattr(N, "BLOCK_DOCS", block)  # small blocks take the path of hot clusters
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in N.near_duplicates(df, k, num, den).collect()}
    want = brute(rows, k, num, den)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())
    assert len({c for _, c in want.values()}) < len(rows) - 20


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (2, "a b c d"), (1, "a b c d"), (1, "a b c d"), (3, None)], "doc_id long, text string").selectExpr("*", "'x' as component_id", "'y' as node")
    rows = sorted(N.near_duplicates(df, 3, 85, 100).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in rows] == [(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert N.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [256, 2])
def test_ids_with_several_texts_join_what_is_near_each(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_DOCS", block)
    rng = random.Random(8)
    text = lambda: [f"w{rng.randrange(500)}" for _ in range(60)]
    near = lambda t: [*t[:-1], "other"]
    a, b, c, d = text(), text(), text(), text()
    rows = [(5, a), (5, b), (6, near(a)), (7, near(b)), (9, c), (8, c), (9, d), (4, near(d)), (10, b), (10, b), (11, text())]
    got = {(r[0], r[2]) for r in N.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string"), 3, 85, 100).collect()}
    assert got == {(5, 5), (6, 5), (7, 5), (10, 5), (9, 4), (8, 4), (4, 4), (11, 11)}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(5)
    pool = np.sort(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    a, b = pool[:2000], pool[1000:]
    regs = lambda x: N.registers(np.sort(x), np.array([0, len(x)]), 2048)[0]
    ra, rb = regs(a), regs(b)
    assert (N.merge_registers(ra, rb) == regs(pool)).all()
    j = N.estimate_jaccard(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([(ra == rb).sum()]), np.array([2000]), np.array([2000]))[0]
    assert abs(j - 1 / 3) < 0.05
    assert N.bands_for(85, 100) * N.ROWS < 128


def test_long_paths_have_one_component(spark):
    n = 60
    edges = [(i, i + 1) for i in range(n)] + [(100, 101), (200, 200), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect())
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}
