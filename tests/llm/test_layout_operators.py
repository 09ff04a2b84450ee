import heapq
import io
import random
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textsieve.llm.ann import nearest
from textsieve.llm.mixing import budgets, fill, mix
from textsieve.llm.prefix import ranked
from textsieve.llm.quality import classify
from textsieve.llm.sharding import schedule, shard_documents
from textsieve.llm.warc import INDEX, ZipReader, parse_record, payload_digest, record, round_trip, zip_archive
from textsieve.scratch import Scratch
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string"


def test_ranks_and_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 50), rng.randint(1, 9)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, v long").repartition(7)
    got = ranked(df, ["g"], ["o", "v"], Scratch(spark, "t"), "x", "v").collect()
    for g in ("a", "b", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own)))
        assert [(r["o"], r["v"]) for r in own] == sorted((o, v) for x, o, v in rows if x == g)
        assert [r["running"] for r in own] == np.cumsum([r["v"] for r in own]).tolist()


def plain_lpt(sizes, shards):
    heap = [(0, i) for i in range(shards)]
    for s in sorted(sizes, reverse=True):
        load, i = heap[0]
        heapq.heapreplace(heap, (load + s, i))
    return sorted(x for x, _ in heap)


def test_schedule_is_lpt():
    rng = random.Random(8)
    for _ in range(30):
        classes = [(s, rng.randint(1, 200), float(s)) for s in rng.sample(range(1, 5000), 20)]
        plan, loads = schedule(classes, 7), [0.0] * 7
        for name, runs in plan.items():
            for i, n in runs:
                loads[i] += n * name
        assert sorted(loads) == plain_lpt([s for s, n, _ in classes for _ in range(n)], 7)
        assert all(sum(n for _, n in plan[s]) == c for s, c, _ in classes)
    assert schedule([], 3) == {} and sum(n for _, n in schedule([(10**9, 1, 1e9), (9, 10**7, 9.0)], 24)[9]) == 10**7


def test_sharding(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 300) + f" {i}", None, None) for i in range(400)] + [(1000 + i, "hot copy é" * 3, None, None) for i in range(60)] + [(None, None, None, None), (2000, "", None, None), (2001, None, None, None), (5, rows_text := "dup", None, None), (5, rows_text, None, None)]
    got = shard_documents(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as shard", "2 as size", "3 as rank"), 24).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"}
    texts = Counter((r[0], (r[1] or "")) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter({(i, len(t.encode()) + 8, zlib.crc32(t.encode())): n for (i, t), n in texts.items()})
    place, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        place[r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        assert r["grown_shard"] is None
    assert all(len(x) == 1 for x in place.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    total, hot = sum(load.values()), 60 * (len(("hot copy é" * 3).encode()) + 8)
    assert max(load.values()) <= max(hot, total / 24 + 320)
    assert shard_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_fill_and_budgets():
    assert fill(10, [1, 1], [100, 100]) == [5, 5] and fill(10, [1, 1], [2, 100]) == [2, 8] and fill(10, [3, 1, 0], [100, 1, 100]) == [9, 1, 0]
    leaves = {("a", "en", "x"): 10, ("a", "en", "y"): 100, ("a", "fr", "z"): 100, ("b", "en", "w"): 1000}
    got = budgets(leaves, {("a",): 0.5, ("b",): 0.5}, 160, 1)
    assert got[("a", "en", "x")] == 10 and got[("a", "en", "y")] == pytest.approx(30)  # siblings first
    assert got[("a", "fr", "z")] == pytest.approx(40) and got[("b", "en", "w")] == pytest.approx(80)
    got = budgets(leaves, {("a",): 0.9, ("b",): 0.1}, 1000, 1)
    assert got[("b", "en", "w")] == pytest.approx(790)  # then the parent's siblings
    assert sum(budgets(leaves, {}, 10**9, 2).values()) == 2 * 1210


@pytest.mark.parametrize("seed", range(4))
def test_leaf_budgets_equal_those_of_the_tree(spark, seed):
    from textsieve.llm.mixing import leaf_budgets

    rng = random.Random(seed)
    leaves = {(d, lang, f"s{i}"): rng.choice([0, 1, 5, 40, 40, 300]) for d in "ab" for lang in ("en", "de") for i in range(rng.randint(1, 9))}
    weights = {path: rng.choice([0.0, 0.5, 2.0, 7.0]) for path in leaves if rng.random() < 0.5} | {("a",): 0.7, ("b",): 0.3, ("a", "en"): 3.0}
    epochs, total = rng.choice([1, 3]), rng.choice([0.3, 0.9, 5]) * sum(leaves.values())
    upper = defaultdict(int)
    for (d, lang, _), n in leaves.items():
        upper[d, lang] += n
    given = budgets(dict(upper), weights, total, epochs)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = leaf_budgets(
        frame([(*p, n) for p, n in leaves.items()], "domain string, lang string, source string, tokens long"),
        frame([(*p, x) for p, x in given.items()], "domain string, lang string, total double"),
        frame([(*p, w) for p, w in weights.items() if len(p) == 3], "domain string, lang string, source string, weight double"),
        epochs,
        Scratch(spark, "t"),
    )
    got = {tuple(r[:3]): r["budget"] for r in got.collect()}
    for parent, share in given.items():
        own = [p for p in leaves if p[:2] == parent]
        want = fill(share, [weights.get(p, 1.0) for p in own], [leaves[p] * epochs for p in own])
        assert [got[p] for p in own] == pytest.approx(want, abs=1e-6)


def test_mixing_equals_brute_force(spark):
    """Whole epochs, then the longest prefix of the last epoch's order that fits, leaf by leaf."""
    rng = random.Random(14)
    rows = [(i, "w " * rng.randint(0, 20), rng.choice(["en", "de"]), rng.choice(["s1", "s2", "s3"])) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    weights, share, epochs = {("d", "en"): 0.9, ("d", "de"): 0.1, ("d", "en", "s1"): 5.0}, 0.7, 3
    leaves, tokens = defaultdict(int), {i: len(t.split()) for i, t, *_ in rows}
    for i, _, lang, source in rows:
        leaves["d", lang, source] += tokens[i]
    given = budgets(dict(leaves), weights, share * sum(leaves.values()), epochs)
    want = Counter()
    for path, budget in given.items():
        own = [i for i, _, *p in rows if ("d", *p) == path]
        whole = min(int((budget + 1e-6) // leaves[path]), epochs)
        want.update((i, e) for i in own for e in range(whole))
        rest, used = int(budget + 1e-6) - whole * leaves[path], 0
        keys = {r[0]: r[1] for r in df.select("doc_id", F.xxhash64("doc_id", F.lit(17), F.lit(whole))).collect()}
        for i in sorted(own, key=lambda i: (keys[i], i)) if rest > 0 else ():
            used += tokens[i]
            if used > rest:
                break
            want[i, whole] += 1
    assert Counter((r["doc_id"], r["epoch"]) for r in mix(df, F.lit("d"), weights, share, max_epochs=epochs).collect()) == want


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None])) for i in range(600)] + [(None, "a b", "en", "s1"), (9000, None, "en", "s1"), (9001, "", "en", "s1"), (1, "a b", "en", "s1")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "7 as epoch", "8 as n_tokens", "9 as domain")
    weights = {("d", "en"): 0.8, ("d", "de"): 0.1, ("d", "(none)"): 0.1}
    got = mix(df, F.lit("d"), weights, 0.4, max_epochs=3).collect()
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    spent = Counter()
    for r in got:
        spent[r["lang"]] += r["n_tokens"]
    longest = 30
    assert abs(sum(spent.values()) - 0.4 * total) <= 12 * longest and abs(spent["en"] - 0.32 * total) <= 4 * longest
    epochs = defaultdict(set)
    for r in got:
        epochs[r["lang"], r["source"]].add(r["epoch"])
    assert all(e == set(range(len(e))) for e in epochs.values())
    assert sorted(map(repr, mix(df.repartition(5), F.lit("d"), weights, 0.4, max_epochs=3).collect())) == sorted(map(repr, got))
    assert mix(df.limit(0), F.lit("d"), weights, 0.4).count() == 0
    assert Counter(r["doc_id"] for r in mix(df, F.lit("d"), {}, 5.0, max_epochs=2).collect())[5] == 2


def test_zip_reader_reads_what_others_write():
    body = zip_archive([("a", b"one"), (INDEX, b"{}\n"), ("c/d", b"")])
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        assert z.testzip() is None and z.read("a") == b"one" and z.namelist() == ["a", INDEX, "c/d"]
    for data in (body, None):
        if data is None:  # a 32-bit archive of another writer
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                z.writestr("a", "one")
                z.writestr("c/d", "")
                z.comment = b"a comment"
            data = out.getvalue()
        r = ZipReader(io.BytesIO(data), len(data))
        assert r.read(*r.place("a")) == b"one" and r.place("c/d")[1] == 0
    with pytest.raises(ValueError, match="end of central"):
        ZipReader(io.BytesIO(b"x" * 100), 100)


def test_records():
    assert parse_record(record(5, "http://x/\r\ny é", b"a\r\n\r\nb", None)) == (5, 6, payload_digest(b"a\r\n\r\nb"), "response", None)
    assert parse_record(record(6, None, b"abc", 5)) == (6, 3, payload_digest(b"abc"), "revisit", 5)
    with pytest.raises(ValueError, match="damaged"):
        parse_record(record(5, "u", b"abc", None).replace(b"abc", b"abd"))


def test_archives(spark):
    rows = [(3, "u3", "same"), (1, "u1", "same"), (2, None, "é" * 1000), (4, "u4", None), (5, "u5", ""), (None, "n", "same"), (1, "u1", "same"), (7, "u\n7", "x\0y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as refers_to", "3 as first")
    got = sorted((tuple(r) for r in round_trip(df).collect()), key=repr)
    first = {"same": 1, "": 4}
    want = []
    for i, _, h in rows:
        body, lead = (h or "").encode(), first.get(h or "")
        revisit = lead is not None and i != lead
        want.append((i, len(body), payload_digest(body), "revisit" if revisit else "response", lead if revisit else None))
    assert got == sorted(want, key=repr)
    assert round_trip(df.limit(0)).count() == 0
    assert {r["record_type"] for r in round_trip(df, least=5).collect()} == {"response"}


def test_nearest_on_small_tables_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:90] = x[40]
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(400, None), (420, [0.0] * 8), (440, [1.0] * 7 + [None]), (460, [float("nan")] * 8), (480, [1.0] * 3), (None, [1.0] * 8), (500, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as score", "3 as part")
    got = defaultdict(list)
    for r in nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 300, 20))
    d = x.astype(np.float64)
    for q, found in got.items():
        s = d @ d[q]
        want = sorted((j for j in range(300) if j != q), key=lambda j: (-round(s[j], 9), j))[:20]
        assert [v for _, v, _ in found] == want and [r for r, *_ in found] == list(range(1, 21))
        assert np.allclose([z for *_, z in found], s[want], atol=1e-12)
    assert nearest(df.limit(0)).count() == 0
    assert nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")).count() == 1


def test_nearest_recall_over_parts(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 4000)] + 0.6 * rng.normal(size=(4000, 16))).astype(np.float32) * rng.uniform(0.5, 2, (4000, 1)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(4000)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in nearest(df).collect():
        got[r["query_id"]].add(r["vec_id"])
    d = x.astype(np.float64)
    hits = []
    for q in range(0, 4000, 20):
        s = d @ d[q]
        s[q] = -np.inf
        hits.append(len(set(np.argsort(-s)[:20].tolist()) & got[q]) / 20)
    assert np.mean(hits) >= 0.9


def test_quality(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(900):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.2
        own = [rng.choice(words) + ("###" if bad and rng.random() < 0.6 else "") for _ in range(rng.randint(20, 80))]
        if toxic:
            own[rng.randrange(len(own))] = rng.choice(["slur1", "slur2", "slur3"])
        docs.append((i, " ".join(own), rng.choice(["en", "de"]), "s"))
        if i < 600:
            labels.append((i, int(not bad), int(toxic)))
    truth = [("###" not in t, "slur" in t) for _, t, *_ in docs]
    docs += [(1000, None, None, None), (1001, "", "en", "s"), (None, "word1", None, None), (3, docs[3][1], "en", "s")]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as score", "2 as kept", "3 as quality", "4 as fold")
    lab = spark.createDataFrame([*labels, (5000, 1, 0), (None, 1, 1), (700, None, None)], "doc_id long, quality int, toxic int")
    got = classify(df, lab).collect()
    assert len(got) == len(docs) and all(0 <= r[c] <= 1 for r in got for c in ("score", "toxic", "content_score", "page_score"))
    by = {r["doc_id"]: r for r in got}
    unseen = range(600, 900)
    assert np.mean([(by[i]["score"] >= 0.5) == truth[i][0] for i in unseen]) > 0.97
    assert np.mean([(by[i]["toxic"] >= 0.5) == truth[i][1] for i in unseen]) > 0.97
    assert np.mean([by[i]["kept"] for i in unseen if truth[i] == (True, False)]) > 0.97
    assert classify(df.limit(0), lab).count() == 0
    assert {r["score"] for r in classify(df, lab.limit(0)).collect()} == {0.5}
