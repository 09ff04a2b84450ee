import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P

DATA = "/root/testdata/sf0.001"


def test_registry():
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {x.split("_")[0] + "_" for x in names if x.startswith("op")} and "pipeline" in names
    assert P.ORACLE_SQL is None and len(P.STAGES) == 5


def words(n, seed):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice([f"word{i}" for i in range(500)]) for _ in range(n))


def test_stages(spark, tmp_path):
    leak = words(40, 99)
    texts = [words(60, i) for i in range(40)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[3], "en", "src1", 0), (101, texts[4] + " tail", "en", "src1", 0), (102, "123 456", "en", "src1", 0), (103, None, None, None, None), (104, f"before {leak} after", "en", "src2", 0), (None, words(30, 77), None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        left[name] = {r[0] for r in docs.select("doc_id").collect()}
    everything = {r[0] for r in rows}
    assert everything - left["language_id"] == {102, 103}
    assert left["language_id"] - left["near_dedup"] == {100, 101}
    assert left["near_dedup"] - left["decontamination"] == {104}
    assert left["mixing"] < left["decontamination"] and left["sharding"] == left["mixing"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_run(spark):
    rows = P.run(spark, DATA).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) > 50


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["op1_near_dedup", "op6_warc"])
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(repr(tuple(r)) for r in df.select(columns).collect()) == sorted(map(repr, want))
