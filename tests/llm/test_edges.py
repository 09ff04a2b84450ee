"""Empty tables, clashing columns, repeated rows and very long texts, for all operators and stages."""

import pytest

import corpus_pipeline as P
from textsieve.llm.decontaminate import find_leaks
from textsieve.llm.language_id import identify
from textsieve.llm.license_scan import scan_licenses
from textsieve.llm.mixing import by_source, mix
from textsieve.llm.near_dedup import near_duplicates
from textsieve.llm.quality import classify
from textsieve.llm.sharding import shard_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHES = "node component cluster rank at hash id shard slot size part lang_pred score kept domain epoch running token host fold quality toxic _row _pos _kept_id _gone tokens budget _order".split()


def corpus(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'x' as {c}" for c in CLASHES])


def benchmark(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def operators(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    yield "op1", near_duplicates(docs)
    yield "op3", scan_licenses(docs)
    yield "op4", classify(docs, labels)
    yield "op5", find_leaks(docs, benchmark(spark, "the quick brown fox jumps over the lazy dog again"))
    yield "op7", shard_documents(docs, 3)
    yield "op8", identify(docs)
    yield "op9", mix(docs, by_source(), {}, 5.0, max_epochs=1)


def test_empty_tables_and_clashing_columns(spark):
    for rows in ([], [(1, "only one text of six words", "en", "s", 3), (1, "only one text of six words", "en", "s", 3), (None, None, None, None, None), (2, "", None, "s", 0)]):
        for name, out in operators(spark, corpus(spark, rows)):
            got = out.collect()
            assert name in ("op5", "op9") or len(got) == len(rows), name


@pytest.mark.parametrize("empty", [True, False])
def test_stages_keep_columns(spark, tmp_path, empty):
    benchmark(spark, "no such item in any of these texts at all").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [] if empty else [(i, " ".join(f"word{(i * 37 + j * j) % 101}" for j in range(60)), "en", f"src{i % 2}", 1) for i in range(20)] + [(None, None, None, None, None)]
    docs = corpus(spark, rows)
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() > 0 or empty, name


def test_very_long_texts(spark):
    """A text of a million words among short ones, with something to find at its end."""
    item = "the quick brown fox jumps over the lazy dog again"
    long = "lorem ipsum dolor sit amet number " * 170_000
    rows = [(1, long + item + " released under the MIT License", "en", "src1", 0), (2, long + "consectetur", "en", "src1", 0)] + [(10 + i, f"a short text of some words number {i}", "en", "src2", 0) for i in range(20)]
    got = {name: {r["doc_id"]: r for r in out.collect()} for name, out in operators(spark, corpus(spark, rows))}
    n = 6 * 170_000
    assert got["op1"][1]["n_shingles"] > 6 and len(got["op1"]) == 22
    assert got["op3"][1]["n_words"] == n + 15 and got["op3"][1]["labels"] == "mit" and got["op3"][2]["labels"] == ""
    assert set(got["op5"]) == {1} and got["op5"][1]["exact"]
    assert got["op7"][1]["size"] == len(rows[0][1]) + 8 and got["op7"][1]["shard"] != got["op7"][2]["shard"]
    assert got["op8"][1]["lang_pred"] == "en" and got["op8"][2]["n_words"] == n + 1
    assert 0 <= got["op4"][1]["score"] <= 1 and got["op9"][1]["n_tokens"] == n + 15
