import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textsieve.errors import SearchError
from textsieve.functions.grams import covering_terms, masked_trigrams, pair_weight_array, sparse_term_array, sparse_terms, term_hash, term_hashes
from textsieve.functions.weights import pair_weights
from textsieve.operators.inspect import inspect_terms

GOLDEN = "MA MAX MAX_ AX AX_ X_ X_F _F _FI _FIL _FILE _FILE_ _FILE_S FI FIL IL ILE LE LE_ E_ E_S _S _SI _SIZE SI SIZ SIZE IZ IZE ZE"


def brute(text, longest=24):
    w = pair_weights(np.array([ord(c) for c in text])).tolist() if len(text) > 1 else []
    out = []
    for s in range(len(text)):
        for e in range(s + 2, min(len(text), s + longest) + 1):
            inner = w[s + 1 : e - 2]
            if not inner or min(w[s], w[e - 2]) > max(inner):
                out.append((text[s:e], s, e, max(w[s], w[e - 2])))
    return out


def test_golden_terms_and_coverings():
    assert " ".join(t.term for t in sparse_terms("MAX_FILE_SIZE")) == GOLDEN
    assert [(t.term, t.start, t.end, t.weight) for t in covering_terms("MAX_FILE_SIZE")] == [("MAX_", 0, 4, 463143), ("_FILE_S", 3, 10, 463856), ("_SIZE", 8, 13, 463856)]
    assert [t.term for t in covering_terms("function")] == ["fun", "unct", "ion"]
    assert covering_terms("a") == [] and sparse_terms("") == []


def test_sparse_terms_equal_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice("theano_AZ é{}=>\n ") for _ in range(rng.randint(0, 60)))
        assert [(t.term, t.start, t.end, t.weight) for t in sparse_terms(text)] == brute(text)


def test_any_literal_is_covered_and_terms_are_in_every_superstring():
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice("abcdeXY_ 19") for _ in range(rng.randint(2, 30)))
        cover = covering_terms(text)
        assert cover[0].start == 0 and cover[-1].end == len(text)
        around = {t.term for t in sparse_terms("qq" + text + "zz")}
        assert all(t.term in around for t in cover)


def test_column_form_equals_python_form(spark):
    texts = ["MAX_FILE_SIZE", "a", "", "foo  bar\nbaz", "éàü==>x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("w", pair_weight_array(F.col("t")))
    for row in df.select("i", sparse_term_array(F.col("t"), F.col("w")).alias("terms")).collect():
        got = [(x["term"], x["start"], x["end"], x["weight"]) for x in row["terms"] or []]
        assert got == brute(texts[row["i"]])


def test_term_hashes_are_distinct_per_document(spark):
    docs = spark.createDataFrame([(1, "foofoo"), (2, None), (3, "x"), (4, "foo")], "doc_id long, content string")
    rows = term_hashes(docs).collect()
    assert len(rows) == len({(r[0], r[1]) for r in rows})
    assert {r[1] for r in rows} == {1, 4}
    assert {r[1] for r in rows if r[0] == term_hash("foo")} == {1, 4}


def test_masked_trigrams(spark):
    rows = {r["term"]: r for r in masked_trigrams(spark.createDataFrame([("abcabcd",)], "content string"), []).collect()}
    assert rows["abc"]["start"] == 0 and rows["abc"]["loc_mask"] == "00001001"
    assert rows["abc"]["next_mask"] == f"{1 << ord('a') % 8 | 1 << ord('d') % 8:08b}" and rows["bcd"]["next_mask"] == "00000000"


def test_inspection(spark, tmp_path):
    assert inspect_terms(spark, "MAX_FILE_SIZE", max_terms=5).term_count == 5
    assert [t["term"] for t in inspect_terms(spark, "abcd", mode="trigram").terms] == ["abc", "bcd"]
    assert inspect_terms(spark, "abcabc", mode="masked-trigram").terms[0]["term"] == "abc"
    (tmp_path / "f").write_text("abcd")
    assert inspect_terms(spark, path=str(tmp_path / "f"), mode="trigram").term_count == 2
    for bad in ({}, {"text": "a", "path": "b"}, {"text": ""}):
        with pytest.raises(SearchError, match="INVALID_INPUT"):
            inspect_terms(spark, **bad)


def test_posting_lists_hold_the_terms_of_each_document(spark, monkeypatch):
    from textsieve.functions import grams

    rng = random.Random(13)
    texts = ["".join(rng.choice("theano_AZ é") for _ in range(rng.randint(0, 80))) for _ in range(40)] + [None, "", "a"]
    for chars in (1 << 20, 100, 7):  # texts are grouped, or one text is cut
        monkeypatch.setattr(grams, "SLICE_CHARS", chars)
        for i, t in enumerate(texts):
            want = sorted({term_hash(x.term) for x in sparse_terms(t or "")})
            assert grams._pairs([t or ""])[0].tolist() == want, (chars, i)
        hashes, of = grams._pairs([t or "" for t in texts])
        got = {(h, i) for h, i in zip(hashes.tolist(), of.tolist(), strict=True)}
        assert len(got) == len(hashes) and got == {(term_hash(x.term), i) for i, t in enumerate(texts) for x in sparse_terms(t or "")}


def test_posting_lists_of_a_table(spark):
    from textsieve.functions.grams import hashed_term, term_postings, term_rows
    from textsieve.operators.index import postings_of

    docs = spark.createDataFrame([(5, "foo bar"), (6, "bar foo"), (7, None), (None, "foo"), (8, "xyz")], "doc_id long, content string")
    lists = {}
    for r in postings_of(docs).collect():
        lists.setdefault(r["term_hash"], []).extend(r["docs"])
    assert sorted(lists[term_hash("foo")]) == [5, 6] and lists[term_hash("xyz")] == [8]
    terms = term_rows(docs).select("term").distinct().withColumn("h", hashed_term("term")).collect()
    assert {r["h"] for r in terms} == set(lists) and all(r["h"] == term_hash(r["term"]) for r in terms)
    assert term_postings(docs.limit(0)).count() == 0
