import os
import subprocess

import pytest

from textsieve.engine import Engine
from textsieve.errors import SearchError
from textsieve.functions.globs import IgnoreRules, glob_regex
from textsieve.functions.grams import term_hashes
from textsieve.operators.index import candidates, postings_of
from textsieve.plans.query_plan import pruning
from textsieve.operators.search import literal_matches, regex_matches, search_literal
from textsieve.sources.corpus import is_text, revision_of, snapshot_revision, text_filter
from textsieve.streaming.feed import feed_postings


def corpus(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "path string, content string")


def test_literal_places_and_context(spark):
    (m,) = literal_matches(corpus(spark, "a\r\nneedle x\r\nb"), "needle").collect()
    assert (m["start"], m["line"], m["column"], m["end_line"], m["end_column"]) == (3, 2, 1, 2, 6)
    assert (m["context_before"], m["context_line"], m["context_after"]) == (["a"], "needle x", ["b"])
    (m,) = literal_matches(corpus(spark, "x\ny"), "x\ny").collect()
    assert (m["line"], m["end_line"], m["end_column"]) == (1, 2, 1)
    assert [r["start"] for r in literal_matches(corpus(spark, "aaaa"), "aa").collect()] == [0, 2]
    assert literal_matches(corpus(spark, "aB", None), "Ab", case_sensitive=False).first()["match"] == "aB"
    assert literal_matches(corpus(spark, r"a\E.b", "a.b"), r"\E.").count() == 1
    assert literal_matches(corpus(spark, "a\0b\0b"), "b").count() == 2
    with pytest.raises(SearchError, match="INVALID_INPUT"):
        literal_matches(corpus(spark, "a"), "")


def test_limits_and_counters(spark):
    docs = corpus(spark, "xx x", "x", "none", "x")
    stats = search_literal(docs, "x", max_results=4).stats()
    assert stats == {"candidate_docs": 4, "scanned_docs": 2, "match_count": 4, "truncated": True}
    assert search_literal(docs, "x", max_results=5).stats()["truncated"] and search_literal(docs, "x", max_results=6).stats()["scanned_docs"] == 4
    assert [r["path"] for r in literal_matches(docs, "x", max_results=4).collect()] == ["d0", "d0", "d0", "d1"]


def test_regex(spark):
    rows = regex_matches(corpus(spark, "aab"), "a*").collect()
    assert [(r["start"], r["match"], r["end_column"]) for r in rows] == [(0, "aa", 2), (2, "", 3), (3, "", 4)]
    assert [r["start"] for r in regex_matches(corpus(spark, "aaa"), "a", max_results=2).collect()] == [0, 1]
    assert [r["match"] for r in regex_matches(corpus(spark, "bb", None, ""), r"(?:(a)|b)\1").collect()] == ["b", "b"]
    assert regex_matches(corpus(spark, "foo1x", "bar1x"), r"(foo\w|bar\d)x").count() == 2
    assert regex_matches(corpus(spark, "a"), "zz").count() == 0


def test_globs_and_ignore_rules():
    import re

    for glob, yes, no in [("**/*", ["a", ".a", "x/.b/c"], []), ("src/*.ts", ["src/a.ts"], ["src/b/a.ts", "a.ts"]), ("src/**", ["src/a/b"], ["a/src"]), ("*.{js,ts}", ["a.ts"], ["a.tsx"]), ("[!a]?", ["bc"], ["ab", "b/"])]:
        rule = re.compile("(?s)" + glob_regex(glob))
        assert all(rule.match(p) for p in yes) and not any(rule.match(p) for p in no), glob
    rules = IgnoreRules(["*.log", "!keep.log", "/build", "out/", "# c", "a/**/z"])
    assert [p for p in ("x.log", "b/keep.log", "build/x", "c/build", "out/x", "out", "a/b/z", "q") if rules.ignores(p)] == ["x.log", "build/x", "out/x", "a/b/z"]


def test_text_filter(spark):
    cases = [b"", b"abc", b"a\0b", b"x" * 49 + b"\1", b"x" * 50 + b"\1", b"\t\n"]
    want = [True, True, False, False, True, True]
    assert [is_text(c) for c in cases] == want
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, c binary")
    assert [r[1] for r in df.select("i", text_filter(df["c"])).orderBy("i").collect()] == want


def write(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_snapshot_index(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("ignored.txt\n")
    write(tmp_path, src__constants_dot_ts="export const MAX_FILE_SIZE = 1024;\n", ignored_dot_txt="MAX_FILE_SIZE\n")
    engine = Engine(spark, str(tmp_path))
    with pytest.raises(SearchError, match="INDEX_NOT_READY"):
        engine.search_literal("MAX_FILE_SIZE", auto_ensure=False)
    assert engine.plan_search("find MAX_FILE_SIZE").first == "index.ensure"
    made = engine.index.ensure()
    assert made["mode"] == "snapshot" and made["file_count"] == 2 and made["ignore_updated"]
    again = engine.index.ensure()
    assert again["reused"] and not again["ignore_updated"] and again["base_id"] == made["base_id"]
    status = engine.index.status()
    assert status["ready"] and status["stale_paths"] == []
    found = engine.search_literal("MAX_FILE_SIZE")
    assert [r["path"] for r in found.matches.collect()] == ["src/constants.ts"] and found.stats()["candidate_docs"] == 1
    found = engine.search_regex("MAX_.*SIZE", include_plan=True)
    assert found.stats()["match_count"] == 1 and found.plan.planner_mode == "literal-covering"
    assert engine.search_regex("max_file", "i").stats()["candidate_docs"] == 2
    write(tmp_path, src__new_dot_ts="q")
    assert engine.index.status()["stale_paths"] == ["src/new.ts"]
    assert engine.manifest().count() == 1 and engine.stats().first()["file_count"] == 2
    engine.index.clear("all")
    assert not engine.index.status()["ready"] and engine.manifest().count() == 0


def test_git_overlay(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    write(tmp_path, src__config_dot_ts="export const MAX_FILE_SIZE = 1024;\n", src__old_dot_ts="OLD_VALUE\n")
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "x")
    write(tmp_path, src__config_dot_ts="export const MAX_UPLOAD_BYTES = 2048;\n")
    os.remove(tmp_path / "src/old.ts")
    engine = Engine(spark, str(tmp_path))
    made = engine.index.ensure()
    assert made["mode"] == "git" and made["overlay_file_count"] == 2  # the edited file and the new ignore file
    assert engine.search_literal("MAX_UPLOAD_BYTES").stats()["match_count"] == 1
    assert engine.search_literal("MAX_FILE_SIZE").stats()["match_count"] == 0
    assert engine.search_literal("OLD_VALUE").stats()["match_count"] == 0
    engine.index.clear("overlay")
    assert engine.search_literal("MAX_FILE_SIZE", auto_ensure=False).stats()["match_count"] == 1


def test_index_outside_of_the_workspace(spark, tmp_path):
    write(tmp_path, w__token_dot_ts="export const SEARCH_TOKEN = 'abc';\n")
    for index, boot in ((str(tmp_path / "index"), True), (str(tmp_path / "w" / ".textsieve"), False)):
        made = Engine(spark, str(tmp_path / "w"), index, boot).index.ensure()
        assert (made["ignore_path"], made["ignore_entry"], made["ignore_updated"]) == (None, None, False)
    assert not (tmp_path / "w" / ".gitignore").exists()


@pytest.mark.parametrize("pattern", ["foo", "foo|bar", "foobar", "(foo|xyz)bar", "foo.*bar", "[fb]oo|zzz"])
def test_pruned_search_equals_scan(spark, pattern):
    texts = ["foo", "bar", "foobar", "xyzbar foo", "boo", "zzz", "fo o", "", None, "foo and bar"]
    docs = spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(texts)], "doc_id long, path string, content string")
    near = candidates(term_hashes(docs), pruning(pattern))
    pruned = regex_matches(docs.join(near, "doc_id", "left_semi"), pattern).collect()
    assert pruned == regex_matches(docs, pattern).collect() and near.select("doc_id").distinct().count() < len(texts)


def test_revisions_agree(spark):
    rows = spark.createDataFrame([(f"p{i % 7}/{i}", f"h{i}") for i in range(50)], "path string, content_hash string")
    assert revision_of(rows) == snapshot_revision(rows).first()[0]


def test_streamed_postings(spark, tmp_path):
    spark.createDataFrame([(1, "foo bar"), (2, "bar")], "doc_id long, content string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, content string").parquet(str(tmp_path / "in"))
    feed_postings(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id").distinct().count() == 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_push_down_and_prune(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"src/{i}.txt", f"foo bar {i}", "x") for i in range(50)], "doc_id long, path string, content string, unused string")
    docs.write.parquet(str(tmp_path / "docs"))
    held = spark.read.parquet(str(tmp_path / "docs"))
    postings_of(held).write.parquet(str(tmp_path / "postings"))
    postings = spark.read.parquet(str(tmp_path / "postings"))
    lookup = plan_of(candidates(postings, pruning("foo.*bar")))
    assert "In(term_hash" in lookup and lookup.count("Exchange") <= 2
    single = plan_of(candidates(postings, pruning("foo|bar")))
    assert "Exchange" not in single and "In(term_hash" in single
    scan = plan_of(literal_matches(held, "foo", path_globs=["src/1*"]))
    assert "StringContains(content,foo)" in scan and "TakeOrderedAndProject" in scan and "unused" not in scan and "Python" not in scan
    assert "Python" not in plan_of(regex_matches(held, r"foo\s\w+"))


def brute_matches(path, text, find, before, after):
    """Places and context of matches, by plain string operations."""
    import re

    lines, out = re.split(r"\r?\n", text), []
    place = lambda at: (text.count("\n", 0, at) + 1, at - (text.rfind("\n", 0, at) + 1) + 1)
    for start, match in find(text):
        (line, column), (end_line, end_column) = place(start), place(max(start, start + len(match) - 1))
        out.append((path, start, line, column, end_line, end_column, match, lines[max(0, line - 1 - before) : line - 1], lines[line - 1], lines[end_line : end_line + after]))
    return out


def test_places_and_context_equal_brute_force(spark):
    import random

    import regex

    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "b", "\n", "\r\n", "ab", "é", "😀", "\0", " "]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    docs = corpus(spark, *texts)
    for pattern in ("a", "ab*", "b*", "a\\n?", "(?:a|b|\\n)+", "^|b", "\\0", "$"):
        for before, after in ((1, 1), (0, 2), (3, 0)):
            got = [tuple(r) for r in regex_matches(docs, pattern, max_results=None, before=before, after=after).collect()]
            rule = regex.compile(pattern.replace("$", r"\Z").replace("\\0", "\0"))

            def find(t, rule=rule):
                at, out = 0, []
                while at <= len(t) and (m := rule.search(t, at)):
                    out.append((m.start(), m.group()))
                    at = max(m.end(), m.start() + 1)
                return out

            want = [m for i, t in enumerate(texts) for m in brute_matches(f"d{i}", t, find, before, after)]
            assert got == sorted(want, key=lambda m: (m[0], m[1])), pattern
    for needle, fold in (("ab", False), ("a\n", False), ("AB", True), ("b", True)):
        def find(t, n=needle, fold=fold):
            at, out, searched, wanted = 0, [], t.lower() if fold else t, n.lower() if fold else n
            while (at := searched.find(wanted, at)) >= 0:
                out.append((at, t[at : at + len(wanted)]))
                at += len(wanted)
            return out

        got = [tuple(r) for r in literal_matches(docs, needle, case_sensitive=not fold, max_results=None).collect()]
        want = [m for i, t in enumerate(texts) for m in brute_matches(f"d{i}", t, find, 1, 1)]
        assert got == sorted(want, key=lambda m: (m[0], m[1])), needle
        limited = [tuple(r)[:2] for r in literal_matches(docs, needle, case_sensitive=not fold, max_results=7, context=False).collect()]
        assert limited == [m[:2] for m in got[:7]]


def test_empty_matches_beside_others(spark):
    """As the successive matches of ECMAScript, in the JVM and in Python."""
    for pattern, want in (("^|b", [(0, "")]), ("(?=b)|b", [(0, "")]), (r"(?:(x)|b)?\1|^", [(0, "b"), (1, "")])):
        assert [(r["start"], r["match"]) for r in regex_matches(corpus(spark, "b"), pattern, context=False).collect()] == want


def test_many_matches_in_one_text(spark):
    n = 50_000
    docs = corpus(spark, "ab\n" * n)
    for found in (regex_matches(docs, "b", max_results=None, context=False), literal_matches(docs, "b", max_results=None, context=False), literal_matches(docs, "B", case_sensitive=False, max_results=None)):
        row = found.selectExpr("count(*) as n", "sum(start) as s", "max(line) as l", "max(`column`) as c").first()
        assert tuple(row) == (n, sum(3 * i + 1 for i in range(n)), n, 2)


def test_repeated_paths_are_documents_of_their_own(spark):
    docs = spark.createDataFrame([("p", "a b a"), ("p", "a b a"), ("p", "b a")], "path string, content string")
    assert sorted(r["start"] for r in regex_matches(docs, "a", max_results=None).collect()) == [0, 0, 2, 4, 4]


def test_texts_with_nul_are_searched(spark):
    docs = corpus(spark, "x\0License", "\0")
    assert [r["start"] for r in regex_matches(docs, "License").collect()] == [2] and literal_matches(docs, "License").count() == 1


def test_table_index(spark, tmp_path):
    from textsieve.operators.index import TableIndex

    rows = [(i, f"p/{i}", f"text {i} {'needle' if i % 10 == 0 else 'hay'}", "extra") for i in range(100)]
    base = spark.createDataFrame(rows, "doc_id long, path string, content string, layer2 string").drop("layer2")
    index = TableIndex(spark, f"file://{tmp_path}", "t")
    assert index.status() == {"ready": False, "workspace_id": index.workspace_id, "stale_paths": [], "file_count": 0, "overlay_file_count": 0}
    with pytest.raises(SearchError, match="INDEX_NOT_READY"):
        index.corpus()
    made = index.ensure(base)
    assert not made["reused"] and made["file_count"] == 100 and made["stored_bytes"] > 0
    paths = lambda: sorted(r["path"] for r in literal_matches(index.literal_candidates("needle"), "needle", max_results=None).collect())
    assert paths() == sorted(f"p/{i}" for i in range(0, 100, 10)) and index.literal_candidates("needle").count() < 50
    now = base.where("doc_id > 10").selectExpr("doc_id", "path", "if(doc_id = 20, 'gone', content) as content").union(spark.createDataFrame([(500, "p/new", "a needle")], base.schema))
    assert index.status(now)["stale_count"] == 13 and index.stale(now).where("change = 'deleted'").count() == 11
    again = index.ensure(now)
    assert again["reused"] and again["base_id"] == made["base_id"] and again["overlay_file_count"] == 2
    assert paths() == ["p/30", "p/40", "p/50", "p/60", "p/70", "p/80", "p/90", "p/new"] and index.status(now)["stale_count"] == 0
    revision = index.manifest()["overlay"]["revision"]
    index.ensure(now)
    assert index.manifest()["overlay"]["revision"] == revision
    index.ensure(base)
    assert len(paths()) == 10 and index.manifest()["overlay"]["revision"] == "overlay-empty"
    index.ensure(now.where("false"))
    assert paths() == [] and index.docs().count() == 0
    assert index.ensure(now, force=True)["file_count"] == 90
    assert index.clear("all")["cleared"] and not index.status()["ready"]


def test_unchanged_files_are_not_read_again(spark, tmp_path, monkeypatch):
    from textsieve.operators import index as module

    write(tmp_path, a_dot_txt="needle\n")
    engine = Engine(spark, str(tmp_path), str(tmp_path / "ix"))
    engine.index.ensure()
    engine.index.ensure()  # the ignore file is new
    monkeypatch.setattr(module, "discover", None)
    assert engine.index.ensure()["reused"] and engine.search_literal("needle").stats()["match_count"] == 1


def test_store(spark, tmp_path):
    from textsieve.sources.store import Store

    for root in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        store = Store(spark, root)
        assert store.read("x", "y.json") is None and store.size() == 0 and not store.exists("x")
        store.write("é\n1", "x", "y.json")
        store.write("é\n2", "x", "y.json")
        assert store.read("x", "y.json") == "é\n2" and store.size() > 0
        store.delete("x")
        assert store.read("x", "y.json") is None
