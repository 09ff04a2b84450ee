"""Registered queries of the engine, with DuckDB SQL of the same results."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textsieve.functions.globs import glob_regex
from textsieve.functions.grams import covering_terms, gram_rows, hashed_term, masked_trigrams, term_hashes, term_rows, trigram_rows
from textsieve.functions.weights import FIRST, FREQUENCY, SCALE, SECOND, SPREAD, SYMBOL_BONUS, UNRANKED, weight_column
from textsieve.operators.index import TableIndex, active_docs, candidates, overlay_diff, postings_of
from textsieve.operators.inspect import inspect_terms
from textsieve.operators.search import literal_matches, regex_matches, search_literal
from textsieve.plans.query_plan import explain, literal_condition, pruning
from textsieve.plans.translate import translate
from textsieve.plans.workflow import plan_search
from textsieve.scratch import Scratch
from textsieve.sources.corpus import DIGITS, LEVELS, snapshot_revision, table_corpus, text_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Literals and patterns that the test tables hold.
WORD, IP, PHONE, MAIL = "License", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", r"\d{3}-\d{4}", r"mail\d\.example"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CORPUS_SQL = {
    "documents": "SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content FROM documents",
    "pages": "SELECT page_id AS doc_id, 'pages/' || page_id || '.html' AS path, html AS content FROM pages",
    "conversations": "SELECT conv_id * 1000 + turn AS doc_id, role || '/' || conv_id || '/' || turn || '.txt' AS path, text AS content FROM conversations",
    "benchmark": "SELECT item_id AS doc_id, 'benchmark/' || item_id || '.txt' AS path, text AS content FROM benchmark",
}
PLACES = "path, start, line, col, end_line, end_col, match"


def _places(matches: DataFrame) -> DataFrame:
    """Places as the SQL names them; ask for matches without context."""
    return matches.select("path", "start", "line", F.col("column").alias("col"), "end_line", F.col("end_column").alias("end_col"), "match")


def _located_sql(rows: str, end: str, tail: str = "", columns: str = PLACES, before: int = 1, after: int = 1) -> str:
    """SQL over rows (path, content, start, match)."""
    line = "(1 + length({h}) - length(replace({h}, chr(10), '')))::BIGINT"
    column = "(length(string_split({h}, chr(10))[-1]) + 1)::BIGINT"
    return f"""
WITH m AS ({rows}), h AS (SELECT *, substr(content, 1, start) AS head, substr(content, 1, {end}) AS tail FROM m),
l AS (SELECT path, content, start, match, {line.format(h="head")} AS line, {column.format(h="head")} AS col, {line.format(h="tail")} AS end_line, {column.format(h="tail")} AS end_col,
  string_split_regex(content, '\\r?\\n') AS lines FROM h),
r AS (SELECT *, array_to_string(lines[greatest(1, line - {before}):line - 1], chr(10)) AS before, lines[line] AS current, array_to_string(lines[end_line + 1:end_line + {after}], chr(10)) AS after FROM l)
SELECT {columns} FROM r {tail}"""


def literal_sql(corpus: str, needle: str, where: str = "true", fold: bool = False, **options) -> str:
    searched, wanted = ("lower(content)", needle.lower()) if fold else ("content", needle)
    n = len(needle)
    rows = f"""SELECT path, content, start, substr(content, start + 1, {n}) AS match FROM (
  SELECT path, content, (list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * {n})::BIGINT AS start
  FROM (SELECT path, content, string_split({searched}, {_text(wanted)}) AS parts FROM ({CORPUS_SQL[corpus]}) WHERE contains({searched}, {_text(wanted)}) AND {where}) t, unnest(range(1, len(parts))) AS u(k))"""
    return _located_sql(rows, f"start + {n - 1}", **options)


def regex_sql(corpus: str, pattern: str, where: str = "true", **options) -> str:
    p = _text(pattern)
    rows = f"""SELECT path, content, match, (list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM (SELECT path, content, gaps, found, k, found[k] AS match FROM (SELECT path, content, string_split_regex(content, {p}) AS gaps, regexp_extract_all(content, {p}) AS found
    FROM ({CORPUS_SQL[corpus]}) WHERE regexp_matches(content, {p}) AND {where}) t, unnest(range(1, len(found) + 1)) AS u(k))"""
    return _located_sql(rows, "greatest(start, start + length(match) - 1)", **options)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_corpus(spark, sf_dir, "documents")


# Literal searches


@query("literal_matches", literal_sql("documents", WORD))
def literal_all(spark, sf_dir):
    return _places(literal_matches(_docs(spark, sf_dir), WORD, max_results=None, context=False))


@query("literal_matches_ci", literal_sql("documents", WORD, fold=True))
def literal_ci(spark, sf_dir):
    return _places(literal_matches(_docs(spark, sf_dir), WORD, case_sensitive=False, max_results=None, context=False))


@query("literal_path_glob", literal_sql("documents", WORD, "(regexp_matches(path, '^src1[^/]*/en/') OR regexp_matches(path, '^src2/'))"))
def literal_glob(spark, sf_dir):
    return _places(literal_matches(_docs(spark, sf_dir), WORD, path_globs=["src1*/en/*.txt", "src2/**"], max_results=None, context=False))


@query("literal_topk", literal_sql("documents", WORD, tail="ORDER BY path, start LIMIT 20"))
def literal_topk(spark, sf_dir):
    return _places(literal_matches(_docs(spark, sf_dir), WORD, max_results=20, context=False))


@query("literal_context", literal_sql("documents", "example.com", columns="path, start, before, current, after", before=2, after=2))
def literal_context(spark, sf_dir):
    found = literal_matches(_docs(spark, sf_dir), "example.com", max_results=None, before=2, after=2)
    return found.select("path", "start", F.array_join("context_before", "\n").alias("before"), F.col("context_line").alias("current"), F.array_join("context_after", "\n").alias("after"))


@query(
    "literal_counters",
    f"""WITH c AS ({CORPUS_SQL["documents"]}), n AS (SELECT path, len(string_split(content, '{WORD}')) - 1 AS n FROM c),
s AS (SELECT path, n, sum(n) OVER (ORDER BY path) AS cum, row_number() OVER (ORDER BY path) AS rk FROM n)
SELECT count(*) AS candidate_docs, coalesce(min(CASE WHEN cum >= 20 THEN rk END), count(*)) AS scanned_docs, least(sum(n), 20)::BIGINT AS match_count, sum(n) >= 20 AS truncated FROM s""",
)
def literal_counters(spark, sf_dir):
    found = search_literal(_docs(spark, sf_dir), WORD, max_results=20)
    matched = found.places.agg(F.count("*").alias("n"), F.max("path").alias("last"))
    n, last = matched.select("n").scalar(), matched.select("last").scalar()
    seen = found.candidates.select(((n < 20) | (F.col("path") <= last)).alias("seen"))
    return seen.agg(F.count("*").alias("candidate_docs"), F.count_if("seen").alias("scanned_docs")).select("candidate_docs", "scanned_docs", n.alias("match_count"), (n >= 20).alias("truncated"))


@query("pages_search", literal_sql("pages", 'class="ad"'))
def pages_search(spark, sf_dir):
    return _places(literal_matches(table_corpus(spark, sf_dir, "pages"), 'class="ad"', max_results=None, context=False))


@query("conversation_search", regex_sql("conversations", r"\bthe (\w+)\b", "path LIKE 'user/%'"))
def conversation_search(spark, sf_dir):
    return _places(regex_matches(table_corpus(spark, sf_dir, "conversations"), r"\bthe (\w+)\b", path_globs=["user/**"], max_results=None, context=False))


# Regex searches


def _regex(name: str, pattern: str, flags: str = "", sql: str | None = None) -> None:
    @query(name, regex_sql("documents", sql or pattern))
    def run(spark, sf_dir):
        return _places(regex_matches(_docs(spark, sf_dir), pattern, flags, max_results=None, context=False))


_regex("regex_matches", IP)
_regex("regex_alternation", r"License|example\.com")
_regex("regex_class_expansion", "[Ll]icense[ds]?")
_regex("regex_group_expansion", r"(MIT|Apache) License")
_regex("regex_anchorless_branch", rf"License|{PHONE}")
_regex("regex_multiline", r"^(Licensed|Released) under.*$", "m", r"(?m)^(Licensed|Released) under.*$")
_regex("regex_ignore_case", "license", "i", "(?i)license")
_regex("regex_full_scan", r"(?:\d{1,3}\.){3}\d{1,3}")


@query("regex_topk_context", regex_sql("documents", "###.*&&&", columns=PLACES + ", before, current, after", tail="ORDER BY path, start LIMIT 100"))
def regex_topk(spark, sf_dir):
    found = regex_matches(_docs(spark, sf_dir), "###.*&&&")
    return found.select("path", "start", "line", F.col("column").alias("col"), "end_line", F.col("end_column").alias("end_col"), "match", F.array_join("context_before", "\n").alias("before"), F.col("context_line").alias("current"), F.array_join("context_after", "\n").alias("after"))


@query("regex_doc_counts", f"SELECT doc_id, len(regexp_extract_all(text, '{PHONE}'))::BIGINT AS n FROM documents WHERE regexp_matches(text, '{PHONE}')")
def regex_counts(spark, sf_dir):
    java = translate(PHONE)
    return _docs(spark, sf_dir).where(F.col("content").rlike(java)).select("doc_id", F.regexp_count("content", F.lit(java)).cast("long").alias("n"))


# Plans and terms


PATTERNS = [("foo.*bar", ""), ("foo|bar", ""), ("token", "i"), ("MAX_.*SIZE", ""), (r"(?:\w+\s+){2,}\w+", ""), ("[rb]at", ""), ("(foo|bar)baz", ""), (r"foo|\d+", "")]
# The reported fields of PATTERNS.
PLAN_ROWS = [
    ("foo.*bar", "", 1, "foo,bar", False, "literal-covering", "search.regex"),
    ("foo|bar", "", 2, "foo,bar", False, "branch-covering", "search.regex"),
    ("token", "i", 1, "token", True, "full-scan-fallback", "search.literal"),
    ("MAX_.*SIZE", "", 1, "MAX_,SIZE", False, "literal-covering", "search.regex"),
    (r"(?:\w+\s+){2,}\w+", "", 1, "", True, "full-scan-fallback", "search.regex"),
    ("[rb]at", "", 1, "rat,bat", False, "literal-covering", "search.regex"),
    ("(foo|bar)baz", "", 1, "foobaz,barbaz", False, "literal-covering", "search.regex"),
    (r"foo|\d+", "", 2, "foo", False, "branch-covering", "search.literal"),
]


def _values(rows: list[tuple], names: str) -> str:
    shown = lambda x: _text(x) if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS v({names})"


@query("explain_plan", _values(PLAN_ROWS, "pattern, flags, branches, anchors, full_scan, mode, tool"))
def explain_plan(spark, sf_dir):
    plans = [(p, f, explain(p, f)) for p, f in PATTERNS]
    rows = [(p, f, e.alternation_branches, ",".join(e.extractable_anchors), e.requires_full_scan, e.planner_mode, e.recommended_tool) for p, f, e in plans]
    return spark.createDataFrame(rows, "pattern string, flags string, branches int, anchors string, full_scan boolean, mode string, tool string")


# Coverings of some literals.
COVERINGS = {
    "MAX_FILE_SIZE": [("MAX_", 0, 4, 463143), ("_FILE_S", 3, 10, 463856), ("_SIZE", 8, 13, 463856)],
    "HELLO_WORLD": [("HELL", 0, 4, 411248), ("O_W", 4, 7, 463924), ("_WO", 5, 8, 463924), ("RLD", 8, 11, 412034)],
    "function": [("fun", 0, 3, 417197), ("unct", 1, 5, 417197), ("ion", 5, 8, 300000)],
    "SIZE": [("SIZE", 0, 4, 412963)],
    "ab": [("ab", 0, 2, 380000)],
}


@query("covering_terms", _values([(k, *t) for k, v in COVERINGS.items() for t in v], "literal, term, start, stop, weight"))
def covering(spark, sf_dir):
    return spark.createDataFrame([(k, t.term, t.start, t.end, t.weight) for k in COVERINGS for t in covering_terms(k)], "literal string, term string, start int, stop int, weight int")


# The sparse n-grams of one text.
MAX_FILE_SIZE = "MA MAX MAX_ AX AX_ X_ X_F _F _FI _FIL _FILE _FILE_ _FILE_S FI FIL IL ILE LE LE_ E_ E_S _S _SI _SIZE SI SIZ SIZE IZ IZE ZE".split()


@query("inspect_terms", _values(list(enumerate(MAX_FILE_SIZE)), "place, term"))
def inspected(spark, sf_dir):
    found = inspect_terms(spark, "MAX_FILE_SIZE").terms
    return spark.createDataFrame([(i, t["term"]) for i, t in enumerate(found)], "place int, term string")


# Objectives, and the sequence that is recommended with a fresh index.
OBJECTIVES = [
    ("find where SEARCH_TOKEN is used", "", "search.literal", "SEARCH_TOKEN"),
    ("matches of `foo.*bar`", "", "search.regex", "foo.*bar"),
    ("long lines", r"(?:\w+\s+){2,}\w+", "query.explain,search.regex", r"(?:\w+\s+){2,}\w+"),
    ("find things", "", "search.literal", "things"),
]


@query("search_plan", _values(OBJECTIVES, "objective, pattern, sequence, searched"))
def search_plan(spark, sf_dir):
    rows = []
    for objective, pattern, *_ in OBJECTIVES:
        p = plan_search(objective, {"ready": True, "stale_paths": []}, pattern or None)
        rows.append((objective, pattern, ",".join(p.sequence), p.literal_args["needle"] if p.literal_args else p.regex_args["pattern"]))
    return spark.createDataFrame(rows, "objective string, pattern string, sequence string, searched string")


@query("trigram_df", "SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS n FROM (SELECT doc_id, substr(text, i, 3) AS term FROM documents, unnest(range(1, length(text) - 1)) AS u(i)) GROUP BY term")
def trigram_df(spark, sf_dir):
    per_doc = trigram_rows(_docs(spark, sf_dir).select("doc_id", "content")).groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("term").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))


@query(
    "masked_trigrams",
    """SELECT doc_id, term, min(i)::INT AS start, lpad(format('{:b}', bit_or(1 << (i % 8)::INT)), 8, '0') AS loc_mask, lpad(format('{:b}', bit_or(CASE WHEN nx = '' THEN 0 ELSE 1 << (unicode(nx) % 8)::INT END)), 8, '0') AS next_mask
FROM (SELECT conv_id * 1000 + turn AS doc_id, i, substr(text, (i + 1)::BIGINT, 3) AS term, substr(text, (i + 4)::BIGINT, 1) AS nx FROM conversations, unnest(range(0, length(text) - 2)) AS u(i)) GROUP BY doc_id, term""",
)
def masked(spark, sf_dir):
    return masked_trigrams(table_corpus(spark, sf_dir, "conversations").select("doc_id", "content"), ["doc_id"])


def _weight_sql(pair: str) -> str:
    table = ", ".join(f"{_text(p) if chr(10) not in p else 'chr(10) || ' + _text(p[1:])}: {max(1, SCALE - n)}" for p, n in FREQUENCY.items())
    return f"coalesce(MAP {{{table}}}[{pair}], {UNRANKED} + CASE WHEN regexp_matches({pair}, '[^a-zA-Z0-9]') THEN {SYMBOL_BONUS} ELSE 0 END + (unicode(substr({pair}, 1, 1)) * {FIRST} + unicode(substr({pair}, 2, 1)) * {SECOND}) % {SPREAD})"


_PAIRS_SQL = f"SELECT pair, n, {_weight_sql('pair')}::INT AS weight FROM (SELECT substr(text, i, 2) AS pair, count(*) AS n FROM documents, unnest(range(1, length(text))) AS u(i) GROUP BY 1)"


@query("bigram_weights", _PAIRS_SQL)
def bigram_weights(spark, sf_dir):
    pairs = gram_rows(_docs(spark, sf_dir).select("content"), 2).groupBy(F.col("term").alias("pair")).agg(F.count("*").alias("n"))
    return pairs.select("pair", "n", weight_column(F.col("pair")).cast("int").alias("weight"))


def _sparse_sql(table: str, key: str, longest: int = 24) -> str:
    """Characters as rows; windows over the rows that follow give all n-grams that begin at a character."""
    ahead = lambda c, k: f"lead({c}, {k}) OVER o AS {c}{k}" if k else f"{c} AS {c}0"
    chars = ", ".join(ahead("c", k) for k in range(longest))
    weights = ", ".join(ahead("w", k) for k in range(longest - 1))
    grams = []
    for size in range(2, longest + 1):
        inside = [f"w{k}" for k in range(1, size - 2)]
        sound = f"least(w0, w{size - 2}) > greatest({', '.join(inside)})" if inside else "true"
        term = " || ".join(f"c{k}" for k in range(size))
        grams.append(f"CASE WHEN w{size - 2} IS NOT NULL AND {sound} THEN {{'term': {term}, 'start': i::INT, 'stop': (i + {size})::INT, 'weight': greatest(w0, w{size - 2})::INT}} END")
    return f"""WITH s AS (SELECT {key} AS doc_id, unnest(range(0, length(text))) AS i, unnest(string_split(text, '')) AS c FROM {table}),
n AS (SELECT *, lead(c) OVER (PARTITION BY doc_id ORDER BY i) AS d FROM s), p AS (SELECT doc_id, i, c, CASE WHEN d IS NOT NULL THEN {_weight_sql("(c || d)")} END AS w FROM n),
a AS (SELECT doc_id, i, {chars}, {weights} FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, unnest(list_filter([{', '.join(grams)}], lambda x: x IS NOT NULL)) AS g FROM a)
SELECT doc_id, g.term AS term, g.start AS start, g.stop AS stop, g.weight AS weight FROM g"""


_TURNS_SQL = _sparse_sql("conversations", "conv_id * 1000 + turn")
_ITEMS_SQL = _sparse_sql("benchmark", "item_id")


def _sparse(spark, sf_dir, table: str) -> DataFrame:
    return term_rows(table_corpus(spark, sf_dir, table)).withColumnRenamed("end", "stop")


@query("sparse_terms", _ITEMS_SQL)
def sparse(spark, sf_dir):
    return _sparse(spark, sf_dir, "benchmark")


@query("inverted_index", f"SELECT term, doc_id, string_agg(start::VARCHAR, ',' ORDER BY start) AS positions FROM ({_ITEMS_SQL}) GROUP BY term, doc_id")
def inverted_index(spark, sf_dir):
    return _sparse(spark, sf_dir, "benchmark").groupBy("term", "doc_id").agg(F.array_join(F.sort_array(F.collect_list("start")), ",").alias("positions"))


@query("term_stats", f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs, sum(start)::BIGINT AS starts, sum(stop)::BIGINT AS stops, min(weight) AS weight FROM ({_TURNS_SQL}) GROUP BY term")
def term_stats(spark, sf_dir):
    """Every sparse n-gram of the conversations with its places, summed up by term; SQL over the documents would need more memory than they are worth."""
    per_doc = _sparse(spark, sf_dir, "conversations").groupBy("term", "doc_id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("stop").alias("stops"), F.min("weight").alias("weight"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"), F.sum("starts").alias("starts"), F.sum("stops").alias("stops"), F.min("weight").alias("weight"))


@query("posting_counts", f"SELECT term, count(DISTINCT doc_id) AS docs FROM ({_TURNS_SQL}) GROUP BY term")
def posting_counts(spark, sf_dir):
    """Documents of each term, read back from stored posting lists by the hash of the term."""
    docs = table_corpus(spark, sf_dir, "conversations")
    stored = Scratch(spark, "postings").save(postings_of(docs), "postings")
    counts = stored.groupBy("term_hash").agg(F.sum(F.size("docs")).alias("docs"))
    terms = term_rows(docs).select("term").distinct().withColumn("term_hash", hashed_term("term"))
    return terms.join(counts, "term_hash").select("term", "docs")


# Pruned searches


@query("posting_intersection", "SELECT doc_id FROM documents WHERE contains(text, 'License') AND contains(text, 'Apache')")
def posting_intersection(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    found = candidates(term_hashes(docs), ("and", (literal_condition("License"), literal_condition("Apache"))))
    return docs.join(found, "doc_id", "left_semi").where(F.contains("content", F.lit("License")) & F.contains("content", F.lit("Apache"))).select("doc_id")


@query("posting_union", "SELECT doc_id FROM documents WHERE contains(text, 'License') OR contains(text, 'example.com')")
def posting_union(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    found = candidates(term_hashes(docs), pruning(r"License|example\.com"))
    return docs.join(found, "doc_id", "left_semi").where(F.col("content").rlike(translate(r"License|example\.com"))).select("doc_id")


@query("pruned_regex_search", regex_sql("documents", MAIL))
def pruned_search(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    found = candidates(term_hashes(docs), pruning(MAIL))
    return _places(regex_matches(docs.join(found, "doc_id", "left_semi"), MAIL, max_results=None, context=False))


EQUAL = ["License", r"(MIT|Apache) License", MAIL, "[Ll]icense"]


@query("pruned_equals_scan", " UNION ALL ".join(f"SELECT {_text(p)} AS pattern, count(*) AS pruned, count(*) AS scanned FROM documents WHERE regexp_matches(text, {_text(p)})" for p in EQUAL))
def pruned_equals_scan(spark, sf_dir):
    docs, out = _docs(spark, sf_dir), None
    for p in EQUAL:
        hits = docs.where(F.col("content").rlike(translate(p))).select(F.lit(p).alias("pattern"), "doc_id")
        near = hits.join(candidates(term_hashes(docs), pruning(p)), "doc_id", "left_semi")
        rows = near.select("pattern", F.lit(1).alias("near"), F.lit(0).alias("all")).union(hits.select("pattern", F.lit(0), F.lit(1)))
        out = rows if out is None else out.union(rows)
    return out.groupBy("pattern").agg(F.sum("near").alias("pruned"), F.sum("all").alias("scanned"))


# Layers: a working copy in which some documents are deleted, edited or new


def _layers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    base = _docs(spark, sf_dir).select("doc_id", "path", "content", F.sha2("content", 256).alias("content_hash"))
    kept = base.where("doc_id % 17 <> 0").withColumn("content", F.when(F.col("doc_id") % 13 == 0, F.concat("content", F.lit(" edited License"))).otherwise(F.col("content")))
    new = base.where("doc_id % 19 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.concat(F.lit("new/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "content")
    working = kept.select("doc_id", "path", "content").union(new)
    return base, working.withColumn("content_hash", F.sha2("content", 256))


_LAYERS_SQL = f"""WITH c AS ({CORPUS_SQL["documents"]}), base AS (SELECT doc_id, path, content, sha256(content) AS content_hash FROM c),
work0 AS (SELECT doc_id, path, CASE WHEN doc_id % 13 = 0 THEN content || ' edited License' ELSE content END AS content FROM c WHERE doc_id % 17 <> 0
  UNION ALL SELECT doc_id + 1000000, 'new/' || doc_id || '.txt', content FROM c WHERE doc_id % 19 = 0),
work AS (SELECT *, sha256(content) AS content_hash FROM work0)"""
_DIFF_SQL = _LAYERS_SQL + """, diff AS (SELECT coalesce(b.path, w.path) AS path, CASE WHEN w.path IS NULL THEN 'deleted' WHEN b.path IS NULL THEN 'added' WHEN b.content_hash <> w.content_hash THEN 'changed' END AS change
FROM base b FULL OUTER JOIN work w ON b.path = w.path)"""


@query("overlay_diff", _DIFF_SQL + " SELECT path, change FROM diff WHERE change IS NOT NULL")
def diff(spark, sf_dir):
    return overlay_diff(*_layers(spark, sf_dir))


@query("stale_paths", _DIFF_SQL + " SELECT path FROM diff WHERE change IS NOT NULL ORDER BY path")
def stale(spark, sf_dir):
    return overlay_diff(*_layers(spark, sf_dir)).select("path").orderBy("path")


def _active(spark, sf_dir) -> DataFrame:
    base, working = _layers(spark, sf_dir)
    changes = overlay_diff(base, working)
    overlay = working.join(changes.where("change <> 'deleted'"), "path", "left_semi").select("path", "content", "content_hash")
    return active_docs(base.select("path", "content", "content_hash"), overlay, changes.where("change = 'deleted'"))


@query("active_docs", _DIFF_SQL + " SELECT w.path, w.content_hash, CASE WHEN d.change IS NULL THEN 'base' ELSE 'overlay' END AS layer FROM work w LEFT JOIN diff d ON w.path = d.path")
def active(spark, sf_dir):
    return _active(spark, sf_dir).select("path", "content_hash", "layer")


@query("tombstone_search", _LAYERS_SQL + " SELECT path, len(string_split(content, 'License')) - 1 AS n FROM work WHERE contains(content, 'License')")
def tombstones(spark, sf_dir):
    return literal_matches(_active(spark, sf_dir), WORD, max_results=None, context=False).groupBy("path").agg(F.count("*").alias("n"))


# A stored index: base, overlay, searches, status and clearing


def _stored(spark, sf_dir, refreshed: bool = True) -> tuple[TableIndex, DataFrame, list[dict]]:
    """An index of the documents, and the working copy that its overlay holds if it is refreshed."""
    base, working = _layers(spark, sf_dir)
    index = TableIndex(spark, Scratch(spark, "index").root, f"documents of {sf_dir}")
    made = [index.ensure(base)]
    return index, working, [*made, index.ensure(working)] if refreshed else made


@query("index_ensure", _DIFF_SQL + """ SELECT (SELECT count(*) FROM base) AS file_count, (SELECT count(*) FROM diff WHERE change IN ('added', 'changed')) AS overlay_file_count,
(SELECT count(*) FROM diff WHERE change = 'deleted') AS deleted, false AS first_reused, true AS then_reused, true AS same_base""")
def index_ensure(spark, sf_dir):
    index, _, (first, then) = _stored(spark, sf_dir)
    row = (then["file_count"], then["overlay_file_count"], index.manifest()["overlay"]["deleted"], first["reused"], then["reused"], first["base_id"] == then["base_id"])
    return spark.createDataFrame([row], "file_count long, overlay_file_count long, deleted long, first_reused boolean, then_reused boolean, same_base boolean")


@query("index_changes", _DIFF_SQL + " SELECT d.path, change, w.content_hash FROM diff d LEFT JOIN work w ON d.path = w.path WHERE change IS NOT NULL")
def index_changes(spark, sf_dir):
    return _stored(spark, sf_dir)[0].changes()


@query("index_docs", _DIFF_SQL + " SELECT w.doc_id, w.path, w.content_hash, CASE WHEN d.change IS NULL THEN 'base' ELSE 'overlay' END AS layer FROM work w LEFT JOIN diff d ON w.path = d.path")
def index_docs(spark, sf_dir):
    return _stored(spark, sf_dir)[0].docs().select("doc_id", "path", "content_hash", "layer")


@query("index_status", _DIFF_SQL + " SELECT path, change FROM diff WHERE change IS NOT NULL")
def index_status(spark, sf_dir):
    """What is stale before the overlay is refreshed."""
    index, working, _ = _stored(spark, sf_dir, refreshed=False)
    return index.stale(working)


@query("index_fresh", _LAYERS_SQL + " SELECT true AS ready, 0::BIGINT AS stale_count, count(*) AS file_count FROM base")
def index_fresh(spark, sf_dir):
    index, working, _ = _stored(spark, sf_dir)
    status = index.status(working)
    return spark.createDataFrame([tuple(status[c] for c in ("ready", "stale_count", "file_count"))], "ready boolean, stale_count long, file_count long")


@query("index_literal_search", _LAYERS_SQL + f" SELECT path, len(string_split(content, '{WORD}')) - 1 AS n FROM work WHERE contains(content, '{WORD}')")
def index_literal_search(spark, sf_dir):
    found = _stored(spark, sf_dir)[0].literal_candidates(WORD)
    return literal_matches(found, WORD, max_results=None, context=False).groupBy("path").agg(F.count("*").alias("n"))


@query("index_regex_search", _LAYERS_SQL + f" SELECT path, len(regexp_extract_all(content, {_text(MAIL)}))::BIGINT AS n FROM work WHERE regexp_matches(content, {_text(MAIL)})")
def index_regex_search(spark, sf_dir):
    found = _stored(spark, sf_dir)[0].regex_candidates(MAIL)
    return regex_matches(found, MAIL, max_results=None, context=False).groupBy("path").agg(F.count("*").alias("n"))


@query("index_prunes", _LAYERS_SQL + f", own AS (SELECT count(*) AS hits FROM work WHERE contains(content, {_text('Apache License')})) SELECT hits, true AS all_found, true AS pruned FROM own")
def index_prunes(spark, sf_dir):
    """Candidates hold every hit, and are fewer than half of the documents."""
    index = _stored(spark, sf_dir)[0]
    near = index.literal_candidates("Apache License").agg(F.count("*").alias("near"), F.count_if(F.contains("content", F.lit("Apache License"))).alias("hits"))
    whole = index.corpus().agg(F.count("*").alias("docs"), F.count_if(F.contains("content", F.lit("Apache License"))).alias("all_hits"))
    counts = {**near.first().asDict(), **whole.first().asDict()}
    row = (counts["hits"], counts["hits"] == counts["all_hits"], 2 * counts["near"] < counts["docs"])
    return spark.createDataFrame([row], "hits long, all_found boolean, pruned boolean")


@query("index_clear", f"SELECT doc_id, path, sha256(content) AS content_hash, 'base' AS layer FROM ({CORPUS_SQL['documents']})")
def index_clear(spark, sf_dir):
    index = _stored(spark, sf_dir)[0]
    index.clear("overlay")
    return index.docs().select("doc_id", "path", "content_hash", "layer")


@query("index_cleared", "SELECT false AS ready, true AS cleared, 0::BIGINT AS stored_bytes")
def index_cleared(spark, sf_dir):
    index = _stored(spark, sf_dir, refreshed=False)[0]
    cleared = index.clear("all")["cleared"]
    return spark.createDataFrame([(index.status()["ready"], cleared, index.stored_bytes())], "ready boolean, cleared boolean, stored_bytes long")


# Fingerprints and filters


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash, strlen(text)::BIGINT AS size FROM documents")
def content_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("content_hash"), F.octet_length("content").cast("long").alias("size"))


def _revision_sql() -> str:
    """Digests of digests, from the buckets of paths up."""
    rows = f"SELECT sha256(path || ':' || sha256(content)) AS d, substr(sha256(path), 1, {LEVELS * DIGITS}) AS bucket FROM ({CORPUS_SQL['documents']})"
    for level in range(LEVELS, -1, -1):
        rows = f"SELECT substr(bucket, 1, {level * DIGITS}) AS bucket, sha256(string_agg(d, chr(10) ORDER BY d)) AS d FROM ({rows}) GROUP BY 1"
    return f"SELECT 'snapshot:' || d AS revision FROM ({rows})"


@query("snapshot_revision", _revision_sql())
def revision(spark, sf_dir):
    return snapshot_revision(_docs(spark, sf_dir).withColumn("content_hash", F.sha2("content", 256)))


@query("text_filter", "SELECT page_id AS doc_id, NOT contains(html, chr(0)) AND len(regexp_extract_all(html, '[\\x01-\\x08\\x0E-\\x1F]')) / greatest(strlen(html), 1) < 0.02 AS is_text FROM pages")
def filtered(spark, sf_dir):
    return table_corpus(spark, sf_dir, "pages").select("doc_id", text_filter(F.col("content").cast("binary")).alias("is_text"))


@query("glob_filter", f"SELECT path FROM ({CORPUS_SQL['documents']}) WHERE regexp_matches(path, {_text(glob_regex('src1?/{de,fr}/*[!0-4].txt'))})")
def globbed(spark, sf_dir):
    from textsieve.functions.globs import glob_filter

    return _docs(spark, sf_dir).where(glob_filter(F.col("path"), ["src1?/{de,fr}/*[!0-4].txt"])).select("path")


@query("line_context", "SELECT doc_id, line, string_split(text, chr(10))[line] AS text, lag(string_split(text, chr(10))[line]) OVER w AS before, lead(string_split(text, chr(10))[line]) OVER w AS after FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(line) WINDOW w AS (PARTITION BY doc_id ORDER BY line)")
def line_context(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("content", "\n", -1)).alias("at", "text"))
    w = Window.partitionBy("doc_id").orderBy("at")
    return lines.select("doc_id", (F.col("at") + 1).cast("long").alias("line"), "text", F.lag("text").over(w).alias("before"), F.lead("text").over(w).alias("after"))


@query("many_matches", """WITH d AS (SELECT doc_id, text || repeat(' ab', 20000) AS content FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)), p AS (SELECT doc_id, string_split(content, 'ab') AS parts FROM d),
k AS (SELECT doc_id, unnest(range(1, len(parts))) AS k, unnest(parts[1:len(parts) - 1]) AS gap FROM p), s AS (SELECT k, sum(length(gap)) OVER (ORDER BY k) + 2 * (k - 1) AS start FROM k)
SELECT count(*) AS n, sum(start)::BIGINT AS starts, max(start)::BIGINT AS last FROM s""")
def many_matches(spark, sf_dir):
    """Twenty thousand matches in one text: the first document with a long tail."""
    docs = _docs(spark, sf_dir)
    first = docs.agg(F.min("doc_id").alias("doc_id"))
    long = docs.join(F.broadcast(first), "doc_id", "left_semi").withColumn("content", F.concat("content", F.repeat(F.lit(" ab"), F.lit(20_000))))
    found = regex_matches(long, "ab", max_results=None, context=False)
    return found.agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.max("start").alias("last"))


@query("plan_json")
def plan_json(spark, sf_dir):
    """All fields of the plans of PATTERNS as JSON."""
    return spark.createDataFrame([(p, f, json.dumps(explain(p, f).as_dict(), sort_keys=True)) for p, f in PATTERNS], "pattern string, flags string, plan string")
