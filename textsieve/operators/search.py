"""Literal and regex search over (path, content), verified exactly.

Everything stays in JVM expressions and is linear in the texts and matches: a
text is split once at its matches, its pieces become rows, and running sums
over them give offsets, lines and columns.  A text is neither split nor
searched again for a match.  With a limit of k, only the first k matching
documents by path are split, as the results lie in them, and content is joined
back for the k results alone, from which their context is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from textsieve.config import CONTEXT_LINES, MAX_RESULTS
from textsieve.errors import SearchError
from textsieve.functions.globs import glob_filter
from textsieve.plans.query_plan import QueryPlan, explain
from textsieve.plans.translate import translate
from textsieve.session import share_package

PLACES = ["path", "start", "line", "column", "end_line", "end_column", "match"]
COLUMNS = [*PLACES, "context_before", "context_line", "context_after"]
_KEY = ["path", "_row"]
#: Characters of a segment that matches in lower case are cut from.
SEGMENT = 4096


def _in_order() -> WindowSpec:
    return Window.partitionBy(*_KEY).orderBy("_pos")


def quoted(text: str) -> str:
    """A Java regex for exactly this text."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _first_documents(hits: DataFrame, most: int | None, keep_content: bool) -> DataFrame:
    """Matching documents with a row number; with a limit, the first ``most`` by path.

    Where the content is needed again, documents are dealt out by their key, so
    that both uses read one exchange.
    """
    cut = (hits if most is None else hits.orderBy("path").limit(most)).withColumn("_row", F.monotonically_increasing_id())
    return cut.repartition(*_KEY) if keep_content else cut


def _regex_pieces(docs: DataFrame, java: str, most: int | None) -> DataFrame:
    """(path, _row, _pos, gap, match): each match with the text between it and the one before.

    No match begins inside a surrogate pair, so that offsets count code points.
    ``split`` leaves out the empty gap before an empty match at the start.
    """
    whole = F.lit(rf"(?![\uDC00-\uDFFF])(?:{java})")
    cut = docs.select(*_KEY, F.split("content", whole, -1).alias("_gaps"), F.regexp_extract_all("content", whole, F.lit(0)).alias("_found"))
    gaps = F.when(F.size("_gaps") == F.size("_found"), F.concat(F.array(F.lit("")), "_gaps")).otherwise(F.col("_gaps"))
    both = F.arrays_zip(gaps.alias("gap"), F.col("_found").alias("match"))
    # posexplode_outer: for a plain one the optimizer would build the array once more, to filter by its size
    rows = cut.select(*_KEY, F.posexplode_outer(both if most is None else F.slice(both, 1, most)).alias("_pos", "_piece"))
    return rows.select(*_KEY, "_pos", "_piece.gap", "_piece.match")


def _literal_pieces(docs: DataFrame, searched: Column, needle: str, most: int | None) -> DataFrame:
    """As ``_regex_pieces``, for a literal; the text after the last match is no piece."""
    rows = docs.select(*_KEY, F.posexplode_outer(F.split(searched, quoted(needle), -1 if most is None else most + 1)).alias("_pos", "gap"))
    return rows.withColumn("match", F.when(F.lead(F.lit(True)).over(_in_order()), F.lit(needle)))


def _python_pieces(docs: DataFrame, pattern: str, most: int | None) -> DataFrame:
    """Documents (path, content) that match a pattern which java.util.regex can't express, with their pieces."""
    share_package(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        find = regex.compile(pattern)
        for frame in frames:
            pieces = []
            for text in frame["content"]:
                text, own, end, at = text or "", [], 0, 0
                while at <= len(text) and (most is None or len(own) < most) and (m := find.search(text, at)):
                    own.append({"gap": text[end : m.start()], "match": m.group()})
                    end = m.end()
                    at = max(end, m.start() + 1)  # after an empty match the next one begins a character later
                pieces.append(own)
            frame["pieces"] = pieces
            yield frame[[len(x) > 0 for x in pieces]]

    return docs.mapInPandas(run, "path string, content string, pieces array<struct<gap string, match string>>")


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def last_line(text: Column) -> Column:
    """Length of what stands after the last line feed."""
    return F.length(F.substring_index(text, "\n", -1))


def placed(pieces: DataFrame) -> DataFrame:
    """Pieces with a match, with offsets, lines and columns: (path, _row, start, line, column, end_line, end_column, match)."""
    body = F.expr("substring(match, 1, length(match) - 1)")  # up to the place of the last character
    sizes = pieces.select(
        *_KEY,
        "_pos",
        "match",
        F.length("gap").cast("long").alias("_gap"),
        newlines(F.col("gap")).alias("_gap_lines"),
        last_line(F.col("gap")).alias("_gap_tail"),
        F.length("match").alias("_size"),
        newlines(F.col("match")).alias("_lines"),
        last_line(F.col("match")).alias("_tail"),
        newlines(body).alias("_body_lines"),
        last_line(body).alias("_body_tail"),
    )
    upto = _in_order().rowsBetween(Window.unboundedPreceding, 0)
    before = _in_order().rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    start = F.sum("_gap").over(upto) + zero(F.sum("_size").over(before))
    line = 1 + F.sum("_gap_lines").over(upto) + zero(F.sum("_lines").over(before))
    rows = sizes.withColumns({"start": start.cast("long"), "line": line.cast("long")})
    # Where the current line begins: after the last line feed of a gap so far or of a match before.
    in_gap = F.max(F.when(F.col("_gap_lines") > 0, F.col("start") - F.col("_gap_tail"))).over(upto)
    in_match = F.max(F.when(F.col("_lines") > 0, F.col("start") + F.col("_size") - F.col("_tail"))).over(before)
    rows = rows.withColumn("column", F.col("start") - F.greatest(zero(in_gap), zero(in_match)) + 1).where("match is not null")
    end_column = F.when(F.col("_body_lines") > 0, F.col("_body_tail") + 1).otherwise(F.col("column") + F.greatest(F.col("_size") - 1, F.lit(0)))
    return rows.select(*_KEY, "start", "line", "column", (F.col("line") + F.col("_body_lines")).alias("end_line"), end_column.cast("long").alias("end_column"), "match")


def _beside(places: DataFrame, parts: DataFrame, place: str, part: str) -> DataFrame:
    """Places with the part (a segment or line, by number) of their document that each of them names.

    A document is told by its row number.  Its path may be null and takes part
    only so that all uses of the documents ask for the same columns: then Spark
    reads one exchange for all of them.
    """
    renamed = parts.withColumnsRenamed({"path": "_path", "_row": "_of", part: "_part"})
    at = (F.col("_row") == F.col("_of")) & (F.col(place) == F.col("_part")) & F.col("path").eqNullSafe(F.col("_path"))
    return places.join(renamed, at).drop("_path", "_of", "_part")


def with_original(places: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Places that were found in lower case, with their matches cut from the text itself.

    The text is cut into segments, so that a match is cut from two of them and not from the whole.
    """
    step = max(SEGMENT, size)
    cut = docs.select(*_KEY, F.posexplode_outer(F.regexp_extract_all("content", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))).alias("_pos", "_text"))
    segments = cut.select(*_KEY, F.col("_pos").cast("long").alias("_number"), F.concat("_text", F.coalesce(F.lead("_text").over(_in_order()), F.lit(""))).alias("_text"))
    rows = _beside(places.withColumn("_segment", F.floor(F.col("start") / step)), segments, "_segment", "_number")
    return rows.withColumn("match", F.substring(F.col("_text"), (F.col("start") % step + 1).cast("int"), F.lit(size))).select(places.columns)


def with_context(places: DataFrame, docs: DataFrame, before: int, after: int) -> DataFrame:
    """Places with the lines around them; a text is cut into lines once."""
    lines = docs.select(*_KEY, F.posexplode_outer(F.split("content", "\r?\n", -1)).alias("_pos", "_text"))
    around = lambda first, last: F.collect_list("_text").over(_in_order().rowsBetween(first, last)) if first <= last else F.array().cast("array<string>")
    lines = lines.select(*_KEY, (F.col("_pos") + 1).cast("long").alias("_line"), around(-before, -1).alias("context_before"), F.col("_text").alias("context_line"), around(1, after).alias("context_after"))
    begun = _beside(places, lines.drop("context_after"), "line", "_line")
    return _beside(begun, lines.select(*_KEY, "_line", "context_after"), "end_line", "_line").select(COLUMNS)


def ordered(matches: DataFrame, most: int | None) -> DataFrame:
    """By path, then offset; the first ``most``."""
    out = matches.orderBy("path", "start")
    return out if most is None else out.limit(most)


def _results(places: DataFrame, docs: DataFrame, most: int | None, before: int, after: int, context: bool, folded: int = 0) -> DataFrame:
    """folded: characters of a needle that was found in lower case, else 0."""
    if most is not None and (context or folded):
        places = ordered(places, most)
    if folded:
        places = with_original(places, docs, folded)
    return ordered(with_context(places, docs, before, after) if context else places.select(PLACES), most)


def literal_matches(docs: DataFrame, needle: str, case_sensitive: bool = True, path_globs: list[str] | None = None, max_results: int | None = MAX_RESULTS, before: int = CONTEXT_LINES, after: int = CONTEXT_LINES, context: bool = True) -> DataFrame:
    """Non-overlapping occurrences of a literal, from left to right.

    Without case, both sides are lower-cased, places are those in the
    lower-cased text (which very few characters make longer), and the match is
    cut from the original text.  Null contents match nothing; an empty needle is refused.
    context: whether to add the lines around each match.
    """
    if not needle:
        raise SearchError("INVALID_INPUT", "the needle is empty")
    scoped = docs.select("path", "content").where(glob_filter(F.col("path"), path_globs))
    searched = F.col("content") if case_sensitive else F.lower("content")
    wanted = needle if case_sensitive else needle.lower()
    held = _first_documents(scoped.where(F.contains(searched, F.lit(wanted))), max_results, context or not case_sensitive)
    pieces = _literal_pieces(held, searched, wanted, max_results)
    return _results(placed(pieces), held, max_results, before, after, context, 0 if case_sensitive else len(wanted))


def regex_matches(docs: DataFrame, pattern: str, flags: str = "", path_globs: list[str] | None = None, max_results: int | None = MAX_RESULTS, before: int = CONTEXT_LINES, after: int = CONTEXT_LINES, context: bool = True) -> DataFrame:
    """Successive matches of an ECMAScript pattern; an empty match ends where it starts.

    Null contents match nothing.  context: whether to add the lines around each match.
    """
    scoped = docs.select("path", "content").where(glob_filter(F.col("path"), path_globs))
    try:
        java = translate(pattern, flags)
    except SearchError as no:
        if no.code != "UNSUPPORTED_REGEX":
            raise
        held = _first_documents(_python_pieces(scoped, translate(pattern, flags, "python"), max_results), max_results, context)
        pieces = held.select(*_KEY, F.posexplode_outer("pieces").alias("_pos", "_piece")).select(*_KEY, "_pos", "_piece.gap", "_piece.match")
        held = held.drop("pieces")
    else:
        held = _first_documents(scoped.where(F.col("content").rlike(java)), max_results, context)
        pieces = _regex_pieces(held, java, max_results)
    return _results(placed(pieces), held, max_results, before, after, context)


@dataclass
class SearchResult:
    """Matches as a lazy DataFrame, and counters that are computed on demand."""

    kind: str
    matches: DataFrame
    candidates: DataFrame  #: (path) of the documents that were to be searched
    max_results: int | None
    plan: QueryPlan | None = None
    places: DataFrame | None = None  #: (path) of the matches, without their context
    _stats: dict = field(default_factory=dict)

    def stats(self) -> dict:
        """candidate_docs, scanned_docs, match_count and truncated.

        Documents count as scanned up to the one, in path order, that holds the
        last result; truncated says that the limit was reached, even exactly.
        """
        if not self._stats:
            count, last = (self.matches if self.places is None else self.places).agg(F.count("*"), F.max("path")).first()
            total = self.candidates.count()
            full = self.max_results is not None and count >= self.max_results
            scanned = self.candidates.where(F.col("path") <= last).count() if full and last is not None else total
            self._stats = {"candidate_docs": total, "scanned_docs": scanned, "match_count": count, "truncated": full}
        return self._stats


def search_literal(docs: DataFrame, needle: str, candidates: DataFrame | None = None, **options) -> SearchResult:
    """``literal_matches`` within the candidates (all documents if None)."""
    scope = (docs if candidates is None else docs.join(candidates, "path", "left_semi")).where(glob_filter(F.col("path"), options.get("path_globs")))
    found = literal_matches(scope, needle, **options)
    return SearchResult("literal", found, scope.select("path"), options.get("max_results", MAX_RESULTS), places=literal_matches(scope, needle, **options | {"context": False}))


def search_regex(docs: DataFrame, pattern: str, flags: str = "", candidates: DataFrame | None = None, include_plan: bool = False, **options) -> SearchResult:
    """``regex_matches`` within the candidates (all documents if None)."""
    scope = (docs if candidates is None else docs.join(candidates, "path", "left_semi")).where(glob_filter(F.col("path"), options.get("path_globs")))
    found = regex_matches(scope, pattern, flags, **options)
    return SearchResult("regex", found, scope.select("path"), options.get("max_results", MAX_RESULTS), explain(pattern, flags) if include_plan else None, regex_matches(scope, pattern, flags, **options | {"context": False}))
