"""Sparse n-grams, their coverings, and trigrams.

A sparse n-gram is a window of at most MAX_TERM characters whose first and last
character pairs both weigh more than every pair between them.  Windows of two
and three characters have no pair between, so all of them count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsieve.config import MAX_TERM
from textsieve.functions.weights import pair_weights, weight_column
from textsieve.session import share_package, spread

_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
#: Characters whose terms are found and grouped at once.
SLICE_CHARS = 1 << 20
_powers: dict[str, np.ndarray] = {}


def codes_of(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def window_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of windows of a text, as signed integers."""
    up, down = _power(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        return _mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)).view(np.int64)


def term_hash(term: str) -> int:
    """Key of a term in the index."""
    codes = codes_of(term)
    return int(window_hashes(codes, np.array([0]), np.array([len(codes)]))[0])


def sparse_windows(codes: np.ndarray, longest: int = MAX_TERM, ordered: bool = True, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, weight) of all sparse n-grams of a text, by (start, end).

    All windows of one length are tested at once.  The greatest weight inside a
    window only grows with its length, so a start whose own pair no longer
    exceeds it is left out of all longer windows; few starts live long.
    owner: text of each character, if there are several; no window crosses them.
    """
    w = pair_weights(codes) if len(codes) > 1 else np.zeros(0, dtype=np.int64)
    at = np.arange(len(w))
    inside = np.full(len(w), -1, dtype=np.int64)
    starts, ends, weights = [], [], []
    for size in range(2, longest + 1):
        fits = at + size <= len(codes)
        if owner is not None:
            fits &= owner[at] == owner[np.minimum(at + size - 1, len(codes) - 1)]
        at, inside = at[fits], inside[fits]
        if size > 3:
            inside = np.maximum(inside, w[at + size - 3])
            alive = w[at] > inside
            at, inside = at[alive], inside[alive]
        if not len(at):
            break
        last = w[at + size - 2]
        hit = last > inside
        starts.append(at[hit])
        ends.append(at[hit] + size)
        weights.append(np.maximum(w[at[hit]], last[hit]))
    if not starts:
        return (np.zeros(0, dtype=np.int64),) * 3
    s, e, x = np.concatenate(starts), np.concatenate(ends), np.concatenate(weights)
    if not ordered:
        return s, e, x
    order = np.lexsort((e, s))
    return s[order], e[order], x[order]


@dataclass(frozen=True)
class Term:
    term: str
    start: int
    end: int
    weight: int


def sparse_terms(text: str, longest: int = MAX_TERM) -> list[Term]:
    """All sparse n-grams of a text with their places; none for fewer than two characters."""
    return [Term(text[s:e], s, e, x) for s, e, x in zip(*(v.tolist() for v in sparse_windows(codes_of(text), longest)), strict=True)]


def covering_terms(text: str, longest: int = MAX_TERM) -> list[Term]:
    """The fewest sparse n-grams that overlap or touch from start to end; of equally few, the heaviest and longest.

    A cover of the first e characters is a cover of fewer plus a term that ends
    at e and begins no later than that cover stops.  For each e the cut before
    it moves left, the best cover to its right is kept at hand, and each term
    that begins at the cut is tried with it; so a term is looked at once.
    Of equal covers the one with the shorter prefix stays, then the one whose
    last term begins first.
    """
    n = len(text)
    ending: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for s, e, weight in zip(*(v.tolist() for v in sparse_windows(codes_of(text), longest)), strict=True):
        ending[e][s] = weight
    # Of the best cover up to each place: (terms, minus score); and (prefix, start of the last term).
    cost: list[tuple[int, int] | None] = [(0, 0), *[None] * n]
    last: list[tuple[int, int]] = [(0, 0)] * (n + 1)
    for e in range(1, n + 1):
        prefix, best = None, None
        for cut in range(e - 1, max(e - longest, 0) - 1, -1):
            if cost[cut] is not None and (prefix is None or cost[cut] <= cost[prefix]):
                prefix = cut
            if cut in ending[e] and prefix is not None:
                terms, score = cost[prefix]
                found = (terms + 1, score - (e - cut) * 1000 - ending[e][cut], prefix, cut)
                best = found if best is None else min(best, found)
        if best is not None:
            cost[e], last[e] = best[:2], best[2:]
    cover, at = [], n
    while at and cost[n] is not None:
        prefix, start = last[at]
        cover.append(Term(text[start:at], start, at, ending[at][start]))
        at = prefix
    return cover[::-1]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE_CHARS together, or of one text."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > SLICE_CHARS:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def _pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the terms of some texts, each once per text, by hash and text."""
    codes = codes_of("".join(texts))
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    found = []
    for at in range(0, len(codes), SLICE_CHARS):  # a long text is cut; windows that begin in a piece may end after it
        piece = slice(at, min(at + SLICE_CHARS + MAX_TERM - 1, len(codes)))
        start, end, _ = sparse_windows(codes[piece], ordered=False, owner=owner[piece])
        own = start < SLICE_CHARS
        start, end = start[own], end[own]
        found.append((window_hashes(codes[piece], start, end), owner[piece][start]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    hashes, text = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(hashes, kind="stable")  # windows of one term have one length and stand in order of their texts
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], text[new]


def term_postings(docs: DataFrame) -> DataFrame:
    """(term_hash, docs) of rows (doc_id, content): doc_ids by term, grouped within about SLICE_CHARS of text.

    A term has a row for each group of documents that hold it, a document is
    once among a term's.  Null contents have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _slices(texts):
                hashes, text = _pairs(texts[lo:hi])
                first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, dtype=np.int64)
                bounds = np.append(first, len(hashes)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[first]), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids[lo:hi][text].astype(np.int64)))], names=["term_hash", "docs"])

    share_package(docs.sparkSession)
    return spread(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "content")).mapInArrow(run, "term_hash long, docs array<long>")


def term_hashes(docs: DataFrame) -> DataFrame:
    """(term_hash, doc_id) of rows (doc_id, content), each term once per document.  Null contents have none."""
    return term_postings(docs).select("term_hash", F.explode("docs").alias("doc_id"))


def term_rows(docs: DataFrame, longest: int = MAX_TERM) -> DataFrame:
    """(doc_id, term, start, end, weight): every sparse n-gram of rows (doc_id, content), with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start, end, weight = sparse_windows(codes_of(text or ""), longest)
                terms = pa.array([text[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), i), pa.int64()), terms, *(pa.array(x.astype(np.int32)) for x in (start, end, weight))], names=["doc_id", "term", "start", "end", "weight"])

    share_package(docs.sparkSession)
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "content").mapInArrow(run, "doc_id long, term string, start int, `end` int, weight int")


def hashed_term(term: str) -> Column:
    """``term_hash`` of a column of terms."""

    @F.pandas_udf("long")
    def run(terms: pd.Series) -> pd.Series:
        codes = codes_of("".join(terms))
        end = np.cumsum(terms.str.len().to_numpy(dtype=np.int64))
        return pd.Series(window_hashes(codes, end - terms.str.len().to_numpy(dtype=np.int64), end))

    return run(F.col(term))


# Column forms


def pair_weight_array(text: Column) -> Column:
    """Weights of the adjacent pairs of a text column."""
    n = F.length(text)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: weight_column(F.substring(text, i, F.lit(2))))).otherwise(F.array().cast("array<int>"))


def sparse_term_array(text: Column, weights: Column, longest: int = MAX_TERM) -> Column:
    """array<struct<term, start, end, weight>> of a text column and its pair weights (a column of its own)."""
    n = F.size(weights)

    def windows(s: Column) -> Column:
        ends = F.sequence(s, F.least(n, s + longest - 2))
        sound = F.filter(ends, lambda e: (e - s <= 1) | (F.least(weights[s - 1], weights[e - 1]) > F.array_max(F.slice(weights, s + 1, F.greatest(e - s - 1, F.lit(1))))))
        return F.transform(sound, lambda e: F.struct(F.substring(text, s, e - s + 2).alias("term"), (s - 1).alias("start"), (e + 1).alias("end"), F.greatest(weights[s - 1], weights[e - 1]).alias("weight")))

    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), windows)))


def characters(text: Column) -> Column:
    """The characters of a text column as an array."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def gram_rows(docs: DataFrame, size: int, content: str = "content") -> DataFrame:
    """All overlapping windows of ``size`` characters: the columns of ``docs`` but its text, with (term, start, end, next).

    next is the character that follows, an empty string at the end.
    """
    kept = [c for c in docs.columns if c != content]
    cut = docs.where(F.length(content) >= size).select(*kept, characters(F.col(content)).alias("_chars"))
    at = F.col("_chars")
    windows = F.transform(F.sequence(F.lit(0), F.size(at) - size), lambda i: F.struct(F.concat(*[at[i + k] for k in range(size)]).alias("term"), i.alias("start"), F.coalesce(F.try_element_at(at, i + size + 1), F.lit("")).alias("next")))
    # explode_outer: for explode, the optimizer would build the array once more, to filter by its size
    rows = cut.select(*kept, F.explode_outer(windows).alias("_g"))
    return rows.select(*kept, "_g.term", "_g.start", (F.col("_g.start") + size).alias("end"), "_g.next")


def trigram_rows(docs: DataFrame, content: str = "content") -> DataFrame:
    """All overlapping three-character windows."""
    return gram_rows(docs, 3, content)


def masked_trigrams(docs: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Trigrams with masks of their places and of the characters that follow, both modulo 8.

    (keys, term, start, loc_mask, next_mask): start is that of the first occurrence.
    """
    bit = lambda i: F.expr(f"shiftleft(1, cast({i} as int))")
    rows = trigram_rows(docs, content).withColumn("loc", bit("pmod(start, 8)")).withColumn("nxt", F.when(F.length("next") > 0, F.expr("shiftleft(1, cast(pmod(ascii(next), 8) as int))")).otherwise(0))
    shown = lambda c: F.lpad(F.bin(F.bit_or(c)), 8, "0")
    return rows.groupBy(*keys, "term").agg(F.min("start").alias("start"), shown("loc").alias("loc_mask"), shown("nxt").alias("next_mask"))
