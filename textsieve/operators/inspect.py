"""Inspection of the terms of a text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textsieve.config import MAX_TERMS_SHOWN
from textsieve.errors import SearchError
from textsieve.functions.grams import masked_trigrams, sparse_terms

NOTES = {
    "sparse": "Windows of any length whose outer pairs weigh more than all pairs between them.",
    "trigram": "All overlapping windows of three characters.",
    "masked-trigram": "Trigrams with masks of their places and of the characters that follow them.",
}


@dataclass
class Inspection:
    mode: str
    term_count: int  #: of the terms shown
    terms: list[dict]
    notes: list[str]


def inspect_terms(spark: SparkSession, text: str | None = None, path: str | None = None, mode: str = "sparse", max_terms: int = MAX_TERMS_SHOWN) -> Inspection:
    """The first ``max_terms`` terms of a text, or of a file; exactly one of both is given, and not empty."""
    if bool(text) == bool(path):
        raise SearchError("INVALID_INPUT", "give exactly one of text and path")
    if mode not in NOTES:
        raise SearchError("INVALID_INPUT", f"mode is one of {', '.join(NOTES)}")
    if path:
        with open(path, encoding="utf-8", errors="replace", newline="") as f:
            text = f.read()
    if mode == "sparse":
        terms = [{"term": t.term, "start": t.start, "end": t.end, "weight": t.weight} for t in sparse_terms(text)]
    elif mode == "trigram":
        terms = [{"term": text[i : i + 3], "start": i, "end": i + 3} for i in range(len(text) - 2)]
    else:
        rows = masked_trigrams(spark.createDataFrame([(text,)], "content string"), [])
        terms = [r.asDict() | {"end": r["start"] + 3} for r in rows.orderBy(F.col("start")).collect()]
    terms = terms[:max_terms]
    return Inspection(mode, len(terms), terms, [NOTES[mode]])
