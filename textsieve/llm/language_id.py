"""Language identification by word-first backoff.

A word that the training texts hold is scored by its log frequency in each
language.  An unseen word falls back to its character n-grams: of the longest
order of which it has a known n-gram the mean log frequency is taken, from
ORDERS[0] down to single characters.  A text's score is the sum over its words.

Frequencies come from labelled documents only, from a bounded sample of each
language, so that rare languages are learned as well as frequent ones and the
model's size does not follow the corpus.  Every word and n-gram of the sample
is in the model; it holds an entry for a language only where that has it, and
all languages are smoothed alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.llm import kernels as K
from textsieve.scratch import Scratch
from textsieve.session import spread

#: Labelled documents of each language that are fitted on, at most (about, chosen by hash).
TRAIN_DOCS = 5_000
#: Character n-grams, longest first; 0 stands for whole words.
ORDERS = (5, 4, 3, 2, 1)
SMOOTHING = 0.5
UNDETERMINED = "und"
#: A mean that stands for at most so many words when scores become a probability.
EVIDENCE = 20

#: Word bytes: letters of ASCII and all bytes of other characters.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[97:123] = LETTERS[128:] = True


def _grams(words: K.Words, which: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, index into ``which``) of the n-grams of some words."""
    heads = np.append(np.flatnonzero((words.data & 0xC0) != 0x80), len(words.data))
    a, b = np.searchsorted(heads, words.start[which]), np.searchsorted(heads, words.end[which])
    n = np.maximum(b - a - order + 1, 0)
    owner = np.repeat(np.arange(len(which)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + a[owner]
    return words.range_hashes(heads[at], heads[at + order]), owner


@dataclass
class Model:
    """Per order (0: words): ascending hashes, the entries of each, and what an unseen language has.

    The entries of hash i are those from first[i] to first[i + 1]: a language
    and how much its log frequency exceeds that of a language without entry.
    """

    languages: list[str]
    keys: dict[int, np.ndarray]
    first: dict[int, np.ndarray]
    lang: dict[int, np.ndarray]
    more: dict[int, np.ndarray]
    least: dict[int, np.ndarray]  #: log frequency without entry, of each language

    def look(self, order: int, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where it is unknown."""
        keys = self.keys[order]
        if not len(keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, at, -1)

    def sums(self, order: int, row: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
        """Summed log frequencies of known entries, owners x languages."""
        size = len(self.languages)
        counts = self.first[order][row + 1] - self.first[order][row]
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.first[order][row], counts)
        cell = np.repeat(owner, counts) * size + self.lang[order][at]
        out = np.bincount(cell, weights=self.more[order][at], minlength=owners * size).reshape(owners, size)
        return out + np.bincount(owner, minlength=owners)[:, None] * self.least[order][None, :]

    def scores(self, words: K.Words) -> tuple[np.ndarray, np.ndarray]:
        """Summed log frequencies, documents x languages, and the number of known words of each document."""
        docs, size = len(words.first) - 1, len(self.languages)
        h = words.hashes()
        row = self.look(0, h)
        known = row >= 0
        total = self.sums(0, row[known], words.doc[known], docs)
        unseen = np.flatnonzero(~known)
        if len(unseen):
            _, one, back = np.unique(h[unseen], return_index=True, return_inverse=True)
            which = unseen[one]
            own = np.zeros((len(which), size))
            left = np.arange(len(which))
            for order in ORDERS:
                if not len(left):
                    break
                grams, owner = _grams(words, which[left], order)
                row = self.look(order, grams)
                hit = row >= 0
                n = np.bincount(owner[hit], minlength=len(left))
                has = n > 0
                own[left[has]] = self.sums(order, row[hit], owner[hit], len(left))[has] / n[has, None]
                left = left[~has]
            for j in range(size):
                total[:, j] += np.bincount(words.doc[unseen], weights=own[back, j], minlength=docs)
        return total, np.bincount(words.doc[known], minlength=docs)


def train(documents: DataFrame, scratch: Scratch) -> Model:
    """Fit on rows (text, lang, key): of each language about TRAIN_DOCS at most, those of least hash of key."""
    counts = {r["lang"]: r["n"] for r in documents.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # languages are few
    languages = sorted(counts)
    if not languages:
        return Model([], {}, {}, {}, {}, {})
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, round(1_000_000 * min(1.0, TRAIN_DOCS / counts[lang])))])
    sample = documents.where(F.pmod(F.xxhash64("key", F.lit("language")), F.lit(1_000_000)) < share[F.col("lang")])
    code = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffer(batch.column(0))
            lang = np.array([code[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for lo, hi in K.slices(offsets):
                at = offsets[lo : hi + 1]
                words = K.words_of(data[at[0] : at[-1]], at - at[0], LETTERS)
                if not len(words.start):
                    continue
                h, of = words.hashes(), lang[lo:hi][words.doc]
                for j in np.unique(of).tolist():
                    mine = np.flatnonzero(of == j)
                    distinct, one, n = np.unique(h[mine], return_index=True, return_counts=True)
                    parts = [(0, distinct, n)]
                    for order in ORDERS:
                        grams, owner = _grams(words, mine[one], order)
                        g, back = np.unique(grams, return_inverse=True)
                        parts.append((order, g, np.bincount(back, weights=n[owner], minlength=len(g)).astype(np.int64)))
                    for order, keys, counts in parts:
                        size = len(keys)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(size, order, dtype=np.int32)), pa.array(keys.view(np.int64)), pa.array(np.full(size, j, dtype=np.int32)), pa.array(counts)], names=["order", "hash", "lang", "n"])

    # The bounded sample's distinct words and n-grams: one row for each of them and language.
    counted = sample.select("text", "lang").mapInArrow(run, "order int, hash long, lang int, n long").groupBy("order", "hash", "lang").agg(F.sum("n").alias("n"))
    table = scratch.save(counted, "counts").toArrow()
    scratch.drop("counts")
    order, key, lang, n = (table.column(c).to_numpy() for c in ("order", "hash", "lang", "n"))
    model = Model(languages, {}, {}, {}, {}, {})
    for o in (0, *ORDERS):
        own = np.flatnonzero(order == o)
        own = own[np.lexsort((lang[own], key[own].view(np.uint64)))]
        model.keys[o], first = np.unique(key[own].view(np.uint64), return_index=True)
        model.first[o] = np.append(first, len(own)).astype(np.int64)
        model.lang[o], held = lang[own].astype(np.int64), n[own].astype(np.float64)
        model.more[o] = (np.log(held + SMOOTHING) - np.log(SMOOTHING)).astype(np.float32)
        totals = np.bincount(model.lang[o], weights=held, minlength=len(languages))
        model.least[o] = np.log(SMOOTHING) - np.log(np.maximum(totals, 1) + SMOOTHING * (len(model.keys[o]) + 1))
    return model


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(documents: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The columns ``carry`` with lang_pred, score, n_words and known_words, a row for each row (text and carry).

    known_words of the n_words (runs of letters) are in the model.  A null text, or one without any letter, is ``und`` with score 0.  Equal
    scores go to the language that sorts first; a model without languages
    gives ``und``.
    """
    spark: SparkSession = documents.sparkSession
    held = spark.sparkContext.broadcast(model)
    kinds = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            data, offsets = K.text_buffer(batch.column(len(carry)))
            for lo, hi in K.slices(offsets):
                at = offsets[lo : hi + 1]
                words = K.words_of(data[at[0] : at[-1]], at - at[0], LETTERS)
                n = np.diff(words.first)
                names, best, known = [UNDETERMINED] * (hi - lo), np.zeros(hi - lo), np.zeros(hi - lo, dtype=np.int64)
                if model.languages:
                    plain = np.zeros(len(words.data) + 1, dtype=np.int64)
                    np.cumsum((words.data >= 97) & (words.data <= 122), out=plain[1:])
                    bounds = at - at[0]
                    lettered = plain[bounds[1:]] > plain[bounds[:-1]]
                    for i in np.flatnonzero(~lettered & (n > 0)):
                        lettered[i] = _has_letter(words.data[bounds[i] : bounds[i + 1]].tobytes())
                    scores, known = model.scores(words)
                    scaled = scores * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
                    chance = np.exp(scaled - scaled.max(1, keepdims=True))
                    chance /= chance.sum(1, keepdims=True)
                    top = scores.argmax(1)
                    best = np.where(lettered, chance[np.arange(hi - lo), top], 0.0)
                    names = [model.languages[j] if ok else UNDETERMINED for j, ok in zip(top.tolist(), lettered.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(carry))), pa.array(names, pa.string()), pa.array(best), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64))], names=[*carry, "lang_pred", "score", "n_words", "known_words"])

    return documents.select(*carry, F.col("text").cast("string")).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", lang_pred string, score double, n_words long, known_words long")


def identify(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_words, known_words): one row per row of ``documents``.

    held_out: crc32 of doc_id as text is a multiple of 5; such rows, and rows
    with a null text, lang or doc_id, are not learned from.  A null doc_id is
    not held out.  A prediction depends on the text alone, so repeated rows
    agree; an empty table gives no rows.  Only doc_id, text and lang are read.
    """
    spark: SparkSession = documents.sparkSession
    K.tune(spark)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rows = spread(documents.select("doc_id", "text", "lang")).withColumn("held_out", F.coalesce(fold == 0, F.lit(False)))
    labelled = rows.where(~F.col("held_out") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    scratch = Scratch(spark, "language")
    model = train(labelled.select("text", "lang", F.col("doc_id").alias("key")), scratch)
    return predict(rows.select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over the whole table ``documents``."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
