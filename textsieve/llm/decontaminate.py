"""Benchmark decontamination by template canonicalisation.

Words are put in canonical form: numbers (of digits, points and commas), names (capitalised words inside a
sentence) and units (after a number) become typed placeholders, other words
their lower-case form.  Windows of canonical words of the documents and of the
benchmark items are hash-joined, and the windows of a document that lie on one
diagonal (same distance between both positions) form an alignment.  An
alignment counts if it covers enough of the item and its slots are consistent:
each value of the item stands for one value of the document and the other way
round.  So a question with other numbers or names in the same places is caught.

Windows of mostly placeholders say too little to stand for a template: tables
of numbers would match each other.  Therefore every window with placeholders is
also sent as its raw words, so that a verbatim copy (in any case of letters)
matches however rich in numbers or names it is; with other values, an item is
known by its other windows alone, and its coverage is counted over these.
What stands before a window decides whether its first word opens a sentence or
follows a number, so a name or unit there is also sent as the word it is.
Items of fewer than LEAST words match where their words are a sentence of their
own; within other sentences such runs of words say nothing.

Documents send on only windows that a bit table of the benchmark's window
hashes lets pass; the table has a fixed size, whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.llm import kernels as K
from textsieve.scratch import Scratch
from textsieve.session import spread

#: Words of a window; shorter items are one window, those of fewer than LEAST words a sentence.
WINDOW, LEAST = 8, 5
#: An alignment counts from this share of the item's windows, or this many of them.
COVERAGE, ENOUGH = 0.5, 6
#: Bits of the table that documents' windows are held against (8 MB).
TABLE_BITS = 26
UNITS = "mm cm m km ft feet inch inches mile miles yard yards g kg mg lb lbs oz ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes hour hours day days week weeks month months year years percent usd eur dollar dollars euro euros cent cents mph kmh hz khz mhz ghz kb mb gb tb w kw v degrees celsius fahrenheit".split()
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x11D7A3C5B9E80F21, 0x22E8B4D6CAF91032, 0x33F9C5E7DB0A2143))
_FACTORS = np.random.default_rng(9151).integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SCHEMA = "id long, at int, size int, hash long, slots array<long>, total int, light boolean"


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[K.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, raw hashes, canonical hashes, slot values, whether a word opens a sentence): a slot value is 0 where a word stands for itself."""
    digit = (data >= 48) & (data <= 57)
    point = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        point[1:-1] = ((data[1:-1] == 44) | (data[1:-1] == 46)) & digit[:-2] & digit[2:]
    words = K.words_of(data, offsets, K.ALNUM, point)
    raw = words.hashes()
    if not len(raw):
        return words, raw, raw, raw, np.zeros(0, dtype=bool)
    figures = np.concatenate([[0], np.cumsum(digit | point)])
    number = figures[words.end] - figures[words.start] == words.end - words.start
    stop = np.isin(data, np.frombuffer(b".?!:;\n\r\"", dtype=np.uint8)) & ~point
    stop = np.concatenate([[0], np.cumsum(stop)])
    opens = np.ones(len(raw), dtype=bool)
    opens[1:] = (words.doc[1:] != words.doc[:-1]) | (stop[words.start[1:]] > stop[words.end[:-1]])
    head = data[words.start]
    name = (head >= 65) & (head <= 90) & ~opens & ~number & (words.end - words.start > 1)
    follows = np.zeros(len(raw), dtype=bool)
    follows[1:] = number[:-1] & ~opens[1:]
    unit = follows & np.isin(raw, K.hash_words(" ".join(UNITS), K.ALNUM))
    form = raw.copy()
    form[name], form[unit], form[number] = _NAME, _UNIT, _NUMBER
    return words, raw, form, np.where(name | unit | number, raw | np.uint64(1), np.uint64(0)), opens


def _sums(form: np.ndarray, size: int) -> np.ndarray:
    """Weighted sums of all runs of ``size`` words."""
    n = max(len(form) - size + 1, 0)
    sums = np.full(n, size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            sums += form[j : j + n] * _FACTORS[j]
    return sums


def _windows(words: K.Words, raw: np.ndarray, form: np.ndarray, slot: np.ndarray, opens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words, hashes, light) of the windows within documents.

    A form is light if at least half of its words stand for themselves.  Light
    windows are sent in canonical form, those with slots also as raw words, and
    those whose first word is a name or a unit also with this word as it is.
    Windows of fewer than LEAST words are sent as raw words if they are a sentence.
    """
    n = max(len(form) - size + 1, 0)
    if size < LEAST:
        ends = np.append(opens[1:], True)[size - 1 :]
        at = np.flatnonzero((words.doc[:n] == words.doc[size - 1 : size - 1 + n]) & opens[:n] & ends[:n])
        return at, K.mix64(_sums(raw, size)[at]), np.zeros(len(at), dtype=bool)
    plain = np.concatenate([[0], np.cumsum(slot == 0)])
    plain = plain[size : size + n] - plain[:n]
    own = words.doc[:n] == words.doc[size - 1 : size - 1 + n]
    depends = (slot[:n] != 0) & (form[:n] != _NUMBER)
    light, freed = 2 * plain >= size, depends & (2 * (plain + 1) >= size)
    template, verbatim, first = np.flatnonzero(own & light), np.flatnonzero(own & (plain < size)), np.flatnonzero(own & freed & (plain + 1 < size))
    sums = _sums(form, size)
    with np.errstate(over="ignore"):
        hashes = [sums[template], _sums(raw, size)[verbatim], sums[first] + (raw[first] - form[first]) * _FACTORS[0]]
    at = np.concatenate([template, verbatim, first])
    return at, K.mix64(np.concatenate(hashes)), (light | freed)[at]


def windows(rows: DataFrame, sizes: list[int] | None, table: np.ndarray | None = None) -> DataFrame:
    """Windows of rows (id, text): (id, at, size, hash, slots, total, light).

    sizes None: each text is an item, cut into windows of WINDOW words, or one
    window if it has fewer; total is the number of places of windows, and slots
    are 0 where a word stands for itself.  Else all words are slots: those of
    the item say which count.  table: only windows whose bit is set are
    returned.  light: whether the window can be sent in canonical form.
    """
    held = rows.sparkSession.sparkContext.broadcast(table) if table is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffer(batch.column(1))
            ids = batch.column(0)
            for lo, hi in K.slices(offsets):
                at = offsets[lo : hi + 1]
                words, raw, form, slot, opens = canonical(data[at[0] : at[-1]], at - at[0])
                counts = np.diff(words.first)
                values = slot if sizes is None else raw | np.uint64(1)
                for size in sizes or range(1, WINDOW + 1):
                    start, hashes, light = _windows(words, raw, form, slot, opens, size)
                    if held is not None:
                        bit = hashes >> np.uint64(64 - TABLE_BITS)
                        hit = (held.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                        start, hashes, light = start[hit], hashes[hit], light[hit]
                    doc = words.doc[start]
                    if sizes is None:
                        own = counts[doc] >= WINDOW if size == WINDOW else counts[doc] == size
                        start, hashes, light, doc = start[own], hashes[own], light[own], doc[own]
                    if not len(start):
                        continue
                    slots = values[start[:, None] + np.arange(size)[None, :]].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(doc + lo)),
                            pa.array((start - words.first[doc]).astype(np.int32)),
                            pa.array(np.full(len(start), size, dtype=np.int32)),
                            pa.array(hashes.view(np.int64)),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(start) + 1, dtype=np.int32) * size), pa.array(slots.reshape(-1))),
                            pa.array((counts[doc] - size + 1).astype(np.int32)),
                            pa.array(light),
                        ],
                        names=["id", "at", "size", "hash", "slots", "total", "light"],
                    )

    return rows.mapInArrow(run, SCHEMA)


def bit_table(items: DataFrame) -> np.ndarray:
    """Bits of the windows' hashes: at most 2**(TABLE_BITS - 6) rows reach the driver."""
    bits = items.select(F.shiftrightunsigned("hash", 64 - TABLE_BITS).alias("bit"))
    rows = bits.select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, int(pmod(bit, 64)))").alias("mask"))
    table = np.zeros(1 << (TABLE_BITS - 6), dtype=np.uint64)
    for word, mask in rows.groupBy("word").agg(F.bit_or("mask")).toLocalIterator():
        table[word] = np.uint64(mask & (2**64 - 1))
    return table


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, coverage, matched_windows, exact): pairs of a document and an item in it.

    coverage: share of the item's windows in the pair's best alignment, or, if
    more, of those that hold at most half placeholders, which are all that can
    match with other values; exact: whether all slot values are equal, else the
    item stands there re-parameterised.  Alignments with inconsistent slots do not count.  Null
    ids and null or empty texts match nothing; repeated rows give one pair; of equal alignments the exact one is
    reported.  An empty table gives no rows.  Other columns are not read.
    """
    spark: SparkSession = documents.sparkSession
    K.tune(spark)
    s = Scratch(spark, "leaks")
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("id"), "text")
    items = s.save(windows(rows, None).distinct(), "items")
    light = items.where("light").groupBy(F.col("id").alias("item_id")).agg(F.count_distinct("at").alias("light_total"))
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most WINDOW values
    if not sizes:
        return spark.createDataFrame([], "doc_id long, item_id long, coverage double, matched_windows long, exact boolean")
    docs = spread(documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text"))
    found = windows(docs, sizes, bit_table(items))
    theirs = items.withColumnRenamed("id", "item_id").join(light, "item_id", "left").select("hash", "size", "item_id", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), F.col("total").alias("item_total"), F.col("light").alias("item_light"), "light_total")
    pairs = found.join(theirs, ["hash", "size"]).select(
        F.col("id").alias("doc_id"),
        "item_id",
        (F.col("at") - F.col("item_at")).alias("shift"),
        "item_at",
        "item_total",
        "item_light",
        "light_total",
        F.filter(F.arrays_zip("item_slots", "slots"), lambda x: x["item_slots"] != 0).alias("slots"),
    )
    runs = pairs.groupBy("doc_id", "item_id", "shift").agg(
        F.count_distinct("item_at").alias("n"), F.max("item_total").alias("total"), F.count_distinct(F.when(F.col("item_light"), F.col("item_at"))).alias("light"), F.max("light_total").alias("light_total"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots")
    )
    named = F.transform(F.col("slots"), lambda x: x["item_slots"])
    values = F.transform(F.col("slots"), lambda x: x["slots"])
    consistent = (F.size(F.array_distinct(named)) == F.size("slots")) & (F.size(F.array_distinct(values)) == F.size("slots"))
    runs = runs.withColumn("coverage", F.greatest(F.col("n") / F.col("total"), F.col("light") / F.col("light_total")))
    good = runs.where(consistent & ((F.col("coverage") >= COVERAGE) | (F.col("n") >= ENOUGH)))
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "n", F.forall("slots", lambda x: x["item_slots"] == x["slots"]).alias("exact"))).alias("b"))
    return best.select("doc_id", "item_id", "b.coverage", F.col("b.n").alias("matched_windows"), "b.exact")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items over the whole tables."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
