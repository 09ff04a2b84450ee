"""Sharding by longest-processing-time scheduling.

Groups that must stay together (equal texts) go, largest first, to the
least-loaded shard through a heap.  Groups of one size are interchangeable, so
the heap works on size classes: a group's bytes with the top MANTISSA bits
kept.  There are at most 2**MANTISSA classes for each power of two, whatever
the number of documents; their histogram is all that reaches the driver.  As
long as the lowest loads differ by less than a group's size, the schedule deals
such groups round by round, and whole rounds are taken in one step.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.llm import kernels as K
from textsieve.llm.prefix import ranked
from textsieve.scratch import Scratch

MANTISSA = 12
#: Most classes whose runs are broadcast (a run has an entry for each shard); beyond it the join shuffles.
BROADCAST_CLASSES = 50_000
#: Bytes that a document takes besides its text.
OVERHEAD = 8


def schedule(classes: list[tuple[int, int, float]], shards: int) -> dict[int, list[tuple[int, int]]]:
    """LPT over (class, groups, bytes of a group): runs of (shard, groups) for each class."""
    heap = [(0.0, i) for i in range(shards)]
    plan: dict[int, list[tuple[int, int]]] = {}
    for name, left, size in sorted(classes, reverse=True):
        given: dict[int, int] = {}
        while left:
            loads = sorted(heap)
            low = [x for x in loads if x[0] <= loads[0][0] + size]
            above = loads[len(low)][0] if len(low) < shards else float("inf")
            rounds = min(left // len(low), left if above == float("inf") else int((above - low[-1][0]) // size))
            if rounds:  # until they reach the next load, each round gives one group to each of the low shards
                heap = [(load + rounds * size, i) for load, i in low] + loads[len(low) :]
                heapq.heapify(heap)
                for _, i in low:
                    given[i] = given.get(i, 0) + rounds
                left -= rounds * len(low)
                continue
            load, i = heap[0]
            heapq.heapreplace(heap, (load + size, i))
            given[i] = given.get(i, 0) + 1
            left -= 1
        plan[name] = sorted(given.items())
    return plan


def shard_documents(documents: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): one row per row of ``documents``.

    size: UTF-8 bytes of the text plus OVERHEAD; a null text has none and is
    one group with the empty texts.  law is ``bytes``: shard sizes are as near
    equal as groups of equal texts allow.  slot: place in the shard, gapless
    from 0, by doc_id (nulls first), then by text.  Rows that repeat take a slot
    each; a null doc_id is sharded like any other.  grown_shard is null under
    this law.  An empty table gives no rows; only doc_id and text are read.
    """
    spark: SparkSession = documents.sparkSession
    K.tune(spark)
    s = Scratch(spark, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = s.save(documents.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash")), "rows")
    key = ["text_hash", "text_crc32", "size"]
    bits = F.greatest(F.length(F.bin("bytes")) - MANTISSA, F.lit(0))
    groups = rows.groupBy(*key).agg((F.count("*") * F.col("size")).alias("bytes")).withColumn("class", F.call_function("shiftleft", F.call_function("shiftright", F.col("bytes"), bits), bits))
    groups = s.save(groups, "groups")
    histogram = groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()  # at most 52 * 2**MANTISSA rows
    plan = schedule([(r["class"], r["n"], r["bytes"] / r["n"]) for r in histogram], shards)
    runs = []
    for name, given in plan.items():
        end, ends = 0, []
        for _, n in given:
            end += n
            ends.append(end)
        runs.append((name, ends, [i for i, _ in given]))
    small = len(runs) <= BROADCAST_CLASSES
    runs = spark.createDataFrame(runs, "of long, ends array<long>, shards array<int>")
    numbered = ranked(groups, ["class"], key, s, "numbered").join(F.broadcast(runs) if small else runs, F.col("class") == F.col("of"))
    shard = F.element_at("shards", F.size(F.filter("ends", lambda e: e <= F.col("rank"))) + 1)
    placed = s.save(numbered.select(*key, shard.alias("shard")), "placed")
    found = rows.join(placed, key)
    s_rows = ranked(found, ["shard"], ["doc_id", "text_crc32", "text_hash"], s, "sharded")
    s.drop("rows", "groups", "numbered", "placed")
    return s_rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents into 24 shards."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
