"""Training-corpus pipeline: five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  All but the last return the columns of ``docs``; null ids, empty texts
and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.llm.decontaminate import find_leaks
from textsieve.llm.language_id import UNDETERMINED, identify
from textsieve.llm.mixing import TARGETS, by_source, mix
from textsieve.llm.near_dedup import near_duplicates
from textsieve.llm.sharding import shard_documents
from textsieve.scratch import Scratch

#: A document of at least WORDS words is in no learned language if a smaller share of them is known.
LEAST_KNOWN, WORDS = 0.1, 10
#: Share of the remaining tokens that the mix takes, each document at most once.
MIX_SHARE = 0.8
SHARDS = 24


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is among ``ids``, a null one included."""
    ids = ids.select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_kept_id"]), "left_semi")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those in none of the learned languages."""
    found = identify(docs)
    foreign = (F.col("n_words") >= WORDS) & (F.col("known_words") < LEAST_KNOWN * F.col("n_words"))
    rejected = found.where((F.col("lang_pred") == UNDETERMINED) | foreign).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["_gone"]), "left_anti")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, 0.8)."""
    return _keep(docs, near_duplicates(docs).where("kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken until each source has its share of the token budget."""
    return _keep(docs, mix(docs, by_source(), TARGETS, MIX_SHARE, max_epochs=1))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of the remaining documents."""
    return shard_documents(docs, SHARDS)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Trained models, sketches and heaps have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}_{name}")
        if k:
            scratch.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    return docs
