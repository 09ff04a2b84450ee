"""Postings of documents that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textsieve.operators.index import postings_of


def feed_postings(docs: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the postings of streamed rows (doc_id, content) to Parquet folders, one for each batch.

    A batch that is run again overwrites its own folder, so no posting is there
    twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        postings_of(batch).select("term_hash", F.explode("docs").alias("doc_id")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = docs.select("doc_id", "content").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
