"""Ranks and running sums within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textsieve.scratch import Scratch

#: Most offsets that are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def ranked(df: DataFrame, group: list[str], order: list[str], scratch: Scratch, name: str, value: str | dict[str, str] | None = None) -> DataFrame:
    """``df`` with a gapless long ``rank`` from 0 within each group, and the sum of ``value`` up to the row as ``running``.

    value may also name several sums and what they are of.

    A group is never gathered in one task: rows are sorted by ranges of
    (group, order), numbered within their partition, and shifted by what the
    earlier partitions hold of their group.  Those offsets are one row for each
    group and one more for each partition; they are broadcast if they are few.
    """
    sums = {} if value is None else {"running": value} if isinstance(value, str) else value
    keys = [F.col(c) for c in (*group, *order)]
    placed = scratch.save(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), *[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}_before") for n in sums])
    offsets = scratch.save(offsets, f"{name}_offsets")
    match = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        match = match & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    out = placed.join(F.broadcast(offsets) if offsets.count() <= BROADCAST_ROWS else offsets, match).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before"))
    if sums:
        within = Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({n: F.sum(c).over(within) + F.col(f"_{n}_before") for n, c in sums.items()})
    return out.select(*df.columns, "rank", *sums)
