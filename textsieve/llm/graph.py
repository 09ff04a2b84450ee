"""Connected components by contraction, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long).

    component is the smallest node reachable.  Each round maps a node to the
    least of itself and its neighbours and contracts the edges; stars around
    their least node, which is what the callers mostly pass, vanish in the
    first round.  From the third round on nodes are ordered by a hash that
    changes with the round, so that long paths shrink by a constant factor.
    Nulls and loops are ignored; an empty input gives an empty result.
    """
    edges = scratch.save(edges.select("a", "b").where("a <> b").distinct(), f"{name}_e0")
    labels = scratch.save(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), f"{name}_l0")
    k = 0
    while not edges.isEmpty():
        order = (lambda c: F.col(c)) if k < 2 else (lambda c, k=k: F.xxhash64(F.col(c), F.lit(k)))
        both = edges.select("a", "b").union(edges.select("b", "a"))
        nearest = both.groupBy("a").agg(F.min(F.struct(order("b").alias("o"), F.col("b").alias("n"))).alias("m"))
        parents = scratch.save(nearest.select(F.col("a").alias("child"), F.least(F.col("m"), F.struct(order("a").alias("o"), F.col("a").alias("n")))["n"].alias("parent")), f"{name}_p{k}")
        pa = parents.select(F.col("child").alias("a"), F.col("parent").alias("pa"))
        pb = parents.select(F.col("child").alias("b"), F.col("parent").alias("pb"))
        new_edges = scratch.save(edges.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{name}_e{k + 1}")
        new_labels = scratch.save(labels.join(parents, labels["root"] == parents["child"], "left").select("node", F.coalesce("parent", "root").alias("root")), f"{name}_l{k + 1}")
        scratch.drop(f"{name}_e{k}", f"{name}_l{k}", f"{name}_p{k}")
        edges, labels, k = new_edges, new_labels, k + 1
    least = scratch.save(labels.groupBy("root").agg(F.min("node").alias("component")), f"{name}_least")
    return labels.join(least, "root").select("node", "component")
