"""Approximate nearest neighbours over learned partitions.

A bounded sample is linked to a neighbour graph, the graph is cut into balanced
parts (median splits, then moves that lower the number of cut links while no
part exceeds its room), and a small softmax classifier learns which parts a
vector's neighbours lie in.  It places every row in its most probable part and
routes a query to the most probable ones; how many is set on the sample so
that the share of true neighbours found there reaches AIM.  All vectors of
those parts are then ranked by their exact inner products.

For inner products of vectors of any length the graph and the classifier work
on vectors with one more component, which makes all rows equally long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textsieve.llm import kernels as K
from textsieve.scratch import Scratch

#: Rows of the sample (chosen by hash, about so many) and sample rows of a part.
SAMPLE, PART = 8192, 128
#: Links of each sample vector, room of a part above the mean, share of neighbours to find.
LINKS, SLACK, AIM = 16, 1.1, 0.97
#: Rows that the driver compares with the sample at once.
ROWS_AT_ONCE = 128
#: Most vectors of a part, and most queries, that meet in one task.  Queries pass through it in batches, so they are
#: many: the rows of a part are sent once for each BLOCK_QUERIES of its queries.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 1 << 16


@dataclass
class Router:
    """Softmax classifier over parts: weights ((d + 2) x parts), longest vector, parts a query visits, rows of each part."""

    weights: np.ndarray
    longest: float
    visits: int
    rows: np.ndarray | None = None

    def chance(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        return _logits(_extended(vectors, self.longest, query), self.weights)

    def route(self, vectors: np.ndarray, k: int) -> list[np.ndarray]:
        """The parts that each query visits: ``visits``, and more until they hold k + 1 rows."""
        order = np.argsort(-self.chance(vectors, True), axis=1, kind="stable")
        held = np.cumsum(self.rows[order], axis=1)
        need = np.maximum((held < k + 1).sum(1) + 1, self.visits)
        return [o[:n] for o, n in zip(order, need, strict=True)]


def _extended(vectors: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Unit-length queries, or rows scaled to at most 1 with a component that makes them 1."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    scaled = vectors / (np.maximum(length, 1e-300) if query else longest)
    last = np.zeros_like(length) if query else np.sqrt(np.maximum(0, 1 - (length / longest) ** 2))
    return np.hstack([scaled, last])


def _logits(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return x @ weights[:-1] + weights[-1]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def neighbours(x: np.ndarray, k: int, of: np.ndarray | None = None) -> np.ndarray:
    """The k rows of largest inner product, itself left out, of each row or of the rows ``of``."""
    of, out = np.arange(len(x)) if of is None else of, []
    for at in range(0, len(of), ROWS_AT_ONCE):
        rows = of[at : at + ROWS_AT_ONCE]
        s = x[rows] @ x.T
        s[np.arange(len(rows)), rows] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k].copy())
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """Part of each node of a neighbour graph; no part holds more than SLACK of the mean."""
    n = len(x)
    label = np.zeros(n, dtype=np.int64)
    size = 1
    while size < parts:  # median splits along the direction of most spread
        for p in range(size):
            own = np.flatnonzero(label == p)
            centred = x[own] - x[own].mean(0)
            direction = centred[np.argmax((centred**2).sum(1))]
            for _ in range(6):
                direction = centred.T @ (centred @ direction)
                direction /= np.linalg.norm(direction) + 1e-12
            order = np.argsort(centred @ direction, kind="stable")
            label[own[order[len(own) // 2 :]]] += size
        size *= 2
    a, b = np.repeat(np.arange(n), near.shape[1]), near.reshape(-1)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    room = int(np.ceil(SLACK * n / parts))
    held = np.bincount(label, minlength=parts)
    for _ in range(rounds):
        links = np.bincount(a * parts + label[b], minlength=n * parts).reshape(n, parts)
        best = links.argmax(1)
        gain = links[np.arange(n), best] - links[np.arange(n), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if held[best[i]] < room:
                held[label[i]] -= 1
                held[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


def learn(sample: np.ndarray, longest: float, k: int) -> Router:
    """Fit the router on sample vectors."""
    parts = 1
    while parts * 2 * PART <= len(sample):
        parts *= 2
    if parts == 1:
        return Router(np.zeros((sample.shape[1] + 2, 1)), longest, 1)
    x = _extended(sample, longest, False)
    near = neighbours(x, min(LINKS, len(x) - 1))
    label = balanced_parts(x, near, parts)
    onehot = np.eye(parts)
    target = 0.5 * onehot[label] + 0.5 * np.stack([onehot[label[row]].mean(0) for row in near])
    weights = np.zeros((x.shape[1] + 1, parts))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    ones = np.hstack([x, np.ones((len(x), 1))])
    for step in range(1, 151):  # Adam on the whole sample
        grad = ones.T @ (_softmax(ones @ weights) - target) / len(x) + 1e-6 * weights
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        weights -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    router = Router(weights, longest, parts)
    # visits: the fewest parts that hold AIM of the sample queries' nearest sample rows
    asked = np.arange(0, len(sample), max(1, len(sample) // 512))
    top = neighbours(sample, min(k, len(sample) - 1), asked)
    placed = router.chance(sample, False).argmax(1)
    order = np.argsort(-router.chance(sample[asked], True), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(parts), order.shape), axis=1)
    needed = np.take_along_axis(rank, placed[top], axis=1)
    found = np.cumsum(np.bincount(needed.reshape(-1), minlength=parts)) / needed.size
    router.visits = int(np.searchsorted(found, AIM) + 1)
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as a float64 matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def sound(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part, all of the most frequent length."""
    v = F.col("embedding")
    ok = v.isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.coalesce(ok, F.lit(False)))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("embedding") == (sizes["d"] if sizes else 0))


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, sample_rows: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are
    all rows with another vec_id.  Ties go to the smaller vec_id, scores are
    computed in double precision on the original vectors.  Vectors that are
    null, zero, of an unusual length or hold null or non-finite components take
    no part, nor do rows without vec_id; repeated rows are candidates each.  An
    empty table gives no rows; only vec_id and embedding are read.

    sample_rows bounds what the router is fitted on.  There is a part for each
    PART rows of the sample, so for very large tables the sample should grow
    with the square root of the table.
    """
    spark: SparkSession = embeddings.sparkSession
    K.tune(spark)
    s = Scratch(spark, "ann")
    rows = s.save(sound(embeddings), "rows")
    n, square = rows.select(F.count("*"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], empty)
    chosen = rows.where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1_000_000)) < round(1_000_000 * min(1.0, sample_rows / n)))
    sample = _matrix(chosen.select("embedding").toArrow().column(0).combine_chunks())  # about sample_rows
    router = learn(sample if len(sample) else np.ones((1, 1)), float(np.sqrt(square)), k)
    del sample
    held = spark.sparkContext.broadcast(router)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            part = held.value.chance(x, False).argmax(1) if held.value.weights.shape[1] > 1 else np.zeros(len(x), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *batch.columns], names=["part", "vec_id", "embedding"])

    index = s.save(rows.select("vec_id", "embedding").mapInArrow(place, "part int, vec_id long, embedding array<double>"), "index")
    counts = dict(index.groupBy("part").agg(F.count("*")).collect())  # one row per part
    parts = router.weights.shape[1]
    router.rows = np.array([counts.get(p, 0) for p in range(parts)], dtype=np.int64)
    blocks = np.maximum(1, -(-router.rows // BLOCK_ROWS))
    routed = spark.sparkContext.broadcast(router)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            visits = routed.value.route(x, k) if parts > 1 else [np.zeros(1, dtype=np.int64)] * len(x)
            take = np.repeat(np.arange(len(x)), [len(v) for v in visits])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(visits).astype(np.int32)), *(c.take(pa.array(take)) for c in batch.columns)], names=["part", "vec_id", "embedding"])

    queries = s.save(index.where(F.col("vec_id") % every == 0).select("vec_id", "embedding").mapInArrow(ask, "part int, vec_id long, embedding array<double>"), "queries")
    asked = dict(queries.groupBy("part").agg(F.count("*")).collect())
    by = spark.createDataFrame([(p, int(blocks[p]), max(1, -(-asked.get(p, 0) // BLOCK_QUERIES))) for p in range(parts)], "part int, blocks int, turns int")
    pick = lambda c, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = index.join(F.broadcast(by), "part").withColumn("block", pick("blocks", 1)).withColumn("turn", each("turns")).withColumn("role", F.lit(0))
    right = queries.join(F.broadcast(by), "part").withColumn("turn", pick("turns", 2)).withColumn("block", each("blocks")).withColumn("role", F.lit(1))
    columns = [F.xxhash64("part", "block", "turn").alias("g"), "role", "vec_id", "embedding"]
    met = left.select(columns).union(right.select(columns)).repartition("g").sortWithinPartitions("g", "role")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, vectors = None, [], []
        for batch in batches:
            g, role, vec, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(3))
            bounds = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (role[1:] != role[:-1])) + 1).tolist(), len(g)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if g[a] != group:
                    group, ids, vectors = g[a], [], []
                if role[a] == 0:
                    ids.append(vec[a:b])
                    vectors.append(x[a:b])
                elif ids:
                    if len(ids) > 1:
                        ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    yield best_of(vec[a:b], x[a:b], ids[0], vectors[0], k)

    found = met.mapInArrow(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best rows of a block for each query, other than the query's own."""
    out_q, out_v, out_s = [], [], []
    for at in range(0, len(queries), 256):
        rough = queries[at : at + 256] @ rows.T
        for i in range(len(rough)):
            q, own = queries[at + i], ids != query_ids[at + i]
            line = np.where(own, rough[i], -np.inf)
            if len(line) > k:
                least = np.partition(line, len(line) - k)[len(line) - k]
                near = np.flatnonzero((line >= least - 1e-9 * max(1.0, abs(least))) & own)
            else:
                near = np.flatnonzero(own)
            exact = (rows[near] * q).sum(1)  # the same order of additions for equal rows, wherever they stand
            top = near[order := np.lexsort((ids[near], -exact))[:k]]
            out_q.append(np.full(len(top), query_ids[at + i]))
            out_v.append(ids[top])
            out_s.append(exact[order])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_q).astype(np.int64)), pa.array(np.concatenate(out_v).astype(np.int64)), pa.array(np.concatenate(out_s))], names=["query_id", "vec_id", "score"])


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over the whole table ``embeddings``."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
