"""MinHash near-dedup with SetSketch registers.

A document is the set of its distinct k-word shingles.  Its sketch holds m
registers: each is the minimum of an exponentially distributed hash over the
set, truncated to a power of ``BASE`` (register value = 1 - log_BASE of the
minimum, rounded down and clipped).  Registers of a union are the maxima of the
registers (``merge_registers``), and equal registers become more likely with
the similarity, so that bands of registers serve as bucket keys.

1. One pass sketches all documents and fingerprints their sets; equal sets
   collapse into one representative (map-side pre-aggregated).
2. Bands of the representatives meet in buckets; each links to the bucket's
   least member.  The components of these stars are candidate clusters.
3. Sets of the clusters' members are built and clusters are cut into blocks of
   bounded size.  Within a block every pair is first held against the joint
   maximum-likelihood estimate from the registers, then verified on the whole
   sets.  The cluster's hub (the member that shares most buckets) takes part in
   each of its blocks.
4. Members that the hub did not bring together are held against all members of
   their cluster, block by block.  No pair that shares a band goes untested.

The chance that a pair at the threshold shares no band is at most ``MISS``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.llm import kernels as K
from textsieve.llm.graph import connected_components
from textsieve.scratch import Scratch
from textsieve.session import spread

#: Ratio of neighbouring register values, rate of the hashes, largest register.
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Registers in a band, and the accepted chance to miss a pair at the threshold.
ROWS, MISS = 4, 1e-8
#: Most documents and most shingles in a block (one document may exceed it).
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1 << 20
#: Standard deviations that an estimate may fall short of the threshold.
MARGIN = 6.0


def bands_for(num: int, den: int) -> int:
    """Bands of ROWS registers so that a pair at num/den is missed with chance MISS at most."""
    return math.ceil(math.log(MISS) / math.log(1 - (num / den) ** ROWS))


def _register_factors(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(771)
    return rng.integers(1, 2**63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1, 2**63, m, dtype=np.uint64)


def registers(values: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """SetSketch registers (documents x m, uint16) of sets of 64-bit hashes."""
    factors, shifts = _register_factors(m)
    out = np.zeros((len(offsets) - 1, m), dtype=np.uint16)
    with np.errstate(over="ignore", divide="ignore"):
        for j in range(m):
            least = K.segment_reduce(np.minimum, (values ^ shifts[j]) * factors[j], offsets, np.uint64(2**64 - 1))
            hashed = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
            out[:, j] = np.clip(np.floor(1 - np.log(hashed) / math.log(BASE)), 0, TOP + 1)
    out[offsets[1:] == offsets[:-1]] = 0
    return out


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate_jaccard(more: np.ndarray, less: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimate of the Jaccard similarity.

    more, less, equal: registers of a above, below and equal to those of b;
    n_a, n_b: the sets' sizes, which are known exactly.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    log_b = math.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / log_b

    def likelihood(j: np.ndarray) -> np.ndarray:
        over, under = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return more * np.log(np.maximum(over, tiny)) + less * np.log(np.maximum(under, tiny)) + equal * np.log(np.maximum(1 - over - under, tiny))

    for _ in range(40):  # the likelihood is concave
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(a) < likelihood(b)
        low, high = np.where(left, a, low), np.where(left, high, b)
    return (low + high) / 2


def sketch(documents: DataFrame, k: int, bands: int) -> DataFrame:
    """(doc_id, n_shingles, key_a, key_b, regs, bands): one row per row of documents."""
    m = bands * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffer(batch.column(1))
            for lo, hi in K.slices(offsets):
                at = offsets[lo : hi + 1]
                values, bounds = K.shingle_sets(K.words_of(data[at[0] : at[-1]], at - at[0], K.NOT_SPACE), k)
                regs = registers(values, bounds, m)
                key_a, key_b = _set_keys(values, bounds)
                keys = np.zeros((hi - lo, bands), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(ROWS):
                        keys = K.mix64(keys * np.uint64(31) + regs[:, r::ROWS].astype(np.uint64) + np.uint64(1))
                    keys = K.mix64(keys + np.arange(bands, dtype=np.uint64)[None, :])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array(key_a),
                        pa.array(key_b),
                        pa.array([row.tobytes() for row in regs], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).view(np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "key_a", "key_b", "regs", "bands"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, key_a long, key_b long, regs binary, bands array<long>")


def _set_keys(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set."""
    return K.segment_reduce(np.add, values, bounds, np.uint64(0)).view(np.int64), K.segment_reduce(np.add, K.mix64(values ^ np.uint64(0x5DEECE66D)), bounds, np.uint64(0)).view(np.int64)


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """Replace the column text by the set as binary: its hashes, ascending.

    Rows whose text is not that of key_a and key_b go: an id may have several texts.
    """
    names = [c for c in rows.columns if c != "text"]
    at_a, at_b = names.index("key_a"), names.index("key_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffer(batch.column(len(names)))
            for lo, hi in K.slices(offsets):
                at = offsets[lo : hi + 1]
                values, bounds = K.shingle_sets(K.words_of(data[at[0] : at[-1]], at - at[0], K.NOT_SPACE), k)
                key_a, key_b = _set_keys(values, bounds)
                own = np.flatnonzero((key_a == batch.column(at_a).to_numpy()[lo:hi]) & (key_b == batch.column(at_b).to_numpy()[lo:hi]))
                sets = pa.array([values[bounds[i] : bounds[i + 1]].tobytes() for i in own.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(own + lo)) for i in range(len(names))), sets], names=[*names, "set"])

    kinds = dict(rows.dtypes)
    return rows.select(*names, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", set binary")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def linked(ids: np.ndarray, sets: list[np.ndarray], regs: np.ndarray, query: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """(node, root) stars of the links among a block's documents.

    Pairs with at least one member in ``query`` are tested: sizes first, then
    the estimate from the registers, then the whole sets.
    """
    order = np.argsort(ids, kind="stable")
    ids, regs, query, sets = ids[order], regs[order], query[order], [sets[i] for i in order]
    n, sizes = len(ids), np.array([len(s) for s in sets], dtype=np.int64)
    forest = _Forest(n)
    a, b = np.triu_indices(n, 1)
    ok = (query[a] | query[b]) & (np.minimum(sizes[a], sizes[b]) * den >= num * np.maximum(sizes[a], sizes[b])) & (sizes[a] > 0) & (sizes[b] > 0)
    a, b = a[ok], b[ok]
    t = num / den
    m = regs.shape[1]
    kept = []
    for at in range(0, len(a), 8192):
        x, y = a[at : at + 8192], b[at : at + 8192]
        more, equal = (regs[x] > regs[y]).sum(1), (regs[x] == regs[y]).sum(1)
        kept.append(estimate_jaccard(more, m - more - equal, equal, sizes[x], sizes[y]) >= t - MARGIN * math.sqrt(t * (1 - t) / m))
    if kept:
        likely = np.concatenate(kept)
        a, b = a[likely], b[likely]
    if len(a) > 4 * n:  # many pairs: products of incidence columns that two sets share at least
        _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(n), sizes)
        shared = counts[inverse] > 1
        column = (np.cumsum(counts > 1) - 1)[inverse][shared]
        row = row[shared]
        by = np.argsort(column, kind="stable")
        column, row = column[by], row[by]
        common = np.zeros((n, n), dtype=np.float64)
        top = int(column[-1]) + 1 if len(column) else 0
        for at in range(0, top, 4096):
            lo, hi = np.searchsorted(column, [at, at + 4096])
            part = np.zeros((n, min(4096, top - at)), dtype=np.float32)
            part[row[lo:hi], column[lo:hi] - at] = 1
            common += part @ part.T
        both = common[a, b].astype(np.int64)
        for i in np.flatnonzero(den * both >= num * (sizes[a] + sizes[b] - both)):
            forest.link(int(a[i]), int(b[i]))
    else:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if forest.find(i) != forest.find(j):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    forest.link(i, j)
    return [(int(ids[i]), int(ids[r])) for i in range(n) if ids[r := forest.find(i)] != ids[i]]


def _verify(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(cluster, a, b) links of rows (g long, cluster, node, query, regs, set, key_a, key_b), g being the block.

    A set may come in both roles, and once for each row that has its text; it counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def done() -> list[tuple[int, int, int]]:
            seen, own = set(), []
            for r in held:
                if (key := (r[1], r[5], r[6])) not in seen:
                    seen.add(key)
                    own.append(r)
            if len(own) < 2:
                return []
            sets = [np.frombuffer(r[4], dtype=np.uint64) for r in own]
            regs = np.stack([np.frombuffer(r[3], dtype=np.uint16) for r in own])
            found = linked(np.array([r[1] for r in own], dtype=np.int64), sets, regs, np.array([r[2] for r in own]), num, den)
            return [(own[0][0], a, b) for a, b in found]

        def out(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], names=["cluster", "a", "b"])

        for batch in batches:
            found = []
            for g, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    found += done()
                    group, held = g, []
                held.append(row)
            if found:
                yield out(found)
        if found := done():
            yield out(found)

    # Rows of a query document come before those of the same document in its other role.
    dealt = rows.repartition("g").sortWithinPartitions("g", "node", F.desc("query"))
    return dealt.select("g", "cluster", "node", "query", "regs", "set", "key_a", "key_b").mapInArrow(run, "cluster long, a long, b long")


def _shared_ids(named: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links between the sets of one id, for ids that have several."""
    key = ["key_a", "key_b", "n_shingles"]
    own = F.struct(*key)
    several = scratch.save(named.groupBy("doc_id").agg(F.min(own).alias("one"), F.max(own).alias("other")).where("one <> other").select("doc_id"), "several")
    sets = named.select("doc_id", *key).join(several, "doc_id").join(reps.select(*key, "rep"), key)
    return sets.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct()


def near_duplicates(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of ``documents``.

    Documents are linked where den * |A & B| >= num * |A | B| for their sets of
    k-word shingles; component_id is the least doc_id reachable.  Reads the
    columns doc_id (long) and text only.  A null, empty or wordless text has an
    empty set and is linked with nothing; a null doc_id has a null component_id
    and is kept; rows that share a doc_id are one node, also if their texts
    differ: what is near one of them is linked with all.  Ties do not arise: a
    component's least doc_id is its name.  An empty table gives no rows.
    """
    spark: SparkSession = documents.sparkSession
    K.tune(spark)
    s = Scratch(spark, "near_dedup")
    bands = bands_for(num, den)
    sketches = s.save(sketch(spread(documents.select("doc_id", "text")), k, bands), "sketch")
    named = sketches.where("n_shingles > 0 and doc_id is not null")
    reps = s.save(named.groupBy("key_a", "key_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("regs").alias("regs"), F.first("bands").alias("bands")), "reps")
    keys = reps.select("rep", F.explode("bands").alias("band"))
    # Counts of a key are written before they are joined: then both sides of the join
    # come straight from an exchange, and Spark can split a hot key's rows.
    buckets = s.save(keys.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1"), "buckets")
    stars = s.save(keys.join(buckets, "band").groupBy("rep", "least").agg(F.sum("n").alias("shared")), "stars")
    clusters = connected_components(stars.select(F.col("rep").alias("a"), F.col("least").alias("b")), s, "cand")
    centrality = stars.groupBy(F.col("rep").alias("node")).agg(F.sum("shared").alias("shared"))
    sized = reps.select(F.col("rep").alias("node"), "n_shingles", "regs", "key_a", "key_b")
    members = s.save(clusters.join(centrality, "node").join(sized, "node").withColumnRenamed("component", "cluster"), "members")
    s.drop("stars", "buckets")
    shape = members.groupBy("cluster").agg(
        F.max(F.struct("shared", -F.col("node")))["col2"].alias("hub"),
        F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
    )
    shape = s.save(shape.select("cluster", (-F.col("hub")).alias("hub"), "blocks"), "shape")
    # Joins by cluster are sort-merge joins straight from exchanges: Spark can split a large cluster's rows.
    placed = members.join(shape.hint("merge"), "cluster").select(F.col("node").alias("doc_id"), "cluster", "regs", "key_a", "key_b", "blocks", (F.col("node") == F.col("hub")).alias("hub"), F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
    sets = s.save(_sets(documents.select("doc_id", "text").join(placed, "doc_id"), k).withColumnRenamed("doc_id", "node"), "sets")
    s.drop("members")
    everywhere = F.when(F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = sets.withColumn("at", F.explode(everywhere)).select(F.xxhash64("cluster", "at").alias("g"), "cluster", "node", F.lit(True).alias("query"), "regs", "set", "key_a", "key_b")
    links = s.save(_verify(first, num, den), "links1")

    # Clusters of several blocks: what the hub left apart is held against all members.
    large = shape.where("blocks > 1").select("cluster")
    if not large.isEmpty():
        within = links.join(large.hint("merge"), "cluster", "left_semi")
        parts = connected_components(within.select("a", "b"), s, "hub")
        state = s.save(sets.where("blocks > 1").select("cluster", "node", "block", "blocks").distinct().join(parts, "node", "left").select("cluster", "node", "block", "blocks", F.coalesce("component", "node").alias("part")), "state")
        main = s.save(state.groupBy("cluster", "part").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "part"))["part"].alias("main")), "main")
        rest = state.join(main.hint("merge"), "cluster").where("part <> main")
        blocks = s.save(rest.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("rest_blocks")), "rest")
        rest = rest.join(blocks.hint("merge"), "cluster").select("cluster", "node", F.pmod(F.xxhash64("node", F.lit(1)), "rest_blocks").cast("int").alias("rest_block"))
        own = sets.select("cluster", "node", "block", "blocks", "regs", "set", "key_a", "key_b")
        asked = own.join(rest, ["cluster", "node"]).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.xxhash64("cluster", "at", "rest_block").alias("g"), "cluster", "node", F.lit(True).alias("query"), "regs", "set", "key_a", "key_b")
        held = own.join(blocks.hint("merge"), "cluster").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1))).select(F.xxhash64("cluster", "block", "at").alias("g"), "cluster", "node", F.lit(False).alias("query"), "regs", "set", "key_a", "key_b")
        more = s.save(_verify(asked.union(held), num, den), "links2")
        links = links.union(more)
    links = links.select("a", "b").union(_shared_ids(named, reps, s))
    parts = s.save(connected_components(links, s, "link"), "parts")
    s.drop("sets", "links1", "links2", "state", "main", "rest", "shape", "several")
    named_reps = reps.join(parts, F.col("rep") == F.col("node"), "left").select("key_a", "key_b", "n_shingles", F.coalesce("component", "rep").alias("found"))
    return (
        sketches.select("doc_id", "n_shingles", "key_a", "key_b")
        .join(named_reps, ["key_a", "key_b", "n_shingles"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: 3-word shingles, links at 85 of 100."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=85, den=100)
