"""Quality classifier by co-training of two views.

The content view sees the text: hashed words, hashed runs of other characters
and its shape (shares of kinds of characters, and of repetition).  The page
view sees metadata only: language, source, and how many bytes, lines and words
there are.  Shares and counts are cut into bins at quantiles of the labelled
sample, so no limit is set by hand.

Each view's logistic classifier is fitted on labelled documents.  In each round
both views score all other documents, and each hands some of those that it is
sure of, with its own verdict as label, to the other view.  Afterwards each
view is calibrated on a fold of labelled documents, and a logistic combination
of the calibrated views scores all documents.  Another fold takes no part in
anything, so that ``held_out`` can measure on it.

The same is done for both labels, quality and toxicity.  Classifiers are fitted
on a bounded sample: LABELLED labelled documents, and HANDED of each kind in a
round, chosen by hash from all that a view is sure of.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.llm import kernels as K
from textsieve.session import spread

#: Labelled documents that are fitted on, at most (about, by hash).
LABELLED = 6000
#: Rounds of exchange, documents that a view hands over for each label and verdict in a round, and its least confidence.
ROUNDS, HANDED, CONFIDENT = 2, 150, 0.95
#: Hashed features of the content view, and of the page view's names; bins of a share or a count.
CONTENT, NAMES, BINS = 1 << 16, 1 << 10, 16
#: Folds (crc32 of doc_id as text, modulo FOLDS) for calibration and for measuring only.
FOLDS, CALIBRATION, MEASURED = 5, 0, 1
STEPS, RATE, DECAY = 80, 0.3, 1e-5
#: Deviations of a feature's share between classes that are chance, and that are certain; documents that hold it.
CHANCE, SURE, SEEN = 3.0, 8.0, 4
#: A document stays if quality is at least, and toxicity below, this.
KEEP = 0.5
TARGETS = ("quality", "toxic")

SYMBOL = ~K.ALNUM & K.NOT_SPACE
SHAPES, COUNTS = 9, 3
CONTENT_SIZE, PAGE_SIZE = CONTENT + SHAPES * BINS + 1, NAMES + COUNTS * BINS + 1


@dataclass
class Rows:
    """Sparse rows: entries (row, column, value) of n rows."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    n: int

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * weights[self.column], minlength=self.n)

    def take(self, rows: np.ndarray) -> Rows:
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        own = np.flatnonzero(place[self.row] >= 0)
        return Rows(place[self.row[own]].astype(np.int32), self.column[own], self.value[own], len(rows))


@dataclass
class Features:
    """What both views are made of: damped counts of hashed words and symbol runs, shapes, counts and hashed names."""

    words: Rows
    shapes: np.ndarray
    counts: np.ndarray
    names: np.ndarray

    def views(self, edges: tuple[np.ndarray, np.ndarray]) -> tuple[Rows, Rows]:
        """Rows of the content view and of the page view; the last column of each is the constant 1."""
        n = self.words.n
        shapes, counts = _binned(self.shapes, edges[0]), _binned(self.counts, edges[1])
        each = lambda k: np.repeat(np.arange(n, dtype=np.int32), k)
        dense = np.hstack([CONTENT + shapes, np.full((n, 1), CONTENT_SIZE - 1)])
        content = Rows(np.concatenate([self.words.row, each(dense.shape[1])]), np.concatenate([self.words.column, dense.reshape(-1)]), np.concatenate([self.words.value, np.ones(dense.size, dtype=np.float32)]), n)
        dense = np.hstack([self.names, NAMES + counts, np.full((n, 1), PAGE_SIZE - 1)])
        return content, Rows(each(dense.shape[1]), dense.reshape(-1), np.ones(dense.size, dtype=np.float32), n)


def _binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Columns of the bins that the values fall into."""
    return np.stack([np.searchsorted(e, v, side="right") + j * BINS for j, (v, e) in enumerate(zip(values.T, edges, strict=True))], axis=1)


def edges_of(values: np.ndarray) -> np.ndarray:
    """Limits of BINS bins of each column, at its quantiles."""
    return np.quantile(values, np.arange(1, BINS) / BINS, axis=0).T if len(values) else np.zeros((values.shape[1], BINS - 1))


def features_of(data: np.ndarray, offsets: np.ndarray, lang: list[str | None], source: list[str | None]) -> Features:
    """Features of some texts (bytes and offsets from 0)."""
    docs, size = len(offsets) - 1, np.diff(offsets)
    per = np.maximum(size, 1)
    keys, repeats, n_words = [], np.zeros(docs), np.zeros(docs)
    for mask, salt in ((K.ALNUM, 0), (SYMBOL, 1)):
        words = K.words_of(data, offsets, mask)
        h = words.hashes()
        if not salt:
            n_words = np.diff(words.first)
            again = np.flatnonzero((h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])) + 1
            repeats = np.bincount(words.doc[again], minlength=docs) / np.maximum(n_words, 1)
        h = K.mix64(h + np.uint64(salt)) >> np.uint64(48)
        keys.append(words.doc.astype(np.int64) * CONTENT + h.astype(np.int64))
    keys, counts = np.unique(np.concatenate(keys), return_counts=True)
    doc = keys // CONTENT
    distinct = np.bincount(doc, minlength=docs) / np.maximum(np.bincount(doc, weights=counts, minlength=docs), 1)
    rows = Rows(doc.astype(np.int32), (keys % CONTENT).astype(np.int32), np.log1p(counts).astype(np.float32), docs)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask[data])])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def of(*codes: int) -> np.ndarray:
        mask = np.zeros(256, dtype=bool)
        mask[list(codes)] = True
        return mask

    upper, digit, punctuation = of(*range(65, 91)), of(*range(48, 58)), of(*b".,;:?!'\"()-")
    kinds = (upper, digit, punctuation, SYMBOL & ~punctuation & ~upper, of(32, 9), of(*range(128, 256)))
    shapes = np.stack([*(total(m) / per for m in kinds), distinct, repeats, size / np.maximum(n_words, 1)], axis=1)
    names = np.array([[hash_name(f"lang={x}"), hash_name(f"source={y}")] for x, y in zip(lang, source, strict=True)], dtype=np.int64).reshape(docs, 2)
    return Features(rows, shapes, np.stack([size, total(of(10)), n_words], axis=1).astype(float), names)


def hash_name(name: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(name) % NAMES


def fit(rows: Rows, target: np.ndarray, size: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Logistic weights by Adam; classes weigh equally, and features by ``telling``, unless ``weight`` is given."""
    scale = np.ones(size)
    if weight is None:
        share = np.clip(target.mean(), 1e-6, 1 - 1e-6)
        weight = np.where(target == 1, 0.5 / share, 0.5 / (1 - share))
        if size == CONTENT_SIZE:
            scale = telling(rows, target, size)
            scale[-1] = 1
            rows = Rows(rows.row, rows.column, rows.value * scale[rows.column], rows.n)
    weights, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        error = (sigmoid(rows.dot(weights)) - target) * weight / rows.n
        grad = np.bincount(rows.column, weights=rows.value * error[rows.row], minlength=size) + DECAY * weights
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        weights -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6) / step**0.5
    return weights * scale


def telling(rows: Rows, target: np.ndarray, size: int) -> np.ndarray:
    """How well the presence of each feature tells the classes apart: 0 (chance) to 1 (SURE deviations)."""
    seen = np.bincount(rows.column, weights=rows.value != 0, minlength=size)
    with_it = np.bincount(rows.column, weights=(rows.value != 0) * target[rows.row], minlength=size)
    n, m = rows.n, target.sum()
    mean = (seen + 1) / (n + 2)
    z = (with_it / max(m, 1) - (seen - with_it) / max(n - m, 1)) / np.sqrt(mean * (1 - mean) * (1 / max(m, 1) + 1 / max(n - m, 1)))
    return np.where(seen >= SEEN, np.clip((np.abs(z) - CHANCE) / (SURE - CHANCE), 0, 1), 0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class CoTrained:
    """Weights of both views, and of the combination of their calibrated logits."""

    content: np.ndarray
    page: np.ndarray
    calibration: np.ndarray  #: per view: slope and offset
    combination: np.ndarray

    def chances(self, content: Rows, page: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(content view, page view, combined)."""
        z = [a * x + b for (a, b), x in zip(self.calibration, (content.dot(self.content), page.dot(self.page)), strict=True)]
        return sigmoid(z[0]), sigmoid(z[1]), sigmoid(z[0] * self.combination[0] + z[1] * self.combination[1] + self.combination[2])


class Teacher:
    """Co-training of one label: rows that each view learns from, and its weights."""

    def __init__(self, views: tuple[Rows, Rows], target: np.ndarray, fold: np.ndarray):
        """target: 1, 0, or -1 for none; fold: that of each row, of which CALIBRATION and MEASURED are not learned from."""
        self.views, self.target, self.fold = views, target, fold
        own = np.flatnonzero((target >= 0) & (fold != CALIBRATION) & (fold != MEASURED))
        self.known: list[list[tuple[Rows, np.ndarray]]] = [[(v.take(own), target[own].astype(float))] for v in views]
        self.able = len(np.unique(target[own])) == 2
        self.weights = [np.zeros(CONTENT_SIZE), np.zeros(PAGE_SIZE)]
        self.learn()

    def learn(self) -> None:
        for v, size in enumerate((CONTENT_SIZE, PAGE_SIZE)):
            if self.able:
                rows, y = zip(*self.known[v], strict=True)
                self.weights[v] = fit(joined(list(rows)), np.concatenate(y), size)

    def done(self) -> CoTrained:
        """Calibrate the views and combine them."""
        if not self.able:  # nothing to tell apart
            y = self.target[self.target >= 0]
            base = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
            return CoTrained(*self.weights, np.array([[1.0, 0.0]] * 2), np.array([0.0, 0.0, np.log(base / (1 - base))]))
        held = np.flatnonzero((self.target >= 0) & (self.fold == CALIBRATION))
        if len(held) < 20 or len(np.unique(self.target[held])) < 2:
            held = np.flatnonzero((self.target >= 0) & (self.fold != MEASURED))
        y = self.target[held].astype(float)
        z = [v.take(held).dot(w) for v, w in zip(self.views, self.weights, strict=True)]

        def dense(columns: list[np.ndarray]) -> np.ndarray:
            m = len(columns) + 1
            rows = Rows(np.tile(np.arange(len(y)), m), np.repeat(np.arange(m), len(y)), np.concatenate([*columns, np.ones(len(y))]), len(y))
            return fit(rows, y, m, np.ones(len(y)))

        calibration = np.stack([dense([x]) for x in z])
        calibration[:, 0] = np.maximum(calibration[:, 0], 0)
        return CoTrained(*self.weights, calibration, dense([a * x + b for (a, b), x in zip(calibration, z, strict=True)]))


def joined(parts: list[Rows]) -> Rows:
    """Rows below each other."""
    shift = np.cumsum([0, *(p.n for p in parts)])
    return Rows(np.concatenate([p.row + k for p, k in zip(parts, shift, strict=False)]), np.concatenate([p.column for p in parts]), np.concatenate([p.value for p in parts]), int(shift[-1]))


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Features]]:
    """Features of the rows (doc_id, text, lang, source, ...) of a batch, slice by slice."""
    data, offsets = K.text_buffer(batch.column(1))
    for lo, hi in K.slices(offsets):
        at = offsets[lo : hi + 1]
        yield lo, hi, features_of(data[at[0] : at[-1]], at - at[0], *(batch.column(i).slice(lo, hi - lo).to_pylist() for i in (2, 3)))


_ARRAYS = (("columns", "array<int>"), ("values", "array<float>"), ("shapes", "array<double>"), ("counts", "array<double>"), ("names", "array<long>"))


def gathered(docs: DataFrame) -> tuple[Features, pa.Table]:
    """Features of few documents (doc_id, text, lang, source, more), made on the executors; and their other columns."""
    more = docs.columns[4:]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, f in _batches(batch):
                cut = np.searchsorted(f.words.row, np.arange(hi - lo + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (f.words.column, f.words.value)]
                lists += [pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1))) for x in (f.shapes, f.counts, f.names)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(batch.column(4 + i).slice(lo, hi - lo) for i in range(len(more))), *lists], names=["doc_id", *more, *(n for n, _ in _ARRAYS)])

    schema = ", ".join([f"{c} {kinds[c]}" for c in ("doc_id", *more)] + [f"{n} {t}" for n, t in _ARRAYS])
    table = docs.mapInArrow(run, schema).toArrow()
    table = table.take(np.argsort(np.array(table.column("doc_id").to_pylist(), dtype=object), kind="stable")) if table.num_rows else table
    flat = lambda c, kind: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
    sizes = np.array([len(x) for x in table.column("columns")], dtype=np.int64)
    rows = Rows(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), flat("columns", np.int32), flat("values", np.float32), len(sizes))
    return Features(rows, flat("shapes", float).reshape(-1, SHAPES), flat("counts", float).reshape(-1, COUNTS), flat("names", np.int64).reshape(-1, 2)), table.select(["doc_id", *more])


def sure_of(docs: DataFrame, weights: list[list[np.ndarray]], edges: tuple[np.ndarray, np.ndarray], gone: set, turn: int) -> dict[tuple[int, int, int], list]:
    """doc_ids, by (target, view, verdict), of HANDED of all documents whose verdict is sure; those of least hash.

    Documents of the fold MEASURED, and those in ``gone``, are left out.  A task hands on HANDED of each kind at most.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((weights, edges, gone))
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, edges, gone = held.value
        best: dict[tuple[int, int, int], list] = {}
        for batch in batches:
            ids, order = batch.column(0).to_pylist(), batch.column(4).to_numpy()
            for lo, _, f in _batches(batch):
                views = f.views(edges)
                for t, by_view in enumerate(weights):
                    for v, w in enumerate(by_view):
                        p = sigmoid(views[v].dot(w))
                        for verdict, at in ((0, np.flatnonzero(p <= 1 - CONFIDENT)), (1, np.flatnonzero(p >= CONFIDENT))):
                            own = best.setdefault((t, v, verdict), [])
                            for i in at.tolist():
                                key = -int(order[lo + i])
                                if (len(own) < HANDED or key > own[0][0]) and ids[lo + i] not in gone and ids[lo + i] is not None:
                                    (heapq.heappush if len(own) < HANDED else heapq.heapreplace)(own, (key, ids[lo + i]))
        rows = [(t * 4 + v * 2 + verdict, -key, i) for (t, v, verdict), own in best.items() for key, i in own]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2])] if rows else [pa.array([], pa.int32()), pa.array([], pa.int64()), batch_ids(kind)], names=["slot", "at", "doc_id"])

    def batch_ids(kind) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.array([], to_arrow_type(kind))

    pool = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != MEASURED)
    dealt = pool.withColumn("_order", F.abs(F.xxhash64("doc_id", F.lit(turn)) % (1 << 62)))
    found = dealt.mapInArrow(run, f"slot int, at long, doc_id {kind.simpleString()}")
    first = found.groupBy("slot").agg(F.slice(F.sort_array(F.collect_set(F.struct("at", "doc_id"))), 1, HANDED).alias("d"))
    return {(r["slot"] // 4, r["slot"] // 2 % 2, r["slot"] % 2): [x["doc_id"] for x in r["d"]] for r in first.collect()}


def train(docs: DataFrame, labels: DataFrame) -> tuple[tuple[CoTrained, ...], tuple[np.ndarray, np.ndarray]] | None:
    """Co-train both labels on rows (doc_id, text, lang, source) and (doc_id, quality, toxic); None without any labelled document."""
    n_labels = labels.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000))
    some = labels.where(draw < round(1_000_000 * min(1.0, LABELLED / max(n_labels, 1))))
    fold = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS).cast("int").alias("fold")
    features, table = gathered(docs.join(F.broadcast(some), "doc_id").select(*docs.columns, *TARGETS, fold))  # LABELLED rows at most
    if not table.num_rows:
        return None
    folds = table.column("fold").to_numpy()
    learned = (folds != CALIBRATION) & (folds != MEASURED)
    edges = (edges_of(features.shapes[learned]), edges_of(features.counts[learned]))
    views = features.views(edges)
    targets = [np.array([-1 if x is None else int(x > 0) for x in table.column(name).to_pylist()]) for name in TARGETS]
    teachers = [Teacher(views, target, folds) for target in targets]
    gone = set(table.column("doc_id").to_pylist())
    for turn in range(ROUNDS if any(t.able for t in teachers) else 0):
        picked = sure_of(docs, [t.weights if t.able else [] for t in teachers], edges, gone, turn)
        ids = sorted({i for own in picked.values() for i in own})
        if not ids:
            break
        taken, names = gathered(docs.where(F.col("doc_id").isin(ids)).dropDuplicates(["doc_id"]))
        place = {i: k for k, i in enumerate(names.column("doc_id").to_pylist())}
        rows = taken.views(edges)
        for (t, v, verdict), own in sorted(picked.items()):
            at = np.array([place[i] for i in own if i in place], dtype=np.int64)
            if len(at):
                teachers[t].known[1 - v].append((rows[1 - v].take(at), np.full(len(at), float(verdict))))
        gone |= set(ids)
        for t in teachers:
            t.learn()
    return tuple(t.done() for t in teachers), edges


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, content_score, page_score, score, toxic, kept): one row per row of ``documents``.

    score is the combined chance of good quality, content_score and page_score
    those of the views; toxic is the combined chance of toxicity; kept: score
    at least KEEP and toxic below it.  A null or empty text has no words; null
    languages and sources are values of their own.  Labels that are null, or
    that name no document, are not learned from; a document with several labels
    counts with the greatest.  Without labels of both kinds every score is the
    share of the one (0.5 without any).  Repeated rows agree; an empty table
    gives no rows; other columns are not read.
    """
    spark: SparkSession = documents.sparkSession
    K.tune(spark)
    docs = spread(documents.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string")))
    named = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(c).cast("int").alias(c) for c in TARGETS])
    held = spark.sparkContext.broadcast(train(docs, named))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, edges = held.value or (None, None)
        for batch in batches:
            for lo, hi, f in _batches(batch):
                if models is None:
                    content = page = score = toxic = np.full(hi - lo, 0.5)
                else:
                    views = f.views(edges)
                    content, page, score = models[0].chances(*views)
                    toxic = models[1].chances(*views)[2]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(x) for x in (content, page, score, toxic)), pa.array((score >= KEEP) & ((toxic < KEEP) | (models is None)))], names=["doc_id", "content_score", "page_score", "score", "toxic", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, content_score double, page_score double, score double, toxic double, kept boolean")


def held_out(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality, toxic) of the labelled documents of the fold that takes no part in fitting or calibration, with their scores."""
    named = labels.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS) == MEASURED)
    return classify(documents, labels).withColumnsRenamed({"toxic": "toxic_score"}).join(named, "doc_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the labels of the table ``labels``."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
