"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves of a tree of domain, language and source.  A token budget
is handed down by the weights of siblings.  What a child cannot fill, even by
repeating its documents ``max_epochs`` times, goes to its siblings by their
weights, and only what all of them cannot fill goes back to the parent, whose
siblings share it in the same way.  Budgets of domains and languages, which are
few, are worked out on the driver; sources may be as many as web hosts, so
theirs come from running sums over a DataFrame (``leaf_budgets``).

A leaf fills its budget epoch by epoch: whole epochs first, then the longest
prefix of the last epoch's order that does not exceed the rest.  The order of
an epoch is a hash of the document id, seeded with the epoch's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.llm import kernels as K
from textsieve.llm.prefix import BROADCAST_ROWS, ranked
from textsieve.scratch import Scratch

LEVELS = ("domain", "lang", "source")
UNKNOWN = "(none)"
SEED = 17


def fill(budget: float, weights: list[float], capacity: list[float]) -> list[float]:
    """Shares of a budget by weight; what exceeds a capacity is shared by the others."""
    got = [0.0] * len(weights)
    open_, left = [i for i, w in enumerate(weights) if w > 0 and capacity[i] > 0], budget
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if got[i] + left * weights[i] / total >= capacity[i]]
        if not full:
            for i in open_:
                got[i] += left * weights[i] / total
            break
        for i in full:
            left -= capacity[i] - got[i]
            got[i] = capacity[i]
        # those that stay open are filled anew from what is left besides their shares
        left += sum(got[i] for i in open_ if i not in full)
        open_ = [i for i in open_ if i not in full]
        for i in open_:
            got[i] = 0.0
    return got


def budgets(leaves: dict[tuple[str, ...], int], weights: dict[tuple[str, ...], float], total: float, max_epochs: int) -> dict[tuple[str, ...], float]:
    """Token budget of each leaf.  weights: of nodes by path; nodes without one weigh 1."""
    room: dict[tuple[str, ...], float] = {}
    children: dict[tuple[str, ...], set] = {}
    for path, tokens in leaves.items():
        for depth in range(len(path) + 1):
            room[path[:depth]] = room.get(path[:depth], 0.0) + tokens * max_epochs
            if depth:
                children.setdefault(path[: depth - 1], set()).add(path[:depth])
    out = {(): min(total, room.get((), 0.0))}
    todo = [()]
    while todo:
        node = todo.pop()
        own = sorted(children.get(node, ()))
        for child, share in zip(own, fill(out[node], [weights.get(c, 1.0) for c in own], [room[c] for c in own]), strict=True):
            out[child] = share
            todo.append(child)
    return {path: out.get(path, 0.0) for path in leaves}


def leaf_budgets(leaves: DataFrame, given: DataFrame, weights: DataFrame, max_epochs: int, scratch: Scratch) -> DataFrame:
    """(domain, lang, source, tokens, budget): the shares of siblings, as ``fill`` gives them.

    leaves: (domain, lang, source, tokens); given: (domain, lang, total), the
    parents' budgets; weights: (domain, lang, source, weight) of leaves that do
    not weigh 1.  A leaf gets its weight times the level of its parent, up to
    its capacity.  In the order of capacity by weight leaves are filled until
    the level that the rest would get no longer fills the next: that level is
    the greatest of those.
    """
    parent = ["domain", "lang"]
    rows = leaves.join(F.broadcast(given), parent).join(F.broadcast(weights), list(LEVELS), "left")
    rows = rows.select(*LEVELS, "tokens", "total", F.coalesce("weight", F.lit(1.0)).alias("weight"), (F.col("tokens") * max_epochs).alias("capacity"))
    open_ = rows.where("weight > 0 and capacity > 0").withColumn("ratio", F.col("capacity") / F.col("weight"))
    order = ranked(open_, parent, ["ratio", "source"], scratch, "leaf_order", {"capacities": "capacity", "weights": "weight"})
    whole = open_.groupBy(*parent).agg(F.sum("weight").alias("all_weights"))
    left = (F.col("total") - F.col("capacities") + F.col("capacity")) / (F.col("all_weights") - F.col("weights") + F.col("weight"))
    level = order.join(whole, parent).groupBy(*parent).agg(F.max(left).alias("level"))
    filled = rows.join(level, parent, "left")
    budget = F.when((F.col("weight") > 0) & (F.col("capacity") > 0), F.least("capacity", F.col("level") * F.col("weight"))).otherwise(0.0)
    return filled.select(*LEVELS, "tokens", F.greatest(budget, F.lit(0.0)).alias("budget"))


def mix(documents: DataFrame, domain: Column, weights: dict[tuple[str, ...], float], share: float, max_epochs: int = 4, seed: int = SEED) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epoch): a row for each document and epoch that it is taken in.

    The budget is ``share`` of all tokens (runs of non-space characters).  A
    null domain, language or source is the node ``(none)``.  A null, empty or
    blank text has no tokens: it costs nothing and is taken once for each epoch
    begun by its leaf, if any budget reaches the leaf.  Repeated rows are
    separate documents of equal order; a null doc_id is ordered like any other.
    An empty table gives no rows.  Only the named columns are read.  Domains and
    languages reach the driver, sources and documents never do.
    """
    spark: SparkSession = documents.sparkSession
    K.tune(spark)
    s = Scratch(spark, "mixing")
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long")
    named = lambda c: F.coalesce(c.cast("string"), F.lit(UNKNOWN))
    docs = s.save(documents.select("doc_id", named(domain).alias("domain"), named(F.col("lang")).alias("lang"), named(F.col("source")).alias("source"), tokens.alias("n_tokens")), "docs")
    leaves = s.save(docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    upper = {(r["domain"], r["lang"]): r["n"] for r in leaves.groupBy("domain", "lang").agg(F.sum("tokens").alias("n")).collect()}  # domains and languages are few
    given = budgets(upper, weights, share * sum(upper.values()), max_epochs)
    given = spark.createDataFrame([(*path, float(total)) for path, total in given.items()], "domain string, lang string, total double")
    own = spark.createDataFrame([(*path, float(w)) for path, w in weights.items() if len(path) == len(LEVELS)], "domain string, lang string, source string, weight double")
    budgeted = leaf_budgets(leaves, given, own, max_epochs, s).withColumn("budget", F.col("budget") + 1e-6)
    whole = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(max_epochs))).otherwise(0).cast("int")
    plan = s.save(budgeted.withColumn("whole", whole).select(*LEVELS, "whole", (F.floor("budget") - F.col("whole") * F.col("tokens")).cast("long").alias("rest")), "plan")
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    placed = docs.join(plan, list(LEVELS)).withColumn("at", F.xxhash64("doc_id", F.lit(seed), "whole"))
    last = ranked(placed.where("rest > 0").drop("rest", "whole"), list(LEVELS), ["at", "doc_id", "n_tokens"], s, "order", "n_tokens")
    last = last.join(plan, list(LEVELS)).where("running <= rest").withColumn("epoch", F.col("whole"))
    full = placed.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    columns = ["doc_id", *LEVELS, "n_tokens", "epoch"]
    return full.select(columns).union(last.select(columns))


#: Example targets: sources src0 to src9 form the domain ``head``.
TARGETS = {("head",): 0.6, ("tail",): 0.4} | {(d, lang): w for d in ("head", "tail") for lang, w in (("en", 0.5), ("de", 0.2), ("fr", 0.2), ("es", 0.1))}


def by_source() -> Column:
    """Domain of the test tables' sources: ``head`` for src0 to src9, else ``tail``."""
    return F.when(F.col("source").rlike(r"^src\d$"), "head").when(F.col("source").isNotNull(), "tail")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the corpus's tokens, mixed to TARGETS with at most four epochs."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), by_source(), TARGETS, 0.5)
