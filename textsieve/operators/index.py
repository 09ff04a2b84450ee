"""The index: postings of sparse n-grams, a base layer and an overlay.

Layout below the index folder, which any file system that Spark reaches may
hold: ``current.json`` names the active base; ``<base id>/`` holds
``manifest.json`` and Parquet folders ``docs``, ``postings``, ``content`` and
the same below ``overlay/``, with ``changes`` beside them.  Postings are dealt
out by ranges of term and sorted, so that a lookup reads the row groups that
can hold its terms; lists of frequent terms are salted, as no task can hold
those of a term that stands in every document.  Searches may use postings to
leave documents out, never to answer: every candidate is verified on its
content.
"""

from __future__ import annotations

import hashlib
import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.config import INDEX_VERSION, EngineConfig
from textsieve.errors import SearchError
from textsieve.functions.grams import term_postings
from textsieve.plans.query_plan import condition_column, hashes_of, literal_condition, pruning
from textsieve.schemas import CHANGES, POSTINGS
from textsieve.sources.corpus import ALL_FILES, bootstrap_ignore, discover, listing
from textsieve.sources.store import Store

#: Documents of a posting list from which it counts as frequent, and parts that the lists of a frequent term go to.
FREQUENT, SALTS = 64, 256


def safe_id(prefix: str, value: str) -> str:
    return f"{prefix}-{hashlib.sha256(value.encode()).hexdigest()[:16]}"


def postings_of(docs: DataFrame) -> DataFrame:
    """(term_hash, docs): posting lists, dealt out by ranges of terms and sorted.

    Hashes are spread evenly, so the ranges need no sample of the data, which
    would find all terms twice.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = term_postings(docs)
    part = F.expr(f"cast(floor((shiftrightunsigned(term_hash, 33)) * {parts} / {2**31}) as int)")
    salt = F.when(F.size("docs") >= FREQUENT, F.pmod(F.xxhash64(F.element_at("docs", 1)), F.lit(SALTS))).otherwise(0)
    return lists.repartition(parts, part, salt).sortWithinPartitions("term_hash")


def candidates(postings: DataFrame, condition) -> DataFrame | None:
    """(doc_id) of the documents that meet a condition over terms; None if any document may.

    postings: lists (term_hash, docs), or rows (term_hash, doc_id).  One pass
    over the few terms' postings: a flag per term and document, then the
    condition over the flags.  Where any one term suffices the postings
    themselves are the answer, without a shuffle; a document may then appear
    more than once.
    """
    if condition is True:
        return None
    hashes = hashes_of(condition)
    found = postings.where(F.col("term_hash").isin(list(hashes.values())))
    if "docs" in found.columns:
        found = found.select("term_hash", F.explode("docs").alias("doc_id"))
    if isinstance(condition, str) or condition[0] == "or" and all(isinstance(p, str) for p in condition[1]):
        return found.select("doc_id")
    flags = {t: f"_t{i}" for i, t in enumerate(hashes)}
    held = found.groupBy("doc_id").agg(*[F.max(F.col("term_hash") == h).alias(flags[t]) for t, h in hashes.items()])
    return held.where(condition_column(condition, {t: F.col(c) for t, c in flags.items()})).select("doc_id")


def overlay_diff(base: DataFrame, working: DataFrame) -> DataFrame:
    """(path, change) of two corpora (path, content_hash): deleted, changed or added."""
    return _diff(base, working).select("path", "change")


def _diff(base: DataFrame, working: DataFrame) -> DataFrame:
    """As ``overlay_diff``, with the new content_hash."""
    old = base.select("path", F.col("content_hash").alias("old"))
    new = working.select("path", F.col("content_hash").alias("new"))
    change = F.when(F.col("new").isNull(), "deleted").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("new"), "changed")
    return old.join(new, "path", "full_outer").withColumn("change", change).where("change is not null").select("path", "change", F.col("new").alias("content_hash"))


def active_docs(base: DataFrame, overlay: DataFrame, deleted: DataFrame) -> DataFrame:
    """Documents of both layers: the overlay's replace the base's, deleted paths go."""
    gone = deleted.select("path").union(overlay.select("path"))
    return base.join(gone, "path", "left_anti").withColumn("layer", F.lit("base")).unionByName(overlay.withColumn("layer", F.lit("overlay")))


class TableIndex:
    """Index of a corpus that is a DataFrame with doc_id, path and content: a table, or what a subclass reads.

    doc_ids are unique within a corpus, and an id stays with its path.
    """

    def __init__(self, spark: SparkSession, root: str, name: str):
        """root: folder of indexes; name: what is indexed, which may be any text."""
        self.spark, self.workspace_id = spark, safe_id("ws", name)
        self.store = Store(spark, f"{root.rstrip('/')}/indexes/{self.workspace_id}")

    # metadata

    def _json(self, *parts: str) -> dict | None:
        held = self.store.read(*parts)
        return None if held is None else json.loads(held)

    def _write_json(self, value: dict, *parts: str) -> None:
        self.store.write(json.dumps(value, indent=2), *parts)

    def pointer(self) -> dict | None:
        return self._json("current.json")

    def manifest(self) -> dict | None:
        """Manifest of the active base, its format checked."""
        at = self.pointer()
        found = self._json(at["base_id"], "manifest.json") if at else None
        if found and found["version"] != INDEX_VERSION:
            raise SearchError("INDEX_NOT_READY", f"index format {found['version']} is not {INDEX_VERSION}")
        return found

    def _table(self, *parts: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(self.store.path(*parts))

    # building

    def _write_layer(self, corpus: DataFrame, *parts: str) -> int:
        """Write content, docs and postings of a corpus; returns the number of documents."""
        at = self.store.path(*parts)
        corpus.write.mode("overwrite").option("compression", "zstd").parquet(f"{at}/content")
        held = self.spark.read.parquet(f"{at}/content")
        held.drop("content").write.mode("overwrite").parquet(f"{at}/docs")
        postings_of(held).write.mode("overwrite").option("compression", "zstd").option("parquet.bloom.filter.enabled#term_hash", "true").parquet(f"{at}/postings")
        return held.count()

    @staticmethod
    def _hashed(corpus: DataFrame) -> DataFrame:
        return corpus if "content_hash" in corpus.columns else corpus.withColumn("content_hash", F.sha2("content", 256))

    def _publish(self, base_id: str, about: dict, base: DataFrame, working: DataFrame, force: bool, refresh_overlay: bool) -> dict:
        """Write a base unless it is there, then its overlay, the manifest and the pointer."""
        held = self._json(base_id, "manifest.json")
        reused = held is not None and not force
        manifest = held if reused else about | {"version": INDEX_VERSION, "base_id": base_id, "workspace_id": self.workspace_id, "created_at": datetime.now(UTC).isoformat(), "file_count": self._write_layer(self._hashed(base), base_id), "overlay": self._empty_overlay()}
        manifest |= about
        if refresh_overlay or not reused:
            manifest["overlay"] = self._refresh(self._hashed(working), base_id, manifest["revision"])
        self._write_json(manifest, base_id, "manifest.json")
        self._write_json({"base_id": base_id, "revision": manifest["revision"], "mode": manifest["mode"], "updated_at": datetime.now(UTC).isoformat()}, "current.json")
        return self._report(manifest, reused)

    def _report(self, manifest: dict, reused: bool) -> dict:
        return {k: manifest[k] for k in ("base_id", "mode", "revision", "file_count")} | {"reused": reused, "overlay_file_count": manifest["overlay"]["file_count"], "stored_bytes": self.stored_bytes()}

    def ensure(self, corpus: DataFrame, force: bool = False, refresh_overlay: bool = True) -> dict:
        """Build the base from a corpus if there is none (or by force); else put what has changed since into the overlay."""
        held = self.manifest()
        base_id = held["base_id"] if held and not force else safe_id("ix", f"{self.workspace_id} {datetime.now(UTC).isoformat()}")
        return self._publish(base_id, {"mode": "table", "revision": f"table:{base_id}"}, corpus, corpus, force, refresh_overlay)

    @staticmethod
    def _empty_overlay() -> dict:
        return {"revision": "overlay-empty", "file_count": 0, "changed": 0, "deleted": 0}

    def _refresh(self, working: DataFrame, base_id: str, revision: str) -> dict:
        """Write the overlay of a working corpus: its changes, and the layer of changed and added documents."""
        self.store.delete(base_id, "overlay")
        at = self.store.path(base_id, "overlay", "changes")
        _diff(self._table(base_id, "docs"), working).write.mode("overwrite").parquet(at)
        changes = self._table(base_id, "overlay", "changes", schema=CHANGES)
        row = F.conv(F.substring(F.sha2(F.concat_ws(":", "path", "change", "content_hash"), 256), 1, 12), 16, 10).cast("long")  # 48 bits: sums of 2**15 rows fit
        deleted, changed, digest = changes.agg(F.count_if(F.col("change") == "deleted"), F.count_if(F.col("change") != "deleted"), F.concat_ws(",", F.bit_xor(row), F.sum(row % (1 << 31)))).first()
        if not deleted and not changed:
            self.store.delete(base_id, "overlay")
            return self._empty_overlay()
        own = working.join(changes.where("change <> 'deleted'").select("path"), "path", "left_semi")
        n = self._write_layer(own, base_id, "overlay") if changed else 0
        return {"revision": safe_id("overlay", f"{revision} {deleted} {changed} {digest}"), "file_count": n, "changed": changed, "deleted": deleted}

    # reading

    def _layers(self) -> tuple[dict, str]:
        manifest = self.manifest()
        if manifest is None:
            raise SearchError("INDEX_NOT_READY", "there is no index; call ensure()")
        return manifest, manifest["base_id"]

    def changes(self) -> DataFrame:
        """(path, change, content_hash) of what the overlay holds against the base."""
        manifest, base_id = self._layers()
        there = manifest["overlay"]["changed"] + manifest["overlay"]["deleted"]
        return self._table(base_id, "overlay", "changes", schema=CHANGES) if there else self.spark.createDataFrame([], CHANGES)

    def _merged(self, name: str) -> DataFrame:
        manifest, base_id = self._layers()
        out = self._table(base_id, name).withColumn("layer", F.lit("base"))
        if manifest["overlay"]["changed"] + manifest["overlay"]["deleted"]:
            out = out.join(self.changes().where("change <> 'added'").select("path"), "path", "left_anti")
        return out.unionByName(self._table(base_id, "overlay", name).withColumn("layer", F.lit("overlay"))) if manifest["overlay"]["file_count"] else out

    def docs(self) -> DataFrame:
        """Active documents without their content."""
        return self._merged("docs")

    def corpus(self) -> DataFrame:
        """Active documents with the content that was indexed."""
        return self._merged("content")

    def pruned(self, condition) -> DataFrame:
        """Active documents, with content, that meet a condition; all if it is True."""
        manifest, base_id = self._layers()
        if condition is True:
            return self.corpus()
        corpus = self.corpus()
        near = lambda *layer: candidates(self._table(base_id, *layer, "postings", schema=POSTINGS), condition)
        out = corpus.where("layer = 'base'").join(near(), "doc_id", "left_semi")
        return out.unionByName(corpus.where("layer = 'overlay'").join(near("overlay"), "doc_id", "left_semi")) if manifest["overlay"]["file_count"] else out

    def literal_candidates(self, needle: str, case_sensitive: bool = True) -> DataFrame:
        """Active documents that may hold a literal."""
        return self.pruned(literal_condition(needle) if case_sensitive else True)

    def regex_candidates(self, pattern: str, flags: str = "") -> DataFrame:
        """Active documents that may match a pattern."""
        return self.pruned(pruning(pattern, flags))

    def stale(self, now: DataFrame) -> DataFrame:
        """(path, change) of what differs between the active documents and a corpus."""
        return overlay_diff(self.docs(), self._hashed(now))

    def status(self, now: DataFrame | None = None) -> dict:
        """Whether there is an index; against a corpus, also how many of its paths have changed."""
        manifest = self.manifest()
        if manifest is None:
            return {"ready": False, "workspace_id": self.workspace_id, "stale_paths": [], "file_count": 0, "overlay_file_count": 0}
        return {"ready": True, "workspace_id": self.workspace_id} | self._report(manifest, True) | {"stale_count": self.stale(now).count() if now is not None else 0}

    def clear(self, scope: str = "all") -> dict:
        """Delete the overlay, or everything of this index."""
        if scope not in ("overlay", "all"):
            raise SearchError("INVALID_INPUT", "scope is overlay or all")
        at = self.pointer()
        if scope == "all":
            self.store.delete()
        elif at:
            manifest = self._json(at["base_id"], "manifest.json")
            if manifest:
                self._write_json(manifest | {"overlay": self._empty_overlay(), "listing": ""}, at["base_id"], "manifest.json")
            self.store.delete(at["base_id"], "overlay")
        return {"scope": scope, "cleared": at is not None}

    def stored_bytes(self) -> int:
        return self.store.size()


class Index(TableIndex):
    """Index of a workspace of files."""

    def __init__(self, spark: SparkSession, config: EngineConfig):
        super().__init__(spark, config.index_dir, config.workspace)
        self.config = config

    def ensure(self, include: list[str] | None = None, exclude: list[str] | None = None, force: bool = False, refresh_overlay: bool = True) -> dict:
        """Build or reuse the base, refresh the overlay and publish both.

        Without globs those of the active index stay in force.  Files are only
        read if one of them has another size or time than at the last call.
        """
        c = self.config
        path, entry, updated = bootstrap_ignore(c.workspace, c.index_dir, c.bootstrap_ignore)
        held = self.manifest()
        include = include or (held or {}).get("include") or ALL_FILES
        exclude = exclude if exclude is not None else (held or {}).get("exclude") or []
        seen = listing(c.workspace, include, exclude)
        if held and not force and held.get("listing") == seen:
            made = self._report(held, True)
        else:
            found = discover(self.spark, c.workspace, include, exclude)
            base_id = safe_id("ix", json.dumps({"workspaceRoot": c.workspace, "sourceRevision": found.revision, "includeGlobs": include, "excludeGlobs": exclude}))
            about = {"mode": found.mode, "revision": found.revision, "include": include, "exclude": exclude, "listing": seen if refresh_overlay else ""}
            by_path = lambda corpus: corpus.withColumn("doc_id", F.xxhash64("path"))
            made = self._publish(base_id, about, by_path(found.base), by_path(found.working), force, refresh_overlay)
        return made | {"ignore_path": path, "ignore_entry": entry, "ignore_updated": updated}

    def status(self, now: DataFrame | None = None) -> dict:
        """Whether there is an index, and which paths have changed since; the files' names are on the driver anyway."""
        manifest, out = self.manifest(), super().status()
        if manifest is None:
            return out
        now = discover(self.spark, self.config.workspace, manifest["include"], manifest["exclude"]).working
        stale = [r["path"] for r in self.stale(now).orderBy("path").collect()]
        return out | {"stale_paths": stale, "stale_count": len(stale)}
