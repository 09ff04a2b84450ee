"""The engine: searches over a workspace of files, with its index."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from textsieve.config import EngineConfig
from textsieve.errors import SearchError
from textsieve.operators.index import Index
from textsieve.operators.inspect import Inspection, inspect_terms
from textsieve.operators.search import SearchResult, search_literal, search_regex
from textsieve.plans.query_plan import QueryPlan, explain
from textsieve.plans.translate import translate
from textsieve.plans.workflow import SearchPlan, plan_search


class Engine:
    """engine.index has ensure, status and clear; the searches refresh the index unless told not to."""

    def __init__(self, spark: SparkSession, workspace: str | None = None, index_dir: str | None = None, bootstrap_ignore: bool | None = None):
        self.spark = spark
        self.config = EngineConfig.resolve(workspace, index_dir, bootstrap_ignore)
        self.index = Index(spark, self.config)

    def _ready(self, refresh: bool) -> None:
        if refresh:
            self.index.ensure()
        elif self.index.manifest() is None:
            raise SearchError("INDEX_NOT_READY", "there is no index of this workspace; call index.ensure()")

    def search_literal(self, needle: str, case_sensitive: bool = True, auto_ensure: bool = True, **options) -> SearchResult:
        """Occurrences of a literal; options: path_globs, max_results, before, after."""
        if not needle:
            raise SearchError("INVALID_INPUT", "the needle is empty")
        self._ready(auto_ensure)
        return search_literal(self.index.literal_candidates(needle, case_sensitive), needle, case_sensitive=case_sensitive, **options)

    def search_regex(self, pattern: str, flags: str = "", include_plan: bool = False, auto_ensure: bool = True, **options) -> SearchResult:
        """Matches of an ECMAScript pattern; options: path_globs, max_results, before, after."""
        explain(pattern, flags)
        self._ready(auto_ensure)
        return search_regex(self.index.regex_candidates(pattern, flags), pattern, flags, include_plan=include_plan, **options)

    def explain(self, pattern: str, flags: str = "") -> QueryPlan:
        return explain(pattern, flags)

    def plan_search(self, objective: str, pattern: str | None = None, exact: str | None = None, path_hints: list[str] | None = None) -> SearchPlan:
        return plan_search(objective, self.index.status(), pattern, exact, path_hints)

    def inspect_terms(self, text: str | None = None, path: str | None = None, **options) -> Inspection:
        """Terms of a text or of a file; a relative path starts at the workspace."""
        at = os.path.join(self.config.workspace, path) if path else None
        return inspect_terms(self.spark, text, at, **options)

    def translate(self, pattern: str, flags: str = "") -> str:
        """The Java form of a pattern."""
        return translate(pattern, flags)

    def manifest(self) -> DataFrame:
        """The active manifest as one row, or none; ``index.changes()`` has the paths of the overlay."""
        found = self.index.manifest()
        schema = "base_id string, mode string, revision string, created_at string, file_count long, overlay_revision string, overlay_file_count long, deleted_paths long, changed_paths long"
        rows = [(found["base_id"], found["mode"], found["revision"], found["created_at"], found["file_count"], found["overlay"]["revision"], found["overlay"]["file_count"], found["overlay"]["deleted"], found["overlay"]["changed"])] if found else []
        return self.spark.createDataFrame(rows, schema)

    def stats(self) -> DataFrame:
        """Size and counts of the active index as one row, or none."""
        found = self.index.manifest()
        rows = [(found["base_id"], found["file_count"], found["overlay"]["file_count"], self.index.stored_bytes())] if found else []
        return self.spark.createDataFrame(rows, "base_id string, file_count long, overlay_file_count long, stored_bytes long")
