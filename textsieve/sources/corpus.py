"""Corpora: tables, folders of text files, and git work trees.

A corpus is a DataFrame with ``schemas.CORPUS``.  Files are listed on the
driver (names only) and read on the executors.
"""

from __future__ import annotations

import hashlib
import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.config import CACHE_DIR
from textsieve.functions.globs import IgnoreRules, glob_regex
from textsieve.schemas import CORPUS
from textsieve.session import share_package

#: Folders that are never searched, and the share of control bytes that makes a file binary.
ALWAYS_IGNORED = (".git", CACHE_DIR, "node_modules", "dist")
CONTROL_SHARE = 0.02
ALL_FILES = ["**/*"]
#: Levels of a snapshot's digest, and hex digits that each of them adds to a bucket (of 16 to that power).
LEVELS, DIGITS = 3, 2
#: Files that a task reads.
FILES = 256


def table_corpus(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """(doc_id, path, content) of one of the text tables.  Null contents stay; they hold no match."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    c = F.col
    shapes = {
        "documents": (c("doc_id"), F.concat(c("source"), F.lit("/"), c("lang"), F.lit("/"), c("doc_id").cast("string"), F.lit(".txt")), c("text")),
        "pages": (c("page_id"), F.concat(F.lit("pages/"), c("page_id").cast("string"), F.lit(".html")), c("html")),
        "conversations": (c("conv_id") * 1000 + c("turn"), F.concat(c("role"), F.lit("/"), c("conv_id").cast("string"), F.lit("/"), c("turn").cast("string"), F.lit(".txt")), c("text")),
        "benchmark": (c("item_id"), F.concat(F.lit("benchmark/"), c("item_id").cast("string"), F.lit(".txt")), c("text")),
    }
    doc_id, path, content = shapes[table]
    return df.select(doc_id.cast("long").alias("doc_id"), path.alias("path"), content.alias("content"))


def is_text(data: bytes) -> bool:
    """No NUL, and less than CONTROL_SHARE of other control bytes."""
    if b"\0" in data:
        return False
    control = sum(data.count(bytes([b])) for b in (*range(1, 9), *range(14, 32)))
    return control / max(len(data), 1) < CONTROL_SHARE


def text_filter(data: Column) -> Column:
    """``is_text`` for a binary column, without Python."""
    shown = F.hex(data)
    pairs = F.regexp_replace(shown, "(..)", "$1 ")
    control = F.regexp_count(pairs, F.lit("(0[1-8]|0E|0F|1[0-9A-F]) "))
    return ~pairs.rlike("(^| )00 ") & (control / F.greatest(F.octet_length(data), F.lit(1)) < CONTROL_SHARE)


@dataclass
class Discovered:
    """mode: git or snapshot; revision: of the base; base and working: corpora (the same in a snapshot)."""

    mode: str
    revision: str
    base: DataFrame
    working: DataFrame


def _git(root: str, *args: str, data: bytes | None = None) -> bytes | None:
    try:
        return subprocess.run(["git", "-C", root, *args], input=data, capture_output=True, check=True).stdout
    except (OSError, subprocess.CalledProcessError):
        return None


def detect_git(root: str) -> tuple[str, str, str] | None:
    """(repository root, prefix of the workspace in it, HEAD), or None outside of git or before a commit."""
    top, head = _git(root, "rev-parse", "--show-toplevel"), _git(root, "rev-parse", "HEAD")
    if top is None or head is None:
        return None
    repo = top.decode().strip()
    prefix = os.path.relpath(os.path.realpath(root), os.path.realpath(repo)).replace(os.sep, "/")
    return repo, "" if prefix == "." else prefix + "/", head.decode().strip()


def ignore_rules(root: str, exclude: list[str]) -> IgnoreRules:
    lines = [*ALWAYS_IGNORED, *exclude]
    path = os.path.join(root, ".gitignore")
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            lines += f.read().splitlines()
    return IgnoreRules(lines)


def _selected(paths: list[str], root: str, include: list[str], exclude: list[str]) -> list[str]:
    import re

    rules = ignore_rules(root, exclude)
    wanted = [re.compile("(?s)" + glob_regex(g)) for g in include]
    return sorted(p for p in set(paths) if any(w.match(p) for w in wanted) and not rules.ignores(p))


def list_files(root: str, include: list[str], exclude: list[str]) -> list[str]:
    """Relative paths of the files to search, dot files included, links to folders not followed."""
    found = []
    for folder, folders, files in os.walk(root):
        folders[:] = [d for d in folders if d not in ALWAYS_IGNORED]
        found += [os.path.relpath(os.path.join(folder, f), root).replace(os.sep, "/") for f in files]
    return _selected(found, root, include, exclude)


def listing(root: str, include: list[str], exclude: list[str]) -> str:
    """A digest of the names, sizes and times of the files to search, and of what git has checked out."""
    digest = hashlib.sha256(repr((include, exclude, detect_git(root))).encode())
    for path in list_files(root, include, exclude):
        at = os.stat(os.path.join(root, path))
        digest.update(f"{path}\0{at.st_size}\0{at.st_mtime_ns}\n".encode())
    return digest.hexdigest()


def _row(path: str, root: str, data: bytes, mtime: float, tracked: bool) -> tuple:
    text = data.decode("utf-8", "replace")
    return path, os.path.join(root, path), text, hashlib.sha256(text.encode()).hexdigest(), len(data), mtime, tracked


def _read(spark: SparkSession, paths: list[str], read) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for r in read(list(frame["path"])) if r is not None]
            yield pd.DataFrame(rows, columns=CORPUS.names)

    share_package(spark)
    parts = max(1, -(-len(paths) // FILES))
    return spark.createDataFrame(spark.sparkContext.parallelize([(p,) for p in paths], parts), "path string").mapInPandas(run, CORPUS)


def read_files(spark: SparkSession, root: str, paths: list[str], tracked: bool) -> DataFrame:
    """Corpus of files on a disk that driver and executors share; binary files are left out."""

    def read(names: list[str]) -> Iterator[tuple]:
        for name in names:
            at = os.path.join(root, name)
            with open(at, "rb") as f:
                data = f.read()
            if is_text(data):
                yield _row(name, root, data, os.stat(at).st_mtime * 1000, tracked)

    return _read(spark, paths, read)


def read_head(spark: SparkSession, root: str, repo: str, prefix: str, head: str, include: list[str], exclude: list[str]) -> DataFrame:
    """Corpus of the files that HEAD tracks below the workspace; those with a NUL are left out."""
    listed = (_git(repo, "ls-tree", "-r", "-z", "--name-only", head) or b"").decode("utf-8", "replace").split("\0")
    own = [p[len(prefix) :] for p in listed if p and p.startswith(prefix)]

    def read(names: list[str]) -> Iterator[tuple]:
        # One blob at a time: the next is asked for when the one before has been read.
        with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            for name in names:
                git.stdin.write(f"{head}:{prefix}{name}\n".encode())
                git.stdin.flush()
                data = git.stdout.read(int(git.stdout.readline().split()[-1]) + 1)[:-1]
                if b"\0" not in data:
                    yield _row(name, root, data, 0.0, True)
            git.stdin.close()

    return _read(spark, _selected(own, root, include, exclude), read)


def snapshot_revision(corpus: DataFrame) -> DataFrame:
    """One row (revision): a digest of all paths and content hashes, whatever their order.

    Rows are digested where they lie and the digests of a bucket of paths are
    sorted and digested again; no more than 16**DIGITS digests meet above
    the lowest level.
    """
    row = F.sha2(F.concat_ws(":", "path", "content_hash"), 256)
    rows = corpus.select(row.alias("d"), F.substring(F.sha2("path", 256), 1, LEVELS * DIGITS).alias("bucket"))
    for level in range(LEVELS, -1, -1):
        rows = rows.groupBy(F.substring("bucket", 1, level * DIGITS).alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("d"))
    return rows.select(F.concat(F.lit("snapshot:"), "d").alias("revision"))


def revision_of(corpus: DataFrame) -> str:
    """The digest of ``snapshot_revision``."""
    return snapshot_revision(corpus).first()[0]


def discover(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> Discovered:
    """The corpus of a workspace: HEAD and work tree in git, else the files as they are."""
    include, exclude = include or ALL_FILES, exclude or []
    git = detect_git(root)
    working = read_files(spark, root, list_files(root, include, exclude), git is not None)
    if git is None:
        return Discovered("snapshot", revision_of(working), working, working)
    repo, prefix, head = git
    return Discovered("git", f"git:{head}", read_head(spark, root, repo, prefix, head, include, exclude), working)


def bootstrap_ignore(root: str, index_dir: str, enabled: bool = True) -> tuple[str | None, str | None, bool]:
    """Add the index folder to the workspace's ignore file: (file, entry, whether it was changed)."""
    inside = os.path.relpath(os.path.abspath(index_dir), os.path.abspath(root)).replace(os.sep, "/")
    if not enabled or inside == "." or inside.startswith("..") or os.path.isabs(inside):
        return None, None, False
    path, entry = os.path.join(root, ".gitignore"), inside + "/"
    held = ""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            held = f.read()
    if any(line.strip().strip("/") == inside for line in held.splitlines() if not line.strip().startswith(("#", "!"))):
        return path, entry, False
    if held and not held.endswith("\n"):
        held += "\n"
    with open(path, "w", encoding="utf-8") as f:
        f.write(held + ("\n" if held else "") + f"# {CACHE_DIR} index\n{entry}\n")
    return path, entry, True
