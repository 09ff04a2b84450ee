"""Shared scratch tables: the library's way to cut lineage.

Tables are Parquet directories below the folder that ``spark.checkpoint.dir``
names, so any executor can read what another one wrote and a lost executor
costs no finished stage.  Where the setting is absent (tests on one machine) a
temporary folder is used, and only with a local master.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """URI of the shared scratch folder of this session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="textsieve-"))
    return root.rstrip("/")


class Scratch:
    """Scratch tables of one operator call, below a folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/textsieve/{name}-{uuid.uuid4().hex[:12]}"
        self._paths: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads it back."""
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self._paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            delete(self.spark, self._paths.pop(name, self.path(name)))


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
