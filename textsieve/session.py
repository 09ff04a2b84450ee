"""What the library asks of a session."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of files for each core up to which a table counts as small.
SMALL = 4 << 20


def share_package(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it.

    It helps where workers see the same folders (one machine, a shared disk);
    elsewhere the package is installed or shipped like any other.
    """
    root, environment = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *paths]))


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a small file dealt out to all cores, for work that costs far more than a shuffle of them.

    A small file often is one row group, and so one task.  Tables of more than
    SMALL bytes a core have row groups enough and stay as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size <= cores * SMALL and rows.inputFiles() else rows
