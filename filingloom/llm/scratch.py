"""Intermediate tables in the cluster's shared checkpoint folder.

Lineage is cut by writing Parquet there, so a lost executor costs only the
tasks it was running: the written table is read again, never recomputed. A
write's shuffle files are deleted when it is done. Tables that a returned result
may still read stay until ``clear`` is called.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_ROOTS: dict[str, list[str]] = {}
#: Session settings of the operators, set where the session has none of its own.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",  # shuffle files go with the query that made them
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),  # a batch of long texts holds fewer rows
}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
    return f"file://{_LOCAL[app]}"


def settle(spark: SparkSession) -> None:
    """Make SETTINGS hold, but for those that the application was started with."""
    for key, value in SETTINGS.items():
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, value)


class Scratch:
    """Named tables of one operator call, under one fresh folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/filingloom-{uuid.uuid4().hex}"
        _ROOTS.setdefault(spark.sparkContext.applicationId, []).append(self.root)
        settle(spark)

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write df and return the written table; ``by``: a column with a folder (name/column=value) for each value."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path, partitionBy=by, compression="zstd")
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        _delete(self.spark, f"{self.root}/{name}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folders(spark: SparkSession) -> list[str]:
    """The folders of intermediate tables that this application has not deleted yet."""
    return list(_ROOTS.get(spark.sparkContext.applicationId, []))


def forget(spark: SparkSession, roots: Iterable[str]) -> None:
    """Delete these folders; results that read them must have been written before."""
    gone = set(roots)
    held = _ROOTS.get(spark.sparkContext.applicationId, [])
    _ROOTS[spark.sparkContext.applicationId] = [r for r in held if r not in gone]
    for root in held:
        if root in gone:
            _delete(spark, root)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results must have been written before."""
    forget(spark, folders(spark))
