"""Session settings and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_FOLDERS: dict[str, list[str]] = {}


def work_folder(spark: SparkSession) -> str:
    """A fresh folder that all executors share: below ``spark.checkpoint.dir``, a temporary one only in local mode."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        folder = f"{told.rstrip('/')}/filings-{uuid.uuid4().hex}"
    elif spark.sparkContext.master.startswith("local"):
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _FOLDERS.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """df as a written table of its own work folder: what is read from it again is not worked out again, nor lost with an executor."""
    path = f"{work_folder(df.sparkSession)}/{name}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_work(spark: SparkSession) -> None:
    """Delete all work folders of this application; results that read them must have been written before."""
    for folder in _FOLDERS.pop(spark.sparkContext.applicationId, []):
        fs, path = file_system(spark, folder)
        fs.delete(path, True)


def file_system(spark: SparkSession, path: str) -> tuple:
    """(the Hadoop file system of a path, the path)."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, unless they import it already."""
    found = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in found or os.path.realpath(os.getcwd()) == str(ROOT) or getattr(spark.sparkContext, "_filingloom_shipped", False):
        return
    spark.sparkContext._filingloom_shipped = True
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "filingloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((ROOT / "filingloom").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
