"""Many named files: written by tasks, read by few of them."""

import time

from pyspark.sql import functions as F

from filingloom.sources import archives as R


def _names(spark, n):
    return spark.range(n).select(F.concat(F.lit("a b/"), (F.col("id") % 7).cast("string"), F.lit("/00-"), F.col("id").cast("string"), F.lit(".htm")).alias("name"), F.concat(F.lit("<p>é "), F.col("id").cast("string"), F.lit("\n</p>")).alias("value"))


def test_many_files_take_seconds(spark, tmp_path):
    n, path = 6000, f"file://{tmp_path}/out"
    began = time.time()
    R.write_named_files(_names(spark, n), path)
    assert time.time() - began < 25
    assert (tmp_path / "out/a b/3/00-10.htm").read_text() == "<p>é 10\n</p>\n"
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == ["a b"]


def test_few_tasks_read_many_files(spark, tmp_path):
    n, path = 600, str(tmp_path / "out" / "a b" / "0")
    R.write_named_files(_names(spark, 7 * n), f"file://{tmp_path}/out")
    read = R.read_filing_html(spark, path)
    assert read.rdd.getNumPartitions() <= 16
    assert {(r.accession, r.html) for r in read.collect()} == {(f"00-{7 * k}", f"<p>é {7 * k}\n</p>\n") for k in range(n)}


def test_files_that_the_driver_renames(spark, tmp_path):
    """Other file systems: the same files; and a later write takes their place, checksums and all."""
    path = f"file://{tmp_path}/out"
    rows = _names(spark, 30)
    R._rename_files(rows, path, f"{path}/_writing")
    assert (tmp_path / "out/a b/3/00-10.htm").read_text() == "<p>é 10\n</p>\n"
    R.write_named_files(rows.withColumn("value", F.when(F.col("name") != "a b/3/00-10.htm", F.lit("other text"))), path)
    got = {r.accession: r.html for r in R.read_filing_html(spark, f"{path}/a b/*").collect()}
    assert len(got) == 30 and got.pop("00-10") == "\n" and set(got.values()) == {"other text\n"}


def test_few_tasks_list_prior_work(spark, tmp_path):
    """20 files in each of 50 folders are listed, hidden ones not, by a few tasks."""
    names = spark.range(1000).select(F.concat(F.lit("Models/"), F.floor(F.col("id") / 20).cast("string"), F.when(F.col("id") % 10 == 0, "/.").otherwise("/"), F.col("id").cast("string")).alias("name"), F.lit("x").alias("value"))
    R.write_named_files(names, f"file://{tmp_path}/root")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    listed = R.list_prior_work(spark, f"file://{tmp_path}/root")
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{tmp_path}/root")
    assert scan.rdd.getNumPartitions() <= 16
    assert {r.path for r in listed.collect()} == {f"Models/{k // 20}/{k}" for k in range(1000) if k % 10}
