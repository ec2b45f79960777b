"""The weekly refresh as a stream of newly landed filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILINGS = "ticker string, accession string, kind string, report_date date, filed date, html string"


def refresh_stream(spark: SparkSession, landing: str, state: str, checkpoint: str, process) -> StreamingQuery:
    """Process filings that landed since the last run, each accession once, and append what ``process`` makes of them.

    ``process(new) -> (sections, errors)``. Sections of a batch are written to its
    own folder before its accessions are recorded, so a batch that is run again
    after a failure overwrites itself; failed filings are not recorded and are
    taken up when they land again.
    """
    landed = spark.readStream.schema(FILINGS).parquet(landing)

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        done = _recorded(session, f"{state}/done", number)
        new = batch.dropDuplicates(["accession"]).join(done, "accession", "left_anti")
        sections, errors = process(new)
        sections.write.mode("overwrite").parquet(f"{state}/sections/batch={number}")
        failed = errors.select("accession")
        new.join(failed, "accession", "left_anti").select("accession").write.mode("overwrite").parquet(f"{state}/done/batch={number}")

    return landed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _recorded(spark: SparkSession, path: str, number: int) -> DataFrame:
    """Accessions recorded by other batches than this one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "accession string")
    return spark.read.schema("accession string, batch long").parquet(path).filter(F.col("batch") != number).select("accession")
