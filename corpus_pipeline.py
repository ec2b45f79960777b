"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept;
all but the last return the columns of documents. ``run`` chains them, each
stage's result written to the shared checkpoint folder and read again. A stage's
result has to be written before the next stage is called: that one deletes the
intermediate tables of the stages before it, but for those its ``docs`` still read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from filingloom.llm import decontam, jaccard_join, langid, packing, pii
from filingloom.llm.scratch import Scratch, folders, forget

#: Folders of intermediate tables that stages left, by application.
_LEFT: dict[str, set[str]] = {}


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, which first deletes what earlier stages left and ``docs`` does not read."""

    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _LEFT.setdefault(spark.sparkContext.applicationId, set())
        if left:
            read = {name for file in docs.inputFiles() for name in file.split("/") if name.startswith("filingloom-")}
            done = {root for root in left if root.rsplit("/", 1)[-1] not in read}
            forget(spark, done)
            left -= done
        before = set(folders(spark))
        out = work(spark, docs, sf_dir)
        left |= set(folders(spark)) - before
        return out

    return stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return langid.keep_identified(docs)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similar word shingles stays."""
    return jaccard_join.keep_one(docs)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark windows are cut out; a document of which nothing is left goes."""
    return decontam.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by the name of their kind."""
    return pii.redact(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("mask_personal_data", mask_personal_data),
    ("pack", pack_sequences),
]

#: Trained models and a tokenizer are not SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage kept is deleted when the next one's rows are written."""
    scratch, before = Scratch(spark), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
