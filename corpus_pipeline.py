"""Documents to packed training sequences, stage by stage.

Each stage takes the documents that its predecessor kept, as they were written, and returns documents with all their
columns; the last returns the pieces' places in sequences. Extra columns pass through every stage but the last.

Null doc_ids: such rows are scored and packed like others, but can't be linked, searched or named: they pass the
stages between unchanged. Rows that repeat a doc_id share its fate. An empty table passes every stage as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import decontam, minhash, packing, passages, quality
from gaugeworks.llm.workspace import Workspace, scope


def _without(docs: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """docs less these doc_ids; rows with a null doc_id stay."""
    gone = doc_ids.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs.doc_id == F.col("__gone"), "left_anti")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; those predicted 0 go."""
    judged = quality.classify(docs, quality.quality_labels(spark, sf_dir))
    return _without(docs, judged.where("predicted = 0 and doc_id is not null"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest doc_id."""
    classes = minhash.near_duplicates(docs)
    return _without(docs, classes.where("doc_id <> class_id"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds; a document left without a word goes."""
    return passages.remove_repeats(docs, passages.repeated_passages(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: SQL can't express learned scores, signatures, chains or a tokenizer: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each written and read again."""
    work = Workspace(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with scope():  # what the stage wrote for itself goes with it
            docs = work.keep(stage(spark, docs, sf_dir), name)
        work.drop(*before)
        before = [name]
    return docs
