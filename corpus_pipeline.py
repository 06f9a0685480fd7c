"""From raw documents to a training mix: rules, classifier, near duplicates, decontamination, mixture.

Every stage works on all rows that its predecessor kept and passes on the
columns of documents; the last returns the mix, a row for each document that is taken from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.decontaminate import decontaminated
from halyard.llm.jaccard_join import distinct_documents
from halyard.llm.mixing import mixed_documents
from halyard.llm.nbsvm import accepted, train
from halyard.llm.quality_cascade import quality_filtered
from halyard.llm.storage import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects go on."""
    return quality_filtered(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go on; the model learns from the labelled rows among them, outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return accepted(docs, train(docs, labels), threshold=0.3)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links connect, the one with the least id goes on."""
    return distinct_documents(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark go on."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of the documents that the mix takes words from."""
    return mixed_documents(docs).where(F.col("taken") > 0)


STAGES = [("quality rules", quality_rules), ("quality classifier", quality_classifier), ("near duplicates", near_duplicate_groups), ("benchmark decontamination", benchmark_passages), ("source mix", source_mix)]

#: The classifier's fit is not expressible in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
