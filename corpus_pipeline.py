"""From raw documents to packed training sequences.

Every stage takes (spark, docs, folder), works on all rows its predecessor kept and returns the
columns of ``docs``, except the last, which returns the packed pieces. Stages are written as
tables to the shared folder, so a lost executor costs at most one stage's tasks.

Defined results, in every stage: a missing text counts as empty; very long texts are read whole; rows
repeated with their id are rows of their own until exact dedup, which keeps one of equal texts; rows
without an id pass the near-duplicate stage; without labels, or with good ones only, the classifier
keeps every document, with bad ones only none; columns beside those of documents, whatever their
names, pass every stage but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import exact, mixing, packing, rules, simhash
from panelforge.session import materialize


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the rule ensemble predicts to be good."""
    return rules.kept(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return simhash.one_per_component(docs)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

# The classifier is fitted in the run, which SQL cannot express; tests hold the stages against
# brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
