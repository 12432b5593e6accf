"""Corpus pipeline: documents to encoded training text, one operator per stage.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents. Between stages the rows
lie as Parquet in the cluster's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from liftlens.llm.chunks import dedup_substrings
from liftlens.llm.decontaminate import clean_of
from liftlens.llm.jaccard import first_of_each
from liftlens.llm.sentencepiece_fst import decode, encode
from liftlens.llm.storage import new_path, staged
from liftlens.llm.toxicity import not_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on those of them with labels, doesn't judge toxic."""
    return not_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    return first_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds; every row stays."""
    return dedup_substrings(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of benchmark."""
    return clean_of(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids and the text decoded from these, which replaces the text.

    The ids lie in the shared folder in between, so that a task holds one Python worker and not two.
    """
    return decode(staged(encode(docs).drop("text"), "encoded"), into="text").select(*docs.columns, "token_ids")


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]

# The fitted chain and the encoder have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and reread as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
