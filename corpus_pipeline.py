"""The corpus pipeline: quality, exact and near duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads again as the next one's ``docs``.  All but the last
return the columns of documents.

Null and empty texts, null and repeated ids, ties and further columns are handled
as the stages' operators state; an empty table gives an empty result.  Without
enough labelled rows for a classifier the first stage keeps everything.  Texts
without words are equal to each other, and the mix never takes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlearn.llm import exact_dedup, mixing, near_dup, packing, quality, scratch
from normlearn.llm.ship import ship


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject; it learns from labels and all documents."""
    ship(spark)
    every = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.learn(every, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: similarity of 0.8 or more over shingles of five words."""
    ship(spark)
    return near_dup.keep_one(docs, near_dup.JoinSpec(percent=80))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights of domains, languages and sources, a row for each copy."""
    return mixing.mix(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 token ids."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mix", mixed),
    ("pack", packed),
]

#: Compression, minwise trees and tokenizers are not SQL: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    point = scratch.mark()
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
        scratch.remove_since(point, docs)  # what the stages before it wrote
    return STAGES[-1][1](spark, docs, sf_dir)
