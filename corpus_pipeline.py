"""A corpus from raw documents: quality, near duplicates, benchmark passages, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Every column may be null, tables may be empty and rows
may repeat; see the operators' docstrings for what each makes of it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listrank.llm import decontam, mixing, quality_model, sharding, simhash
from listrank.llm.common import free_name, shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    name = free_name(docs, "quality")
    out = quality_model.classify(docs, table(spark, sf_dir, "labels"), column=name)
    return out.where(F.col(name)["kept"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window. A document with one goes as a whole: cutting the spans would leave its
    context, and join words that did not stand together."""
    name = free_name(docs, "found")
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"), found_column=name)
    return found.where(F.size(F.col(name)["spans"]) == 0).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with slot and shard."""
    return sharding.assign_shards(docs)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixture), ("sharding", shards)]

#: SQL has no logistic fit, no XXH64 and no pivotal draws; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{top}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{top}/{k}")
    return docs
