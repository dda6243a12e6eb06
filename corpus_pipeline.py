"""A training corpus from `documents`: toxicity, quality, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Its result is written
as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from casewright.llm import line_dedup, packing, quality, simhash, toxicity
from casewright.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_documents(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", drop_low_quality), ("line_dedup", drop_repeated_lines), ("simhash", drop_near_duplicates), ("packing", pack)]

#: Learned weights, fuzzy matching and tokenisation are beyond SQL; tests hold the quality stage against its SQL and the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before, scratch = table(spark, sf_dir, "documents"), None, Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir))
        if before is not None:  # all that read it has been written
            scratch.drop(before)
        before = docs
    return docs
