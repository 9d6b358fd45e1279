"""The documents, cleaned, mixed and packed.

Quality rules drop documents that read like none of their language; of near-duplicates one
stays; passages that occur elsewhere are cut out; sources are repeated to their target weights;
and what remains is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewell.llm import minhash, mixing, packing, quality, substrings
from pagewell.llm.common import read, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.cleaned(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs).select("doc.*")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mixture", source_mixture),
    ("packed sequences", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs


#: Tokens, signatures and the packing plan are beyond SQL; the tests check every stage against brute force.
ORACLE_SQL = None
