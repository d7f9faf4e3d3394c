"""The corpus pipeline: quality, near-duplicates, source mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before
it kept; its result is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqmill.llm import mixing, packing, quality, simhash
from seqmill.llm.common import read_table, written
from seqmill.llm.queries import word_vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant accepts, fitted on the labelled ones among ``docs``."""
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_one(docs, width=3, most=3, seed=42)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs, weights=(5.0, 2.0, 1.0), max_repeats=3)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 4096 tokens."""
    return packing.pack(docs, word_vocabulary(), capacity=4096, end_id=1)


STAGES = [("quality classifier", keep_quality), ("simhash near-dedup", drop_near_duplicates),
          ("source mixing", mix_sources), ("best-fit packing", pack_sequences)]

#: SQL has no tokenizer, SimHash or fitted discriminant: the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the folder's documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
