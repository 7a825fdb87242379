"""Documents to balanced training shards: five stages of corpus operators, each written and read again by its caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenforge.llm.common import materialize
from lumenforge.llm.decontaminate import remove_spans
from lumenforge.llm.langid import keep_identified
from lumenforge.llm.mixing import mix
from lumenforge.llm.sharding import shard_documents
from lumenforge.llm.simhash import keep_one_per_component


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is told stay."""
    return keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one_per_component(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target shares of sources, languages and topics."""
    return mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot."""
    return shard_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_to_targets),
    ("sharding", shard),
]

#: Neural language ID, SimHash components and hashed sampling have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
    return docs
