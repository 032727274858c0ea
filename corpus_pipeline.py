"""Documents to shards in five stages: quality rules, near-duplicates, benchmark leaks, source mix, shards.

Each stage takes what the one before kept and is written as Parquet in the shared checkpoint folder in between, so a
lost executor repeats at most one stage.

Defined results: null, empty and short texts fail the quality rules; null ids and null sources are kept like others; of
repeated rows and copies one stays, until the mix takes a document more than once; very long texts are read whole; an
empty table gives an empty result; columns named like ours are kept up to the last stage, whose own replace them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papertrawl.llm import decontam, mix, quality, shards, simhash
from papertrawl.session import cut_lineage
from papertrawl.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, and documents that fail the base rules or keep too little."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes."""
    return mix.mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their shard and their place in it."""
    return shards.shard(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("sharding", sharding)]

#: SimHash fingerprints and random rounding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
