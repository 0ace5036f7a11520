"""The corpus pipeline: quality rules, near duplicates, benchmark leaks, mixing, shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before left; all but the last
return the columns of ``documents``.  An empty table passes through every stage."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tailcast.llm import decontaminate, jaccard, mixing, quality, sharding
from tailcast.llm.common import load, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or stray from their language's histograms."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the document with the smallest doc_id of each group linked by five-word shingles at 0.8."""
    return jaccard.without_near_copies(docs, n=5, num=4, den=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage that covers question and answer of a benchmark item."""
    return decontaminate.keep_clean(docs, load(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents by Poisson counts and shuffles globally."""
    return mixing.mix(docs, extra=False)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.assign_shards(docs, 24)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination),
          ("mixing sources", source_mixing), ("sharding", shards)]

#: Set hashes, fuzzy components and block-max search have no SQL of reasonable cost; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
