"""A corpus pipeline of five stages. Each stage takes (spark, docs, sf_dir), works on all its
predecessor kept, and all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyorder.llm.common import keep_rows, stash
from tidyorder.llm.decontaminate import decontaminate
from tidyorder.llm.mixing import mix
from tidyorder.llm.quality import quality_scores
from tidyorder.llm.sharding import with_shard
from tidyorder.llm.simhash import simhash_groups
from tidyorder.session import ship_package

#: Token shares of the mixture: nothing that the classifier holds for toxic.
TARGETS = {"clean": 1.0, "toxic": 0.0}
SHARDS = 8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    scores = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_rows(docs, scores.filter("predicted = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays, and of a
    row that is repeated, one."""
    groups = simhash_groups(docs, shingle=4, distance=4)
    firsts = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = keep_rows(docs, firsts).withColumn("__tk", F.xxhash64(F.coalesce("text", F.lit(""))))
    return kept.dropDuplicates(["doc_id", "__tk"]).drop("__tk")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words lie in benchmark windows go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "documents")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates are fitted to TARGETS; a document stays, once, if its rate is at least one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    domains = labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").alias("domain"))
    return keep_rows(docs, mix(docs, domains, TARGETS).filter("rate >= 0.5"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard."""
    return with_shard(docs, SHARDS)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("sharding", sharding),
]

#: SQL cannot express the classifier, the fingerprints or the fit; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each result written and read again."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
