"""Feature and run-table views over the parquet tables of a scale-factor folder.

Feature tables use `row_id BIGINT, label INT, x_* DOUBLE, c_* INT`; run tables use
`dataset, classifier, seed, cleaning_order, balanced_accuracy, failed`.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyorder.functions.steps import ARROW, STEP_CODES
from tidyorder.sources.loaders import encode_categories

ORDERS = [ARROW.join(p) for p in itertools.permutations(STEP_CODES)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with line-item averages; orders without lines carry natural NULLs."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("x_qty"),
        F.round(F.avg("l_extendedprice"), 6).alias("x_price"),
        F.round(F.avg("l_discount"), 6).alias("x_disc"),
        F.round(F.avg("l_tax"), 6).alias("x_tax"),
    )
    joined = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("row_id"),
            F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
            F.col("o_totalprice").alias("x_total"),
            "x_qty",
            "x_price",
            "x_disc",
            "x_tax",
            F.col("o_orderpriority").alias("c_prio"),
            F.col("c_mktsegment").alias("c_seg"),
        )
    )
    return encode_categories(joined, ["c_prio", "c_seg"])


def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with whole-text counts; a small imbalanced table."""
    docs = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id"
    )
    text = F.col("text")
    return encode_categories(
        docs.select(
            F.col("doc_id").alias("row_id"),
            F.col("toxic").alias("label"),
            F.col("n_chars").cast("double").alias("x_chars"),
            (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("double").alias("x_spaces"),
            F.length(F.regexp_replace(text, "[^0-9]", "")).cast("double").alias("x_digits"),
            F.col("lang").alias("c_lang"),
        ),
        ["c_lang"],
    )


def vec_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 64 numeric features; label 1 marks embedding class 0."""
    raw = table(spark, sf_dir, "embeddings")
    return raw.select(
        F.col("vec_id").alias("row_id"),
        (F.col("label") == 0).cast("int").alias("label"),
        *[F.col("embedding")[i].cast("double").alias(f"x_{i:02d}") for i in range(64)],
    )


def orders24(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ORDERS)), "id int, cleaning_order string")


def order_of(key: Column) -> Column:
    """Deterministic order name for an integer key (key modulo the number of orders)."""
    names = F.array(*[F.lit(o) for o in ORDERS])
    return F.get(names, F.pmod(key, F.lit(len(ORDERS))).cast("int"))


def _classifier(flag: str) -> Column:
    return (
        F.when(F.col(flag) == "A", "logistic_regression")
        .when(F.col(flag) == "N", "random_forest")
        .otherwise("xgboost")
    )


def runs(
    spark: SparkSession, sf_dir: str, *, measure: str = "l_discount", scale: float = 5.0,
    coarse: bool = False, seeds: int = 5,
) -> DataFrame:
    """Stand-in run table: one score per dataset, classifier, seed and cleaning order.
    `coarse` cuts scores to two digits, which makes order means tie."""
    score = F.round(0.5 + scale * F.avg("_m"), 6)
    if coarse:
        score = F.floor(100 * score + 0.001) / 100
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.concat(F.lit("ds"), F.col("l_suppkey") % 10).alias("dataset"),
            _classifier("l_returnflag").alias("classifier"),
            (42 + F.col("l_orderkey") % seeds).cast("int").alias("seed"),
            order_of(F.col("l_partkey")).alias("cleaning_order"),
            F.col(measure).alias("_m"),
        )
        .groupBy("dataset", "classifier", "seed", "cleaning_order")
        .agg(score.alias("balanced_accuracy"))
        .withColumn("failed", F.lit(False))
    )


def runs_detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run table with step-log columns and some failed rows."""
    base = (
        table(spark, sf_dir, "lineitem")
        .select(
            F.concat(F.lit("ds"), F.col("l_suppkey") % 10).alias("dataset"),
            _classifier("l_returnflag").alias("classifier"),
            (42 + F.col("l_orderkey") % 5).cast("int").alias("seed"),
            order_of(F.col("l_partkey")).alias("cleaning_order"),
            "l_discount",
            "l_quantity",
            "l_linenumber",
        )
        .groupBy("dataset", "classifier", "seed", "cleaning_order")
        .agg(
            F.round(0.5 + 5 * F.avg("l_discount"), 6).alias("score"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("n_relabelled"),
            F.count("*").alias("lines"),
        )
    )
    tag = F.md5(F.concat_ws("|", "dataset", "classifier", F.col("seed").cast("string"), "cleaning_order"))
    failed = F.substring(tag, 1, 2) == "00"
    return base.select(
        "dataset",
        "classifier",
        "seed",
        "cleaning_order",
        F.when(~failed, F.col("score")).alias("balanced_accuracy"),
        failed.alias("failed"),
        "n_relabelled",
        (F.col("lines") % 4 == 0).alias("smote_skipped"),
        F.when(F.col("dataset").isin("ds0", "ds1"), 0).otherwise(F.col("lines")).alias("imputation__n_imputed"),
        F.when(F.col("classifier") == "logistic_regression", F.substring(tag, 3, 1) != "0").alias("converged"),
    )


def runs_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """504-cell run table that is complete at every scale factor."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_returnflag").alias("dataset"),
            F.lit("random_forest").alias("classifier"),
            F.col("l_linenumber").cast("int").alias("seed"),
            order_of(F.col("l_partkey")).alias("cleaning_order"),
            "l_discount",
        )
        .groupBy("dataset", "classifier", "seed", "cleaning_order")
        .agg(F.round(0.5 + 5 * F.avg("l_discount"), 6).alias("balanced_accuracy"))
        .withColumn("failed", F.lit(False))
    )


def run_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realised minority share per run-table dataset."""
    minority = F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") <= 25), 1.0).otherwise(0.0)
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.concat(F.lit("ds"), F.col("l_suppkey") % 10).alias("dataset"))
        .agg(F.avg(minority).alias("minority_share"))
    )
