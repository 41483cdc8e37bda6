"""Classifiers and evaluation on Spark ML, boosted trees over packed rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyorder.operators.boosting import boost, boosted_predictions
from tidyorder.operators.impute import apply_fill, apply_scaling, fit_fill, fit_standard
from tidyorder.session import materialize
from tidyorder.sources.loaders import feature_columns

CLASSIFIERS = ("random_forest", "logistic_regression", "xgboost")
TREES = 100
DEPTH = 10
ROUNDS = 100
STEP = 0.1
ROWS_PER_TASK = 100_000
LEAST_TASKS = 16


def assemble(df: DataFrame, weight: str | None = None) -> DataFrame:
    """(row_id, label, features[, weight]) with all x_* and c_* columns in one vector."""
    num, cat = feature_columns(df)
    doubles = df.select(
        "row_id", F.col("label").cast("double").alias("label"), *num,
        *[F.col(c).cast("double").alias(c) for c in cat], *([weight] if weight else []),
    )
    built = VectorAssembler(inputCols=num + cat, outputCol="features").transform(doubles)
    return built.select("row_id", "label", "features", *([weight] if weight else []))


def fixed_layout(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Same rows in the same partitions and order on every run: tree learners sample per
    partition. The partition count follows from the number of rows alone, at most
    `rows_per_task` each on average and LEAST_TASKS at least, never from the cluster, so a
    table gives the same fit everywhere and a task stays bounded."""
    partitions = max(LEAST_TASKS, math.ceil(df.count() / rows_per_task))
    return df.repartition(partitions, "row_id").sortWithinPartitions("row_id")


def forest(seed: int, trees: int = TREES, depth: int = DEPTH, weight: str | None = None) -> RandomForestClassifier:
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)
    return model.setWeightCol(weight) if weight else model


def probabilities(model, assembled: DataFrame) -> DataFrame:
    """(row_id, label, p0, p1)."""
    p = vector_to_array("probability")
    return model.transform(assembled).select(
        "row_id", F.col("label").cast("int").alias("label"), p[0].alias("p0"), p[1].alias("p1")
    )


def null_indicators(df: DataFrame, params: DataFrame, flagged: list[str]) -> DataFrame:
    """Fill NULLs and add 0/1 columns saying where they were: the tree learners here have
    no missing-value split."""
    if not flagged:
        return apply_fill(df, params)
    marks = [F.col(c).isNull().cast("double").alias(f"x_gap_{c}") for c in flagged]
    return apply_fill(df, params).join(df.select("row_id", *marks), "row_id")


def balanced_accuracy(predicted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean over classes of the share of rows predicted right; one pass, pure aggregation."""
    by = by or []
    hit = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    per_class = predicted.groupBy(*by, "label").agg(hit.alias("recall"))
    return per_class.groupBy(*by).agg(F.avg("recall").alias("balanced_accuracy"))


@dataclass(frozen=True)
class Fit:
    """Sizes of the learners; defaults are the study's fixed hyperparameters. rows_per_task:
    mean rows of a task of a fit, see `fixed_layout`."""

    trees: int = TREES
    depth: int = DEPTH
    rounds: int = ROUNDS
    rows_per_task: int = ROWS_PER_TASK


def packable(train: DataFrame, columns: list[str]) -> bool:
    """Whether a learner over packed rows can be trained on a table: it has rows, no gaps, and labels
    of 0 and 1 only. Spark's own says what is wrong with the rest."""
    if not columns:
        return False
    gap = F.lit(False)
    for c in columns:
        x = F.col(c).cast("double")
        gap = gap | x.isNull() | F.isnan(x)
    fine = F.coalesce(F.col("label").cast("int").isin(0, 1), F.lit(False)) & ~gap
    row = train.agg(F.count("*").alias("n"), F.count_if(fine).alias("fine")).first()
    return row["n"] > 0 and row["n"] == row["fine"]


def predict(train: DataFrame, test: DataFrame, classifier: str, seed: int, fit: Fit = Fit()) -> tuple[DataFrame, bool]:
    """(row_id, label, prediction) on the test table, and whether the fit converged."""
    num, cat = feature_columns(train)
    if classifier == "logistic_regression":
        params = materialize(fit_standard(train, num + cat))
        as_double = [F.col(c).cast("double").alias(c) for c in num + cat]
        train, test = (
            apply_scaling(t.select("row_id", "label", *as_double), params, num + cat) for t in (train, test)
        )
        n = train.count()
        # L2 penalty with C = 1 on the summed loss equals 1/n on Spark's mean loss
        learner = LogisticRegression(maxIter=1000, regParam=1.0 / n, elasticNetParam=0.0, standardization=False)
    elif classifier == "random_forest":
        learner = forest(seed, fit.trees, fit.depth)
    elif classifier == "xgboost":
        if packable(train, num + cat):
            n = train.count()
            sampled = fixed_layout(train.select("row_id", "label", *num, *cat), fit.rows_per_task)
            return boosted_predictions(boost(sampled, num + cat, n, fit.rounds, fit.depth, STEP, seed), test, num + cat), True
        learner = GBTClassifier(maxIter=fit.rounds, maxDepth=fit.depth, stepSize=STEP, seed=seed)
    else:
        raise ValueError(f"unknown model {classifier!r}; valid: {CLASSIFIERS}")
    model = learner.fit(fixed_layout(assemble(train), fit.rows_per_task))
    converged = True
    if classifier == "logistic_regression":
        converged = model.summary.totalIterations < learner.getMaxIter()
    scored = model.transform(assemble(test)).select(
        "row_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")
    )
    return scored, converged


def with_null_support(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model-boundary treatment of NULLs: sequences without imputation leave them in the
    training part, and the test part is never cleaned. Fills come from the training part;
    indicators are added for columns with training gaps."""
    num, cat = feature_columns(train)

    def gaps(df: DataFrame) -> set[str]:
        row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in num + cat]).first()
        return {c for c in num + cat if row[c]}

    in_train, in_test = gaps(train), gaps(test)
    if not in_train and not in_test:
        return train, test
    params = materialize(fit_fill(train))
    flagged = [c for c in num + cat if c in in_train]
    return tuple(
        materialize(null_indicators(t.select("row_id", "label", *num, *cat), params, flagged))
        for t in (train, test)
    )


def train_and_evaluate(
    train: DataFrame, test: DataFrame, classifier: str, seed: int, fit: Fit = Fit()
) -> dict[str, object]:
    """One result row. A failing fit is recorded, not raised, so one run cannot stop a grid."""
    counts = {"n_train": train.count(), "n_test": test.count()}
    try:
        filled_train, filled_test = with_null_support(train, test)
        scored, converged = predict(filled_train, filled_test, classifier, seed, fit)
        score = balanced_accuracy(scored).first()["balanced_accuracy"]
        return {**counts, "balanced_accuracy": score, "converged": converged, "failed": False, "error": None}
    except Exception as problem:  # noqa: BLE001 - any learner failure becomes a row
        return {
            **counts, "balanced_accuracy": None, "converged": None, "failed": True, "error": str(problem),
        }


def eligible(order: Column, classifier: Column) -> Column:
    """Logistic regression needs imputation in the order; the tree models do not."""
    return F.contains(order, F.lit("IMP")) | (classifier != "logistic_regression")
