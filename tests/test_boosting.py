"""Trees over packed rows: equal to Spark's own boosting, whatever the layout."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from tidyorder.operators import boosting, models

COLUMNS = ["x_a", "x_b", "x_c", "c_k"]
SCHEMA = "row_id long, label int, x_a double, x_b double, x_c double, c_k int"


def learnable(spark, n=3000, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[::3, 2] = 0.0
    y = (x[:, 0] + x[:, 1] ** 2 + 0.3 * rng.normal(size=n) > 1.2).astype(int)
    return spark.createDataFrame([(i, int(y[i]), *map(float, x[i, :3]), int(3 * x[i, 3])) for i in range(n)], SCHEMA)


def predictions(train, test, classifier, fit):
    assert models.packable(train, COLUMNS)
    return {r.row_id: r.prediction for r in models.predict(train, test, classifier, 7, fit)[0].collect()}


@pytest.mark.parametrize("n", [3000, 16_000])  # edges from all rows, from a sample
def test_boosting_equals_sparks_own(spark, n):
    df = learnable(spark, n)
    train, test = df.where("row_id % 4 > 0"), df.where("row_id % 4 = 0")
    model = boosting.boost(models.fixed_layout(train), COLUMNS, train.count(), 12, 5, 0.1, 7)
    theirs = GBTClassifier(maxIter=12, maxDepth=5, stepSize=0.1, seed=7).fit(models.fixed_layout(models.assemble(train)))
    want = {r.row_id: r.prediction for r in theirs.transform(models.assemble(test)).collect()}
    got = {r.row_id: r.prediction for r in boosting.boosted_predictions(model, test, COLUMNS).collect()}
    assert got == want and 0 < sum(got.values()) < len(got)
    assert len(set(map(tuple, model.feature))) > 1  # trees differ


def test_boosting_does_not_depend_on_the_layout(spark, monkeypatch):
    df = learnable(spark, 1500)
    one = boosting.boost(df, COLUMNS, 1500, 4, 4, 0.1, 7)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    monkeypatch.setattr(boosting, "COLLECTED", 0)
    monkeypatch.setattr(boosting, "NODES_PER_PART", 3)
    monkeypatch.setattr(boosting, "ROUNDS_PER_CHECKPOINT", 2)
    other = boosting.boost(df.repartition(5, "x_a"), COLUMNS, 1500, 4, 4, 0.1, 7)
    assert (one.feature == other.feature).all() and (one.cut == other.cut).all() and (one.value == other.value).all()


def test_one_task_and_many_grow_the_same_trees(spark, monkeypatch):
    """Also with leaves above the last level, columns of two words and copies of rows."""
    df = learnable(spark, 700)
    wide = df.union(df.where("row_id < 40")).select("row_id", "label", *[F.round(F.sin(F.col("row_id") * (k + 1)), 1).alias(f"x_{k}") for k in range(9)], "x_a", "x_c")
    columns = wide.columns[2:]
    one = boosting.boost(wide, columns, 740, 5, 7, 0.1, 7)
    monkeypatch.setattr(boosting, "ONE_TASK_CELLS", 0)
    other = boosting.boost(wide, columns, 740, 5, 7, 0.1, 7)
    assert (one.feature == other.feature).all() and (one.cut == other.cut).all() and (one.value == other.value).all()
    assert (one.feature[:, :63] < 0).any() and (one.feature >= 8).any()


def test_more_rounds_of_a_small_table_take_no_more_jobs(spark):
    df, jobs = learnable(spark, 600), []
    for rounds in (1, 6):
        spark.sparkContext.setJobGroup(f"rounds {rounds}", "boosting")
        boosting.boost(df, COLUMNS, 600, rounds, 5, 0.1, 7)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds {rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0


def test_levels_read_packed_rows_and_not_the_table(spark):
    """A fit reads its table a fixed number of times, whatever the rounds."""
    df, passed = learnable(spark, 600), spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    for rounds in (1, 5):
        before = passed.value
        boosting.boost(df.mapInArrow(through, df.schema), COLUMNS, 600, rounds, 3, 0.1, 7)
        assert passed.value - before == 2 * 600  # edges and blocks


@pytest.mark.parametrize("classifier", ["random_forest", "xgboost"])
def test_rows_with_repeated_or_missing_ids_are_learnt_from_and_scored(spark, classifier):
    df = learnable(spark, 800)
    odd = df.withColumn("row_id", F.when(F.col("row_id") % 2 == 0, F.lit(3).cast("long")))
    row = models.train_and_evaluate(odd, odd, classifier, 7, models.Fit(trees=20, depth=5, rounds=5))
    assert not row["failed"] and row["n_test"] == 800 and row["balanced_accuracy"] > 0.85


def test_more_classes_gaps_and_empty_tables_go_to_sparks_own(spark):
    df = learnable(spark, 300)
    three = df.withColumn("label", (F.col("row_id") % 3).cast("int"))
    assert not models.packable(three, COLUMNS) and not models.packable(df.where("false"), COLUMNS)
    assert not models.packable(df.withColumn("x_a", F.when(F.col("row_id") > 0, F.col("x_a"))), COLUMNS)
    assert not models.packable(df.withColumn("label", F.when(F.col("row_id") > 0, F.col("label"))), COLUMNS)
    small = models.Fit(trees=3, depth=2, rounds=2)
    assert {r.prediction for r in models.predict(three, three, "random_forest", 7, small)[0].collect()} <= {0, 1, 2}
    assert models.train_and_evaluate(three, three, "xgboost", 7, small)["failed"]
    assert models.train_and_evaluate(df.where("false"), df, "random_forest", 7, small)["failed"]


@pytest.mark.parametrize("label", [0, 1])
def test_one_class(spark, label):
    df = learnable(spark, 100).withColumn("label", F.lit(label))
    for classifier in ("random_forest", "xgboost"):
        assert set(predictions(df, df, classifier, models.Fit(trees=3, depth=3, rounds=3)).values()) == {label}


def test_wide_tables(spark):
    """More columns than one word holds."""
    df = learnable(spark, 500)
    wide = df.select("row_id", "label", *[F.sin(F.col("row_id") * (k + 1)).alias(f"x_{k}") for k in range(12)], "x_a", "x_b")
    columns = [c for c in wide.columns if c[:2] == "x_"]
    model = boosting.boost(wide, columns, 500, 6, 4, 0.1, 7)
    theirs = GBTClassifier(maxIter=6, maxDepth=4, stepSize=0.1, seed=7).fit(models.fixed_layout(models.assemble(wide)))
    want = {r.row_id: r.prediction for r in theirs.transform(models.assemble(wide)).collect()}
    assert {r.row_id: r.prediction for r in boosting.boosted_predictions(model, wide, columns).collect()} == want
