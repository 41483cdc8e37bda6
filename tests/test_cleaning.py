"""Faults, cleaning steps, sequences and models: counts, rules and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyorder.functions import steps as st
from tidyorder.operators import balance, faults, impute, labels, models, outliers, sampling
from tidyorder.plans import diagnostics, grid, sequence
from tidyorder.session import materialize
from tidyorder.sources import loaders
from tidyorder.sources.tables import order_features

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base(spark):
    return materialize(order_features(spark, FOLDER))


def test_draws_do_not_depend_on_partitioning(spark, base):
    a = sampling.mark_exact_k(base, "row_id", 7, F.lit(101)).where("hit").select("row_id")
    b = sampling.mark_exact_k(base.repartition(13), "row_id", 7, F.lit(101)).where("hit").select("row_id")
    assert a.count() == 101 and a.exceptAll(b).count() == 0


def test_more_than_all_and_none(base):
    assert sampling.mark_exact_k(base, "row_id", 7, F.lit(10**9)).where("hit").count() == base.count()
    assert sampling.mark_exact_k(base, "row_id", 7, F.lit(0)).where("hit").count() == 0


def test_label_noise_counts(base):
    n, n1 = base.count(), base.where("label = 1").count()
    flipped = faults.flip_labels(base, 42)
    total, k_min = int(n * 0.15), int(int(n * 0.15) * 0.7)
    assert flipped.where("f_label").count() == total
    assert flipped.where("f_label and label = 0").count() == k_min
    anchored = faults.flip_labels(base, 42, faults.LabelNoise(kind="minority_anchored"))
    assert anchored.where("f_label").count() == 2 * int(n1 * 0.15)
    with pytest.raises(ValueError, match="noise kind"):
        faults.flip_labels(base, 42, faults.LabelNoise(kind="other"))
    with pytest.raises(ValueError, match="mechanism"):
        faults.drop_cells(base, 42, faults.Missing(mechanism="other"))


def test_outliers_refill_missing_cells(base):
    hurt = materialize(faults.inject(base, 42))
    num, _ = loaders.feature_columns(base)
    moved = hurt.where("f_outlier")
    assert moved.count() == int(base.count() * 0.05)
    assert moved.where(" or ".join(f"{c} is null" for c in num)).count() == 0
    assert moved.where(F.size("f_missing") > 0).count() > 0


def test_empty_column_fills_with_zero(spark):
    df = spark.createDataFrame([(1, 0, None, None), (2, 1, None, 3)], "row_id bigint, label int, x_a double, c_b int")
    assert [tuple(r) for r in impute.fill(df).orderBy("row_id").collect()] == [(1, 0, 0.0, 3), (2, 1, 0.0, 3)]


def test_isolation_forest_share_and_repeatability(base):
    kept = outliers.remove_isolated(base, 42, trees=20)
    again = outliers.remove_isolated(base.repartition(5), 42, trees=20)
    assert kept.count() == base.count() - base.count() // 20
    assert kept.select("row_id").exceptAll(again.select("row_id")).count() == 0


def test_isolation_forest_finds_planted_points(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(1000 + i, 9.0 + i, -9.0) for i in range(4)]
    df = materialize(spark.createDataFrame(rows, "row_id bigint, x_a double, x_b double"))
    top = outliers.isolation_scores(df, 1, trees=50).orderBy(F.desc("score")).limit(4)
    assert {r["row_id"] for r in top.collect()} == {1000, 1001, 1002, 1003}


def test_synthetic_rows(base):
    grown = materialize(balance.smote(base, 42))
    n1, n0 = base.where("label = 1").count(), base.where("label = 0").count()
    new = grown.where("origin = 'syn'")
    assert new.count() == int(n0 * 0.8 - n1)
    assert grown.where("origin = 'orig'").drop("origin").exceptAll(base).count() == 0
    low, high = base.where("label = 1").agg(F.min("x_total"), F.max("x_total")).first()
    assert new.where(~F.col("x_total").between(low, high)).count() == 0
    assert balance.smote(grown.drop("origin"), 42).where("origin = 'syn'").count() == 0
    assert balance.balance_plan(base.where("label = 0")).reason == "single_class"


def test_relabel_rule(spark):
    rows = [(1, 0, 0.3, 0.7), (2, 0, 0.31, 0.69), (3, 1, 0.5, 0.5), (4, 1, 0.9, 0.1)]
    probs = spark.createDataFrame(rows, "row_id bigint, label int, p0 double, p1 double")
    assert [r["new_label"] for r in labels.relabel(probs).orderBy("row_id").collect()] == [1, 0, 1, 0]


def test_correction_repeats_and_equals_its_parts(base):
    filled = materialize(impute.fill(base))
    whole = labels.correct_labels(filled, 42, trees=5, depth=4).select("row_id", "label")
    probs = labels.out_of_fold(filled.repartition(7), 42, trees=5, depth=4)
    parts = labels.relabel(probs).select("row_id", F.col("new_label").alias("label"))
    assert whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0


def test_edited_neighbors_never_wipe_out_a_class(spark):
    rows = [(i, 1 if i == 2 else 0, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "row_id bigint, label int, x_a double")
    assert labels.edit_neighbors(df).count() == 5


def test_sequence_rejects_unknown_steps(base):
    with pytest.raises(ValueError, match="unknown operation"):
        sequence.apply_sequence(base, ["XYZ"], 42)


def test_orders_share_prefixes(base, monkeypatch):
    calls = []

    def step(df, seed, methods, code):
        calls.append(code)
        if len(calls) == 64:
            raise RuntimeError("broken step")
        return sequence.StepResult(df, {})

    for code in sequence.STEPS:
        monkeypatch.setitem(sequence.STEPS, code, lambda d, s, m, c=code: step(d, s, m, c))
    import itertools

    orders = list(itertools.permutations(st.STEP_CODES))
    seen = list(sequence.walk_orders(base, orders, 42))
    assert len(calls) == 64 and len({o for o, *_ in seen}) == 24
    assert [bool(error) for *_, error in seen].count(True) == 1


def test_published_run_count(spark):
    grid_rows = grid.expected_rows(grid.task_grid(spark)).collect()
    assert sum(r["n_runs"] for r in grid_rows) == 41_185


def test_run_grid_end_to_end(spark, base):
    runs = grid.run_condition(
        base, "orders", "methods_b", orders=[(), ("IMP", "BAL"), ("BAL",)], seeds=[42], code_id="t",
        classifiers=["random_forest", "logistic_regression"], fit=models.Fit(trees=3, depth=3),
    )
    rows = runs.collect()
    assert len(rows) == 4 and not any(r["failed"] for r in rows)
    by_order = {(r["cleaning_order"], r["classifier"]): r for r in rows}
    assert by_order[("IMP→BAL", "random_forest")]["imputation__n_imputed"] > 0
    assert by_order[("NONE", "random_forest")]["n_relabelled"] is None


def test_orders_as_columns(spark):
    row = spark.createDataFrame([("IMP→BAL→LNR→OUT",)], "o string").select(
        st.swap("o", "LNR", "BAL").alias("s"), st.before("o", "LNR", "BAL").alias("b"), st.without("o", "IMP").alias("w"), st.n_steps("o").alias("n")
    ).first()
    assert tuple(row) == ("IMP→LNR→BAL→OUT", False, "BAL→LNR→OUT", 4)


def test_sources_and_registry(spark, tmp_path):
    (tmp_path / "p.csv").write_text("6,148,1\n1,85,0\n")
    assert not loaders.csv_has_header(spark, str(tmp_path / "p.csv"))
    assert loaders.read_numeric_csv(spark, str(tmp_path / "p.csv")).columns == ["x_c0", "x_c1", "label"]
    with pytest.raises(ValueError, match="unknown dataset"):
        loaders.Registry().load("nope", spark, "")
    with pytest.raises(KeyError, match="nominal"):
        loaders.nominal_columns(spark.range(1), ["SEX"])
    with pytest.raises(ValueError, match="binary"):
        loaders.require_binary(spark.createDataFrame([(0,), (1,), (2,)], "label int"))
    nulls = loaders.nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"))
    assert nulls.where("x is null").count() == 1


def test_failed_fit_is_a_row(base):
    row = models.train_and_evaluate(base, base, "no_such_model", 1)
    assert row["failed"] and row["balanced_accuracy"] is None


def test_failed_fit_stops_the_threshold_sweep(spark):
    rows = materialize(spark.range(120).select(
        F.col("id").alias("row_id"), (F.col("id") % 4 == 0).cast("int").alias("label"), F.rand(3).alias("x_a"), (F.col("id") % 4 + F.rand(5)).alias("x_b")))
    truth = rows.select("row_id", "label", (F.col("row_id") % 9 == 0).alias("f_label"))
    sweep = lambda names: diagnostics.threshold_sweep(rows, truth, rows, 1, 7, (0.6,), names, models.Fit(trees=2, depth=2, rounds=2))
    with pytest.raises(RuntimeError, match="no_such_model failed at threshold 0.6, lnr_first: unknown model"):
        sweep(["no_such_model"])
    (row,) = sweep(["logistic_regression"])[1]
    assert row["threshold"] == 0.6 and 0 <= row["lnr_first"] <= 1 and 0 <= row["bal_first"] <= 1


def test_random_gaps_in_many_columns_plan_quickly_and_exactly(spark):
    names = [f"x_{k}" for k in range(128)]
    wide = spark.range(40).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"), *[F.rand(k).alias(n) for k, n in enumerate(names)])
    out = faults.drop_cells(wide, 7, faults.Missing(mechanism="MCAR", rate=0.25))
    affected = faults.affected_features(names, 7)
    row = out.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names], F.sum(F.size("f_missing")).alias("all")).first()
    assert len(affected) == 64 and all(row[n] == (10 if n in affected else 0) for n in names) and row["all"] == 640
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") <= 4


def test_steps_that_are_not_in_an_order(spark):
    row = spark.createDataFrame([("IMP→OUT", "IMP")], "o string, one string").select(
        st.before("o", "LNR", "OUT").alias("a"), st.before("o", "IMP", "LNR").alias("b"), st.before("o", "IMP", "OUT").alias("c"), st.without("one", "IMP").alias("w")
    ).first()
    assert (row.a, row.b, row.c, row.w) == (None, None, True, st.EMPTY_ORDER)


def test_close_large_values_spread_over_many_buckets(spark):
    from tidyorder.functions.ordering import _bucketed, quantiles

    times = spark.range(20_000).select((F.col("id") * 17.0 + 1_700_000_000.0).alias("v"))
    assert _bucketed(times, "v").select("_bucket").distinct().count() > 15_000
    assert quantiles(times, ["v"], [0.5]).first()["q_v"][0] == 1_700_000_000.0 + 17.0 * 9999.5
    one = spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")
    assert quantiles(one, ["v"], [0.25]).first()["q_v"][0] == 3.0
    mixed = spark.createDataFrame([(float(v),) for v in (-1e300, -2.0, 0.0, 1e-300, 5.0)], "v double")
    assert [r.v for r in _bucketed(mixed, "v").orderBy("_bucket", "v").collect()] == [-1e300, -2.0, 0.0, 1e-300, 5.0]
