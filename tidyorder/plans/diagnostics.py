"""Grading of cleaning decisions against the injected ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyorder.operators import stats
from tidyorder.operators.balance import smote
from tidyorder.operators.impute import impute_neighbors
from tidyorder.operators.labels import correct_labels, out_of_fold, relabel, relabel_at
from tidyorder.operators.models import CLASSIFIERS, Fit, train_and_evaluate
from tidyorder.operators.outliers import remove_isolated
from tidyorder.session import materialize

# Sequence labels of the published table.
BAL_FIRST, LNR_FIRST = "IMP→BAL→LNR", "IMP→LNR"
VARIANTS = (BAL_FIRST, "IMP→LNR (SMOTE inside folds)", "IMP→LNR (class-weighted)")


def relabel_stats(observed: DataFrame, corrected: DataFrame, minority: Column | int, by: Sequence[str] = ()) -> DataFrame:
    """Grade relabelled rows. `observed` has (by, row_id, label, f_label); `corrected` has
    (by, row_id, label). Rows only in `corrected` (synthetic) do not count here."""
    joined = observed.select(*by, "row_id", F.col("label").alias("seen"), "f_label").join(
        corrected.select(*by, "row_id", F.col("label").alias("new")), [*by, "row_id"]
    )
    changed = F.col("new") != F.col("seen")
    was_minority = F.col("seen") == minority
    fixed = F.count_if(changed & F.col("f_label"))
    return joined.groupBy(*by).agg(
        F.count_if(changed).alias("relabelled"),
        fixed.alias("fixed"),
        F.count_if(changed & ~F.col("f_label")).alias("broken"),
        F.try_divide(fixed, F.count_if(changed)).alias("precision"),
        F.try_divide(fixed, F.count_if("f_label")).alias("recall"),
        F.count_if(changed & was_minority).alias("minority_to_majority"),
        F.count_if(changed & ~F.col("f_label") & was_minority).alias("true_minority_broken"),
    )


def removed_synthetic(balanced: DataFrame, kept: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Synthetic share of a balanced table and of the rows a later step removed."""
    keys = [*by, "row_id"]
    marked = balanced.select(*keys, (F.col("origin") == "syn").cast("int").alias("syn"))
    gone = marked.join(kept.select(*keys), keys, "left_anti").withColumn("gone", F.lit(1))
    both = marked.join(gone.select(*keys, "gone"), keys, "left")
    return both.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.sum("syn").alias("n_synthetic"),
        F.count("gone").alias("removed"),
        F.coalesce(F.sum(F.when(F.col("gone") == 1, F.col("syn"))), F.lit(0)).alias("removed_synthetic"),
        F.avg("syn").alias("synthetic_share_of_data"),
        F.avg(F.when(F.col("gone") == 1, F.col("syn"))).alias("synthetic_share_of_removed"),
    )


def relabel_comparison(corrupted: DataFrame, minority: int, seed: int, trees: int = 100, depth: int = 10) -> DataFrame:
    """Label correction with and without balancing before it, graded against `f_label`."""
    truth = corrupted.select("row_id", "label", "f_label")
    features = corrupted.drop("f_label", "f_missing", "f_outlier")
    imputed = materialize(impute_neighbors(features))
    plain = correct_labels(imputed, seed, trees=trees, depth=depth)
    balanced = materialize(smote(imputed, seed))
    after = materialize(correct_labels(balanced, seed, trees=trees, depth=depth))
    synthetic = after.where(F.col("origin") == "syn").join(
        balanced.select("row_id", F.col("label").alias("given")), "row_id"
    ).agg(F.count_if(F.col("label") != F.col("given")).alias("synthetic_relabelled"))
    first = relabel_stats(truth, plain, minority).withColumn("sequence", F.lit(LNR_FIRST)).withColumn(
        "synthetic_relabelled", F.lit(0).cast("bigint")
    )
    second = relabel_stats(truth, after, minority).withColumn("sequence", F.lit(BAL_FIRST)).crossJoin(synthetic)
    return first.unionByName(second)


def outliers_after_balancing(corrupted: DataFrame, seed: int, trees: int = 100) -> DataFrame:
    """What outlier removal takes from a balanced table."""
    features = corrupted.drop("f_label", "f_missing", "f_outlier")
    balanced = materialize(smote(impute_neighbors(features), seed))
    return removed_synthetic(balanced, remove_isolated(balanced, seed, trees))


def diagnostic_means(relabels: DataFrame) -> DataFrame:
    """Means over seeds per dataset and sequence, rounded to 3 digits."""
    measures = ["relabelled", "fixed", "broken", "precision", "recall", "true_minority_broken"]
    return relabels.groupBy("dataset", "sequence").agg(*[F.round(F.avg(m), 3).alias(m) for m in measures])


def mechanism_runs(imputed: DataFrame, truth: DataFrame, minority: int, seed: int, trees: int = 100, depth: int = 10) -> DataFrame:
    """The correction variants without fold dependence, graded against the truth."""
    parts = []
    for mode, name in (("plain", LNR_FIRST), ("fold_smote", VARIANTS[1]), ("weighted", VARIANTS[2])):
        new = correct_labels(imputed, seed, mode, trees, depth)
        parts.append(relabel_stats(truth, new, minority).withColumn("sequence", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("sequence", "relabelled", "fixed", "broken", "precision")


def precision_by_dataset(relabels: DataFrame, sequences: Sequence[str]) -> DataFrame:
    """Datasets by sequences: mean precision, columns `precision_<i>` in the given order."""
    wide = relabels.groupBy("dataset").pivot("sequence", list(sequences)).agg(F.avg("precision"))
    return wide.select("dataset", *[F.col(f"`{s}`").alias(f"precision_{i}") for i, s in enumerate(sequences)])


def precision_rises(relabels: DataFrame, base: str, others: Sequence[str]) -> DataFrame:
    """Per variant: datasets whose mean precision is above the base sequence's."""
    means = relabels.groupBy("dataset", "sequence").agg(F.round(F.avg("precision"), 12).alias("p"))
    reference = means.where(F.col("sequence") == base).select("dataset", F.col("p").alias("base"))
    return means.where(F.col("sequence").isin(list(others))).join(reference, "dataset").groupBy("sequence").agg(
        F.count_if(F.col("p") > F.col("base")).alias("datasets_higher"), F.count("*").alias("n_datasets")
    )


def threshold_precision(probs: DataFrame, truth: DataFrame, thresholds: Sequence[float], minority: int) -> DataFrame:
    """Relabel precision at every threshold from one probability table."""
    each = relabel_at(probs, list(thresholds)).select("threshold", "row_id", F.col("new_label").alias("label"))
    seen = truth.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return relabel_stats(seen, each, minority, by=["threshold"])


def threshold_sweep(
    imputed: DataFrame, truth: DataFrame, test: DataFrame, minority: int, seed: int,
    thresholds: Sequence[float] = (0.6, 0.7, 0.8, 0.9), classifiers: Sequence[str] = CLASSIFIERS, fit: Fit = Fit(),
) -> tuple[DataFrame, list[dict[str, object]]]:
    """Precision per threshold before and after balancing, and end-to-end scores. The
    out-of-fold probabilities are computed once per input and shared by all thresholds. A fit
    that fails stops the sweep: a row without its score would pass for a result."""

    def score(cleaned: DataFrame, classifier: str, run: str) -> float | None:
        result = train_and_evaluate(cleaned, test, classifier, seed, fit)
        if result["failed"]:
            raise RuntimeError(f"{classifier} failed at {run}: {result['error']}")
        return result["balanced_accuracy"]

    balanced = materialize(smote(imputed, seed))
    first = out_of_fold(imputed, seed, trees=fit.trees, depth=fit.depth)
    after = out_of_fold(balanced, seed, trees=fit.trees, depth=fit.depth)
    precision = threshold_precision(first, truth, thresholds, minority).select(
        "threshold", F.col("precision").alias("precision_lnr_first")
    ).join(
        threshold_precision(after, truth, thresholds, minority).select(
            "threshold", F.col("precision").alias("precision_bal_first")
        ),
        "threshold",
    )
    scores = []
    for t in thresholds:
        sides = {}
        for name, base, probs in (("lnr_first", imputed, first), ("bal_first", balanced, after)):
            new = relabel(probs, t).select("row_id", "new_label")
            cleaned = base.join(new, "row_id").withColumn("label", F.col("new_label")).drop("new_label")
            if name == "lnr_first":
                cleaned = smote(materialize(cleaned), seed)
            sides[name] = materialize(remove_isolated(materialize(cleaned), seed, fit.trees))
        for c in classifiers:
            scores.append({
                "threshold": t, "classifier": c,
                **{n: score(d, c, f"threshold {t}, {n}") for n, d in sides.items()},
            })
    return precision, scores


def threshold_medians(precision: DataFrame) -> DataFrame:
    """Per threshold: median dataset precision both ways and datasets improved by balancing first."""
    means = precision.groupBy("threshold", "dataset").agg(
        F.round(F.avg("precision_lnr_first"), 12).alias("lnr"), F.round(F.avg("precision_bal_first"), 12).alias("bal")
    )
    return means.groupBy("threshold").agg(  # one value per dataset
        F.median("lnr").alias("median_lnr_first"),
        F.median("bal").alias("median_bal_first"),
        F.count_if(F.col("bal") > F.col("lnr")).alias("datasets_higher"),
        F.count("*").alias("n_datasets"),
    )


def threshold_effects(scores: DataFrame) -> DataFrame:
    """Effect of balancing first per (threshold, classifier), one difference per dataset."""
    diffs = scores.groupBy("threshold", "classifier", "dataset").agg(
        F.round(100 * (F.avg("bal_first") - F.avg("lnr_first")), 9).alias("diff_pp")
    )
    return stats.effect_report(diffs, ["threshold", "classifier"], "diff_pp")


def fold_safe_scores(
    imputed: DataFrame, test: DataFrame, seed: int, classifiers: Sequence[str] = CLASSIFIERS, fit: Fit = Fit()
) -> list[dict[str, object]]:
    """End-to-end scores of four ways to order and fit label correction.

    A balance, correct, drop outliers; B correct, balance, drop outliers; C as B with
    oversampling inside the correction folds; D as B with class weights.
    """
    tables = {}
    balanced = materialize(smote(imputed, seed))
    tables["A_bal_first"] = correct_labels(balanced, seed, trees=fit.trees, depth=fit.depth)
    for name, mode in (("B_lnr_first", "plain"), ("C_foldsmote", "fold_smote"), ("D_weighted", "weighted")):
        corrected = materialize(correct_labels(imputed, seed, mode, fit.trees, fit.depth))
        tables[name] = smote(corrected, seed)
    cleaned = {n: materialize(remove_isolated(materialize(t), seed, fit.trees)) for n, t in tables.items()}
    return [
        {"classifier": c, **{n: train_and_evaluate(t, test, c, seed, fit)["balanced_accuracy"] for n, t in cleaned.items()}}
        for c in classifiers
    ]


GAINS = ("A_bal_first", "C_foldsmote", "D_weighted")


def fold_safe_gains(scores: DataFrame) -> DataFrame:
    """Gain over B in pp per (classifier, dataset, variant), averaged over seeds."""
    means = scores.groupBy("classifier", "dataset").agg(
        *[F.avg(c).alias(c) for c in (*GAINS, "B_lnr_first")]
    )
    stacked = ", ".join(f"'{g}', round(100 * ({g} - B_lnr_first), 9)" for g in GAINS)
    return means.select("classifier", "dataset", F.expr(f"stack({len(GAINS)}, {stacked}) as (variant, gain_pp)"))


def fold_safe_summary(scores: DataFrame) -> DataFrame:
    """Per (classifier, variant): datasets improved, median gain, signed-rank p."""
    gains = fold_safe_gains(scores)
    by = ["classifier", "variant"]
    base = gains.groupBy(*by).agg(
        F.count_if(F.col("gain_pp") > 0).alias("better"),
        F.count("*").alias("n_datasets"),
        F.median("gain_pp").alias("median_pp"),  # one value per dataset
    )
    return base.join(stats.wilcoxon(gains, by, "gain_pp").select(*by, "p"), by)


def gain_correlation(scores: DataFrame) -> DataFrame:
    """Rank correlation of the balancing-first gain with the fold-safe gain over all pairs."""
    wide = fold_safe_gains(scores).groupBy("classifier", "dataset").pivot("variant", list(GAINS)).agg(F.first("gain_pp"))
    return stats.spearman(wide, [], "A_bal_first", "C_foldsmote")
