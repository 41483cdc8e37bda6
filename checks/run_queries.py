"""Queries over run tables: statistics and analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sqlparts as sp
from checks.registry import query, round_sql, rounded
from checks.sqlparts import AUDIT, COARSE, DETAILED, ORDERS24, RUNS, with_
from tidyorder.functions import steps as st
from tidyorder.operators import stats
from tidyorder.plans import analysis, diagnostics, grid
from tidyorder.session import materialize
from tidyorder.sources import tables as t

BY = "dataset, classifier"
PAIR = ["dataset", "classifier"]
DRAWS = 1000
OSI_EXPR = "CASE WHEN best_mean > 0 THEN (best_mean - worst_mean) / best_mean ELSE 0.0 END"


def _runs(spark: SparkSession, d: str, **kw) -> DataFrame:
    return materialize(t.runs(spark, d, **kw))


# ------------------------------------------------------------------ order sensitivity
@query("st01_order_sensitivity", with_(ORDERS24, RUNS, sp.osi("runs"), f"SELECT {BY}, round({OSI_EXPR}, 8) AS osi FROM osi"))
def _st01(spark, d):
    return rounded(stats.osi_summary(t.runs(spark, d)).select(*PAIR, "osi"))


@query("st02_order_sensitivity_summary", with_(
    ORDERS24, DETAILED, "ok AS (SELECT * FROM detailed WHERE NOT failed)", sp.osi("ok"),
    f"""SELECT {BY}, n_orderings, best_order, round(best_mean, 8) AS best_mean, worst_order, round(worst_mean, 8) AS worst_mean,
    round({OSI_EXPR} * 100, 8) AS osi_pct, round(100 * (best_mean - worst_mean), 8) AS gap_pp FROM osi"""))
def _st02(spark, d):
    out = stats.osi_summary(t.runs_detailed(spark, d))
    return rounded(out.select(*PAIR, "n_orderings", "best_order", "best_mean", "worst_order", "worst_mean", "osi_pct", "gap_pp"))


@query("st02_order_sensitivity_ties", with_(
    ORDERS24, sp.runs(coarse=True), sp.osi("runs"),
    f"SELECT {BY}, best_order, worst_order, round({OSI_EXPR}, 8) AS osi FROM osi"))
def _st02_ties(spark, d):
    return rounded(stats.osi_summary(t.runs(spark, d, coarse=True)).select(*PAIR, "best_order", "worst_order", "osi"))


_DIFFS = f"""diffs AS (SELECT b.{', b.'.join(['dataset', 'classifier', 'seed'])}, b.balanced_accuracy - w.balanced_accuracy AS diff
  FROM osi JOIN complete b ON b.dataset = osi.dataset AND b.classifier = osi.classifier AND b.cleaning_order = best_order
  JOIN complete w ON w.dataset = b.dataset AND w.classifier = b.classifier AND w.seed = b.seed AND w.cleaning_order = worst_order)"""
_T = """tt AS (SELECT dataset, classifier, count(*) AS n, avg(diff) AS mean_diff, stddev_samp(diff) AS sd FROM diffs GROUP BY 1, 2)"""


def _best_worst_diffs(spark, d):
    ok = materialize(analysis.complete_groups(_runs(spark, d)))
    ends = stats.osi_summary(ok).select(*PAIR, "best_order", "worst_order")
    chosen = ok.join(ends, PAIR)
    return ok, stats.paired_differences(
        chosen.where("cleaning_order = best_order"), chosen.where("cleaning_order = worst_order"),
        [*PAIR, "seed"], "balanced_accuracy",
    )


@query("st03_paired_t_test", with_(
    ORDERS24, RUNS, sp.complete(), sp.osi("complete"), _DIFFS, _T,
    f"SELECT {BY}, n, round(mean_diff, 8) AS mean_diff, round(mean_diff / (sd / sqrt(n)), 6) AS t, round(mean_diff / sd, 6) AS cohens_d FROM tt"))
def _st03(spark, d):
    _, diffs = _best_worst_diffs(spark, d)
    out = stats.t_test(diffs, PAIR, "diff")
    return out.select(*PAIR, "n", F.round("mean_diff", 8).alias("mean_diff"), F.round("t", 6).alias("t"), F.round("cohens_d", 6).alias("cohens_d"))


@query("st03_paired_t_test_p")
def _st03_p(spark, d):
    _, diffs = _best_worst_diffs(spark, d)
    return rounded(stats.t_test(diffs, PAIR, "diff").select(*PAIR, "t", "p"))


_PAIRS = f"""pairs AS (SELECT l.dataset, l.classifier, l.seed, l.cleaning_order,
    l.balanced_accuracy - b.balanced_accuracy AS diff FROM complete l JOIN complete b
    ON l.dataset = b.dataset AND l.classifier = b.classifier AND l.seed = b.seed AND b.cleaning_order = {sp.swapped('l.cleaning_order')}
  WHERE {sp.pos('l.cleaning_order', 'LNR')} < {sp.pos('l.cleaning_order', 'BAL')})"""
_SEED_MEANS = f"seed_means AS (SELECT {BY}, seed, avg(diff) AS d FROM pairs GROUP BY 1, 2, 3)"


@query("st04_one_sample_t_test", with_(
    ORDERS24, RUNS, sp.complete(), _PAIRS, _SEED_MEANS,
    f"""SELECT {BY}, count(*) AS n, round(avg(d), 8) AS mean_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t
    FROM seed_means GROUP BY 1, 2"""))
def _st04(spark, d):
    pairs = analysis.order_pairs(analysis.complete_groups(_runs(spark, d)))
    means = pairs.groupBy(*PAIR, "seed").agg(F.avg(F.col("balanced_accuracy_lnr") - F.col("balanced_accuracy_bal")).alias("d"))
    out = stats.t_test(means, PAIR, "d")
    return out.select(*PAIR, "n", F.round("mean_diff", 8).alias("mean_diff"), F.round("t", 6).alias("t"))


@query("st05_cliffs_delta", with_(
    ORDERS24, RUNS, """sides AS (SELECT dataset, classifier, balanced_accuracy AS v, cleaning_order LIKE 'IMP%' AS a FROM runs)""",
    f"""SELECT x.dataset, x.classifier, round(avg(CASE WHEN x.v > y.v THEN 1.0 WHEN x.v < y.v THEN -1.0 ELSE 0.0 END), 8) AS cliffs_delta
    FROM sides x JOIN sides y ON x.dataset = y.dataset AND x.classifier = y.classifier AND x.a AND NOT y.a GROUP BY 1, 2"""))
def _st05(spark, d):
    return rounded(stats.cliffs_delta(t.runs(spark, d), PAIR, "balanced_accuracy", F.col("cleaning_order").startswith("IMP")))


_PVALS = sp.permutation("complete", 200)


def _p_values(spark, d):
    return materialize(stats.permutation_test(analysis.complete_groups(_runs(spark, d)), PAIR, 200).select(*PAIR, "p_osi"))


@query("st06_false_discovery_rate", with_(
    ORDERS24, RUNS, sp.complete(), _PVALS, sp.bh("perm", "p_osi", "p_bh", "adj"),
    f"SELECT {BY}, round(p_osi, 8) AS p_osi, round(p_bh, 8) AS p_bh FROM adj"))
def _st06(spark, d):
    return rounded(stats.benjamini_hochberg(_p_values(spark, d), "p_osi"))


@query("st06_false_discovery_rate_null_as_one", with_(
    ORDERS24, RUNS, sp.complete(), _PVALS,
    "gappy AS (SELECT dataset, classifier, coalesce(CASE WHEN classifier <> 'xgboost' THEN p_osi END, 1.0) AS q, CASE WHEN classifier <> 'xgboost' THEN p_osi END AS p FROM perm)",
    sp.bh("gappy", "q", "p_bh", "adj"), f"SELECT {BY}, round(p, 8) AS p, round(p_bh, 8) AS p_bh FROM adj"))
def _st06_null(spark, d):
    gappy = _p_values(spark, d).select(*PAIR, F.when(F.col("classifier") != "xgboost", F.col("p_osi")).alias("p"))
    return rounded(stats.benjamini_hochberg(gappy, "p", null_as_one=True))


@query("st07_step_down_adjustment", with_(
    ORDERS24, RUNS, sp.complete(), _PVALS, sp.holm("perm", "p_osi", "p_holm", "adj"),
    f"SELECT {BY}, round(p_osi, 8) AS p_osi, round(p_holm, 8) AS p_holm FROM adj"))
def _st07(spark, d):
    return rounded(stats.holm(_p_values(spark, d), "p_osi"))


@query("st08_bootstrap_interval", with_(
    ORDERS24, RUNS, sp.complete(), sp.resampled("complete", 200),
    f"each_boot AS (SELECT {BY}, boot, max(m) AS hi, min(m) AS lo FROM (SELECT {BY}, boot, cleaning_order, avg(balanced_accuracy) AS m FROM boot GROUP BY ALL) GROUP BY 1, 2, 3)",
    f"SELECT {BY}, round(quantile_cont((hi - lo) / hi, 0.025), 8) AS ci_lo, round(quantile_cont((hi - lo) / hi, 0.975), 8) AS ci_hi FROM each_boot GROUP BY 1, 2"))
def _st08(spark, d):
    ok = materialize(analysis.complete_groups(_runs(spark, d)))
    return rounded(stats.bootstrap_osi(ok, PAIR, 200))


@query("st09_permutation_test", with_(
    ORDERS24, RUNS, sp.complete(), sp.permutation("complete", DRAWS),
    f"SELECT {BY}, round(osi, 8) AS osi, round(osi_null, 8) AS osi_null, round(p_osi, 8) AS p_osi FROM perm"))
def _st09(spark, d):
    out = stats.permutation_test(analysis.complete_groups(_runs(spark, d)), PAIR, DRAWS)
    return rounded(out.select(*PAIR, "osi", "osi_null", "p_osi"))


@query("st09_permutation_test_coarse", with_(
    ORDERS24, COARSE, sp.permutation("coarse", DRAWS),
    f"SELECT {BY}, round(osi, 8) AS osi, round(osi_null, 8) AS osi_null, round(p_osi, 8) AS p_osi FROM perm"))
def _st09_coarse(spark, d):
    return rounded(stats.permutation_test(t.runs_coarse(spark, d), PAIR, DRAWS).select(*PAIR, "osi", "osi_null", "p_osi"))


@query("st10_permutation_test_of_gap", with_(
    ORDERS24, RUNS, sp.complete(), sp.permutation("complete", DRAWS), f"SELECT {BY}, round(gap, 8) AS gap, round(p_gap, 8) AS p_gap FROM perm"))
def _st10(spark, d):
    out = stats.permutation_test(analysis.complete_groups(_runs(spark, d)), PAIR, DRAWS)
    return rounded(out.select(*PAIR, "gap", "p_gap"))


@query("st11_excess_interval", with_(
    ORDERS24, RUNS, sp.complete(), sp.permutation("complete", 200), sp.resampled("complete", 20),
    sp.permutation("boot", 20, "dataset, classifier, boot", "nested"),
    f"bounds AS (SELECT {BY}, quantile_cont(osi - osi_null, 0.025) AS lo, quantile_cont(osi - osi_null, 0.975) AS hi FROM nested GROUP BY 1, 2)",
    f"""SELECT {BY}, round(100 * (osi - osi_null), 8) AS delta_osi_pct, round(100 * lo, 8) AS ci_lo_pct, round(100 * hi, 8) AS ci_hi_pct,
    round(p_osi, 8) AS p_osi, round(p_gap, 8) AS p_gap FROM perm JOIN bounds USING ({BY})"""))
def _st11(spark, d):
    ok = materialize(analysis.complete_groups(_runs(spark, d)))
    return rounded(stats.excess_interval(ok, PAIR, n_boot=20, boot_draws=20, draws=200))


@query("st12_friedman", with_(
    ORDERS24, sp.runs(coarse=True), sp.complete(), sp.friedman("complete"),
    f"SELECT {BY}, round(friedman_chi2, 6) AS friedman_chi2, round(kendall_w, 6) AS kendall_w FROM fr"))
def _st12(spark, d):
    out = stats.friedman(analysis.complete_groups(_runs(spark, d, coarse=True)))
    return rounded(out.select(*PAIR, "friedman_chi2", "kendall_w"), 6)


@query("st12_friedman_p")
def _st12_p(spark, d):
    return rounded(stats.friedman(analysis.complete_groups(_runs(spark, d))))


_PER_DS = f"per_ds AS (SELECT {BY}, round(avg(d), 12) AS d FROM seed_means GROUP BY 1, 2)"


def _dataset_differences(spark, d):
    pairs = analysis.order_pairs(analysis.complete_groups(_runs(spark, d)))
    means = pairs.groupBy(*PAIR, "seed").agg(F.avg(F.col("balanced_accuracy_lnr") - F.col("balanced_accuracy_bal")).alias("d"))
    return materialize(means.groupBy(*PAIR).agg(F.round(F.avg("d"), 12).alias("d")))


@query("st13_signed_rank_exact", with_(
    ORDERS24, RUNS, sp.complete(), _PAIRS, _SEED_MEANS, _PER_DS, sp.signed_rank("per_ds", "classifier", "d", "sr"), sp.exact_p("sr", "classifier", "ex"),
    "SELECT classifier, n, round(w_plus, 6) AS w_plus, round(p, 8) AS p FROM sr JOIN ex USING (classifier)"))
def _st13(spark, d):
    return rounded(stats.wilcoxon(_dataset_differences(spark, d), ["classifier"], "d").select("classifier", "n", "w_plus", "p"))


@query("st14_signed_rank_one_sided", with_(
    ORDERS24, RUNS, sp.complete(), _PAIRS, _SEED_MEANS, _PER_DS, sp.signed_rank("per_ds", "classifier", "d", "sr"), sp.exact_p("sr", "classifier", "ex", True),
    "SELECT classifier, n, round(w_plus, 6) AS w_plus, round(p, 8) AS p FROM sr JOIN ex USING (classifier)"))
def _st14(spark, d):
    return rounded(stats.wilcoxon(_dataset_differences(spark, d), ["classifier"], "d", "greater").select("classifier", "n", "w_plus", "p"))


@query("st15_signed_rank_pooled", with_(
    ORDERS24, RUNS, sp.complete(), _PAIRS, "rp AS (SELECT dataset, classifier, round(diff, 12) AS d FROM pairs)", sp.signed_rank("rp", BY, "d", "sr"),
    f"SELECT {BY}, n, positive, round(w_plus, 6) AS w_plus FROM sr"))
def _st15(spark, d):
    pairs = analysis.order_pairs(analysis.complete_groups(_runs(spark, d)))
    diffs = pairs.withColumn("d", F.round(F.col("balanced_accuracy_lnr") - F.col("balanced_accuracy_bal"), 12))
    return rounded(stats.wilcoxon(diffs, PAIR, "d").select(*PAIR, "n", "positive", "w_plus"))


@query("st16_hodges_lehmann", with_(
    ORDERS24, RUNS, sp.complete(), _PAIRS, _SEED_MEANS, _PER_DS, sp.hodges_lehmann("per_ds", "classifier", "d", "hl"),
    round_sql("hl", "hl, ci_lo, ci_hi", "classifier").replace("FROM hl", "FROM (SELECT classifier, hl_pp AS hl, ci_lo_pp AS ci_lo, ci_hi_pp AS ci_hi FROM hl)")))
def _st16(spark, d):
    return rounded(stats.hodges_lehmann(_dataset_differences(spark, d), ["classifier"], "d"))


@query("st17_effect_report", with_(
    ORDERS24, RUNS, sp.complete(), _PAIRS, _SEED_MEANS, _PER_DS, "neg AS (SELECT dataset, classifier, -100 * d AS d FROM per_ds)",
    sp.hodges_lehmann("neg", "classifier", "d", "hl"), sp.signed_rank("neg", "classifier", "d", "sr"), sp.exact_p("sr", "classifier", "ex"),
    "SELECT classifier, hl.n, hl.positive, round(hl_pp, 8) AS hl_pp, round(ci_lo_pp, 8) AS ci_lo_pp, round(ci_hi_pp, 8) AS ci_hi_pp, round(p, 8) AS wilcoxon_p FROM hl JOIN ex USING (classifier)"))
def _st17(spark, d):
    neg = _dataset_differences(spark, d).withColumn("d", -100 * F.col("d"))
    return rounded(stats.effect_report(neg, ["classifier"], "d"))


@query("st18_rank_correlation", with_(
    ORDERS24, RUNS, f"ranked AS (SELECT dataset, {sp.avg_rank('l', 'dataset')} AS rx, {sp.avg_rank('a', 'dataset')} AS ry FROM (SELECT dataset, classifier, seed, avg(balanced_accuracy) AS l, round(max(balanced_accuracy), 2) AS a FROM runs GROUP BY 1, 2, 3))",
    "SELECT dataset, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM ranked GROUP BY 1"))
def _st18(spark, d):
    cells = materialize(t.runs(spark, d).groupBy(*PAIR, "seed").agg(
        F.avg("balanced_accuracy").alias("l"), F.round(F.max("balanced_accuracy"), 2).alias("a")))
    return rounded(stats.spearman(cells, ["dataset"], "l", "a").select("dataset", "n", "rho"), 6)


_CENTRED = f"""centred AS (SELECT c.*, balanced_accuracy - avg(balanced_accuracy) OVER (PARTITION BY {BY}, seed) AS centred FROM complete c)"""
_LODO = """lm AS (SELECT classifier, dataset, cleaning_order, avg(centred) AS m FROM centred GROUP BY 1, 2, 3),
lo AS (SELECT a.classifier, a.dataset, a.cleaning_order, a.m, round(avg(b.m), 12) AS others FROM lm a JOIN lm b
  ON a.classifier = b.classifier AND a.cleaning_order = b.cleaning_order AND a.dataset <> b.dataset GROUP BY ALL),
lr AS (SELECT *, row_number() OVER (PARTITION BY classifier, dataset ORDER BY others DESC, cleaning_order) AS rn FROM lo),
lodo AS (SELECT m.classifier, m.dataset AS held_out, max(r.cleaning_order) AS rule, count(*) FILTER (WHERE m.m > r.m) + 1 AS rank_of_rule,
    100 * (max(m.m) - max(r.m)) AS regret_pp, 100 * (max(m.m) - avg(m.m)) AS random_regret_pp
  FROM lm m JOIN lr r ON m.classifier = r.classifier AND m.dataset = r.dataset AND r.rn = 1 GROUP BY 1, 2)"""


def _lodo(spark, d):
    return materialize(analysis.leave_one_dataset_out(_runs(spark, d)))


@query("st19_regret_reduction", with_(
    ORDERS24, RUNS, sp.complete(), _CENTRED, _LODO,
    "num AS (SELECT classifier, regret_pp, random_regret_pp, row_number() OVER (PARTITION BY classifier ORDER BY held_out) - 1 AS pick, count(*) OVER (PARTITION BY classifier) AS size FROM lodo)",
    f"""slots AS (SELECT classifier, boot, slot, CAST(floor({sp.u(2026, 'classifier', 'boot', 'slot')} * size) AS BIGINT) AS pick
    FROM (SELECT DISTINCT classifier, size FROM num) CROSS JOIN range(1, 501) AS b(boot) CROSS JOIN LATERAL (SELECT unnest(range(1, size + 1)) AS slot))""",
    "bs AS (SELECT classifier, boot, 100 * (1 - avg(regret_pp) / avg(random_regret_pp)) AS r FROM slots JOIN num USING (classifier, pick) GROUP BY 1, 2)",
    "bb AS (SELECT classifier, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM bs GROUP BY 1)",
    "gain AS (SELECT classifier, round(random_regret_pp - regret_pp, 12) AS g FROM lodo)",
    sp.signed_rank("gain", "classifier", "g", "sr"), sp.exact_p("sr", "classifier", "ex", True),
    """SELECT classifier, round(100 * (1 - avg(regret_pp) / avg(random_regret_pp)), 6) AS reduction_pct, round(any_value(lo), 6) AS ci_lo_pct,
    round(any_value(hi), 6) AS ci_hi_pct, round(any_value(p), 6) AS wilcoxon_p_one_sided FROM lodo JOIN bb USING (classifier) JOIN ex USING (classifier) GROUP BY 1"""))
def _st19(spark, d):
    return rounded(stats.regret_reduction(_lodo(spark, d), n_boot=500), 6)


@query("st20_selected_extremes_report", with_(
    ORDERS24, RUNS, sp.complete(), sp.osi("complete"), _DIFFS, _T, sp.resampled("complete", 100),
    f"eb AS (SELECT {BY}, boot, max(m) AS hi, min(m) AS lo FROM (SELECT {BY}, boot, cleaning_order, avg(balanced_accuracy) AS m FROM boot GROUP BY ALL) GROUP BY 1, 2, 3)",
    f"bi AS (SELECT {BY}, quantile_cont((hi - lo) / hi, 0.025) AS lo, quantile_cont((hi - lo) / hi, 0.975) AS hi FROM eb GROUP BY 1, 2)",
    f"""cd AS (SELECT osi.dataset, osi.classifier, avg(CASE WHEN b.balanced_accuracy > w.balanced_accuracy THEN 1.0 WHEN b.balanced_accuracy < w.balanced_accuracy THEN -1.0 ELSE 0.0 END) AS cliffs_delta
    FROM osi JOIN complete b ON b.dataset = osi.dataset AND b.classifier = osi.classifier AND b.cleaning_order = best_order
    JOIN complete w ON w.dataset = osi.dataset AND w.classifier = osi.classifier AND w.cleaning_order = worst_order GROUP BY 1, 2)""",
    f"""SELECT {BY}, round({OSI_EXPR} * 100, 6) AS osi_pct, best_order, worst_order, round(100 * (best_mean - worst_mean), 6) AS gap_pp,
    round(mean_diff / (sd / sqrt(n)), 6) AS t, round(mean_diff / sd, 6) AS cohens_d, round(cliffs_delta, 6) AS cliffs_delta,
    round(100 * lo, 6) AS osi_ci_lower, round(100 * hi, 6) AS osi_ci_upper, n_seeds
    FROM osi JOIN tt USING ({BY}) JOIN cd USING ({BY}) JOIN bi USING ({BY})"""))
def _st20(spark, d):
    ok = materialize(analysis.complete_groups(_runs(spark, d)))
    out = materialize(stats.selected_extremes_report(ok, PAIR, n_boot=100))
    return rounded(out.select(*PAIR, "osi_pct", "best_order", "worst_order", "gap_pp", "t", "cohens_d", "cliffs_delta", "osi_ci_lower", "osi_ci_upper", "n_seeds"), 6)


# ----------------------------------------------------------------------- analysis
@query("a01_score_matrix", with_(
    ORDERS24, COARSE, f"SELECT {BY}, cleaning_order, " + ", ".join(f"max(CASE WHEN seed = {s} THEN balanced_accuracy END) AS seed_{s}" for s in range(1, 8)) + " FROM coarse GROUP BY 1, 2, 3"))
def _a01(spark, d):
    return analysis.seed_matrix(materialize(t.runs_coarse(spark, d)), list(range(1, 8)))


@query("a01_missing_cells", with_(
    ORDERS24, DETAILED, "ok AS (SELECT * FROM detailed WHERE NOT failed)",
    """SELECT g.dataset, g.classifier, s.seed, o.cleaning_order FROM (SELECT DISTINCT dataset, classifier FROM ok) g
    JOIN (SELECT DISTINCT dataset, seed FROM ok) s USING (dataset) JOIN (SELECT DISTINCT dataset, cleaning_order FROM ok) o USING (dataset)
    WHERE NOT EXISTS (SELECT 1 FROM ok r WHERE r.dataset = g.dataset AND r.classifier = g.classifier AND r.seed = s.seed AND r.cleaning_order = o.cleaning_order)"""))
def _a01_missing(spark, d):
    return analysis.missing_cells(materialize(t.runs_detailed(spark, d).where("not failed")))


@query("a02_group_coverage", with_(
    ORDERS24, DETAILED, "ok AS (SELECT * FROM detailed WHERE NOT failed)",
    f"""SELECT {BY}, present, expected, present >= expected AS complete FROM (SELECT {BY}, count(*) AS present FROM ok GROUP BY 1, 2)
    JOIN (SELECT dataset, count(DISTINCT cleaning_order) * count(DISTINCT seed) AS expected FROM ok GROUP BY 1) USING (dataset)"""))
def _a02(spark, d):
    return analysis.group_coverage(materialize(t.runs_detailed(spark, d).where("not failed")))


@query("a02_complete_groups", with_(
    ORDERS24, DETAILED, "ok AS (SELECT * FROM detailed WHERE NOT failed)", sp.complete("ok"),
    f"SELECT {BY}, seed, cleaning_order, balanced_accuracy FROM complete"))
def _a02_runs(spark, d):
    ok = materialize(t.runs_detailed(spark, d).where("not failed"))
    return analysis.complete_groups(ok).select(*PAIR, "seed", "cleaning_order", "balanced_accuracy")


_OSI_TABLE = f"""ot0 AS (SELECT {BY}, n_orderings, n_seeds, best_order, best_mean, best_sd, worst_order, worst_mean, worst_sd,
    100 * (best_mean - worst_mean) AS gap_pp, 100 * ({OSI_EXPR}) AS osi_pct, 100 * osi_null AS osi_null_pct,
    100 * ({OSI_EXPR}) - 100 * osi_null AS osi_excess_pct, p_osi AS p_perm, friedman_chi2, kendall_w
  FROM osi JOIN perm USING ({BY}) JOIN fr USING ({BY}))"""


def _osi_cte(source: str = "runs", draws: int = 200, out: str = "ot") -> list[str]:
    return [sp.complete(source), sp.osi("complete"), sp.permutation("complete", draws), sp.friedman("complete"), _OSI_TABLE, sp.bh("ot0", "p_perm", "p_perm_bh", out)]


_OSI_DOUBLES = "best_mean, best_sd, worst_mean, worst_sd, gap_pp, osi_pct, osi_null_pct, osi_excess_pct, p_perm, friedman_chi2, kendall_w, p_perm_bh"


@query("a03_sensitivity_table", with_(
    ORDERS24, RUNS, *_osi_cte(), "SELECT 'main' AS stage, * FROM (" + round_sql("ot", _OSI_DOUBLES, f"{BY}, n_orderings, n_seeds, best_order, worst_order", 6) + ")"))
def _a03(spark, d):
    return rounded(analysis.osi_table(_runs(spark, d), "main", 200).drop("friedman_p"), 6)


@query("a04_swapped_orders", with_(
    ORDERS24, RUNS, f"SELECT cleaning_order, {sp.swapped('cleaning_order')} AS partner, count(*) AS n_runs FROM runs GROUP BY 1, 2"))
def _a04(spark, d):
    return t.runs(spark, d).groupBy("cleaning_order", st.swap("cleaning_order", "LNR", "BAL").alias("partner")).agg(F.count("*").alias("n_runs"))


@query("a05_correction_first", with_(
    ORDERS24, RUNS, f"SELECT dataset, {sp.pos('cleaning_order', 'LNR')} < {sp.pos('cleaning_order', 'BAL')} AS lnr_first, count(*) AS n_runs, round(avg(balanced_accuracy), 8) AS mean_score FROM runs GROUP BY 1, 2"))
def _a05(spark, d):
    return rounded(t.runs(spark, d).groupBy("dataset", st.before("cleaning_order", "LNR", "BAL").alias("lnr_first")).agg(
        F.count("*").alias("n_runs"), F.avg("balanced_accuracy").alias("mean_score")))


def _lnr_bal_sql(source: str, stage: str, out: str) -> str:
    first = f"{sp.pos('cleaning_order', 'LNR')} < {sp.pos('cleaning_order', 'BAL')}"
    return f"""{out}_p AS (SELECT l.dataset, l.classifier, l.seed, l.balanced_accuracy - b.balanced_accuracy AS diff FROM {source} l JOIN {source} b
    ON l.dataset = b.dataset AND l.classifier = b.classifier AND l.seed = b.seed AND b.cleaning_order = {sp.swapped('l.cleaning_order')}
    WHERE {sp.pos('l.cleaning_order', 'LNR')} < {sp.pos('l.cleaning_order', 'BAL')}),
{out}_s AS (SELECT {BY}, seed, round(avg(diff), 12) AS d, count(*) AS n_pairs, count(*) FILTER (WHERE diff > 0) AS wins FROM {out}_p GROUP BY 1, 2, 3),
{out}_a AS (SELECT {BY}, avg(n_relabelled) FILTER (WHERE {first}) AS al, avg(n_relabelled) FILTER (WHERE NOT ({first})) AS ab FROM {source} GROUP BY 1, 2),
{out} AS (SELECT '{stage}' AS stage, {BY}, max(n_pairs) AS n_pairs, count(*) AS n_seeds, 100 * avg(d) AS mean_diff_pp, 100 * stddev_samp(d) AS sd_diff_pp,
    count(*) FILTER (WHERE d > 0) AS seeds_favouring_lnr_first, sum(wins) / sum(n_pairs) AS pairs_favouring_lnr_first,
    'n_relabelled' AS label_step_measure, any_value(al) AS label_actions_lnr_first, any_value(ab) AS label_actions_bal_first
  FROM {out}_s JOIN {out}_a USING ({BY}) GROUP BY {BY})"""


# scores of the detailed table without its failures, so that every group is complete
_FULL = "fullruns AS (SELECT dataset, classifier, seed, cleaning_order, score AS balanced_accuracy, n_relabelled FROM base_runs)"


def _full(spark, d):
    base = t.runs(spark, d)
    extra = t.runs_detailed(spark, d).select(*analysis.KEY, "n_relabelled")
    return materialize(base.join(extra, list(analysis.KEY)))


@query("a06_paired_comparison", with_(
    ORDERS24, DETAILED, _FULL, _lnr_bal_sql("fullruns", "main", "lb"),
    round_sql("lb", "mean_diff_pp, sd_diff_pp, pairs_favouring_lnr_first, label_actions_lnr_first, label_actions_bal_first", f"stage, {BY}, n_pairs, n_seeds, seeds_favouring_lnr_first, label_step_measure", 6)))
def _a06(spark, d):
    return rounded(analysis.lnr_bal_table(_full(spark, d), "main"), 6)


@query("a07_paired_across_datasets", with_(
    ORDERS24, DETAILED, _FULL, _lnr_bal_sql("fullruns", "main", "lb"), sp.signed_rank("lb", "stage, classifier", "mean_diff_pp", "sr"), sp.exact_p("sr", "stage, classifier", "ex"),
    """SELECT stage, classifier, count(*) AS n_datasets, count(*) FILTER (WHERE mean_diff_pp > 0) AS datasets_favouring_lnr_first,
    round(quantile_cont(mean_diff_pp, 0.5), 6) AS median_diff_pp, round(any_value(p), 6) AS wilcoxon_p FROM lb JOIN ex USING (stage, classifier) GROUP BY 1, 2"""))
def _a07(spark, d):
    return rounded(analysis.lnr_bal_across(materialize(analysis.lnr_bal_table(_full(spark, d), "main"))), 6)


@query("a08_pooled_pairs", with_(
    ORDERS24, DETAILED, "complete AS (SELECT * FROM detailed WHERE balanced_accuracy IS NOT NULL)", _PAIRS,
    "rp AS (SELECT dataset, classifier, seed, round(diff, 12) AS d FROM pairs)", sp.signed_rank("rp", BY, "d", "sr"),
    f"sm AS (SELECT {BY}, avg(m) / (stddev_samp(m) / sqrt(count(*))) AS t FROM (SELECT {BY}, seed, avg(d) AS m FROM rp GROUP BY 1, 2, 3) GROUP BY 1, 2)",
    f"""SELECT {BY}, count(*) AS n_pairs, round(100 * avg(d), 6) AS mean_diff_pp, round(100.0 * count(*) FILTER (WHERE d > 0) / count(*), 6) AS pct_pairs_lnr_first_better,
    round(any_value(w_plus), 6) AS w_plus, round(any_value(t), 6) AS t FROM rp JOIN sr USING ({BY}) JOIN sm USING ({BY}) GROUP BY 1, 2"""))
def _a08(spark, d):
    out = analysis.pooled_pairs(materialize(t.runs_detailed(spark, d)))
    return rounded(out.select(*PAIR, "n_pairs", "mean_diff_pp", "pct_pairs_lnr_first_better", "w_plus", "t"), 6)


@query("a08_pooled_pairs_p")
def _a08_p(spark, d):
    out = analysis.pooled_pairs(materialize(t.runs_detailed(spark, d)))
    return rounded(out.select(*PAIR, "p_wilcoxon_pooled", "p_ttest_seed_means", "p_ttest_bh"), 6)


@query("a09_skip_share", with_(
    ORDERS24, DETAILED, "SELECT dataset, cleaning_order, round(avg(CASE WHEN smote_skipped THEN 1.0 ELSE 0.0 END), 8) AS smote_skipped FROM detailed GROUP BY 1, 2"))
def _a09(spark, d):
    return rounded(analysis.skip_share(t.runs_detailed(spark, d)))


@query("a09_skip_share_wide", with_(
    ORDERS24, DETAILED, "ss AS (SELECT dataset, cleaning_order, avg(CASE WHEN smote_skipped THEN 1.0 ELSE 0.0 END) AS s FROM detailed GROUP BY 1, 2)",
    "SELECT dataset, " + ", ".join(f"round(max(CASE WHEN cleaning_order = '{o}' THEN s END), 8) AS \"{o}\"" for o in sp.ORDERS) + ", round(avg(s), 8) AS mean_share FROM ss GROUP BY 1"))
def _a09_wide(spark, d):
    return rounded(analysis.skip_share_wide(materialize(t.runs_detailed(spark, d)), t.ORDERS))


_NOOP = f"""noop AS (SELECT dataset FROM detailed GROUP BY 1 HAVING bool_and(coalesce(imputation__n_imputed, 0) = 0)),
collapsed AS (SELECT d.* EXCLUDE (cleaning_order), cleaning_order AS original_order, CASE WHEN noop.dataset IS NOT NULL
    THEN array_to_string(list_filter(string_split(cleaning_order, '→'), lambda s: s <> 'IMP'), '→') ELSE cleaning_order END AS cleaning_order,
    noop.dataset IS NOT NULL AS is_noop FROM detailed d LEFT JOIN noop USING (dataset))"""


@query("a10_collapse_noop_imputation", with_(
    ORDERS24, DETAILED, _NOOP, f"""SELECT {BY}, seed, cleaning_order, balanced_accuracy FROM (
    SELECT *, row_number() OVER (PARTITION BY {BY}, seed, cleaning_order ORDER BY original_order) AS rn FROM collapsed) WHERE rn = 1"""))
def _a10(spark, d):
    out = analysis.collapse_noop_imputation(materialize(t.runs_detailed(spark, d)))
    return out.select(*PAIR, "seed", "cleaning_order", "balanced_accuracy")


@query("a10_collapse_spread", with_(
    ORDERS24, DETAILED, _NOOP, f"""SELECT dataset, round(max(sp), 8) AS max_spread, max(sp) <= 1e-12 AS deterministic FROM (
    SELECT {BY}, seed, cleaning_order, max(balanced_accuracy) - min(balanced_accuracy) AS sp FROM collapsed WHERE is_noop GROUP BY ALL) GROUP BY 1"""))
def _a10_spread(spark, d):
    return rounded(analysis.collapse_spread(materialize(t.runs_detailed(spark, d))))


# shorter sequences: full orders cut after l_linenumber % 4 steps
_SUBSETS = f"""subset_runs AS (SELECT dataset, classifier, CASE WHEN len = 0 THEN 'NONE' ELSE array_to_string(list_slice(string_split(o, '→'), 1, len), '→') END AS cleaning_order,
    round(0.5 + 5 * avg(l_tax), 6) AS balanced_accuracy FROM (
    SELECT 'ds' || (l_suppkey % 10) AS dataset, CASE l_returnflag WHEN 'A' THEN 'logistic_regression' WHEN 'N' THEN 'random_forest' ELSE 'xgboost' END AS classifier,
      CAST(l_linenumber % 4 AS INTEGER) AS len, o.cleaning_order AS o, l_tax FROM lineitem JOIN orders24 o ON l_partkey % 24 = o.id WHERE l_suppkey % 10 < 7) GROUP BY 1, 2, 3)"""


def _subset_runs(spark, d):
    li = t.table(spark, d, "lineitem").where("l_suppkey % 10 < 7").select(
        F.concat(F.lit("ds"), F.col("l_suppkey") % 10).alias("dataset"),
        t._classifier("l_returnflag").alias("classifier"),
        (F.col("l_linenumber") % 4).alias("len"),
        st.steps(t.order_of(F.col("l_partkey"))).alias("s"), "l_tax")
    name = F.when(F.col("len") == 0, st.EMPTY_ORDER).otherwise(F.array_join(F.slice("s", F.lit(1), F.col("len")), st.ARROW))
    return li.groupBy(*PAIR, name.alias("cleaning_order")).agg(F.round(0.5 + 5 * F.avg("l_tax"), 6).alias("balanced_accuracy"))


@query("a11_subsets_against_full", with_(
    ORDERS24, RUNS, _SUBSETS,
    f"am AS (SELECT {BY}, cleaning_order, round(avg(balanced_accuracy), 12) AS mean FROM (SELECT {BY}, cleaning_order, balanced_accuracy FROM subset_runs UNION ALL SELECT {BY}, cleaning_order, balanced_accuracy FROM runs WHERE dataset IN (SELECT dataset FROM subset_runs)) GROUP BY ALL)",
    f"ar AS (SELECT *, len(string_split(cleaning_order, '→')) = 4 AS is_full, row_number() OVER (PARTITION BY {BY} ORDER BY mean DESC, cleaning_order) AS rb, row_number() OVER (PARTITION BY {BY}, len(string_split(cleaning_order, '→')) = 4 ORDER BY mean DESC, cleaning_order) AS rf FROM am)",
    f"""ag AS (SELECT {BY}, count(*) AS n_sequences, max(CASE WHEN rb = 1 THEN cleaning_order END) AS best_sequence, max(mean) AS best_mean,
    max(CASE WHEN is_full AND rf = 1 THEN cleaning_order END) AS best_full_order, max(CASE WHEN is_full THEN mean END) AS best_full_mean,
    max(CASE WHEN cleaning_order = 'NONE' THEN mean END) AS no_cleaning_mean, min(mean) AS worst FROM ar GROUP BY 1, 2)""",
    f"""SELECT {BY}, n_sequences, best_sequence, CASE WHEN best_sequence = 'NONE' THEN 0 ELSE CAST(len(string_split(best_sequence, '→')) AS INTEGER) END AS best_len,
    round(best_mean, 8) AS best_mean, best_full_order, round(best_full_mean, 8) AS best_full_mean, round(100 * (best_mean - best_full_mean), 8) AS best_minus_best_full_pp,
    round(no_cleaning_mean, 8) AS no_cleaning_mean, round(100 * (best_mean - worst) / best_mean, 8) AS osi_all_sequences_pct FROM ag"""))
def _a11(spark, d):
    return rounded(analysis.subsets_table(materialize(_subset_runs(spark, d)), _runs(spark, d)))


@query("a12_two_run_tables", with_(
    ORDERS24, RUNS, sp.runs("variant", "l_tax"),
    f"j AS (SELECT f.dataset, f.classifier, f.seed, f.cleaning_order, f.balanced_accuracy AS f, v.balanced_accuracy AS v, {sp.pos('f.cleaning_order', 'IMP')} < least({sp.pos('f.cleaning_order', 'LNR')}, {sp.pos('f.cleaning_order', 'BAL')}) AS un FROM runs f JOIN variant v USING ({BY}, seed, cleaning_order))",
    f"jf AS (SELECT {BY}, cleaning_order, f AS balanced_accuracy FROM j)", f"jv AS (SELECT {BY}, cleaning_order, v AS balanced_accuracy FROM j)",
    sp.osi("jf", "of_"), sp.osi("jv", "ov_"),
    f"dd AS (SELECT {BY}, max(CASE WHEN un THEN abs(100 * (f - v)) END) AS a, avg(CASE WHEN NOT un THEN 100 * (f - v) END) AS b, avg(CASE WHEN NOT un THEN abs(100 * (f - v)) END) AS c FROM j GROUP BY 1, 2)",
    f"""SELECT 'fixed_vs_variant' AS comparison, {BY}, round(a, 9) AS max_abs_diff_unaffected_pp, round(b, 9) AS mean_diff_affected_pp, round(c, 9) AS mean_abs_diff_affected_pp,
    round(100 * (x.best_mean - x.worst_mean) / x.best_mean, 9) AS osi_fixed_pct, round(100 * (y.best_mean - y.worst_mean) / y.best_mean, 9) AS osi_variant_pct,
    x.best_order AS best_fixed, y.best_order AS best_variant, x.worst_order AS worst_fixed, y.worst_order AS worst_variant
    FROM dd JOIN of_ x USING ({BY}) JOIN ov_ y USING ({BY})"""))
def _a12(spark, d):
    return rounded(analysis.ab_table(_runs(spark, d), _runs(spark, d, measure="l_tax"), "fixed_vs_variant"), 9)


@query("a13_centred_scores", with_(ORDERS24, RUNS, sp.complete(), _CENTRED, f"SELECT {BY}, seed, cleaning_order, round(centred, 10) + 0.0 AS centred FROM centred"))
def _a13(spark, d):
    return rounded(analysis.centred(_runs(spark, d)).select(*PAIR, "seed", "cleaning_order", "centred"), 10)


_POS = f"""pe AS (SELECT {BY}, op.code AS operation, CAST({sp.pos('cleaning_order', 'X').replace("'X'", 'op.code')} AS INTEGER) AS position, 100 * avg(centred) AS centred_pp
  FROM centred CROSS JOIN (VALUES ('IMP'), ('OUT'), ('LNR'), ('BAL')) op(code) GROUP BY 1, 2, 3, 4)"""


@query("a14_position_effects", with_(ORDERS24, RUNS, sp.complete(), _CENTRED, _POS, f"SELECT {BY}, operation, position, round(centred_pp, 8) + 0.0 AS centred_pp FROM pe"))
def _a14(spark, d):
    return rounded(analysis.position_effects(_runs(spark, d)))


@query("a14_position_effects_pooled", with_(
    ORDERS24, RUNS, sp.complete(), _CENTRED, _POS, 'SELECT classifier, operation, position, round(avg(centred_pp), 8) + 0.0 AS mean, round(stddev_samp(centred_pp), 8) AS sd, count(*) AS n_datasets FROM pe GROUP BY 1, 2, 3'))
def _a14_pooled(spark, d):
    return rounded(analysis.pooled_position_effects(analysis.position_effects(_runs(spark, d))))


@query("a15_extreme_positions", with_(
    ORDERS24, RUNS, sp.osi("runs"), "ext AS (SELECT 'best' AS kind, best_order AS o FROM osi UNION ALL SELECT 'worst', worst_order FROM osi)",
    "SELECT kind, code AS operation, " + ", ".join(f"count(*) FILTER (WHERE {sp.pos('o', 'X').replace(chr(39) + 'X' + chr(39), 'code')} = {i}) AS position_{i}" for i in range(1, 5)) + " FROM ext CROSS JOIN (VALUES ('IMP'), ('OUT'), ('LNR'), ('BAL')) op(code) GROUP BY 1, 2"))
def _a15(spark, d):
    return analysis.extreme_positions(stats.osi_summary(_runs(spark, d)))


@query("a16_sensitivity_vs_imbalance", with_(
    ORDERS24, RUNS, *_osi_cte(), AUDIT,
    "long AS (SELECT classifier, m.measure, (1 - minority_share) / minority_share AS ir, CASE m.measure WHEN 'osi_pct' THEN osi_pct ELSE osi_excess_pct END AS v FROM ot JOIN run_audit USING (dataset) CROSS JOIN (VALUES ('osi_pct'), ('osi_excess_pct')) m(measure))",
    f"rk AS (SELECT classifier, measure, {sp.avg_rank('ir', 'classifier, measure')} AS rx, {sp.avg_rank('v', 'classifier, measure')} AS ry FROM long)",
    "SELECT classifier, measure, count(*) AS n_datasets, round(corr(rx, ry), 6) + 0.0 AS spearman_rho FROM rk GROUP BY 1, 2"))
def _a16(spark, d):
    osi = analysis.osi_table(_runs(spark, d), "main", 200)
    return rounded(analysis.sensitivity_vs_imbalance(materialize(osi), materialize(t.run_audit(spark, d))).drop("p"), 6)


@query("a17_leave_one_dataset_out", with_(ORDERS24, RUNS, sp.complete(), _CENTRED, _LODO, round_sql("lodo", "regret_pp, random_regret_pp", "classifier, held_out, rule, rank_of_rule")))
def _a17(spark, d):
    return rounded(analysis.leave_one_dataset_out(_runs(spark, d)))


@query("a18_transfer_summary", with_(
    ORDERS24, RUNS, sp.complete(), _CENTRED, _LODO,
    """SELECT classifier, count(*) AS n_datasets, round(quantile_cont(rank_of_rule, 0.5), 6) AS median_rank, round(avg(regret_pp), 6) AS mean_regret_pp,
    round(avg(random_regret_pp), 6) AS mean_random_regret_pp, count(*) FILTER (WHERE regret_pp < random_regret_pp) AS datasets_rule_beats_random FROM lodo GROUP BY 1"""))
def _a18(spark, d):
    return rounded(analysis.transfer_summary(_lodo(spark, d)), 6)


# three conditions: the same cells scored by three measures
STAGE_MEASURES = {"main": ("l_discount", 5.0), "noise_05": ("l_tax", 5.0), "noise_20": ("l_quantity", 0.004)}


def _stage_osi(spark, d):
    out = None
    for stage, (measure, scale) in STAGE_MEASURES.items():
        one = analysis.osi_table(_runs(spark, d, measure=measure, scale=scale), stage, 100)
        out = one if out is None else out.unionByName(one)
    return materialize(out)


def _stage_sql() -> list[str]:
    ctes, union = [], []
    for i, (stage, (measure, scale)) in enumerate(STAGE_MEASURES.items()):
        ctes += [sp.runs(f"r{i}", measure, scale), sp.complete(f"r{i}", f"k{i}"), sp.osi(f"k{i}", f"o{i}"), sp.permutation(f"k{i}", 100, out=f"p{i}")]
        union.append(f"SELECT '{stage}' AS stage, {BY}, 100 * ({OSI_EXPR}) AS osi_pct, 100 * ({OSI_EXPR}) - 100 * osi_null AS osi_excess_pct, p_osi AS p_perm FROM o{i} JOIN p{i} USING ({BY})")
    return [*ctes, "stages AS (" + " UNION ALL ".join(union) + ")"]


@query("a19_robustness_wide", with_(
    ORDERS24, *_stage_sql(), f"SELECT {BY}, " + ", ".join(f"round(max(CASE WHEN stage = '{s}' THEN {m} END), 4) + 0.0 AS {m}__{s}" for m in ("osi_excess_pct", "osi_pct", "p_perm") for s in STAGE_MEASURES) + " FROM stages GROUP BY 1, 2"))
def _a19(spark, d):
    return rounded(analysis.robustness_wide(_stage_osi(spark, d), list(STAGE_MEASURES)), 4)


_DOSES = [("noise_05", "noise", 5.0), ("main", "noise", 15.0), ("noise_20", "noise", 20.0), ("main", "ratio", 0.8)]


@query("a29_dose_table", with_(
    ORDERS24, *_stage_sql(), "doses(stage, kind, x) AS (VALUES " + ", ".join(f"('{s}', '{k}', CAST({x} AS DOUBLE))" for s, k, x in _DOSES) + ")",
    "dosed AS (SELECT kind, x, osi_excess_pct, p_perm FROM stages JOIN doses USING (stage) WHERE dataset IN (SELECT dataset FROM stages WHERE stage = 'noise_05'))",
    sp.bh("dosed", "p_perm", "bh", "adj", "kind, x"),
    """SELECT kind, x, round(quantile_cont(osi_excess_pct, 0.5), 6) AS median, round(quantile_cont(osi_excess_pct, 0.25), 6) AS q25,
    round(quantile_cont(osi_excess_pct, 0.75), 6) AS q75, count(*) FILTER (WHERE bh < 0.05) AS significant, count(*) AS pairs FROM adj GROUP BY 1, 2"""))
def _a29(spark, d):
    tables = _stage_osi(spark, d)
    return rounded(analysis.dose_table(tables, _DOSES, tables.where("stage = 'noise_05'")), 6)


@query("a25_seed_stability", with_(
    ORDERS24, RUNS, sp.runs("runs20", seeds=10), sp.complete("runs", "k0"), sp.osi("k0", "o0"), sp.permutation("k0", 100, out="p0"),
    sp.complete("runs20", "k1"), sp.osi("k1", "o1"), sp.permutation("k1", 100, out="p1"),
    f"few0 AS (SELECT {BY}, 100 * ({OSI_EXPR}) AS osi_pct, 100 * ({OSI_EXPR}) - 100 * osi_null AS ex, p_osi AS p FROM o0 JOIN p0 USING ({BY}) WHERE dataset IN (SELECT dataset FROM o1))",
    f"many0 AS (SELECT {BY}, 100 * ({OSI_EXPR}) AS osi_pct, 100 * ({OSI_EXPR}) - 100 * osi_null AS ex, p_osi AS p FROM o1 JOIN p1 USING ({BY}))",
    sp.bh("few0", "p", "pb", "few"), sp.bh("many0", "p", "pb", "many"),
    f"""SELECT {BY}, round(f.osi_pct, 6) AS osi_pct_few, round(f.ex, 6) AS excess_pct_few, round(f.p, 6) AS p_few, round(f.pb, 6) AS p_bh_few,
    round(m.osi_pct, 6) AS osi_pct_many, round(m.ex, 6) AS excess_pct_many, round(m.p, 6) AS p_many, round(m.pb, 6) AS p_bh_many,
    (f.pb < 0.05) = (m.pb < 0.05) AS same_call FROM few f JOIN many m USING ({BY})"""))
def _a25(spark, d):
    few = analysis.osi_table(_runs(spark, d), "main", 100)
    many = analysis.osi_table(_runs(spark, d, seeds=10), "seeds10", 100)
    return rounded(analysis.stability(materialize(few), materialize(many)), 6)


_STAGE_PAIRS = [x for i, (s, (m, k)) in enumerate(STAGE_MEASURES.items()) for x in (
    sp.runs(f"sr{i}", m, k), f"sn{i} AS (SELECT *, 0 AS n_relabelled FROM sr{i})", _lnr_bal_sql(f"sn{i}", s, f"sl{i}"))]


@query("a30_condition_matrix", with_(
    ORDERS24, *_STAGE_PAIRS, "al AS (" + " UNION ALL ".join(f"SELECT stage, classifier, mean_diff_pp FROM sl{i}" for i in range(3)) + ")",
    "SELECT stage, " + ", ".join(
        f"round(quantile_cont(mean_diff_pp, 0.5) FILTER (WHERE classifier = '{c}'), 6) AS {c}_median, count(*) FILTER (WHERE classifier = '{c}' AND mean_diff_pp > 0) AS {c}_favouring, count(*) FILTER (WHERE classifier = '{c}') AS {c}_n"
        for c in ("logistic_regression", "random_forest", "xgboost")) + " FROM al GROUP BY 1"))
def _a30(spark, d):
    per = None
    for stage, (measure, scale) in STAGE_MEASURES.items():
        one = analysis.lnr_bal_table(_runs(spark, d, measure=measure, scale=scale).withColumn("n_relabelled", F.lit(0)), stage)
        per = one if per is None else per.unionByName(one)
    return rounded(analysis.condition_matrix(materialize(analysis.lnr_bal_across(materialize(per)))), 6)


@query("a32_value_checks", with_(
    ORDERS24, RUNS, sp.osi("runs"), "found AS (SELECT 'groups' AS label, CAST(count(*) AS VARCHAR) AS value FROM osi UNION ALL SELECT 'runs', CAST(count(*) AS VARCHAR) FROM runs UNION ALL SELECT 'datasets', CAST(count(DISTINCT dataset) AS VARCHAR) FROM runs)",
    "expected(label, expected) AS (VALUES ('groups', '30'), ('runs', '3600'), ('datasets', '12'))",
    "SELECT label, expected, value AS computed, CASE WHEN expected IS NOT DISTINCT FROM value THEN 'OK' ELSE 'MISMATCH' END AS status FROM expected LEFT JOIN found USING (label)"))
def _a32(spark, d):
    runs = _runs(spark, d)
    found = runs.agg(
        F.countDistinct(*PAIR).cast("string").alias("groups"), F.count("*").cast("string").alias("runs"),
        F.countDistinct("dataset").cast("string").alias("datasets")).select(F.expr("stack(3, 'groups', groups, 'runs', runs, 'datasets', datasets) as (label, value)"))
    return analysis.check_values([("groups", "30"), ("runs", "3600"), ("datasets", "12")], found)


@query("a33_legacy_pivot", with_(
    ORDERS24, RUNS, sp.osi("runs"), "SELECT dataset, " + ", ".join(f"round(max(CASE WHEN classifier = '{c}' THEN 100 * ({OSI_EXPR}) END), 8) AS {c}" for c in ("logistic_regression", "random_forest", "xgboost")) + " FROM osi GROUP BY 1"))
def _a33(spark, d):
    return rounded(analysis.osi_pivot(stats.osi_summary(t.runs(spark, d))))


@query("a34_reproduction_check", with_(
    ORDERS24, RUNS, sp.runs("rebuilt", scale=5.0000001), "j AS (SELECT a.balanced_accuracy AS a, b.balanced_accuracy AS b FROM runs a FULL OUTER JOIN rebuilt b USING (dataset, classifier, seed, cleaning_order))",
    "SELECT count(*) FILTER (WHERE b IS NULL) AS only_stored, count(*) FILTER (WHERE a IS NULL) AS only_rebuilt, round(max(abs(a - b)), 8) AS max_abs_diff, count(*) FILTER (WHERE a IS NULL OR b IS NULL) = 0 AND max(abs(a - b)) <= 1e-9 AS reproduced FROM j"))
def _a34(spark, d):
    return rounded(analysis.reproduction_check(t.runs(spark, d), t.runs(spark, d, scale=5.0000001), analysis.KEY, "balanced_accuracy"))


# ------------------------------------------------------------------------- the grid
def _datasets(spark, d):
    named = t.table(spark, d, "lineitem").select(F.concat(F.lit("ds"), F.col("l_suppkey") % 10).alias("dataset")).distinct()
    stages = [(s,) for s in grid.CONDITIONS]
    return named.join(F.broadcast(spark.createDataFrame(stages, "stage string")))


@query("g01_full_orders", with_(
    ORDERS24, RUNS, "SELECT o.cleaning_order, 4 AS seq_len, count(r.dataset) AS n_runs FROM orders24 o LEFT JOIN runs r ON r.cleaning_order = o.cleaning_order GROUP BY 1"))
def _g01(spark, d):
    return grid.orders(spark, "all").join(t.runs(spark, d).select("cleaning_order", "dataset"), "cleaning_order", "left").groupBy(
        "cleaning_order", "seq_len").agg(F.count("dataset").alias("n_runs"))


@query("g02_shorter_sequences", with_(
    ORDERS24, RUNS, "pre AS (SELECT CASE WHEN k = 0 THEN 'NONE' ELSE array_to_string(list_slice(string_split(cleaning_order, '→'), 1, k), '→') END AS cleaning_order, CAST(k AS INTEGER) AS seq_len FROM runs CROSS JOIN (VALUES (0), (1), (2), (3)) t(k))",
    "SELECT cleaning_order, seq_len, count(*) AS n_runs FROM pre GROUP BY 1, 2"))
def _g02(spark, d):
    cut = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.array_join(F.slice(st.steps("cleaning_order"), F.lit(1), k), st.ARROW))
    prefixes = t.runs(spark, d).select(F.explode(cut).alias("p")).select(
        F.when(F.col("p") == "", st.EMPTY_ORDER).otherwise(F.col("p")).alias("cleaning_order"))
    return grid.orders(spark, "subsets").join(prefixes.groupBy("cleaning_order").agg(F.count("*").alias("n_runs")), "cleaning_order")


_SEQS = """allseq AS (SELECT DISTINCT CASE WHEN k = 0 THEN 'NONE' ELSE array_to_string(list_slice(string_split(cleaning_order, '→'), 1, k), '→') END AS cleaning_order, CAST(k AS INTEGER) AS seq_len
  FROM orders24 CROSS JOIN (VALUES (0), (1), (2), (3), (4)) t(k))"""
_STAGES = "stages(stage, kind, n_seeds) AS (VALUES " + ", ".join(
    f"('{s}', '{'subsets' if s == 'subsets' else 'all'}', {20 if s == 'seeds20' else 5})"
    for s in ("main", "clean", "subsets", "methods_b", "high_ir", "smote_050", "smote_100", "noise_05", "noise_10", "noise_20", "noise_sym", "seeds20")) + ")"
_GRID = """grid AS (SELECT stage, dataset, CAST(42 + s AS INTEGER) AS seed, cleaning_order, seq_len, classifier
  FROM (SELECT DISTINCT 'ds' || (l_suppkey % 10) AS dataset FROM lineitem) CROSS JOIN stages CROSS JOIN LATERAL (SELECT unnest(range(0, n_seeds)) AS s)
  JOIN allseq ON (kind = 'all' AND seq_len = 4) OR (kind = 'subsets' AND seq_len < 4)
  CROSS JOIN (VALUES ('random_forest'), ('logistic_regression'), ('xgboost')) c(classifier)
  WHERE classifier <> 'logistic_regression' OR cleaning_order LIKE '%IMP%')"""


@query("g03_task_grid", with_(ORDERS24, _SEQS, _STAGES, _GRID, "SELECT * FROM grid"))
def _g03(spark, d):
    return grid.task_grid(spark, _datasets(spark, d))


@query("g03_expected_rows", with_(
    ORDERS24, _SEQS, _STAGES, _GRID, "SELECT stage, count(*) AS n_runs, count(DISTINCT dataset) AS n_datasets, count(DISTINCT seed) AS n_seeds, count(DISTINCT cleaning_order) AS n_sequences FROM grid GROUP BY 1"))
def _g03_rows(spark, d):
    return grid.expected_rows(grid.task_grid(spark, _datasets(spark, d)))


@query("m06_model_eligibility", with_(
    ORDERS24, _SEQS, _STAGES, _GRID, "SELECT cleaning_order, count(DISTINCT classifier) AS n_classifiers, bool_or(classifier = 'logistic_regression') AS allows_logistic FROM grid GROUP BY 1"))
def _m06(spark, d):
    return grid.task_grid(spark, _datasets(spark, d)).groupBy("cleaning_order").agg(
        F.countDistinct("classifier").alias("n_classifiers"), F.bool_or(F.col("classifier") == "logistic_regression").alias("allows_logistic"))


@query("g06_smoke_grid", with_(
    ORDERS24, RUNS, f"SELECT {BY}, seed, cleaning_order, id AS order_no FROM runs JOIN orders24 USING (cleaning_order) WHERE seed = (SELECT min(seed) FROM runs) AND id % 6 = 0"))
def _g06(spark, d):
    numbered = _runs(spark, d).join(F.broadcast(t.orders24(spark).withColumnRenamed("id", "order_no")), "cleaning_order")
    return grid.smoke_grid(numbered, 24).select(*PAIR, "seed", "cleaning_order", "order_no")


@query("g07_run_summary", with_(
    ORDERS24, DETAILED, """SELECT dataset, count(*) AS n_rows, count(*) FILTER (WHERE failed) AS n_failed, count(*) FILTER (WHERE classifier = 'logistic_regression') AS lr_rows,
    count(*) FILTER (WHERE classifier = 'logistic_regression' AND NOT converged) AS lr_not_converged, count(*) FILTER (WHERE smote_skipped) AS balance_skipped,
    count(smote_skipped) AS balance_rows, count(*) FILTER (WHERE failed) / count(*) > 0.02 AS too_many_failures FROM detailed GROUP BY 1"""))
def _g07(spark, d):
    return analysis.run_summary(t.runs_detailed(spark, d))


@query("g08_noise_sensitivity", with_(
    ORDERS24, sp.runs("r10", "l_discount"), sp.runs("r20", "l_tax"),
    "both_rates AS (SELECT 0.1 AS noise_rate, * FROM r10 WHERE classifier = 'random_forest' UNION ALL SELECT 0.2, * FROM r20 WHERE classifier = 'random_forest')",
    sp.osi("both_rates", "osi", "noise_rate, dataset"),
    f"""SELECT CAST(noise_rate AS DOUBLE) AS noise_rate, dataset, best_order, round(best_mean, 8) AS best_mean, worst_order, round(worst_mean, 8) AS worst_mean, round(100 * (best_mean - worst_mean), 8) AS gap_pp,
    round(100 * ({OSI_EXPR}), 8) AS osi_pct, {sp.pos('best_order', 'LNR')} AS best_lnr_position, {sp.pos('worst_order', 'LNR')} AS worst_lnr_position FROM osi"""))
def _g08(spark, d):
    both = t.runs(spark, d).withColumn("noise_rate", F.lit(0.1)).unionByName(t.runs(spark, d, measure="l_tax").withColumn("noise_rate", F.lit(0.2)))
    return rounded(analysis.sensitivity_summary(both.where("classifier = 'random_forest'")))


# ------------------------------------------------------- fold-safe and threshold tables
_FOLD = f"""fold_scores AS (SELECT dataset, seed, classifier, max(CASE WHEN cleaning_order = 'IMP→BAL→LNR→OUT' THEN balanced_accuracy END) AS A_bal_first,
    max(CASE WHEN cleaning_order = 'IMP→LNR→BAL→OUT' THEN balanced_accuracy END) AS B_lnr_first, max(CASE WHEN cleaning_order = 'LNR→IMP→BAL→OUT' THEN balanced_accuracy END) AS C_foldsmote,
    max(CASE WHEN cleaning_order = 'OUT→IMP→LNR→BAL' THEN balanced_accuracy END) AS D_weighted FROM runs GROUP BY 1, 2, 3),
gains AS (SELECT classifier, dataset, variant, round(100 * (avg(CASE variant WHEN 'A_bal_first' THEN A_bal_first WHEN 'C_foldsmote' THEN C_foldsmote ELSE D_weighted END) - avg(B_lnr_first)), 9) AS gain_pp
  FROM fold_scores CROSS JOIN (VALUES ('A_bal_first'), ('C_foldsmote'), ('D_weighted')) v(variant) GROUP BY 1, 2, 3)"""
_FOLD_ORDERS = {"A_bal_first": "IMP→BAL→LNR→OUT", "B_lnr_first": "IMP→LNR→BAL→OUT", "C_foldsmote": "LNR→IMP→BAL→OUT", "D_weighted": "OUT→IMP→LNR→BAL"}


def _fold_scores(spark, d):
    wide = t.runs(spark, d).groupBy("dataset", "seed", "classifier").pivot("cleaning_order", list(_FOLD_ORDERS.values())).agg(F.first("balanced_accuracy"))
    return materialize(wide.select("dataset", "seed", "classifier", *[F.col(f"`{o}`").alias(n) for n, o in _FOLD_ORDERS.items()]))


@query("a28_fold_safe_summary", with_(
    ORDERS24, RUNS, _FOLD, sp.signed_rank("gains", "classifier, variant", "gain_pp", "sr"), sp.exact_p("sr", "classifier, variant", "ex"),
    """SELECT classifier, variant, count(*) FILTER (WHERE gain_pp > 0) AS better, count(*) AS n_datasets, round(quantile_cont(gain_pp, 0.5), 6) AS median_pp, round(any_value(p), 6) AS p
    FROM gains JOIN ex USING (classifier, variant) GROUP BY 1, 2"""))
def _a28(spark, d):
    return rounded(diagnostics.fold_safe_summary(_fold_scores(spark, d)), 6)


@query("a28_gain_correlation", with_(
    ORDERS24, RUNS, _FOLD, "gw AS (SELECT classifier, dataset, max(CASE WHEN variant = 'A_bal_first' THEN gain_pp END) AS a, max(CASE WHEN variant = 'C_foldsmote' THEN gain_pp END) AS c FROM gains GROUP BY 1, 2)",
    f"gr AS (SELECT {sp.avg_rank('a', '1')} AS rx, {sp.avg_rank('c', '1')} AS ry FROM gw)", "SELECT count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS rho FROM gr"))
def _a28_corr(spark, d):
    return rounded(diagnostics.gain_correlation(_fold_scores(spark, d)).select("n", "rho"), 6)


_THR = """ts AS (SELECT dataset, seed, classifier, CAST(tt AS DOUBLE) AS threshold, round(0.5 + tt * (max(CASE WHEN cleaning_order = 'IMP→BAL→LNR→OUT' THEN balanced_accuracy END) - 0.5), 9) AS bal_first,
    max(CASE WHEN cleaning_order = 'IMP→LNR→BAL→OUT' THEN balanced_accuracy END) AS lnr_first FROM runs CROSS JOIN (VALUES (0.6), (0.7), (0.8), (0.9)) t(tt) GROUP BY 1, 2, 3, tt),
td AS (SELECT threshold, classifier, dataset, round(100 * (avg(bal_first) - avg(lnr_first)), 9) AS d FROM ts GROUP BY 1, 2, 3)"""


def _threshold_scores(spark, d):
    s = _fold_scores(spark, d).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.6, 0.7, 0.8, 0.9)])))
    return materialize(s.select("dataset", "seed", "classifier", "threshold", F.round(0.5 + F.col("threshold") * (F.col("A_bal_first") - 0.5), 9).alias("bal_first"), F.col("B_lnr_first").alias("lnr_first")))


@query("a27_threshold_effects", with_(
    ORDERS24, RUNS, _THR, sp.hodges_lehmann("td", "threshold, classifier", "d", "hl"), sp.signed_rank("td", "threshold, classifier", "d", "sr"), sp.exact_p("sr", "threshold, classifier", "ex"),
    "SELECT threshold, classifier, hl.n, hl.positive, round(hl_pp, 6) AS hl_pp, round(ci_lo_pp, 6) AS ci_lo_pp, round(ci_hi_pp, 6) AS ci_hi_pp, round(p, 6) AS wilcoxon_p FROM hl JOIN ex USING (threshold, classifier)"))
def _a27(spark, d):
    return rounded(diagnostics.threshold_effects(_threshold_scores(spark, d)), 6)


@query("a27_threshold_medians", with_(
    ORDERS24, RUNS, _THR, "tm AS (SELECT threshold, dataset, round(avg(lnr_first), 12) AS lnr, round(avg(bal_first), 12) AS bal FROM ts WHERE classifier = 'random_forest' GROUP BY 1, 2)",
    "SELECT threshold, round(quantile_cont(lnr, 0.5), 6) AS median_lnr_first, round(quantile_cont(bal, 0.5), 6) AS median_bal_first, count(*) FILTER (WHERE bal > lnr) AS datasets_higher, count(*) AS n_datasets FROM tm GROUP BY 1"))
def _a27_medians(spark, d):
    s = _threshold_scores(spark, d).where("classifier = 'random_forest'").select("dataset", "seed", "threshold", F.col("lnr_first").alias("precision_lnr_first"), F.col("bal_first").alias("precision_bal_first"))
    return rounded(diagnostics.threshold_medians(s), 6)
