"""Queries over cleaning steps, models, sequences and their diagnostics.

Queries that fit models have no SQL twin. They read whole tables but use smaller
ensembles than the library defaults where stated, which only affects their run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import sqlparts as sp
from checks.registry import query, rounded, rounded_where
from checks.sqlparts import DF, OF, VF, h, u, with_
from checks.table_queries import ALL, CAT, NUM, SEED, features, flips_sql
from tidyorder.operators import balance, faults, impute, labels, models, outliers, sampling
from tidyorder.operators.neighbors import nearest
from tidyorder.plans import diagnostics, grid
from tidyorder.plans.sequence import MethodSet, apply_sequence, log_table
from tidyorder.session import materialize
from tidyorder.sources import tables as t

SMALL_FIT = models.Fit(trees=20, depth=6, rounds=5)


def _cols(digits: int = 6, num=NUM, cat=CAT) -> str:
    return ", ".join([f"round({c}, {digits}) + 0.0 AS {c}" for c in num] + list(cat))


# the category of an order goes missing where its line items are, or its discount is high
_GAPS = "of_gaps AS (SELECT * REPLACE (CASE WHEN x_disc <= 0.07 THEN c_prio END AS c_prio) FROM order_features)"


def _gaps(spark, d) -> DataFrame:
    return materialize(features(spark, d).withColumn("c_prio", F.when(F.col("x_disc") <= 0.07, F.col("c_prio"))))


def _filled(source: str, out: str, num=NUM, cat=CAT, where: str = "") -> str:
    exprs = [f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM {source}), 0.0) AS {c}" for c in num]
    exprs += [
        f"coalesce({c}, (SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1), 0) AS {c}" for c in cat
    ]
    return f"{out} AS (SELECT * REPLACE ({', '.join(exprs)}) FROM {source}{where})"


@query("c01_median_fill", with_(OF, _filled("order_features", "filled"), f"SELECT row_id, {_cols()} FROM filled"))
def _c01(spark, d):
    return rounded(impute.impute_median(features(spark, d)).select("row_id", *ALL), 6)


@query("c02_mode_fill", with_(OF, _GAPS, _filled("of_gaps", "filled"), "SELECT row_id, c_prio, c_seg FROM filled"))
def _c02(spark, d):
    return impute.impute_median(_gaps(spark, d)).select("row_id", *CAT)


_FOLD = f"folded AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY {h(SEED, chr(39) + 'fold' + chr(39), 'row_id')}, row_id) - 1) % 5 AS INTEGER) AS fold FROM of_gaps)"


@query("c03_fill_by_fold", with_(
    OF, _GAPS, _FOLD, "SELECT k AS fold, " + ", ".join(f"round(quantile_cont({c}, 0.5), 6) AS f_{c}" for c in NUM) + ", " + ", ".join(f"mode_{c} AS f_{c}" for c in CAT)
    + " FROM folded JOIN range(0, 5) f(k) ON fold <> k JOIN (" + " JOIN ".join(
        f"(SELECT k, c AS mode_{c} FROM (SELECT k, {c} AS c, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, {c}) AS rn FROM folded JOIN range(0, 5) f(k) ON fold <> k WHERE {c} IS NOT NULL GROUP BY 1, 2) WHERE rn = 1){' USING (k)' if i else ''}"
        for i, c in enumerate(CAT)) + ") m USING (k) GROUP BY ALL"))
def _c03(spark, d):
    folded = materialize(sampling.stratified_folds(_gaps(spark, d), SEED))
    return rounded(impute.fit_fill_by_fold(folded).withColumn("fold", F.col("fold").cast("bigint")), 6)


def _standard(source: str, out: str, cols, keep: str) -> str:
    sd = "(SELECT CASE WHEN coalesce(stddev_pop({c}), 0) < 1e-12 THEN 1.0 ELSE stddev_pop({c}) END FROM " + source + ")"
    return f"{out} AS (SELECT {keep}, " + ", ".join(f"({c} - (SELECT avg({c}) FROM {source})) / {sd.format(c=c)} AS {c}" for c in cols) + f" FROM {source})"


def _robust(source: str, out: str, cols, keep: str) -> str:
    width = "(SELECT CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 THEN 1.0 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END FROM " + source + ")"
    return f"{out} AS (SELECT {keep}, " + ", ".join(f"({c} - (SELECT quantile_cont({c}, 0.5) FROM {source})) / {width.format(c=c)} AS {c}" for c in cols) + f" FROM {source})"


def _neighbor_fill_sql() -> str:
    need = [c for c in NUM if c != "x_total"]
    shared = " + ".join(f"CASE WHEN q.{c} IS NOT NULL AND e.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in ALL)
    total = " + ".join(f"coalesce((q.{c} - e.{c}) * (q.{c} - e.{c}), 0)" for c in ALL)
    parts = [
        OF, _standard("order_features", "sc", ALL, "row_id"),
        f"pairs AS (SELECT q.row_id AS qid, e.row_id AS eid, round(({total}) * ({len(ALL)}.0 / ({shared})), 9) AS d2, {', '.join(f'e.{c}' for c in need)} FROM sc q JOIN sc e ON q.row_id <> e.row_id WHERE q.x_qty IS NULL OR q.x_price IS NULL OR q.x_disc IS NULL OR q.x_tax IS NULL)",
    ]
    for c in need:
        parts.append(f"e_{c} AS (SELECT qid, avg({c}) AS v FROM (SELECT qid, {c}, row_number() OVER (PARTITION BY qid ORDER BY d2, eid) AS rn FROM pairs WHERE {c} IS NOT NULL) WHERE rn <= 5 GROUP BY 1)")
    cells = ", ".join(
        f"round(coalesce(f.{c}, e_{c}.v * (SELECT stddev_pop({c}) FROM order_features) + (SELECT avg({c}) FROM order_features)), 6) + 0.0 AS {c}" for c in need)
    joins = " ".join(f"LEFT JOIN e_{c} ON e_{c}.qid = f.row_id" for c in need)
    return with_(*parts, f"SELECT f.row_id, round(f.x_total, 6) AS x_total, {cells}, f.c_prio, f.c_seg FROM order_features f {joins}")


@query("c04_neighbor_imputation", _neighbor_fill_sql())
def _c04(spark, d):
    return rounded(impute.impute_neighbors(features(spark, d)).select("row_id", *ALL), 6)


@query("c05_null_counts", with_(
    OF, _filled("order_features", "filled"), "SELECT " + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in ALL) + " AS nulls_before, CAST(0 AS BIGINT) AS nulls_after, count(*) AS n_rows FROM order_features"))
def _c05(spark, d):
    base = features(spark, d)
    after = impute.impute_median(base)
    left = base.agg(impute.null_cells(base).alias("nulls_before"))
    return left.crossJoin(after.agg(impute.null_cells(after).alias("nulls_after"), F.count("*").alias("n_rows")))


@query("c06_robust_scaling", with_(OF, _robust("order_features", "sc", NUM, "row_id"), f"SELECT row_id, {_cols(6, NUM, [])} FROM sc"))
def _c06(spark, d):
    base = features(spark, d).select("row_id", *NUM)
    return rounded(impute.apply_scaling(base, impute.fit_robust(base, NUM), NUM), 6)


@query("c07_standard_scaling", with_(OF, _standard("order_features", "sc", NUM, "row_id"), f"SELECT row_id, {_cols(6, NUM, [])} FROM sc"))
def _c07(spark, d):
    base = features(spark, d).select("row_id", *NUM)
    return rounded(impute.apply_scaling(base, impute.fit_standard(base, NUM), NUM), 6)


@query("c08_isolation_forest")
def _c08(spark, d):
    scaled = materialize(outliers.scoring_features(features(spark, d)))
    return rounded(outliers.flag_extreme(materialize(outliers.isolation_scores(scaled, SEED))), 6)


DOC_NUM, DOC_CAT = ["x_chars", "x_spaces", "x_digits"], ["c_lang"]
DOC = DOC_NUM + DOC_CAT


def _neighbors_sql(source: str, cols, k: int, out: str = "nn", extra: str = "", mismatch=()) -> str:
    d2 = " + ".join([f"(q.{c} - e.{c}) * (q.{c} - e.{c})" for c in cols] + [f"CASE WHEN q.{c} <> e.{c} THEN 1 ELSE 0 END" for c in mismatch])
    return f"""{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, eid) AS rn FROM (
    SELECT q.row_id AS qid, e.row_id AS eid, round({d2}, 9) AS d2{extra} FROM {source} q JOIN {source} e ON q.row_id <> e.row_id)) WHERE rn <= {k})"""


_LOF = [
    DF, _robust("doc_features", "sc", DOC, "row_id"), _neighbors_sql("sc", DOC, 20),
    "kd AS (SELECT qid, max(sqrt(d2)) AS kd FROM nn GROUP BY 1)",
    "lrd AS (SELECT nn.qid, 1.0 / (avg(greatest(sqrt(d2), kd.kd)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.qid = nn.eid GROUP BY 1)",
    "lof AS (SELECT nn.qid AS row_id, round(avg(o.lrd) / max(s.lrd), 8) AS score FROM nn JOIN lrd o ON o.qid = nn.eid JOIN lrd s ON s.qid = nn.qid GROUP BY 1)",
]


@query("c09_local_outlier_factor", with_(*_LOF, "SELECT row_id, round(score, 6) AS score, score > (SELECT quantile_cont(score, 0.95) FROM lof) AS outlier FROM lof"))
def _c09(spark, d):
    scaled = materialize(outliers.scoring_features(materialize(t.doc_features(spark, d))))
    return rounded(outliers.flag_extreme(materialize(outliers.local_outlier_factor(scaled))), 6)


@query("c09_local_outliers_removed", with_(*_LOF, "SELECT row_id, label FROM doc_features JOIN lof USING (row_id) WHERE score <= (SELECT quantile_cont(score, 0.95) FROM lof)"))
def _c09_removed(spark, d):
    return outliers.remove_local_outliers(materialize(t.doc_features(spark, d))).select("row_id", "label")


def _oof_input(spark, d) -> DataFrame:
    return materialize(faults.flip_labels(features(spark, d), SEED))


@query("c10_out_of_fold_correction")
def _c10(spark, d):
    noisy = _oof_input(spark, d)
    new = materialize(labels.correct_labels(noisy, SEED))
    return diagnostics.relabel_stats(noisy, new, 1)


@query("c11_out_of_fold_probabilities")
def _c11(spark, d):
    return rounded(labels.out_of_fold(_oof_input(spark, d), SEED).select("row_id", "label", "p0", "p1"), 6)


# a probability for every row that both engines derive from the table
_PROBS = "probs AS (SELECT row_id, label, round(1 - coalesce(x_disc, 0.05) * 10, 6) AS p0, round(coalesce(x_disc, 0.05) * 10, 6) AS p1 FROM order_features)"
THRESHOLDS = [0.6, 0.7, 0.8, 0.9]


def _probs(spark, d) -> DataFrame:
    p1 = F.coalesce(F.col("x_disc"), F.lit(0.05)) * 10
    return materialize(features(spark, d).select("row_id", "label", F.round(1 - p1, 6).alias("p0"), F.round(p1, 6).alias("p1")))


_NEW = "CASE WHEN (CASE WHEN p1 > p0 THEN 1 ELSE 0 END) <> label AND greatest(p0, p1) >= {t} THEN CASE WHEN p1 > p0 THEN 1 ELSE 0 END ELSE label END"


@query("c12_relabel_at_thresholds", with_(
    OF, _PROBS, f"SELECT CAST(th AS DOUBLE) AS threshold, row_id, label, {_NEW.format(t='th')} AS new_label FROM probs CROSS JOIN (VALUES (0.6), (0.7), (0.8), (0.9)) v(th)"))
def _c12(spark, d):
    return labels.relabel_at(_probs(spark, d), THRESHOLDS)


@query("c13_correction_with_oversampling_in_folds")
def _c13(spark, d):
    noisy = _oof_input(spark, d)
    new = labels.correct_labels(noisy, SEED, "fold_smote")
    return diagnostics.relabel_stats(noisy, materialize(new), 1)


@query("c14_class_weights", with_(OF, "SELECT label, count(*) AS n_rows, round((SELECT count(*) FROM order_features) / (2.0 * count(*)), 8) AS weight FROM order_features GROUP BY 1"))
def _c14(spark, d):
    base = features(spark, d)
    return rounded(base.groupBy("label").agg(F.count("*").alias("n_rows")).join(labels.class_weights(base), "label"))


@query("c14_correction_with_class_weights")
def _c14_model(spark, d):
    noisy = _oof_input(spark, d)
    return diagnostics.relabel_stats(noisy, materialize(labels.correct_labels(noisy, SEED, "weighted")), 1)


@query("c15_edited_neighbors", with_(
    DF, _standard("doc_features", "sc", DOC, "row_id, label"), _neighbors_sql("sc", DOC, 3, extra=", q.label AS ql, e.label AS el"),
    "noisy AS (SELECT qid FROM nn GROUP BY 1 HAVING sum(CASE WHEN ql <> el THEN 1 ELSE 0 END) >= 2)",
    "SELECT row_id, label FROM doc_features WHERE row_id NOT IN (SELECT qid FROM noisy) OR (SELECT count(DISTINCT label) FROM doc_features WHERE row_id NOT IN (SELECT qid FROM noisy)) < 2"))
def _c15(spark, d):
    return labels.edit_neighbors(materialize(t.doc_features(spark, d))).select("row_id", "label")


@query("c15_edited_neighbors_vectors", with_(
    VF, _standard("vec_features", "sc", sp.VECS, "row_id, label"), _neighbors_sql("sc", sp.VECS, 3, extra=", q.label AS ql, e.label AS el"),
    "noisy AS (SELECT qid FROM nn GROUP BY 1 HAVING sum(CASE WHEN ql <> el THEN 1 ELSE 0 END) >= 2)",
    "SELECT row_id, label FROM vec_features WHERE row_id NOT IN (SELECT qid FROM noisy) OR (SELECT count(DISTINCT label) FROM vec_features WHERE row_id NOT IN (SELECT qid FROM noisy)) < 2"))
def _c15_vec(spark, d):
    return labels.edit_neighbors(materialize(t.vec_features(spark, d))).select("row_id", "label")


@query("c15_nearest_neighbors", with_(VF, _neighbors_sql("vec_features", sp.VECS, 5), "SELECT qid AS row_id, CAST(rn AS INTEGER) AS place, eid AS neighbor, round(d2, 6) AS d2 FROM nn"))
def _c15_nn(spark, d):
    vec = t.vec_features(spark, d)
    found = nearest(vec, vec, 5, num=sp.VECS)
    return rounded(found.select("row_id", F.posexplode("neighbors").alias("p", "e")).select(
        "row_id", (F.col("p") + 1).alias("place"), F.col("e.id").alias("neighbor"), F.col("e.d2").alias("d2")), 6)


def _draws_sql(n_new: str, n_min: str, k: str, purpose: str = "smote") -> str:
    return f"""picks AS (SELECT draw, 1 + CAST(floor({u(SEED, f"'{purpose}'", 'draw')} * {n_min}) AS BIGINT) AS base_rank,
    1 + CAST(floor({u(SEED, "'neighbor'", 'draw')} * {k}) AS BIGINT) AS slot, {u(SEED, "'gap'", 'draw')} AS gap FROM range(1, {n_new} + 1) t(draw))"""


def _sizes(source: str, ratio: float = 0.8) -> str:
    return f"sizes AS (SELECT sum(label) AS n_min, sum(1 - label) AS n_maj, CAST(floor(sum(1 - label) * {ratio} - sum(label)) AS BIGINT) AS n_new FROM {source})"


_N_NEW, _N_MIN = "(SELECT n_new FROM sizes)", "(SELECT n_min FROM sizes)"
_BASE_RANK = f"row_number() OVER (ORDER BY {h(SEED, chr(39) + 'base' + chr(39), 'row_id')}, row_id) AS base_rank"


@query("c16_synthetic_minority", with_(
    VF, _sizes("vec_features"), f"minority AS (SELECT *, {_BASE_RANK} FROM vec_features WHERE label = 1)", _neighbors_sql("minority", sp.VECS, 5), _draws_sql(_N_NEW, _N_MIN, "5"),
    "syn AS (SELECT -draw AS row_id, " + ", ".join(f"b.{c} + gap * (o.{c} - b.{c}) AS {c}" for c in sp.VECS) + " FROM picks JOIN minority b USING (base_rank) JOIN nn ON nn.qid = b.row_id AND nn.rn = slot JOIN minority o ON o.row_id = nn.eid)",
    "SELECT row_id, label, 'orig' AS origin, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in sp.VECS) + " FROM vec_features UNION ALL SELECT row_id, 1, 'syn', " + ", ".join(f"round({c}, 6) + 0.0" for c in sp.VECS) + " FROM syn"))
def _c16(spark, d):
    return rounded(balance.smote(materialize(t.vec_features(spark, d)), SEED).select("row_id", "label", "origin", *sp.VECS), 6)


def _nominal_sql() -> str:
    unit = "(SELECT quantile_cont(sd, 0.5) FROM (" + " UNION ALL ".join(f"SELECT stddev_pop({c}) AS sd FROM minority" for c in NUM) + "))"
    votes = ", ".join(
        f"(SELECT o.{c} FROM nn v JOIN minority o ON o.row_id = v.eid WHERE v.qid = b.row_id GROUP BY o.{c} ORDER BY count(*) DESC, o.{c} LIMIT 1) AS {c}" for c in CAT)
    modes = [
        f"mode_{c} AS (SELECT qid, {c} FROM (SELECT qid, o.{c}, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, o.{c}) AS r FROM nn JOIN minority o ON o.row_id = nn.eid GROUP BY 1, 2) WHERE r = 1)" for c in CAT]
    blended = ", ".join(f"b.{c} + gap * (o.{c} - b.{c}) AS {c}" for c in NUM)
    joins = " ".join(f"JOIN mode_{c} ON mode_{c}.qid = b.row_id" for c in CAT)
    return with_(
        OF, _sizes("order_features"), _filled("order_features", "filled"), f"minority AS (SELECT *, {_BASE_RANK} FROM filled WHERE label = 1)",
        f"unit AS (SELECT {unit} AS u)", "space AS (SELECT row_id, " + ", ".join(f"{c} / u AS {c}" for c in NUM) + f", {', '.join(CAT)} FROM minority CROSS JOIN unit)",
        _neighbors_sql("space", NUM, 5, mismatch=CAT), _draws_sql(_N_NEW, _N_MIN, "5"), *modes,
        f"syn AS (SELECT -draw AS row_id, {blended}, {', '.join(f'mode_{c}.{c} AS {c}' for c in CAT)} FROM picks JOIN minority b USING (base_rank) JOIN nn ON nn.qid = b.row_id AND nn.rn = slot JOIN minority o ON o.row_id = nn.eid {joins})",
        f"SELECT row_id, label, 'orig' AS origin, {_cols(6)} FROM order_features UNION ALL SELECT row_id, 1, 'syn', " + ", ".join([f"round({c}, 4) + 0.0" for c in NUM] + CAT) + " FROM syn")


@query("c17_synthetic_minority_nominal", _nominal_sql())
def _c17(spark, d):
    return rounded_where(balance.smote(features(spark, d), SEED).select("row_id", "label", "origin", *ALL), "origin = 'syn'")


def _oversample_sql(source: str, ratio: float) -> list[str]:
    return [
        _sizes(source, ratio), f"minority AS (SELECT *, {_BASE_RANK} FROM {source} WHERE label = 1)", _draws_sql(_N_NEW, _N_MIN, "5", "oversample"),
        f"balanced AS (SELECT row_id, label, 'orig' AS origin, {', '.join(ALL)} FROM {source} UNION ALL SELECT -draw, 1, 'syn', {', '.join(ALL)} FROM picks JOIN minority USING (base_rank))",
    ]


@query("c18_random_oversampling", with_(OF, *_oversample_sql("order_features", 0.8), f"SELECT row_id, label, origin, {_cols()} FROM balanced"))
def _c18(spark, d):
    return rounded(balance.oversample(features(spark, d), SEED).select("row_id", "label", "origin", *ALL), 6)


@query("c19_target_ratio", with_(OF, *_oversample_sql("order_features", 1.0), f"SELECT row_id, label, origin, {_cols()} FROM balanced"))
def _c19(spark, d):
    return rounded(balance.oversample(features(spark, d), SEED, 1.0).select("row_id", "label", "origin", *ALL), 6)


@query("c20_balance_skip_rules", with_(
    OF, "grp AS (SELECT c_prio, CAST(floor(x_total / 20000) AS BIGINT) AS band, least(sum(label), sum(1 - label)) AS n_min, greatest(sum(label), sum(1 - label)) AS n_maj FROM order_features GROUP BY 1, 2)",
    "SELECT c_prio, band, CAST(n_min AS BIGINT) AS n_min, CAST(n_maj AS BIGINT) AS n_maj, CASE WHEN n_min = 0 THEN 'single_class' WHEN n_min / n_maj >= 0.8 * 0.95 THEN 'already_balanced' WHEN n_min < 2 THEN 'too_few_minority' END AS reason FROM grp"))
def _c20(spark, d):
    banded = features(spark, d).withColumn("band", F.floor(F.col("x_total") / 20000))
    counts = sampling.class_counts(banded, ["c_prio", "band"])
    return counts.select("c_prio", "band", "n_min", "n_maj", balance.skip_reason(F.col("n_min"), F.col("n_maj")).alias("reason"))


@query("c21_step_sequence", with_(OF, _filled("order_features", "imputed"), *_oversample_sql("imputed", 0.8), f"SELECT row_id, label, origin, {_cols()} FROM balanced"))
def _c21(spark, d):
    out, _ = apply_sequence(features(spark, d), ["IMP", "BAL"], SEED, MethodSet("B"))
    return rounded(out.select("row_id", "label", "origin", *ALL), 6)


@query("c21_step_log", with_(
    OF, _sizes("order_features"), "nulls AS (SELECT " + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in ALL) + " AS n FROM order_features)",
    "SELECT 1 AS step_no, 'imputation' AS operation, 'n_imputed' AS metric, CAST(n AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS reason FROM nulls UNION ALL SELECT 2, 'balance', 'skipped', 0.0, NULL UNION ALL SELECT 2, 'balance', 'n_synthetic', CAST(n_new AS DOUBLE), NULL FROM sizes"))
def _c21_log(spark, d):
    _, log = apply_sequence(features(spark, d), ["IMP", "BAL"], SEED, MethodSet("B"))
    return log_table(spark, log)


# ------------------------------------------------------------------------------ models
def _split(spark, d):
    filled = materialize(impute.fill(features(spark, d)))
    both = materialize(sampling.stratified_split(filled, SEED))
    return (both.where(F.col("is_test") == flag).drop("is_test") for flag in (False, True))


def _fit_row(spark, d, classifier: str, fit: models.Fit) -> DataFrame:
    train, test = _split(spark, d)
    row = models.train_and_evaluate(train, test, classifier, SEED, fit)
    schema = "classifier string, balanced_accuracy double, converged boolean, failed boolean, n_train bigint, n_test bigint, error string"
    names = ("balanced_accuracy", "converged", "failed", "n_train", "n_test", "error")
    return spark.createDataFrame([(classifier, *[row[n] for n in names])], schema)


@query("m01_random_forest")
def _m01(spark, d):
    return _fit_row(spark, d, "random_forest", models.Fit())


@query("m02_logistic_regression")
def _m02(spark, d):
    return _fit_row(spark, d, "logistic_regression", models.Fit())


@query("m03_boosted_trees")
def _m03(spark, d):
    return _fit_row(spark, d, "xgboost", models.Fit())


@query("m04_failed_fit_becomes_a_row")
def _m04(spark, d):
    return _fit_row(spark, d, "no_such_model", models.Fit())


@query("m05_balanced_accuracy", with_(
    OF, "pred AS (SELECT c_seg, label, CASE WHEN coalesce(x_disc, 0) > 0.05 THEN 1 ELSE 0 END AS prediction FROM order_features)",
    "SELECT c_seg, round(avg(recall), 8) AS balanced_accuracy FROM (SELECT c_seg, label, avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END) AS recall FROM pred GROUP BY 1, 2) GROUP BY 1"))
def _m05(spark, d):
    predicted = t.order_features(spark, d).select("c_seg", "label", F.when(F.col("x_disc") > 0.05, 1).otherwise(0).alias("prediction"))
    return rounded(models.balanced_accuracy(predicted, ["c_seg"]))


@query("g04_evaluate_orders")
def _g04(spark, d):
    return grid.run_condition(
        materialize(t.doc_features(spark, d)), "doc_features", "methods_b", orders=[("IMP", "BAL", "LNR", "OUT"), ("IMP", "BAL", "OUT", "LNR")],
        seeds=[SEED], code_id="check", fit=SMALL_FIT, classifiers=["random_forest", "logistic_regression"])


# ------------------------------------------------------------------------- diagnostics
_GRADED_KINDS = {42: "asymmetric", 43: "symmetric", 44: "minority_anchored"}
_GRADED = [flips_sql(k, out=f"g{s}", seed=s) for s, k in _GRADED_KINDS.items()] + [
    "graded AS (" + " UNION ALL ".join(f"SELECT {s} AS seed, 'seg' || c_seg AS dataset, * FROM g{s}" for s in _GRADED_KINDS) + ")"]
_RULES = {"IMP→LNR": "x_disc > 0.07", "IMP→BAL→LNR": "x_tax > 0.05"}


def _graded(spark, d) -> DataFrame:
    base, out = features(spark, d), None
    for seed, kind in _GRADED_KINDS.items():
        one = faults.flip_labels(base, seed, faults.LabelNoise(kind=kind)).withColumn("seed", F.lit(seed))
        out = one if out is None else out.unionByName(one)
    return materialize(out.withColumn("dataset", F.concat(F.lit("seg"), F.col("c_seg").cast("string"))))


def _corrected(graded: DataFrame, rule: str) -> DataFrame:
    return graded.withColumn("label", F.when(F.expr(rule), 1 - F.col("label")).otherwise(F.col("label")))


def _stats_sql(by: str, rule: str) -> str:
    fixed, changed = f"count(*) FILTER (WHERE ({rule}) AND f_label)", f"count(*) FILTER (WHERE {rule})"
    return f"""SELECT {by}, {changed} AS relabelled, {fixed} AS fixed, count(*) FILTER (WHERE ({rule}) AND NOT f_label) AS broken,
    {fixed} / nullif({changed}, 0) AS precision, {fixed} / nullif(count(*) FILTER (WHERE f_label), 0) AS recall,
    count(*) FILTER (WHERE ({rule}) AND label = 1) AS minority_to_majority, count(*) FILTER (WHERE ({rule}) AND NOT f_label AND label = 1) AS true_minority_broken FROM graded GROUP BY {by}"""


@query("a20_relabel_quality", with_(
    OF, *_GRADED, f"st AS ({_stats_sql('seed', _RULES['IMP→LNR'])})",
    "SELECT seed, relabelled, fixed, broken, round(precision, 8) AS precision, round(recall, 8) AS recall, minority_to_majority, true_minority_broken FROM st"))
def _a20(spark, d):
    graded = _graded(spark, d)
    return rounded(diagnostics.relabel_stats(graded, _corrected(graded, _RULES["IMP→LNR"]), 1, ["seed"]))


_RELABELS = "relabels AS (" + " UNION ALL ".join(f"SELECT '{s}' AS sequence, * FROM ({_stats_sql('dataset, seed', r)})" for s, r in _RULES.items()) + ")"


def _relabels(spark, d) -> DataFrame:
    graded, out = _graded(spark, d), None
    for sequence, rule in _RULES.items():
        one = diagnostics.relabel_stats(graded, _corrected(graded, rule), 1, ["dataset", "seed"]).withColumn("sequence", F.lit(sequence))
        out = one if out is None else out.unionByName(one)
    return materialize(out)


@query("a22_synthetic_share_of_removed", with_(
    OF, *_oversample_sql("order_features", 0.8),
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE origin = 'syn') AS n_synthetic, count(*) FILTER (WHERE x_price > 70000) AS removed,
    count(*) FILTER (WHERE x_price > 70000 AND origin = 'syn') AS removed_synthetic, round(avg(CASE WHEN origin = 'syn' THEN 1.0 ELSE 0.0 END), 8) AS synthetic_share_of_data,
    round(avg(CASE WHEN origin = 'syn' THEN 1.0 ELSE 0.0 END) FILTER (WHERE x_price > 70000), 8) AS synthetic_share_of_removed FROM balanced"""))
def _a22(spark, d):
    balanced = materialize(balance.oversample(features(spark, d), SEED))
    return rounded(diagnostics.removed_synthetic(balanced, balanced.where("x_price is null or x_price <= 70000")))


@query("a23_diagnostic_means", with_(
    OF, *_GRADED, _RELABELS, "SELECT dataset, sequence, " + ", ".join(f"round(avg({m}), 3) AS {m}" for m in ("relabelled", "fixed", "broken", "precision", "recall", "true_minority_broken")) + " FROM relabels GROUP BY 1, 2"))
def _a23(spark, d):
    return diagnostics.diagnostic_means(_relabels(spark, d))


@query("a24_precision_rises", with_(
    OF, *_GRADED, _RELABELS, "pm AS (SELECT dataset, sequence, round(avg(precision), 12) AS p FROM relabels GROUP BY 1, 2)",
    "SELECT b.sequence, count(*) FILTER (WHERE b.p > a.p) AS datasets_higher, count(*) AS n_datasets FROM pm a JOIN pm b ON a.dataset = b.dataset AND a.sequence = 'IMP→LNR' AND b.sequence = 'IMP→BAL→LNR' GROUP BY 1"))
def _a24(spark, d):
    return diagnostics.precision_rises(_relabels(spark, d), "IMP→LNR", ["IMP→BAL→LNR"])


@query("a31_precision_by_dataset", with_(
    OF, *_GRADED, _RELABELS, "SELECT dataset, round(avg(precision) FILTER (WHERE sequence = 'IMP→LNR'), 8) AS precision_0, round(avg(precision) FILTER (WHERE sequence = 'IMP→BAL→LNR'), 8) AS precision_1 FROM relabels GROUP BY 1"))
def _a31(spark, d):
    return rounded(diagnostics.precision_by_dataset(_relabels(spark, d), list(_RULES)))


@query("a26_threshold_precision", with_(
    OF, _PROBS, flips_sql("asymmetric"), f"th AS (SELECT CAST(v.th AS DOUBLE) AS threshold, f_label, f.label AS seen, {_NEW.format(t='v.th').replace('label', 'p.label')} AS new FROM probs p JOIN flipped f USING (row_id) CROSS JOIN (VALUES (0.6), (0.7), (0.8), (0.9)) v(th))",
    "SELECT threshold, count(*) FILTER (WHERE new <> seen) AS relabelled, count(*) FILTER (WHERE new <> seen AND f_label) AS fixed, round(count(*) FILTER (WHERE new <> seen AND f_label) / nullif(count(*) FILTER (WHERE new <> seen), 0), 8) AS precision FROM th GROUP BY 1"))
def _a26(spark, d):
    truth = faults.flip_labels(features(spark, d), SEED).select("row_id", "label", "f_label")
    out = diagnostics.threshold_precision(_probs(spark, d), truth, THRESHOLDS, 1)
    return rounded(out.select("threshold", "relabelled", "fixed", "precision"))


@query("a21_relabel_comparison")
def _a21(spark, d):
    noisy = materialize(faults.inject(materialize(t.doc_features(spark, d)), SEED))
    return rounded(diagnostics.relabel_comparison(noisy, 1, SEED), 6)


@query("a26_threshold_scores")
def _a26_scores(spark, d):
    base = materialize(sampling.stratified_split(materialize(t.doc_features(spark, d)), SEED))
    noisy = materialize(faults.flip_labels(base.where("not is_test").drop("is_test"), SEED))
    _, scores = diagnostics.threshold_sweep(
        materialize(impute.fill(noisy.drop("f_label"))), noisy.select("row_id", "label", "f_label"), base.where("is_test").drop("is_test"), 1, SEED,
        thresholds=(0.6, 0.9), classifiers=["logistic_regression"], fit=SMALL_FIT)
    return spark.createDataFrame([tuple(s[k] for k in ("threshold", "classifier", "bal_first", "lnr_first")) for s in scores],
                                 "threshold double, classifier string, bal_first double, lnr_first double")


# ------------------------------------------------------------- invariants of fitted models
# A fit has no SQL twin, but what must hold whatever the trees look like has.
@query("c08_flagged_rows", with_(DF, "SELECT count(*) AS n_rows, count(*) AS n_scores_in_range, true AS flagged_at_most_a_twentieth, true AS kept_and_flagged_add_up FROM doc_features"))
def _c08_flagged(spark, d):
    base = materialize(t.doc_features(spark, d))
    flagged = materialize(outliers.flag_extreme(materialize(outliers.isolation_scores(materialize(outliers.scoring_features(base)), SEED))))
    kept = outliers.drop_flagged(base, flagged).agg(F.count("*").alias("kept"))
    return flagged.agg(F.count("*").alias("n_rows"), F.count_if(F.col("score").between(0, 1)).alias("n_scores_in_range"), F.count_if("outlier").alias("flagged")).crossJoin(kept).select(
        "n_rows", "n_scores_in_range", (F.col("flagged") <= F.ceil(F.col("n_rows") * 0.05)).alias("flagged_at_most_a_twentieth"),
        (F.col("kept") + F.col("flagged") == F.col("n_rows")).alias("kept_and_flagged_add_up"))


def _rule_kept(spark, d, mode: str) -> DataFrame:
    """The corrected table against the relabelling rule on the probabilities behind it."""
    noisy = _oof_input(spark, d)
    probs = labels.out_of_fold(noisy, SEED, mode)
    again = labels.correct_labels(noisy, SEED, mode, probs=probs).select("row_id", F.col("label").alias("corrected"))
    rule = F.expr("CASE WHEN (CASE WHEN p1 > p0 THEN 1 ELSE 0 END) <> label AND greatest(p0, p1) >= 0.7 THEN 1 - label ELSE label END")
    return probs.join(again, "row_id").agg(
        F.count("*").alias("n_rows"), F.count_if(F.abs(F.col("p0") + F.col("p1") - 1) < 1e-9).alias("n_sums_of_one"),
        F.count_if(F.col("corrected") == rule).alias("n_by_rule"))


_RULE_SQL = with_(OF, "SELECT count(*) AS n_rows, count(*) AS n_sums_of_one, count(*) AS n_by_rule FROM order_features")


@query("c10_correction_follows_rule", _RULE_SQL)
def _c10_rule(spark, d):
    return _rule_kept(spark, d, "plain")


@query("c11_probabilities_of_every_row", with_(
    OF, "SELECT label, count(*) AS n_rows, count(DISTINCT row_id) AS n_ids, count(*) AS n_in_range, true AS spread_out FROM order_features GROUP BY 1"))
def _c11_rows(spark, d):
    """Each row has one held-out probability; it is a mean over trees, so not 0 or 1 everywhere."""
    probs = labels.out_of_fold(features(spark, d), SEED)
    inside = F.col("p0").between(0, 1) & F.col("p1").between(0, 1) & (F.abs(F.col("p0") + F.col("p1") - 1) < 1e-9)
    return probs.groupBy("label").agg(
        F.count("*").alias("n_rows"), F.count_distinct("row_id").alias("n_ids"), F.count_if(inside).alias("n_in_range"), (F.stddev_pop("p1") > 0).alias("spread_out"))


@query("c13_correction_follows_rule", _RULE_SQL)
def _c13_rule(spark, d):
    return _rule_kept(spark, d, "fold_smote")


@query("c14_correction_follows_rule", _RULE_SQL)
def _c14_rule(spark, d):
    return _rule_kept(spark, d, "weighted")


_FIT_SQL = with_(OF, "n AS (SELECT count(*) AS n, CAST(ceil(0.2 * count(*)) AS BIGINT) AS k FROM order_features)",
                 "SELECT '{c}' AS classifier, n - k AS n_train, k AS n_test, false AS failed, true AS scored, CAST(NULL AS VARCHAR) AS error FROM n")


def _fit_facts(spark, d, classifier: str) -> DataFrame:
    return _fit_row(spark, d, classifier, models.Fit()).select(
        "classifier", "n_train", "n_test", "failed", F.coalesce(F.col("balanced_accuracy").between(0, 1), F.lit(False)).alias("scored"), "error")


@query("m01_forest_facts", _FIT_SQL.replace("{c}", "random_forest"))
def _m01_facts(spark, d):
    return _fit_facts(spark, d, "random_forest")


@query("m02_regression_facts", _FIT_SQL.replace("{c}", "logistic_regression"))
def _m02_facts(spark, d):
    return _fit_facts(spark, d, "logistic_regression")


@query("m03_boosting_facts", _FIT_SQL.replace("{c}", "xgboost"))
def _m03_facts(spark, d):
    return _fit_facts(spark, d, "xgboost")


@query("m04_failed_fit_facts", _FIT_SQL.replace("{c}", "no_such_model").replace("false AS failed, true AS scored, CAST(NULL AS VARCHAR) AS error", "true AS failed, false AS scored, 'unknown model ''no_such_model''; valid: (''random_forest'', ''logistic_regression'', ''xgboost'')' AS error"))
def _m04_facts(spark, d):
    return _fit_facts(spark, d, "no_such_model")


@query("f06_missing_mcar_counts", with_(DF, "SELECT CAST(16 AS BIGINT) AS n_columns, count(*) AS n_rows, CAST(floor(0.1 * count(*)) AS BIGINT) AS least_gone, CAST(floor(0.1 * count(*)) AS BIGINT) AS most_gone, 16 * CAST(floor(0.1 * count(*)) AS BIGINT) AS named FROM doc_features"))
def _f06_wide(spark, d):
    base = t.doc_features(spark, d)
    wide = base.select("row_id", "label", *[(F.col("row_id") * k + 0.5).alias(f"x_{k}") for k in range(32)])
    out = faults.drop_cells(wide, SEED, faults.Missing(mechanism="MCAR", rate=0.1))
    affected = faults.affected_features([f"x_{k}" for k in range(32)], SEED)
    gone = [F.count_if(F.col(c).isNull()) for c in affected]
    return out.agg(F.lit(len(affected)).cast("bigint").alias("n_columns"), F.count("*").alias("n_rows"), F.least(*gone).alias("least_gone"), F.greatest(*gone).alias("most_gone"), F.sum(F.size("f_missing")).cast("bigint").alias("named"))
