"""Published values and brute-force checks of the statistics."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyorder.functions import distributions
from tidyorder.functions.keyed import draw_hash
from tidyorder.functions.ordering import modes, quantiles, value_ranks
from tidyorder.operators import stats
from tidyorder.plans import analysis

# Fixed published values: permutation p-values of the main condition and their adjustment.
P_PERM = [
    0.00029997, 0.0311969, 0.00339966, 0.70113, 0.0752925, 0.40376, 0.629437, 0.937806, 0.880412, 0.919708,
    9.999e-05, 0.20458, 0.585241, 0.0482952, 0.0140986, 0.890711, 0.619438, 0.00749925, 0.770523, 0.00209979,
    0.00519948, 9.999e-05, 0.0576942, 0.0049995, 9.999e-05, 0.00119988, 0.0129987, 9.999e-05, 9.999e-05, 9.999e-05,
]
P_BH = [
    0.00128559, 0.0584942, 0.010199, 0.841356, 0.118883, 0.576799, 0.786796, 0.937806, 0.937806, 0.937806,
    0.00049995, 0.306869, 0.786796, 0.0852268, 0.0281972, 0.937806, 0.786796, 0.017306, 0.889065, 0.0069993,
    0.0129987, 0.00049995, 0.0961571, 0.0129987, 0.00049995, 0.00449955, 0.0278544, 0.00049995, 0.00049995, 0.00049995,
]
# Fixed published values: rank of rule, regret and random regret, boosted trees.
TRANSFER = [
    (11, 0.847452, 2.42929), (1, 0.0, 1.26469), (8, 0.793651, 1.13591), (21, 2.69823, 1.58006), (7, 1.2381, 2.91964),
    (20, 6.50435, 4.62138), (3, 0.840741, 3.83796), (3, 0.56338, 3.38686), (9, 0.688705, 1.53191), (9, 1.62895, 2.32257),
]

# Fixed published values: mean differences (pp), random forest, and their effect estimate.
RF_DIFFS = [-2.9663, -0.29693, 0.107474, 3.33296, -3.7877, 1.11667, -3.90988, -4.31405, -1.12276, -0.847285]
RF_EFFECT = [1.397, -0.4099, 3.377]


def test_false_discovery_rate_matches_published(spark):
    df = spark.createDataFrame(list(enumerate(P_PERM)), "i int, p double")
    got = [r["p_bh"] for r in stats.benjamini_hochberg(df, "p").orderBy("i").collect()]
    assert np.allclose(got, P_BH, rtol=1e-5)
    assert sum(v < 0.05 for v in got) == 15


def test_step_down_matches_published(spark):
    df = spark.createDataFrame([(0.005859,), (0.009766,), (0.01953,), (None,)], "p double")
    got = {r["p"]: r["p_holm"] for r in stats.holm(df, "p").collect()}
    assert got[None] is None
    assert np.allclose([got[0.005859], got[0.009766], got[0.01953]], [0.01758, 0.01953, 0.01953], rtol=1e-3)


def test_transfer_summary_and_reduction(spark):
    per = spark.createDataFrame(
        [("xgboost", f"d{i}", *row) for i, row in enumerate(TRANSFER)],
        "classifier string, held_out string, rank_of_rule int, regret_pp double, random_regret_pp double",
    )
    row = analysis.transfer_summary(per).first()
    assert (row["n_datasets"], row["median_rank"], row["datasets_rule_beats_random"]) == (10, 8.5, 8)
    assert np.allclose([row["mean_regret_pp"], row["mean_random_regret_pp"]], [1.58036, 2.50303], atol=1e-5)
    test = stats.regret_reduction(per, n_boot=200).first()
    assert test["reduction_pct"] == pytest.approx(36.86, abs=0.01)
    assert test["wilcoxon_p_one_sided"] == pytest.approx(0.06543, abs=1e-5)
    assert test["ci_lo_pct"] < test["reduction_pct"] < test["ci_hi_pct"]


def test_effect_report_matches_published(spark):
    df = spark.createDataFrame([("rf", -d) for d in RF_DIFFS], "k string, d double")
    row = stats.effect_report(df, ["k"], "d").first()
    assert (row["n"], row["positive"]) == (10, 7)
    assert row["wilcoxon_p"] == pytest.approx(0.130859, abs=1e-6)
    assert [row["hl_pp"], row["ci_lo_pp"], row["ci_hi_pp"]] == pytest.approx(RF_EFFECT, abs=2e-3)


def test_no_interval_for_tiny_samples(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 4, 8, 9)], "k string, v double")
    row = stats.hodges_lehmann(df, ["k"], "v").first()
    assert row["ci_lo"] is None and row["ci_hi"] is None and row["hl"] == 5.0


def test_walsh_order_statistics_match_listing():
    d = np.sort(np.random.default_rng(5).normal(size=41))
    walsh = np.sort([(d[i] + d[j]) / 2 for i in range(41) for j in range(i, 41)])
    assert np.allclose([stats._walsh_at(d, k) for k in (1, 7, 430, 861)], walsh[[0, 6, 429, 860]])


def test_tail_probabilities(spark):
    row = spark.range(1).select(
        distributions.chi2_upper(F.lit(100.368), F.lit(23)).alias("chi"),
        distributions.t_two_sided(F.lit(2.776445), F.lit(4)).alias("t"),
        distributions.normal_upper(F.lit(1.959964)).alias("z"),
    ).first()
    assert row["chi"] == pytest.approx(1.21611e-11, rel=1e-3)
    assert row["t"] == pytest.approx(0.05, abs=1e-6)
    assert row["z"] == pytest.approx(0.025, abs=1e-7)


def test_signed_rank_counts_match_listing(spark):
    counts = spark.range(1).select(distributions.signed_rank_counts(F.lit(7)).alias("c")).first()["c"]
    listed = np.bincount([sum(r for r, s in zip(range(1, 8), signs) if s) for signs in itertools.product([0, 1], repeat=7)])
    assert counts == listed.tolist()


def runs(spark, seeds=6, groups=3):
    rng = np.random.default_rng(4)
    rows = [
        (f"d{g}", "c", s, o, float(np.round(0.7 + 0.05 * rng.normal() + (0.1 if o == "A→B" else 0), 6)), False)
        for g in range(groups) for s in range(seeds) for o in ("A→B", "B→A", "A", "B")
    ]
    return spark.createDataFrame(rows, "dataset string, classifier string, seed int, cleaning_order string, balanced_accuracy double, failed boolean")


def test_groups_with_many_seeds_are_split_and_agree(spark, monkeypatch):
    table = runs(spark)
    whole = sorted(stats.permutation_test(table, draws=300).collect())
    monkeypatch.setattr(stats, "SEEDS_PER_TASK", 2)
    split = sorted(stats.permutation_test(table, draws=300).collect())
    for a, b in zip(whole, split, strict=True):
        assert a["p_osi"] == b["p_osi"] and a["p_gap"] == b["p_gap"]
        assert a["osi_null"] == pytest.approx(b["osi_null"], abs=1e-12)


def test_permutation_agrees_with_independent_shuffles(spark):
    table = runs(spark)
    draws, rng = 20_000, np.random.default_rng(0)
    got = {r["dataset"]: r for r in stats.permutation_test(table, draws=draws).collect()}
    for name, cells in table.toPandas().groupby("dataset"):
        x = cells.pivot(index="cleaning_order", columns="seed", values="balanced_accuracy").to_numpy()
        place = rng.random((draws, *x.shape)).argsort(axis=1)
        means = np.take_along_axis(np.broadcast_to(x, place.shape), place, axis=1).mean(axis=2)
        null = (means.max(axis=1) - means.min(axis=1)) / means.max(axis=1)
        p = (1 + (null >= got[name]["osi"] - 1e-12).sum()) / (draws + 1)
        assert got[name]["osi_null"] == pytest.approx(null.mean(), abs=6 * null.std() / np.sqrt(draws))
        assert got[name]["p_osi"] == pytest.approx(p, abs=6 * np.sqrt(p * (1 - p) / draws))


def test_shuffles_are_uniform():
    place = np.arange(4, dtype=np.int64)
    counter = np.arange(240_000, dtype=np.int64)[:, None] * 4 + place
    orders = np.argsort(draw_hash(counter, 12345), axis=1, kind="stable") @ (4**place)
    seen = np.unique(orders, return_counts=True)[1]
    assert len(seen) == 24 and ((seen - 10_000) ** 2 / 10_000).sum() < 60


def test_quantiles_ranks_and_modes_with_a_hot_value(spark):
    rng = np.random.default_rng(6)
    values = np.round(rng.normal(size=600) * 10.0 ** rng.integers(-3, 6, 600), 3)
    values[::3] = 0.0
    df = spark.createDataFrame([("g", float(v), int(abs(v)) % 4) for v in values], "g string, x double, c int")
    got = quantiles(df, ["x"], [0.0, 0.05, 0.5, 0.9, 1.0]).first()["q_x"]
    assert np.allclose(got, np.quantile(values, [0.0, 0.05, 0.5, 0.9, 1.0]))
    ranks = {r["x"]: r["avg_rank"] for r in value_ranks(df, ["g"], "x").collect()}
    order = np.sort(values)
    assert all(ranks[v] == (np.searchsorted(order, v) + np.searchsorted(order, v, "right") + 1) / 2 for v in set(values))
    codes = np.abs(values).astype(int) % 4
    assert modes(df, ["c"]).first()["m_c"] == np.bincount(codes).argmax()


def test_duplicate_and_missing_cells_are_errors(spark):
    table = runs(spark)
    with pytest.raises(ValueError, match="duplicate"):
        analysis.seed_matrix(table.unionByName(table.limit(1)), range(6))
    with pytest.raises(ValueError, match="missing"):
        analysis.seed_matrix(table.where("not (seed = 1 and cleaning_order = 'A' and dataset = 'd1')"), range(6))


def test_interval_of_a_large_sample_follows_alpha(spark):
    values = [((k * 7919) % 1000) / 10 - 40 for k in range(400)]
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    wide, narrow, normal = (stats.hodges_lehmann(df, ["g"], "v", **how).first() for how in ({"alpha": 0.01}, {"alpha": 0.5}, {"alpha": 0.01, "method": "normal"}))
    assert wide.ci_lo < narrow.ci_lo < narrow.hl < narrow.ci_hi < wide.ci_hi
    assert abs(wide.ci_lo - normal.ci_lo) < 0.5 and wide.hl == normal.hl


def test_tails_of_large_groups_converge():
    import pytest

    from tidyorder.functions import distributions as d

    assert d._beta_tail(5e6, 5e6, 0.5) == pytest.approx(0.5, abs=1e-6)
    assert d._gamma_tail(4e6, 4e6) == pytest.approx(0.5, abs=1e-3)


def _exact(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


@pytest.mark.parametrize("in_bracket", [1_000_000, 50])
def test_quantiles_equal_sorting(spark, monkeypatch, in_bracket):
    """Also with brackets so large that they are cut again, with ties, a hot value and gaps."""
    from tidyorder.functions import ordering

    monkeypatch.setattr(ordering, "_IN_BRACKET", in_bracket)
    if in_bracket == 50:
        monkeypatch.setattr(ordering, "_ACCURACY", 30)
    rng = np.random.default_rng(8)
    rows = [
        (int(g), float(rng.normal()), None if k % 7 == 0 else float(1.7e9 + k), 5.0 if k % 3 else float(k), float(10.0 ** rng.integers(-300, 300)) * (-1) ** k)
        for g in range(2) for k in range(1200)
    ]
    rows.append((0, None, 0.0, None, None))
    df = spark.createDataFrame(rows, "fold int, a double, b double, c double, d double").repartition(5)
    probs = [0.0, 0.05, 0.5, 1.0]
    for by in ([], ["g"]):
        frame = df.withColumnRenamed("fold", "g") if by == ["g"] else df
        for r in quantiles(frame, ["a", "b", "c", "d"], probs, by).collect():
            for j, c in enumerate("abcd", start=1):
                values = [x[j] for x in rows if x[j] is not None and (not by or x[0] == r[by[0]])]
                for q, p in zip(r[f"q_{c}"], probs):
                    assert q == pytest.approx(_exact(values, p), rel=1e-12)
    assert quantiles(df.where("a is null").drop("b"), ["a"], [0.5]).first()["q_a"] is None
    assert quantiles(df.where("false"), ["a"], [0.5]).first()["q_a"] is None


def test_times_beside_a_zero_are_spread(spark):
    """A million-fold gap between one value and the rest leaves no bucket with them all."""
    from tidyorder.functions.ordering import _bucketed

    times = spark.range(40_000).select((F.col("id") + 1_700_000_000).cast("double").alias("v"))
    for odd in (0.0, 1_600_000_000.0):
        most = _bucketed(times.union(spark.createDataFrame([(odd,)], "v double")), "v").groupBy("_bucket").count().agg(F.max("count")).first()[0]
        assert most <= 400


def test_rank_correlation_of_a_side_with_one_value_is_null(spark):
    rows = [("flat", float(i), 2.0) for i in range(4)] + [("one", 1.0, 1.0)] + [("varied", x, y) for x, y in ((1.0, 1.0), (2.0, 4.0), (4.0, 3.0))]
    got = {r["g"]: r for r in stats.spearman(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    assert {g: r["n"] for g, r in got.items()} == {"flat": 4, "one": 1, "varied": 3}
    assert got["flat"]["rho"] is None and got["flat"]["p"] is None and got["one"]["rho"] is None
    assert got["varied"]["rho"] == pytest.approx(0.5)
    assert stats.spearman(spark.createDataFrame(rows[:4], "g string, x double, y double"), [], "x", "y").first()["rho"] is None
