"""Statistics over grouped samples. Every function serves all groups (`by`) in one job."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyorder.functions.distributions import chi2_upper, normal_upper, signed_rank_counts, t_two_sided
from tidyorder.functions.keyed import draw_hash, group_code
from tidyorder.functions.ordering import cumulative_counts, running_extreme, value_ranks
from tidyorder.operators.sampling import bootstrap_slots
from tidyorder.session import parallel_tasks

PAIR = ("dataset", "classifier")
SCORE = "balanced_accuracy"
EXACT_LIMIT = 50
SEEDS_PER_TASK = 512
DRAWS_PER_TASK = 1000
TIE_SLACK = 1e-12


def _grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A constant group stands in when there is none, so one code path serves both."""
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


# ------------------------------------------------------------- order sensitivity
def order_means(runs: DataFrame, by: Sequence[str] = PAIR) -> DataFrame:
    """Mean, deviation and size per order. Means are rounded to 12 digits so that equal
    means tie whatever the summation order."""
    return runs.groupBy(*by, "cleaning_order").agg(
        F.round(F.avg(SCORE), 12).alias("mean"), F.stddev_samp(SCORE).alias("sd"), F.count("*").alias("n_seeds")
    )


def best_and_worst(means: DataFrame, by: Sequence[str] = PAIR) -> DataFrame:
    """Best and worst order per group; ties go to the first order in string order."""
    picked = means.groupBy(*by).agg(
        F.min(F.struct((-F.col("mean")).alias("k"), "cleaning_order", "mean", "sd")).alias("b"),
        F.min(F.struct("mean", "cleaning_order", "sd")).alias("w"),
        F.count("*").alias("n_orderings"),
        F.max("n_seeds").alias("n_seeds"),
    )
    return picked.select(
        *by,
        "n_orderings",
        "n_seeds",
        F.col("b.cleaning_order").alias("best_order"),
        F.col("b.mean").alias("best_mean"),
        F.col("b.sd").alias("best_sd"),
        F.col("w.cleaning_order").alias("worst_order"),
        F.col("w.mean").alias("worst_mean"),
        F.col("w.sd").alias("worst_sd"),
    )


def osi_expr(best: str = "best_mean", worst: str = "worst_mean", guarded: bool = True) -> Column:
    """(best - worst) / best; guarded: 0 where best <= 0."""
    ratio = F.try_divide(F.col(best) - F.col(worst), F.col(best))
    return F.when(F.col(best) > 0, ratio).otherwise(0.0) if guarded else ratio


def osi_summary(runs: DataFrame, by: Sequence[str] = PAIR) -> DataFrame:
    """Order sensitivity per group with its best and worst order; failed runs left out."""
    ok = runs.where(~F.col("failed")) if "failed" in runs.columns else runs
    return best_and_worst(order_means(ok, by), by).select(
        "*",
        osi_expr().alias("osi"),
        (100 * osi_expr()).alias("osi_pct"),
        (100 * (F.col("best_mean") - F.col("worst_mean"))).alias("gap_pp"),
    )


# ------------------------------------------------------------ permutation of orders
def _score_rows(runs: DataFrame, by: list[str]) -> DataFrame:
    """Per group and chunk of seeds: score vectors (orders sorted), at most
    SEEDS_PER_TASK seeds each, with the group's observed extremes."""
    vectors = runs.groupBy(*by, "seed").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cleaning_order", SCORE))), lambda c: c[SCORE]).alias("row")
    )
    by_seed = Window.partitionBy(*by).orderBy("seed")
    numbered = vectors.select(
        *by,
        "row",
        (F.row_number().over(by_seed) - 1).alias("at"),
        F.count("*").over(Window.partitionBy(*by)).alias("n_seeds"),
    )
    chunks = numbered.groupBy(*by, "n_seeds", F.floor(F.col("at") / SEEDS_PER_TASK).alias("chunk")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "row"))), lambda c: c["row"]).alias("rows")
    )
    observed = runs.groupBy(*by, "cleaning_order").agg(F.avg(SCORE).alias("m")).groupBy(*by).agg(
        F.max("m").alias("best"), F.min("m").alias("worst"), F.count("*").alias("n_orderings")
    )
    return chunks.join(observed, by)


def _shuffled_sums(rows, first: int, n_seeds: int, group: int, draws: np.ndarray) -> np.ndarray:
    """(draws, orders) score sums after shuffling orders within each seed."""
    x = np.stack(rows)
    seeds, orders = x.shape
    sums = np.zeros((len(draws), orders))
    place = np.arange(orders, dtype=np.int64)
    for i in range(seeds):
        counter = ((draws[:, None] * n_seeds + first + i) * orders + place) % (2**62)
        sums += x[i][np.argsort(draw_hash(counter, group), axis=1, kind="stable")]
    return sums


def permutation_test(runs: DataFrame, by: Sequence[str] = PAIR, draws: int = 10_000) -> DataFrame:
    """Permutation test of the order sensitivity and of the plain best-worst gap.

    Order labels are shuffled within each seed. A task handles blocks of draws of a group: the
    chunks of its seeds come one after another, their sums are added in place, and each block
    leaves one row. Draws never become rows.
    """
    runs, by = _grouped(runs, by)
    blocks = _score_rows(runs, by).withColumn("_g", group_code(*by)).withColumn(
        "_first_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(DRAWS_PER_TASK)))
    )
    key = [*by, "_first_draw"]
    ordered = blocks.repartition(4 * parallel_tasks(runs.sparkSession), *key).sortWithinPartitions(*key, "chunk")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.select(*by).schema)
    kept = [*by, "n_orderings", "n_seeds", "best", "worst"]
    kept_schema = f"{kinds}, n_orderings bigint, n_seeds bigint, best double, worst double"

    def block_row(head: dict, sums: np.ndarray) -> dict:
        means = sums / head["n_seeds"]
        hi, lo = means.max(axis=1), means.min(axis=1)
        usable = hi != 0
        ratio = (hi[usable] - lo[usable]) / hi[usable]
        best, worst = head["best"], head["worst"]
        reached = int((ratio >= (best - worst) / best - TIE_SLACK).sum()) if best else 0
        return {**{c: head[c] for c in kept}, "s": float(ratio.sum()), "a": reached, "b": int((hi - lo >= best - worst - TIE_SLACK).sum())}

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, sums, done = None, None, []
        for batch in batches:
            for row in batch.to_dict("records"):
                numbers = np.arange(row["_first_draw"], min(row["_first_draw"] + DRAWS_PER_TASK, draws), dtype=np.int64)
                part = _shuffled_sums(row["rows"], int(row["chunk"]) * SEEDS_PER_TASK, int(row["n_seeds"]), int(row["_g"]), numbers)
                if head is not None and all(row[c] == head[c] for c in key):
                    sums += part
                    continue
                if head is not None:
                    done.append(block_row(head, sums))
                head, sums = row, part
            if done:
                yield pd.DataFrame(done)
                done = []
        if head is not None:
            yield pd.DataFrame([block_row(head, sums)])

    total = ordered.mapInPandas(add_up, f"{kept_schema}, s double, a bigint, b bigint").groupBy(*kept).agg(
        F.sum("s").alias("s"), F.sum("a").alias("a"), F.sum("b").alias("b")
    )
    return total.select(
        *[c for c in by if c != "_all"],
        "n_orderings",
        "n_seeds",
        osi_expr("best", "worst", False).alias("osi"),
        (F.col("s") / draws).alias("osi_null"),
        ((1 + F.col("a")) / (draws + 1)).alias("p_osi"),
        (F.col("best") - F.col("worst")).alias("gap"),
        ((1 + F.col("b")) / (draws + 1)).alias("p_gap"),
    )


def resample_seeds(runs: DataFrame, by: Sequence[str] = PAIR, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Seed bootstrap: (by, boot, seed = slot, cleaning_order, score) with seeds drawn with replacement."""
    by = list(by)
    seeds = runs.select(*by, "seed").distinct().select(
        *by,
        "seed",
        (F.row_number().over(Window.partitionBy(*by).orderBy("seed")) - 1).cast("bigint").alias("pick"),
    )
    sizes = seeds.groupBy(*by).agg(F.count("*").alias("size"))
    slots = bootstrap_slots(sizes, by, "size", n_boot, seed)
    picked = slots.join(seeds, [*by, "pick"]).select(*by, "boot", "slot", "seed")
    return picked.join(runs.select(*by, "seed", "cleaning_order", SCORE), [*by, "seed"]).select(
        *by, "boot", F.col("slot").alias("seed"), "cleaning_order", SCORE
    )


def bootstrap_osi(runs: DataFrame, by: Sequence[str] = PAIR, n_boot: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of the order sensitivity under seed resampling."""
    resampled = resample_seeds(runs, by, n_boot, seed)
    means = resampled.groupBy(*by, "boot", "cleaning_order").agg(F.avg(SCORE).alias("mean"))
    each = means.groupBy(*by, "boot").agg(F.max("mean").alias("best_mean"), F.min("mean").alias("worst_mean"))
    low = (1 - level) / 2
    return each.groupBy(*by).agg(  # n_boot values per group
        F.percentile(osi_expr(), F.lit(low)).alias("ci_lo"), F.percentile(osi_expr(), F.lit(1 - low)).alias("ci_hi")
    )


def excess_interval(
    runs: DataFrame, by: Sequence[str] = PAIR, n_boot: int = 1000, boot_draws: int = 1000, draws: int = 10_000, seed: int = 42
) -> DataFrame:
    """Order sensitivity beyond chance with its seed-bootstrap interval; each resample gets
    its own permutation null. All resamples of all groups are one permutation job."""
    by = list(by)
    main = permutation_test(runs, by, draws)
    nested = permutation_test(resample_seeds(runs, by, n_boot, seed), [*by, "boot"], boot_draws)
    excess = F.col("osi") - F.col("osi_null")
    bounds = nested.groupBy(*by).agg(
        F.percentile(excess, F.lit(0.025)).alias("lo"), F.percentile(excess, F.lit(0.975)).alias("hi")
    )
    return main.join(bounds, by).select(
        *by,
        (100 * excess).alias("delta_osi_pct"),
        (100 * F.col("lo")).alias("ci_lo_pct"),
        (100 * F.col("hi")).alias("ci_hi_pct"),
        "p_osi",
        "p_gap",
    )


# ------------------------------------------------------------------ rank-based tests
def friedman(runs: DataFrame, by: Sequence[str] = PAIR) -> DataFrame:
    """Tie-corrected Friedman chi-square with seeds as blocks, p and Kendall's W (NULL if all tied)."""
    block = Window.partitionBy(*by, "seed")
    ranked = runs.select(
        *by,
        "seed",
        "cleaning_order",
        F.rank().over(block.orderBy(SCORE)).alias("r"),
        F.count("*").over(Window.partitionBy(*by, "seed", SCORE)).alias("t"),
    )
    per_order = ranked.groupBy(*by, "cleaning_order").agg(
        F.sum(F.col("r") + (F.col("t") - 1) / 2).alias("rank_sum"),
        F.sum(F.col("t") * F.col("t") - 1).alias("ties"),
        F.count("*").alias("s"),
    )
    sums = per_order.groupBy(*by).agg(
        F.sum(F.col("rank_sum") * F.col("rank_sum")).alias("ss"),
        F.sum("ties").alias("ties"),
        F.max("s").cast("double").alias("s"),
        F.count("*").cast("double").alias("k"),
    )
    s, k = F.col("s"), F.col("k")
    correction = 1 - F.col("ties") / (s * (k * k * k - k))
    raw = 12 / (s * k * (k + 1)) * F.col("ss") - 3 * s * (k + 1)
    out = sums.withColumn("friedman_chi2", F.when(correction > 0, raw / correction))
    return out.select(
        *by,
        "friedman_chi2",
        chi2_upper(F.col("friedman_chi2"), k - 1).alias("friedman_p"),
        (F.col("friedman_chi2") / (s * (k - 1))).alias("kendall_w"),
    )


def wilcoxon(
    df: DataFrame, by: Sequence[str], value: str, alternative: str = "two-sided", method: str = "auto"
) -> DataFrame:
    """Signed-rank test per group: n, w_plus, p. Zeros are dropped.

    method: "exact" uses the exact law wherever there are no ties or zeros, "approx" the
    tie-corrected normal approximation, and "auto", the usual default, the exact law for up
    to EXACT_LIMIT values without ties or zeros and else the approximation.
    """
    if method not in ("auto", "exact", "approx"):
        raise ValueError(f"unknown method {method!r}; valid: auto, exact, approx")
    frame, by = _grouped(df, by)
    frame = frame.where(F.col(value).isNotNull()).select(
        *by, F.abs(value).alias("_size"), (F.col(value) > 0).cast("int").alias("_pos")
    )
    counted = cumulative_counts(frame, by, "_size", {"ties": F.lit(1), "pos": F.col("_pos")})
    zero = F.col("_size") == 0
    rank = F.col("ties_below") + (F.col("ties") + 1) / 2
    sums = counted.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(zero, F.col("ties"))), F.lit(0)).alias("zeros"),
        F.coalesce(F.sum(F.when(~zero, F.col("ties"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("positive"),
        F.coalesce(F.sum(F.col("pos") * rank), F.lit(0.0)).alias("w"),
        F.coalesce(F.max(F.when(~zero, F.col("ties"))), F.lit(0)).alias("most"),
        F.coalesce(F.sum(F.when(~zero, F.col("ties") * F.col("ties") * F.col("ties") - F.col("ties"))), F.lit(0)).alias("tie_term"),
    ).withColumn("w_plus", F.col("w") - F.col("zeros") * F.col("positive"))
    n = F.col("n").cast("double")
    exact = (F.col("n") > 0) & (F.col("most") <= 1) & (F.col("zeros") == 0) & F.lit(method != "approx")
    if method == "auto":
        exact = exact & (F.col("n") <= EXACT_LIMIT)
    sums = sums.withColumn("exact", exact).withColumn(
        "_counts", F.when(F.col("exact"), signed_rank_counts(F.when(F.col("exact"), F.col("n")).cast("int")))
    )
    patterns = F.pow(F.lit(2.0), n)
    at = F.col("w_plus").cast("int")

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda a, b: a + b) / patterns

    lower = total(F.slice("_counts", F.lit(1), at + 1))
    upper = total(F.slice("_counts", at + 1, F.size("_counts")))
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("tie_term") / 2) / 24)
    z = F.when(F.col("n") > 0, z)
    if alternative == "greater":
        exact_p, approx_p = upper, normal_upper(z)
    else:
        exact_p, approx_p = F.least(F.lit(1.0), 2 * F.least(lower, upper)), 2 * normal_upper(F.abs(z))
    return sums.select(
        *[c for c in by if c != "_all"], "n", "positive", "w_plus", F.when(F.col("exact"), exact_p).otherwise(approx_p).alias("p")
    )


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Spearman correlation of average ranks with its two-sided t p-value; both are NULL where a
    side has one value only."""
    frame, by = _grouped(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by)
    varied = frame.groupBy(*by).agg(((F.min(x) < F.max(x)) & (F.min(y) < F.max(y))).alias("_varied"))
    rx = value_ranks(frame, by, x).select(*by, x, F.col("avg_rank").alias("_rx"))
    ry = value_ranks(frame, by, y).select(*by, y, F.col("avg_rank").alias("_ry"))
    ranked = frame.select(*by, x, y).join(rx, [*by, x]).join(ry, [*by, y]).join(varied, by)
    # corr divides by zero where a side does not vary; it passes over NULLs
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr(F.when(F.col("_varied"), F.col("_rx")), "_ry").alias("rho"))
    spread = F.greatest(F.lit(0.0), 1 - F.col("rho") * F.col("rho"))
    t = F.when(spread > 0, F.col("rho") * F.sqrt((F.col("n") - 2) / spread))
    p = F.when(F.abs("rho") >= 1, F.lit(0.0)).otherwise(t_two_sided(t, F.col("n") - 2))
    return out.select(*[c for c in by if c != "_all"], "n", "rho", p.alias("p"))


def cliffs_delta(df: DataFrame, by: Sequence[str], value: str, first: Column) -> DataFrame:
    """Share of (first, other) pairs with first greater minus the share with first smaller,
    from ranks; no pairs are formed."""
    frame, by = _grouped(df, by)
    frame = frame.select(*by, value, first.cast("int").alias("_a"))
    counted = cumulative_counts(frame, by, value, {"a": F.col("_a"), "b": 1 - F.col("_a")})
    sums = counted.groupBy(*by).agg(
        F.sum("a").alias("na"),
        F.sum("b").alias("nb"),
        F.sum(F.col("a") * F.col("b_below")).alias("wins"),
        F.sum(F.col("a") * (F.col("b_below") + F.col("b"))).alias("not_lost"),
    )
    lost = F.col("na") * F.col("nb") - F.col("not_lost")
    return sums.select(
        *[c for c in by if c != "_all"], ((F.col("wins") - lost) / (F.col("na") * F.col("nb"))).alias("cliffs_delta")
    )


# -------------------------------------------------------------------------- t tests
def t_test(df: DataFrame, by: Sequence[str], diff: str) -> DataFrame:
    """One-sample / paired t-test of mean 0: n, mean_diff, t, p, cohens_d (0 if no spread)."""
    stats = df.groupBy(*by).agg(
        F.count(diff).alias("n"), F.avg(diff).alias("mean_diff"), F.stddev_samp(diff).alias("sd")
    )
    spread = F.col("sd") > 1e-12
    t = F.when(spread, F.col("mean_diff") / (F.col("sd") / F.sqrt("n")))
    return stats.withColumn("t", t).select(
        *by,
        "n",
        "mean_diff",
        "t",
        t_two_sided(F.col("t"), F.col("n") - 1).alias("p"),
        F.when(spread, F.col("mean_diff") / F.col("sd")).otherwise(0.0).alias("cohens_d"),
    )


def paired_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """a - b over the keys both sides have."""
    left = a.select(*keys, F.col(value).alias("_a"))
    return left.join(b.select(*keys, F.col(value).alias("_b")), list(keys)).select(
        *keys, (F.col("_a") - F.col("_b")).alias("diff")
    )


# --------------------------------------------------------------- multiple testing
def _adjusted(df: DataFrame, p: str, out: str, by: Sequence[str], method: str) -> DataFrame:
    frame, by = _grouped(df, by)
    counted = cumulative_counts(frame, by, p, {"ties": F.lit(1)})
    sizes = counted.groupBy(*by).agg(F.sum("ties").alias("_n"))
    counted = counted.join(sizes, by)
    if method == "bh":
        raw = F.least(F.lit(1.0), F.col(p) * F.col("_n") / (F.col("ties_below") + F.col("ties")))
        steps = running_extreme(counted.withColumn("_raw", raw), by, p, "_raw", "min", out)
    else:
        raw = F.least(F.lit(1.0), F.col(p) * (F.col("_n") - F.col("ties_below")))
        steps = running_extreme(counted.withColumn("_raw", raw), by, p, "_raw", "max", out)
    return frame.join(steps.select(*by, p, out), [*by, p], "left").select(*df.columns, out)


def benjamini_hochberg(df: DataFrame, p: str, out: str = "p_bh", by: Sequence[str] = (), null_as_one: bool = False) -> DataFrame:
    """False-discovery-rate adjustment. NULL p-values stay NULL and do not count, or with
    `null_as_one` count as 1."""
    if not null_as_one:
        return _adjusted(df, p, out, by, "bh")
    filled = _adjusted(df.withColumn("_p", F.coalesce(F.col(p), F.lit(1.0))), "_p", out, by, "bh")
    return filled.drop("_p")


def holm(df: DataFrame, p: str, out: str = "p_holm", by: Sequence[str] = ()) -> DataFrame:
    """Holm step-down adjustment."""
    return _adjusted(df, p, out, by, "holm")


# ------------------------------------------------------------------ effect sizes
def _walsh_at(d: np.ndarray, k: int) -> float:
    """k-th smallest (1-based) mean of two sorted values, i <= j, without forming the pairs."""
    n, place = len(d), np.arange(len(d))
    low, high = d[0], d[-1]

    def count(x: float) -> int:
        return int(np.maximum(np.searchsorted(d, 2 * x - d, side="right") - place, 0).sum())

    if count(low) >= k:
        return float(low)
    while True:
        mid = low + (high - low) / 2
        if mid <= low or mid >= high:
            break
        low, high = (low, mid) if count(mid) >= k else (mid, high)
    return float(high)


def _signed_rank_quantile(n: int, q: float) -> int:
    """Smallest w with P(W <= w) > q for the signed-rank sum of n values, by its exact law."""
    law = np.zeros(n * (n + 1) // 2 + 1)
    law[0] = 1.0
    for r in range(1, n + 1):
        law[r:] += law[:-r].copy()
        law *= 0.5
    return int(np.searchsorted(np.cumsum(law), q, side="right"))


def _hl(values: np.ndarray, alpha: float, method: str) -> tuple[float, float | None, float | None]:
    d = np.sort(values.astype(float))
    n = len(d)
    m = n * (n + 1) // 2
    estimate = (_walsh_at(d, (m + 1) // 2) + _walsh_at(d, m // 2 + 1)) / 2
    if method == "exact":
        k = _signed_rank_quantile(n, alpha / 2)
    else:
        z = NormalDist().inv_cdf(1 - alpha / 2)
        k = int(n * (n + 1) / 4 - z * np.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    if k < 1:
        return estimate, None, None
    return estimate, _walsh_at(d, k), _walsh_at(d, m - k + 1)


def hodges_lehmann(
    df: DataFrame, by: Sequence[str], value: str, alpha: float = 0.05, method: str = "exact"
) -> DataFrame:
    """Median of pairwise means with the signed-rank interval; NULL bounds where none exists.

    The sample is one difference per dataset. Order statistics of the pairwise means
    come from counting, so their memory stays linear in the sample. The rank of the bounds
    comes from the exact law of the signed-rank sum, whose work grows with the cube of the
    sample, or with method="normal" from its normal approximation, whatever the size.
    """
    if method not in ("exact", "normal"):
        raise ValueError(f"unknown method {method!r}; valid: exact, normal")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema)

    def estimate(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        point, low, high = _hl(part[value].to_numpy(), alpha, method)
        return pd.DataFrame([[*key, point, low, high]], columns=[*by, "hl", "ci_lo", "ci_hi"])

    return df.where(F.col(value).isNotNull()).select(*by, value).groupBy(*by).applyInPandas(
        estimate, f"{schema}, hl double, ci_lo double, ci_hi double"
    )


def effect_report(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, positives, Hodges-Lehmann estimate and interval, signed-rank p per group."""
    counts = df.groupBy(*by).agg(F.count(value).alias("n"), F.count_if(F.col(value) > 0).alias("positive"))
    return (
        counts.join(hodges_lehmann(df, by, value), list(by))
        .join(wilcoxon(df, by, value).select(*by, F.col("p").alias("wilcoxon_p")), list(by))
        .select(*by, "n", "positive", F.col("hl").alias("hl_pp"), F.col("ci_lo").alias("ci_lo_pp"),
                F.col("ci_hi").alias("ci_hi_pp"), "wilcoxon_p")
    )


def regret_reduction(per: DataFrame, n_boot: int = 10_000, seed: int = 2026) -> DataFrame:
    """1 - mean regret / mean random regret per classifier, with a dataset-bootstrap interval
    and the one-sided signed-rank p."""
    by = ["classifier"]
    numbered = per.select(
        *by,
        "regret_pp",
        "random_regret_pp",
        (F.row_number().over(Window.partitionBy(*by).orderBy("held_out")) - 1).cast("bigint").alias("pick"),
    )
    point = per.groupBy(*by).agg(
        (100 * (1 - F.avg("regret_pp") / F.avg("random_regret_pp"))).alias("reduction_pct"), F.count("*").alias("size")
    )
    slots = bootstrap_slots(point.select(*by, "size"), by, "size", n_boot, seed)
    boots = slots.join(numbered, [*by, "pick"]).groupBy(*by, "boot").agg(
        (100 * (1 - F.avg("regret_pp") / F.avg("random_regret_pp"))).alias("r")
    )
    bounds = boots.groupBy(*by).agg(  # n_boot values per classifier
        F.percentile("r", F.lit(0.025)).alias("ci_lo_pct"), F.percentile("r", F.lit(0.975)).alias("ci_hi_pct")
    )
    gain = per.select(*by, (F.col("random_regret_pp") - F.col("regret_pp")).alias("gain"))
    p = wilcoxon(gain, by, "gain", "greater").select(*by, F.col("p").alias("wilcoxon_p_one_sided"))
    return point.drop("size").join(bounds, by).join(p, by)


# -------------------------------------------------------------------- legacy report
def selected_extremes_report(runs: DataFrame, by: Sequence[str] = PAIR, n_boot: int = 1000) -> DataFrame:
    """Legacy: tests best against worst order after choosing them from the same scores.

    The choice inflates the effect, so these p-values are not valid; kept for comparison
    with older tables only. Use `permutation_test`.
    """
    by = list(by)
    groups = runs.select(*by).distinct()
    ok = runs.where(~F.col("failed") & F.col(SCORE).isNotNull())
    extremes = osi_summary(ok, by)
    chosen = ok.join(extremes.select(*by, "best_order", "worst_order"), by)
    best = chosen.where(F.col("cleaning_order") == F.col("best_order"))
    worst = chosen.where(F.col("cleaning_order") == F.col("worst_order"))
    diffs = paired_differences(best, worst, [*by, "seed"], SCORE)
    pooled = chosen.where(
        (F.col("cleaning_order") == F.col("best_order")) | (F.col("cleaning_order") == F.col("worst_order"))
    )
    delta = cliffs_delta(pooled, by, SCORE, F.col("cleaning_order") == F.col("best_order"))
    rank = wilcoxon(diffs, by, "diff").select(*by, F.col("p").alias("wilcoxon_p"))
    test = t_test(diffs, by, "diff").select(*by, F.col("p").alias("p_value"), "t", "cohens_d")
    bounds = bootstrap_osi(ok, by, n_boot)
    report = groups.join(extremes, by, "left").join(test, by, "left").join(delta, by, "left").join(rank, by, "left").join(bounds, by, "left")
    return report.select(
        *by, "osi_pct", "best_order", "best_mean", "worst_order", "worst_mean", "gap_pp", "t", "p_value",
        "cohens_d", "cliffs_delta", "wilcoxon_p", (100 * F.col("ci_lo")).alias("osi_ci_lower"),
        (100 * F.col("ci_hi")).alias("osi_ci_upper"), "n_seeds",
        F.when(F.col("osi_pct").isNull(), "no_data").alias("error"),
    )
