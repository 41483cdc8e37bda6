"""Exact, partition-independent sampling: ranks, exact-k, splits, folds, resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyorder.functions.keyed import hash_hex, uniform

# Hex digits of a hash bucket: 65,536 per group. Ranks and cuts do not depend on it; a task
# sorts one bucket, and bucket counts are scanned per group.
_BUCKET_DIGITS = 4


def _hashed(df: DataFrame, key: str, seed: Column | int, salt: Sequence[Column | str]) -> DataFrame:
    return with_buckets(df.withColumn("_h", hash_hex(seed, *salt, key)))


def with_buckets(hashed: DataFrame) -> DataFrame:
    """Adds the bucket `_hb` of a hash `_h`."""
    return hashed.withColumn("_hb", F.substring("_h", 1, _BUCKET_DIGITS))


def _few_groups(by: Sequence[str]) -> bool:
    """Group tables with at most one row per class: the only ones broadcast by hint."""
    return set(by) <= {"label"}


def _keyed(by: Sequence[str]) -> list[str]:
    return list(by) or ["_all"]


def _with_group(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df if by else df.withColumn("_all", F.lit(0))


def hash_rank(
    df: DataFrame, key: str, seed: Column | int, by: Sequence[str] = (), salt: Sequence[Column | str] = (),
    out: str = "rank",
) -> DataFrame:
    """Exact 1..n rank by (keyed hash, key) inside each group.

    Rows are ranked inside hash buckets, so no group is one task; only
    the bucket counts are scanned in order.
    """
    groups = _keyed(by)
    hashed = _hashed(_with_group(df, by), key, seed, salt)
    counts = hashed.groupBy(*groups, "_hb").agg(F.count("*").alias("_cnt"))
    ahead = Window.partitionBy(*groups).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_hb", F.coalesce(F.sum("_cnt").over(ahead), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*groups, "_hb").orderBy("_h", key)
    ranked = hashed.join(offsets, groups + ["_hb"]).withColumn(
        out, F.row_number().over(inside) + F.col("_off")
    )
    return ranked.select(*df.columns, out)


def mark_exact_k(
    df: DataFrame, key: str, seed: Column | int, k: Column | DataFrame, by: Sequence[str] = (),
    salt: Sequence[Column | str] = (), out: str = "hit",
) -> DataFrame:
    """Boolean column true for exactly k rows per group, drawn without replacement.

    `k` is a column over the group size `n`, or a table (by..., k). The rows are not
    shuffled: bucket counts locate the hash value of the k-th row, and each row is
    compared with that one cut per group.
    """
    groups = _keyed(by)
    hashed = _hashed(_with_group(df, by), key, seed, salt)
    cut = exact_cuts(hashed, key, groups, _with_group(k, by) if isinstance(k, DataFrame) else k, _few_groups(by))
    # one cut per group: broadcast for whole tables and classes, else Spark sizes the join
    marked = hashed.join(F.broadcast(cut) if _few_groups(by) else cut, groups, "left")
    hit = (F.col("_h") < F.col("_h_cut")) | (
        (F.col("_h") == F.col("_h_cut")) & (F.col(key) <= F.col("_key_cut"))
    )
    return marked.withColumn(out, F.coalesce(hit, F.lit(False))).select(*df.columns, out)


def exact_cuts(hashed: DataFrame, key: str, groups: Sequence[str], k: Column | DataFrame, few: bool = False) -> DataFrame:
    """(groups..., _h_cut, _key_cut): hash and key of the k-th row per group of rows with a
    hash `_h` and its bucket `_hb`. Groups with k = 0 have no row."""
    groups = list(groups)
    counts = hashed.groupBy(*groups, "_hb").agg(F.count("*").alias("_cnt"))
    if isinstance(k, DataFrame):
        quota = k
    else:
        quota = counts.groupBy(*groups).agg(F.sum("_cnt").alias("n")).select(*groups, k.alias("k"))
    running = Window.partitionBy(*groups).orderBy("_hb")
    totals = Window.partitionBy(*groups)
    placed = counts.select(
        *groups, "_hb", "_cnt", F.sum("_cnt").over(running).alias("_cum"), F.sum("_cnt").over(totals).alias("_n")
    )
    edge = (
        placed.join(quota, groups)
        .withColumn("k", F.least("k", "_n"))
        .where((F.col("_cum") - F.col("_cnt") < F.col("k")) & (F.col("k") <= F.col("_cum")))
        .select(*groups, "_hb", (F.col("k") - F.col("_cum") + F.col("_cnt")).alias("_need"))
    )
    # one bucket per group is looked at in detail
    inside = Window.partitionBy(*groups, "_hb").orderBy("_h", key)
    return (
        hashed.select(*groups, "_hb", "_h", key)
        .join(F.broadcast(edge) if few else edge, groups + ["_hb"])
        .withColumn("_rn", F.row_number().over(inside))
        .where(F.col("_rn") == F.col("_need"))
        .select(*groups, F.col("_h").alias("_h_cut"), F.col(key).alias("_key_cut"))
    )


def class_counts(df: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """One row per group: n0, n1, n, minority class (ties: 1), n_min, n_maj."""
    ones, zeros = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    counts = df.groupBy(*by).agg(zeros.alias("n0"), ones.alias("n1"))
    minority = F.when(F.col("n1") <= F.col("n0"), 1).otherwise(0)
    return counts.select(
        *by,
        "n0",
        "n1",
        (F.col("n0") + F.col("n1")).alias("n"),
        minority.alias("minority"),
        F.least("n0", "n1").alias("n_min"),
        F.greatest("n0", "n1").alias("n_maj"),
    )


def stratified_split(df: DataFrame, seed: Column | int, by: Sequence[str] = (), test_size: float = 0.2) -> DataFrame:
    """Add `is_test`: ceil(test_size * n) rows in all, split over classes by largest remainder."""
    counts = df.groupBy(*by, "label").agg(F.count("*").alias("c"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    share = counts.withColumn("n", F.sum("c").over(group)).withColumn("total", F.ceil(F.col("n") * test_size))
    share = share.withColumn("exact", F.col("total") * F.col("c") / F.col("n")).withColumn("k", F.floor("exact"))
    by_remainder = Window.partitionBy(*(by or [F.lit(0)])).orderBy(
        F.round(F.col("exact") - F.col("k"), 9).desc(), "label"
    )
    extra = F.col("total") - F.sum("k").over(group)
    quota = share.withColumn("k", F.col("k") + (F.row_number().over(by_remainder) <= extra).cast("int"))
    return mark_exact_k(df, "row_id", seed, quota.select(*by, "label", "k"), [*by, "label"], ["label"], out="is_test")


def stratified_folds(df: DataFrame, seed: Column | int, by: Sequence[str] = (), folds: int = 5) -> DataFrame:
    """Add `fold` 0..folds-1: consecutive hash ranks within a class go to different folds."""
    ranked = hash_rank(df, "row_id", seed, [*by, "label"], [F.lit("fold")], out="_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def sample_without_replacement(
    df: DataFrame, key: str, seed: Column | int, k: Column, by: Sequence[str] = ()
) -> DataFrame:
    return mark_exact_k(df, key, seed, k, by).where("hit").drop("hit")


def draws(spark: SparkSession, n: int, seed: int, n_base: int, purpose: str) -> DataFrame:
    """`n` draws with replacement of base ranks 1..n_base: (draw, base_rank)."""
    ids = spark.range(1, n + 1).withColumnRenamed("id", "draw")
    pick = 1 + F.floor(uniform(seed, F.lit(purpose), "draw") * n_base)
    return ids.select("draw", pick.alias("base_rank"))


def sample_with_replacement(df: DataFrame, key: str, seed: int, n: int, n_base: int) -> DataFrame:
    """`n` rows drawn with replacement from the `n_base` rows of df, with `draw` 1..n."""
    ranked = hash_rank(df, key, seed, out="base_rank", salt=[F.lit("base")])
    return draws(df.sparkSession, n, seed, n_base, "pick").join(ranked, "base_rank").drop("base_rank")


def bootstrap_slots(groups: DataFrame, by: Sequence[str], size: str, n_boot: int, seed: int) -> DataFrame:
    """(by, boot, slot, pick): for each resample, `size` picks of 0-based positions."""
    expanded = groups.select(*by, size, F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("boot")).select(
        *by, size, "boot", F.explode(F.sequence(F.lit(1), F.col(size).cast("int"))).alias("slot")
    )
    pick = F.floor(uniform(seed, *by, "boot", "slot") * F.col(size))
    return expanded.select(*by, "boot", "slot", pick.alias("pick"))
