"""Class balancing: skip rules, random oversampling and synthetic minority rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyorder.functions.keyed import uniform
from tidyorder.operators.impute import fill
from tidyorder.operators.neighbors import nearest
from tidyorder.operators.sampling import class_counts, draws, hash_rank
from tidyorder.session import brief_shuffles, materialize, release
from tidyorder.sources.loaders import feature_columns

TARGET_RATIO = 0.8


def skip_reason(n_min: Column, n_maj: Column, ratio: Column | float = TARGET_RATIO) -> Column:
    """Why balancing is skipped, else NULL."""
    return (
        F.when(n_min == 0, "single_class")
        .when(n_min / n_maj >= ratio * 0.95, "already_balanced")
        .when(n_min < 2, "too_few_minority")
    )


@dataclass(frozen=True)
class BalancePlan:
    minority: int
    n_min: int
    n_maj: int
    n_new: int
    reason: str | None


def balance_plan(df: DataFrame, ratio: float = TARGET_RATIO) -> BalancePlan:
    """Class counts on the driver (one row) and the number of rows to add (truncated)."""
    row = class_counts(df).withColumn("reason", skip_reason(F.col("n_min"), F.col("n_maj"), ratio)).first()
    n_new = 0 if row["reason"] else max(0, int(row["n_maj"] * ratio - row["n_min"]))
    return BalancePlan(row["minority"], row["n_min"], row["n_maj"], n_new, row["reason"])


def _with_origin(df: DataFrame) -> DataFrame:
    return df if "origin" in df.columns else df.withColumn("origin", F.lit("orig"))


def _append(df: DataFrame, extra: DataFrame) -> DataFrame:
    """Originals keep their NULLs; other columns of the new rows are NULL."""
    return df.unionByName(extra.withColumn("origin", F.lit("syn")), allowMissingColumns=True)


def oversample(df: DataFrame, seed: int, ratio: float = TARGET_RATIO) -> DataFrame:
    """Repeat minority rows, drawn with replacement, up to the target ratio."""
    num, cat = feature_columns(df)
    plan = balance_plan(df, ratio)
    df = _with_origin(df)
    if plan.reason or plan.n_new == 0:
        return df
    minority = df.where(F.col("label") == plan.minority).select("row_id", "label", *num, *cat)
    ranked = hash_rank(minority, "row_id", seed, out="base_rank", salt=[F.lit("base")])
    picks = draws(df.sparkSession, plan.n_new, seed, plan.n_min, "oversample")
    extra = picks.join(ranked, "base_rank").select((-F.col("draw")).alias("row_id"), "label", *num, *cat)
    return _append(df, extra)


def smote(df: DataFrame, seed: int, ratio: float = TARGET_RATIO, k: int = 5) -> DataFrame:
    """Synthetic minority rows between a row and one of its k nearest minority rows.

    With categorical columns, distances are taken on numeric columns divided by the
    median minority deviation, plus 1 per categorical mismatch; new categories are the
    most frequent among the neighbours (ties: smallest code). NULLs are filled for the
    synthesis only.
    """
    num, cat = feature_columns(df)
    plan = balance_plan(df, ratio)
    df = _with_origin(df)
    if plan.reason or plan.n_new == 0:
        return df
    k = min(k, plan.n_min - 1)
    filled = fill(df.select("row_id", "label", *num, *cat))
    minority = materialize(filled.where(F.col("label") == plan.minority).drop("label"))
    if cat:
        deviations = minority.agg(*[F.stddev_pop(c).alias(c) for c in num])
        # median over the few numeric columns
        unit = deviations.select(F.explode(F.array(*num)).alias("sd")).agg(F.median("sd").alias("unit"))
        space = minority.crossJoin(F.broadcast(unit)).select(  # exactly one row
            "row_id",
            *[F.when(F.col("unit") > 0, F.col(c) / F.col("unit")).otherwise(F.col(c)).alias(f"s_{c}") for c in num],
            *[F.when(F.col("unit") > 0, F.col(c)).otherwise(0).alias(f"s_{c}") for c in cat],
        )
    else:
        space = minority.select("row_id", *[F.col(c).alias(f"s_{c}") for c in num])
    found = nearest(space, space, k, num=[f"s_{c}" for c in num], cat=[f"s_{c}" for c in cat])
    lists = materialize(found.select("row_id", F.col("neighbors.id").alias("near")))
    release(found)
    ranked = hash_rank(minority, "row_id", seed, out="base_rank", salt=[F.lit("base")]).join(lists, "row_id")
    picks = draws(df.sparkSession, plan.n_new, seed, plan.n_min, "smote").select(
        "draw",
        "base_rank",
        F.floor(uniform(seed, F.lit("neighbor"), "draw") * k).cast("int").alias("slot"),
        uniform(seed, F.lit("gap"), "draw").alias("gap"),
    )
    joined = picks.join(ranked, "base_rank").withColumn("id", F.get("near", F.col("slot")))
    extra = _between(joined, lists, minority, num, cat, [])
    return _append(df, extra.select((-F.col("draw")).alias("row_id"), F.lit(plan.minority).alias("label"), *num, *cat))


def _between(joined: DataFrame, lists: DataFrame, values: DataFrame, num: list[str], cat: list[str], by: list[str]) -> DataFrame:
    """The rows of `joined` with features on the way (`gap`) from the base row they hold to the
    neighbour `id`, whose values are fetched from `values`; categories by majority of the base
    row's neighbours in `lists` (row_id, near), ties to the smallest code."""
    other = values.select(*by, F.col("row_id").alias("id"), *[F.col(c).alias(f"o_{c}") for c in num])
    out = joined.join(other, [*by, "id"])
    if cat:
        edges = lists.select(*by, "row_id", F.explode("near").alias("id"))
        codes = edges.join(values.select(*by, F.col("row_id").alias("id"), *cat), [*by, "id"])
        votes = codes.groupBy(*by, "row_id").agg(*[F.expr(f"mode() within group (order by `{c}`)").alias(f"v_{c}") for c in cat])
        out = out.join(votes, [*by, "row_id"])
    blended = {c: F.col(c) + F.col("gap") * (F.col(f"o_{c}") - F.col(c)) for c in num}
    return out.withColumns({**blended, **{c: F.col(f"v_{c}") for c in cat}})


#: Distance between the copies of a point that belong to different folds, in an extra dimension.
_APART = 1e100
#: Rows of the folds that are joined together, whose intermediate files lie on disk at once; a fold is not divided.
JOIN_ROWS = 1 << 24


@brief_shuffles
def smote_by_fold(folded: DataFrame, fills: DataFrame, seed: int, folds: int, ratio: float = TARGET_RATIO, k: int = 5) -> DataFrame:
    """(row_id, label, only, features): for each fold the synthetic rows that `smote` makes of the
    rows outside it, filled from `fills` (one row per fold), all from one neighbour join, or from
    a few where the folds together have more than JOIN_ROWS minority rows. The folds of a join
    stand apart in a further dimension, so a row meets only rows of its own training part.
    The result reads nothing but tables made here, which the caller may `release` with it.
    """
    num, cat = feature_columns(folded)
    sizes = {(r["fold"], r["label"]): r["n"] for r in folded.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    groups, rows = [], 0
    for fold in range(folds):
        n0, n1 = (sum(n for (f, y), n in sizes.items() if f != fold and y == label) for label in (0, 1))
        n_min, n_maj = min(n0, n1), max(n0, n1)
        new = max(0, int(n_maj * ratio - n_min))
        if n_min >= 2 and n_min / n_maj < ratio * 0.95 and new:
            if not groups or rows + n_min > JOIN_ROWS:
                groups.append({})
                rows = 0
            groups[-1][fold] = BalancePlan(1 if n1 <= n0 else 0, n_min, n_maj, new, None)
            rows += n_min
    if not groups:
        none = folded.select("row_id", "label", F.lit(0).alias("only"), *num, *cat)
        return folded.sparkSession.createDataFrame([], none.schema)
    if len(groups) == 1:
        return _smote_of_folds(folded, fills, seed, folds, groups[0], k)
    out = None
    for plans in groups:
        plan = _smote_of_folds(folded, fills, seed, folds, plans, k)
        made = materialize(plan)
        release(plan)
        out = made if out is None else out.unionByName(made)
    return out


def _smote_of_folds(folded: DataFrame, fills: DataFrame, seed: int, folds: int, plans: dict[int, BalancePlan], k: int) -> DataFrame:
    """The synthetic rows of some folds from one neighbour join."""
    num, cat = feature_columns(folded)
    kinds = {c: folded.schema[c].dataType.simpleString() for c in num + cat}
    parts = [F.when((F.col("fold") != f) & (F.col("label") == p.minority), F.lit(f)) for f, p in plans.items()]
    minority = folded.withColumn("only", F.explode(F.array_compact(F.array(*parts)))).drop("fold")
    fills = fills.withColumnRenamed("fold", "only")
    filled = minority.join(F.broadcast(fills), "only").select(  # one row per fold
        "row_id", "only", *[F.coalesce(F.col(c), F.col(f"f_{c}")).cast(kinds[c]).alias(c) for c in num + cat]
    )
    filled = materialize(filled)
    space = filled.withColumn("unit", F.lit(1.0))
    if cat:
        spread = filled.groupBy("only").agg(F.array(*[F.stddev_pop(c) for c in num]).alias("sd"))
        unit = spread.select("only", F.explode("sd").alias("sd")).groupBy("only").agg(F.median("sd").alias("unit"))
        space = filled.join(F.broadcast(unit), "only")  # one row per fold
    usable, bits = F.col("unit") > 0, (folds - 1).bit_length()
    space = space.select(
        (F.shiftleft("row_id", bits) + F.col("only")).alias("row_id"),
        *[F.when(usable, F.col(c) / F.col("unit")).otherwise(F.col(c)).alias(f"s_{c}") for c in num],
        (F.col("only") * _APART).alias("s_fold"),
        *[F.when(usable, F.col(c)).otherwise(0).alias(f"s_{c}") for c in cat],
    )
    found = nearest(space, space, k, num=[*[f"s_{c}" for c in num], "s_fold"], cat=[f"s_{c}" for c in cat])
    own = F.filter("neighbors", lambda e: e["d2"] < _APART)  # fewer than k where the part is small
    lists = materialize(found.select(
        (F.col("row_id") - F.shiftleft(F.shiftright("row_id", bits), bits)).cast("int").alias("only"), F.shiftright("row_id", bits).alias("row_id"),
        F.transform(own, lambda e: F.shiftright(e["id"], bits)).alias("near"),
    ))
    release(found)
    ranked = hash_rank(filled, "row_id", seed, ["only"], out="base_rank", salt=[F.lit("base")]).join(lists, ["only", "row_id"])
    picks = None
    for fold, plan in plans.items():
        one = draws(folded.sparkSession, plan.n_new, seed, plan.n_min, "smote").withColumns({
            "only": F.lit(fold), "new_label": F.lit(plan.minority), "slot": F.floor(uniform(seed, F.lit("neighbor"), "draw") * min(k, plan.n_min - 1)).cast("int"),
            "gap": uniform(seed, F.lit("gap"), "draw"),
        })
        picks = one if picks is None else picks.unionByName(one)
    joined = picks.join(ranked, ["only", "base_rank"]).withColumn("id", F.get("near", F.col("slot")))
    extra = _between(joined, lists, filled, num, cat, ["only"])
    return extra.select((-(F.col("draw") * folds + F.col("only"))).alias("row_id"), F.col("new_label").alias("label"), "only", *num, *cat)
