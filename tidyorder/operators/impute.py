"""Fills and scalings with separate fit and apply, and the imputation steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyorder.functions.ordering import modes, quantiles
from tidyorder.operators.neighbors import nearest
from tidyorder.sources.loaders import feature_columns


# ------------------------------------------------------------------ fit and apply
def fit_fill(df: DataFrame) -> DataFrame:
    """One row of fills, `f_<column>`: exact median (numeric) or mode (categorical);
    0 for a column without observed values."""
    num, cat = feature_columns(df)
    params = None
    if num:
        medians = quantiles(df, num, [0.5])
        params = medians.selectExpr(*[f"coalesce(`q_{c}`[0], 0D) as `f_{c}`" for c in num])
    if cat:
        most = modes(df, cat).selectExpr(*[f"coalesce(`m_{c}`, 0) as `f_{c}`" for c in cat])
        params = most if params is None else params.crossJoin(most)  # one row each
    return params


def apply_fill(df: DataFrame, params: DataFrame) -> DataFrame:
    """Fill NULL cells from a one-row parameter table."""
    num, cat = feature_columns(df)
    filled = df.crossJoin(F.broadcast(params))  # exactly one row
    return filled.selectExpr(
        *[f"coalesce(`{c}`, `f_{c}`) as `{c}`" if c in num + cat else f"`{c}`" for c in df.columns]
    )


def fill(df: DataFrame) -> DataFrame:
    return apply_fill(df, fit_fill(df))


def fit_fill_by_fold(df: DataFrame, folds: int = 5) -> DataFrame:
    """Fills fitted without each fold: one row per `fold`, from one pass over df.

    Rows are labelled with every fold they train for, so a validation fold never
    contributes to its own fill.
    """
    num, cat = feature_columns(df)
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold"))
    training = df.withColumn("_held", F.explode(others)).drop("fold").withColumnRenamed("_held", "fold")
    params = quantiles(training, num, [0.5], ["fold"]) if num else training.select("fold").distinct()
    if cat:
        params = params.join(modes(training, cat, ["fold"]), "fold")
    return params.select(
        "fold",
        *[F.coalesce(F.col(f"q_{c}")[0], F.lit(0.0)).alias(f"f_{c}") for c in num],
        *[F.coalesce(F.col(f"m_{c}"), F.lit(0)).alias(f"f_{c}") for c in cat],
    )


def fit_robust(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median and interquartile range (0 becomes 1) per column."""
    q = quantiles(df, columns, [0.25, 0.5, 0.75])

    width = "coalesce(`q_{c}`[2] - `q_{c}`[0], 0D)"
    return q.selectExpr(
        *[f"coalesce(`q_{c}`[1], 0D) as `mid_{c}`" for c in columns],
        *[f"if({width.format(c=c)} = 0, 1D, {width.format(c=c)}) as `width_{c}`" for c in columns],
    )


def fit_standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation (0 becomes 1) over observed values."""

    sd = "coalesce(stddev_pop(cast(`{c}` as double)), 0D)"
    return df.selectExpr(
        *[f"coalesce(avg(`{c}`), 0D) as `mid_{c}`" for c in columns],
        *[f"if({sd.format(c=c)} < 1e-12, 1D, {sd.format(c=c)}) as `width_{c}`" for c in columns],
    )


def apply_scaling(df: DataFrame, params: DataFrame, columns: Sequence[str]) -> DataFrame:
    scaled = df.crossJoin(F.broadcast(params))  # exactly one row
    return scaled.selectExpr(
        *[f"(`{c}` - `mid_{c}`) / `width_{c}` as `{c}`" if c in columns else f"`{c}`" for c in df.columns]
    )


# ----------------------------------------------------------------------- imputers
def null_cells(df: DataFrame) -> Column:
    """Aggregate: number of NULL feature cells."""
    num, cat = feature_columns(df)
    return F.coalesce(F.sum(sum((F.col(c).isNull().cast("int") for c in num + cat), F.lit(0))), F.lit(0))


def impute_median(df: DataFrame) -> DataFrame:
    """Median for numeric, most frequent code for categorical columns."""
    return fill(df)


def impute_neighbors(df: DataFrame, k: int = 5) -> DataFrame:
    """Mean of the k nearest rows that observe the column.

    Distances run over all columns, standardised on observed values, and skip cells
    missing on either side (rescaled by the share of usable columns). Categorical cells
    take the column's most frequent code. A cell with no comparable donor takes the
    column mean. Only rows with a NULL act as queries.
    """
    num, cat = feature_columns(df)
    cols = num + cat
    params = fit_standard(df, cols)
    scaled = apply_scaling(df.select("row_id", *[F.col(c).cast("double").alias(c) for c in cols]), params, cols)
    gaps = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in num])) if num else None
    out = df
    if num:
        wanting = scaled.where(F.size(gaps) > 0).select("*", gaps.alias("need"))
        found = nearest(wanting, scaled, k, num=cols, need="need")
        edges = found.select("row_id", "need", F.explode("neighbors.id").alias("id"))
        values = scaled.select(F.col("row_id").alias("id"), *num)
        means = edges.join(values, "id").groupBy("row_id").agg(*[F.avg(F.when(F.col("need") == c, F.col(c))).alias(f"knn_{c}") for c in num])
        out = out.join(means, "row_id", "left").crossJoin(F.broadcast(params))  # exactly one row

        def cell(c: str) -> Column:
            estimate = F.col(f"knn_{c}") * F.col(f"width_{c}") + F.col(f"mid_{c}")
            return F.coalesce(F.col(c), estimate, F.col(f"mid_{c}")).alias(c)

        out = out.select(*[cell(c) if c in num else F.col(c) for c in df.columns])
    if cat:
        most = modes(df, cat)
        out = out.crossJoin(F.broadcast(most)).select(  # exactly one row
            *[
                F.coalesce(F.col(c), F.col(f"m_{c}"), F.lit(0)).alias(c) if c in cat else F.col(c)
                for c in df.columns
            ]
        )
    return out
