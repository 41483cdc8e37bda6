"""Label-noise correction: out-of-fold relabelling and edited nearest neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyorder.operators.balance import smote_by_fold
from tidyorder.operators.fold_forests import grow, held_out, lay_out
from tidyorder.operators.impute import apply_scaling, fill, fit_fill_by_fold, fit_standard
from tidyorder.operators.models import DEPTH, TREES
from tidyorder.operators.neighbors import nearest
from tidyorder.operators.sampling import stratified_folds
from tidyorder.session import brief_shuffles, materialize, release
from tidyorder.sources.loaders import feature_columns

THRESHOLD = 0.7
FOLDS = 5


def class_weights(df: DataFrame) -> DataFrame:
    """(label, weight): n / (classes * class size)."""
    counts = df.groupBy("label").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("classes"))
    return counts.crossJoin(F.broadcast(total)).select(  # one row per class
        "label", (F.col("n") / (F.col("classes") * F.col("c"))).alias("weight")
    )


@brief_shuffles
def out_of_fold(df: DataFrame, seed: int, mode: str = "plain", trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(row_id, label, p0, p1): class probabilities from forests that did not see the row.

    `mode`: `plain`, `fold_smote` (oversample inside each training part) or `weighted`
    (balanced class weights). Fills are fitted on the training part only. The forests of all
    folds grow in the same passes over the table.
    """
    if mode not in ("plain", "fold_smote", "weighted"):
        raise ValueError(f"unknown mode: {mode}")
    num, cat = feature_columns(df)
    folded = materialize(stratified_folds(df.select("row_id", "label", *num, *cat), seed, folds=FOLDS))
    fills = materialize(fit_fill_by_fold(folded, FOLDS))
    by_fold = {r["fold"]: [float(r[f"f_{c}"]) for c in num + cat] for r in fills.collect()}  # one row per fold
    known = np.array([by_fold.get(f, [0.0] * len(num + cat)) for f in range(FOLDS)])
    rows = folded.withColumn("only", F.lit(-1))
    if mode == "fold_smote":
        plan = smote_by_fold(folded, fills, seed, FOLDS)
        made = materialize(plan)  # counted, laid out and drawn from
        release(plan)
        rows = rows.unionByName(made.withColumn("fold", F.lit(-1)))
    weights = None
    if mode == "weighted":
        sizes = {(r["fold"], r["label"]): r["n"] for r in folded.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
        seen = np.array([[sum(n for (f, y), n in sizes.items() if f != fold and y == label) for label in (0, 1)] for fold in range(FOLDS)])
        weights = seen.sum(axis=1, keepdims=True) / (np.maximum((seen > 0).sum(axis=1, keepdims=True), 1) * np.maximum(seen, 1))
    layout = lay_out(rows, num + cat, known, seed)
    release(rows, fills)
    probs = materialize(held_out(layout, grow(layout, seed, trees, depth, weights)))
    release(layout.blocks)
    return probs


def relabelled(label: Column, p0: Column, p1: Column, threshold: Column | float) -> Column:
    """The confident other class, else the label. Equal probabilities predict class 0."""
    predicted = F.when(p1 > p0, 1).otherwise(0)
    return F.when((predicted != label) & (F.greatest(p0, p1) >= threshold), predicted).otherwise(label)


def relabel(probs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row_id, label, new_label)."""
    new = relabelled(F.col("label"), F.col("p0"), F.col("p1"), threshold)
    return probs.select("row_id", "label", new.alias("new_label"))


def relabel_at(probs: DataFrame, thresholds: list[float]) -> DataFrame:
    """All thresholds in one pass: (threshold, row_id, label, new_label)."""
    each = probs.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    new = relabelled(F.col("label"), F.col("p0"), F.col("p1"), F.col("threshold"))
    return each.select("threshold", "row_id", "label", new.alias("new_label"))


def correct_labels(
    df: DataFrame, seed: int, mode: str = "plain", trees: int = TREES, depth: int = DEPTH, probs: DataFrame | None = None
) -> DataFrame:
    """Same rows, confident disagreements relabelled; `probs` are those of `out_of_fold` where
    they are known already."""
    probs = out_of_fold(df, seed, mode, trees, depth) if probs is None else probs
    new = relabel(probs).select("row_id", "new_label")
    return df.join(new, "row_id").withColumn("label", F.col("new_label")).select(*df.columns)


@brief_shuffles
def edit_neighbors(df: DataFrame) -> DataFrame:
    """Drop rows whose label differs from at least two of their three nearest neighbours.

    A no-op with fewer than two classes or four rows, and when it would wipe out a class.
    """
    num, cat = feature_columns(df)
    shape = df.groupBy("label").count().collect()  # one row per class
    if len(shape) < 2 or sum(r["count"] for r in shape) < 4:
        return df
    filled = fill(df.select("row_id", "label", *num, *cat))
    doubles = filled.select("row_id", "label", *[F.col(c).cast("double").alias(c) for c in num + cat])
    scaled = materialize(apply_scaling(doubles, fit_standard(doubles, num + cat), num + cat))
    found = nearest(scaled, scaled, 3, num=num + cat)
    edges = found.select("row_id", F.explode("neighbors.id").alias("id"))
    other = scaled.select(F.col("row_id").alias("id"), F.col("label").alias("other"))
    against = edges.join(other, "id").join(scaled.select("row_id", "label"), "row_id").groupBy("row_id", "label")
    verdict = materialize(against.agg((F.count_if(F.col("other") != F.col("label")) >= 2).alias("outlier")))
    release(found, scaled)
    if verdict.where("not outlier").select("label").distinct().count() < 2:
        return df
    return df.join(verdict.where("outlier").select("row_id"), "row_id", "left_anti").select(*df.columns)
