"""Outlier removal: isolation forest and local outlier factor."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyorder.functions.keyed import PRIME, draw_hash
from tidyorder.functions.ordering import quantiles
from tidyorder.operators.impute import apply_scaling, fill, fit_robust
from tidyorder.operators.neighbors import nearest
from tidyorder.session import materialize, parallel_tasks, spread
from tidyorder.sources.loaders import feature_columns

TREES = 100
TREE_ROWS = 256
CONTAMINATION = 0.05
EULER_GAMMA = 0.5772156649015329


def scoring_features(df: DataFrame) -> DataFrame:
    """row_id plus filled, robust-scaled double features; used for scoring only."""
    num, cat = feature_columns(df)
    filled = fill(df.select("row_id", *num, *cat))
    doubles = filled.select("row_id", *[F.col(c).cast("double").alias(c) for c in num + cat])
    return apply_scaling(doubles, fit_robust(doubles, num + cat), num + cat)


# ----------------------------------------------------------------- isolation forest
def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow_tree(rows: np.ndarray, depth_limit: int, tree: int, seed: int) -> list[tuple]:
    """Nodes (feature, cut, left, right, depth value) of one random tree; leaves have feature -1."""
    nodes: list[list] = []

    def uniform(draw: int) -> float:
        return int(draw_hash(np.int64(len(nodes) * 4 + draw), tree * 7919 + seed)) / PRIME

    def grow(part: np.ndarray, depth: int) -> int:
        at = len(nodes)
        spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(rows.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= depth_limit or len(part) <= 1 or not len(usable):
            nodes.append([-1, 0.0, -1, -1, depth + float(_mean_path(len(part)))])
            return at
        feature = int(usable[int(uniform(0) * len(usable))])
        low = part[:, feature].min()
        cut = float(low + uniform(1) * spread[feature])
        nodes.append([feature, cut, -1, -1, 0.0])
        left = part[:, feature] <= cut
        nodes[at][2] = grow(part[left], depth + 1)
        nodes[at][3] = grow(part[~left], depth + 1)
        return at

    grow(rows, 0)
    return [tuple(n) for n in nodes]


def _tree_samples(scaled: DataFrame, features: list[str], seed: int, trees: int, tree_rows: int) -> DataFrame:
    """(tree, features...) of the rows of each tree: consecutive stretches of `tree_rows` rows in
    the order of one hash, and once the table is used up, of the next hash. A row is hashed once
    per such round, which is once for any table of trees x tree_rows rows; only hashes below a
    bound that half more rows than wanted are expected to pass are ranked (at most a few tens of
    thousands of rows), and should a round fall short, the bound is doubled."""
    n = scaled.count()
    wanted = min(tree_rows, n)
    per_round = max(1, n // max(wanted, 1))
    rounds = -(-trees // per_round)
    share = 1.5 * min(per_round, trees) * wanted / max(n, 1) + 64 / max(n, 1)
    order = Window.partitionBy("_round").orderBy("_h", "row_id")
    while True:
        rows = scaled.select("row_id", *features, F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("_round"))
        rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "_round", "row_id"))
        if share < 1:
            rows = rows.where(F.col("_h") < int(share * 2**64) - 2**63)
        ranked = materialize(rows.withColumn("_rank", F.row_number().over(order) - 1))
        used = F.col("_rank") < min(per_round, trees) * wanted
        least = ranked.where(used).groupBy("_round").count().agg(F.min("count"), F.count("*")).first()
        if share >= 1 or (least[1] == rounds and least[0] == min(per_round, trees) * wanted):
            tree = F.col("_round") * per_round + F.expr(f"_rank div {max(wanted, 1)}")
            return ranked.where(used).withColumn("tree", tree.cast("int")).where(F.col("tree") < trees).select("tree", "row_id", *features)
        share *= 2


def isolation_scores(scaled: DataFrame, seed: int, trees: int = TREES, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(row_id, score): 2^(-mean path / expected path); larger means more isolated.

    Each tree sees `tree_rows` rows of the whole table (all rows of a smaller one), drawn
    without replacement. Trees are grown one per task; every row is scored.
    """
    features = [c for c in scaled.columns if c != "row_id"]
    sample = _tree_samples(scaled, features, seed, trees, tree_rows)

    def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values("row_id")[features].to_numpy(dtype=float)
        nodes = _grow_tree(rows, math.ceil(math.log2(max(len(rows), 2))), int(key[0]), seed)
        frame = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "path"])
        return frame.assign(tree=key[0], node=np.arange(len(frame)), rows=len(rows))

    by_tree = sample.select("tree", "row_id", *features).repartition(parallel_tasks(scaled.sparkSession), "tree")
    forest = by_tree.groupBy("tree").applyInPandas(
        grow, "feature int, cut double, left int, right int, path double, tree int, node int, rows int"
    ).toPandas().sort_values(["tree", "node"])
    grown = [
        tuple(part[c].to_numpy() for c in ("feature", "cut", "left", "right", "path"))
        for _, part in forest.groupby("tree")
    ]
    expected = float(_mean_path(float(forest["rows"].max()))) or 1.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch[features].to_numpy(dtype=float)
            total = np.zeros(len(values))
            for feature, cut, left, right, path in grown:
                at = np.zeros(len(values), dtype=np.int64)
                inner = np.flatnonzero(feature[at] >= 0)
                while len(inner):
                    node = at[inner]
                    go_left = values[inner, feature[node]] <= cut[node]
                    at[inner] = np.where(go_left, left[node], right[node])
                    inner = inner[feature[at[inner]] >= 0]
                total += path[at]
            yield pd.DataFrame(
                {"row_id": batch["row_id"], "score": np.exp2(-total / len(grown) / expected)}
            )

    return spread(scaled).mapInPandas(score, "row_id bigint, score double")


def flag_extreme(scores: DataFrame, share: float = CONTAMINATION) -> DataFrame:
    """Add `outlier`: score strictly above the (1 - share) quantile."""
    cut = quantiles(scores, ["score"], [1 - share]).select(F.col("q_score")[0].alias("_cut"))
    return scores.crossJoin(F.broadcast(cut)).select(  # exactly one row
        "row_id", "score", (F.col("score") > F.col("_cut")).alias("outlier")
    )


def drop_flagged(df: DataFrame, flagged: DataFrame) -> DataFrame:
    return df.join(flagged.where("outlier").select("row_id"), "row_id", "left_anti").select(*df.columns)


def remove_isolated(df: DataFrame, seed: int, trees: int = TREES) -> DataFrame:
    """Drop the most isolated rows; NULLs are filled for scoring only."""
    scaled = materialize(scoring_features(df))
    scores = materialize(isolation_scores(scaled, seed, trees))
    return drop_flagged(df, flag_extreme(scores))


# ------------------------------------------------------------- local outlier factor
def local_outlier_factor(scaled: DataFrame, k: int = 20) -> DataFrame:
    """(row_id, score): mean ratio of the neighbours' reachability density to the row's own.

    Scores are rounded to 8 digits so that ties do not hang on summation order.
    """
    features = [c for c in scaled.columns if c != "row_id"]
    lists = materialize(nearest(scaled, scaled, k, num=features).select("row_id", "neighbors"))
    edges = lists.select("row_id", F.inline(F.transform(
        "neighbors", lambda e: F.struct(e["id"].alias("other"), F.sqrt(e["d2"]).alias("d"))
    )))
    k_distance = lists.select(
        F.col("row_id").alias("other"), F.sqrt(F.element_at("neighbors", -1)["d2"]).alias("k_dist")
    )
    density = materialize(
        edges.join(k_distance, "other").groupBy("row_id")
        .agg((1.0 / (F.avg(F.greatest("d", "k_dist")) + 1e-10)).alias("lrd"))
    )
    theirs = density.select(F.col("row_id").alias("other"), F.col("lrd").alias("lrd_other"))
    return (
        edges.join(theirs, "other").groupBy("row_id").agg(F.avg("lrd_other").alias("around"))
        .join(density, "row_id").select("row_id", F.round(F.col("around") / F.col("lrd"), 8).alias("score"))
    )


def remove_local_outliers(df: DataFrame, k: int = 20) -> DataFrame:
    scaled = materialize(scoring_features(df))
    k = min(k, scaled.count() - 1)
    return drop_flagged(df, flag_extreme(materialize(local_outlier_factor(scaled, k))))
