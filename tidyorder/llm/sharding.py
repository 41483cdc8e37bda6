"""Sharding by a k-d tree over document metadata.

Documents with equal text are one atom and stay together. Atoms are split at exact weighted
medians along the widest dimension of their node (text size, source, language; the hash of
the text breaks ties), until every leaf is one shard. A median is found by counting bytes in
buckets of the order key, 15 bits at a time, for all nodes of a level at once; only sums per
bucket are shuffled. Node tables are tables too, so nothing is collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyorder.llm.common import stash

DIM_BITS, TIE_BITS, ROUND_BITS = 20, 40, 15
#: Rows of one slot bucket, on average; a bucket is ranked by one task.
SLOT_ROWS = 50_000


def _dims(docs: DataFrame) -> list[Column]:
    top = (1 << DIM_BITS) - 1
    size = F.least(F.lit(top), F.floor(F.log2(F.col("size")) * ((1 << DIM_BITS) / 48))).cast("long")
    coded = [F.pmod(F.xxhash64(F.col(f"`{c}`").cast("string")), F.lit(top + 1)) for c in ("source", "lang") if c in docs.columns]
    return [size, *coded]


def _medians(atoms: DataFrame, d: int) -> DataFrame:
    """base, dim, cut: atoms of node `base` with key <= cut along `dim` go left."""
    spread = [F.max(f"x{j}") - F.min(f"x{j}") for j in range(d)]
    widest = F.greatest(*spread) if d > 1 else spread[0]
    dim = F.coalesce(*[F.when(s == widest, F.lit(j)) for j, s in enumerate(spread)], F.lit(0))
    goal = F.sum("w") * F.floor(F.first("k") / 2) / F.first("k")
    nodes = stash(atoms.filter("k > 1").groupBy("base").agg(dim.alias("dim"), goal.alias("goal")).withColumn("prefix", F.lit(0).cast("long")), "shard-nodes")
    rounds = range((DIM_BITS + TIE_BITS) // ROUND_BITS - 1, -1, -1)
    for step in rounds:
        shift = step * ROUND_BITS
        hist = (
            atoms.filter("k > 1").join(nodes, "base").withColumn("key", _key(d))
            .filter(F.shiftright("key", shift + ROUND_BITS) == F.col("prefix"))
            .groupBy("base", "dim", "goal", F.shiftright("key", shift).alias("bucket")).agg(F.sum("w").alias("w"))
        )
        by_node = Window.partitionBy("base").orderBy("bucket")
        cum = hist.withColumn("upto", F.sum("w").over(by_node)).withColumn("before", F.col("upto") - F.col("w"))
        crossing = cum.filter((F.col("before") < F.col("goal")) & (F.col("upto") >= F.col("goal")))
        if step:
            nodes = stash(crossing.select("base", "dim", (F.col("goal") - F.col("before")).alias("goal"), F.col("bucket").alias("prefix")), "shard-nodes")
        else:
            nearer = F.when(F.col("upto") - F.col("goal") <= F.col("goal") - F.col("before"), F.col("bucket")).otherwise(F.col("bucket") - 1)
            return crossing.select("base", "dim", nearer.alias("cut"))


def _key(d: int) -> Column:
    x = F.coalesce(*[F.when(F.col("dim") == j, F.col(f"x{j}")) for j in range(d)])
    return F.shiftleft(x, TIE_BITS).bitwiseOR(F.col("tie"))


def assign_shards(docs: DataFrame, n_shards: int | None = 8, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, tk, size, text_crc32, shard, slot.

    Give `n_shards`, or `target_bytes` for as many leaves as that needs. Size is the UTF-8
    bytes of the text plus 1; null text has no bytes. Rows with equal texts, repeated rows
    too, share a shard, so a group larger than a shard's part makes that shard larger. slot
    counts from 0 without gaps in each shard. An empty table gives none; source and lang may
    be null or missing.
    """
    items, atoms, n_shards = _leaves(docs, n_shards, target_bytes, id_col, text_col)
    placed = items.join(atoms.select("tk", F.col("base").alias("shard")), "tk").select("doc_id", "size", "text_crc32", "tk", "shard")
    return with_slots(placed, n_shards)


def with_shard(docs: DataFrame, n_shards: int | None = 8, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs`, all rows and columns, with the column shard (one of that name is replaced)."""
    _, atoms, _ = _leaves(docs, n_shards, target_bytes, id_col, text_col)
    docs = docs.drop("shard")
    placed = atoms.select(F.col("tk").alias("__tk"), F.col("base").alias("shard"))
    return docs.join(placed, F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == placed["__tk"]).drop("__tk")


def _leaves(docs: DataFrame, n_shards: int | None, target_bytes: int | None, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """Rows with size and text key, text keys with their leaf (base), and the number of leaves."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.withColumn("size", (F.octet_length(text) + 1).cast("long"))
    xs = _dims(docs)
    items = stash(sized.select(
        F.col(id_col).alias("doc_id"), "size", F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("tk"),
        *[x.alias(f"x{j}") for j, x in enumerate(xs)],
    ), "shard-items")
    d = len(xs)
    if n_shards is None:
        total = items.agg(F.sum("size")).first()[0] or 0
        n_shards = max(1, math.ceil(total / target_bytes))
    atoms = items.groupBy("tk").agg(F.sum("size").alias("w"), *[F.min(f"x{j}").alias(f"x{j}") for j in range(d)])
    atoms = atoms.withColumns({
        "tie": F.shiftrightunsigned(F.xxhash64("tk", F.lit(7)), 64 - TIE_BITS), "base": F.lit(0), "k": F.lit(n_shards),
    })
    atoms = stash(atoms, "shard-atoms")
    for _ in range(math.ceil(math.log2(n_shards)) if n_shards > 1 else 0):
        half = F.floor(F.col("k") / 2).cast("int")
        left = F.col("cut").isNull() | (_key(d) <= F.col("cut"))
        moved = atoms.join(_medians(atoms, d), "base", "left").select(
            "tk", "w", *[f"x{j}" for j in range(d)], "tie",
            F.when(left, F.col("base")).otherwise(F.col("base") + half).alias("base"),
            F.when(F.col("k") == 1, F.lit(1)).when(left, half).otherwise(F.col("k") - half).alias("k"),
        )
        atoms = stash(moved, "shard-atoms")
    return items, atoms, n_shards


def with_slots(placed: DataFrame, n_shards: int) -> DataFrame:
    """Gapless numbers within each shard: ranks inside hash buckets of bounded mean size plus
    the rows of the buckets before."""
    placed = stash(placed, "shard-placed")
    buckets = max(1, math.ceil(placed.count() / (n_shards * SLOT_ROWS)))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tk"), F.lit(buckets)))
    sums = placed.groupBy("shard", "bucket").count()
    before = sums.select("shard", "bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    ranked = placed.withColumn("r", F.row_number().over(inside)).join(before, ["shard", "bucket"])
    return ranked.select("doc_id", "tk", "size", "text_crc32", "shard", (F.col("start") + F.col("r") - 1).alias("slot"))
