"""Exact dedup by deterministic block naming.

Every text is cut into blocks of BLOCK bytes. The distinct blocks of the corpus are sorted
and numbered; a document becomes a sequence of integers. Then adjacent pairs are named the
same way, level by level, until each document has one integer: two documents have the same
(level, name) if and only if their texts are equal byte for byte. No hash decides equality of
texts; rows of one doc_id (null ids too) are told apart by a 64-bit hash of the text.
Each level halves the rows, distinct values are combined before every shuffle, and only
names, never text, go back to the documents. Blocks are sorted in ranges of PREFIX bytes;
blocks that share a frequent beginning, such as a common header, are ranged by the PREFIX
bytes after it, and so on level by level, so that no header makes one range large.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyorder.llm.common import null_safe_join, stash, wide

BLOCK, PREFIX = 1024, 32
#: One of so many distinct blocks, by hash, counts for how the ranges are laid out (not for
#: what comes out); beginnings that hold more than a part of 1 / (RANGES * partitions) go on.
LAYOUT, RANGES = 16, 4


def _blocks(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    bytes_ = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tk"), bytes_.alias("b"))
    base = base.withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("b") / block)).cast("int"))
    cut = F.expr(f"transform(sequence(0, n - 1), i -> substring(b, i * {block} + 1, {block}))")
    return base.select("doc_id", "tk", "n", F.posexplode(cut).alias("pos", "block"))


def _frequent_beginnings(blocks: DataFrame, layout: int) -> list[bytes]:
    """Beginnings of 32, 64, ... bytes that too many distinct blocks share for one range:
    at most RANGES x partitions of each length."""
    kept = F.pmod(F.xxhash64("block"), F.lit(layout)) == 0
    some = stash(blocks.filter(kept).groupBy("block").agg(F.lit(1).alias("one")).select("block"), "block-layout")
    most, found = max(16, some.count() // (RANGES * wide(blocks.sparkSession))), []
    for size in count(PREFIX, PREFIX):
        start = F.substring("block", 1, size)
        longer = some.filter(F.octet_length("block") > size)
        hot = [bytes(r.start) for r in longer.groupBy(start.alias("start")).count().filter(F.col("count") > most).collect()]
        if not hot:
            return found
        found += hot
        inside = F.broadcast(blocks.sparkSession.createDataFrame([(h,) for h in hot], "start binary"))
        some = some.join(inside, start == F.col("start"), "left_semi")


def _ranged(distinct: DataFrame, beginnings: list[bytes]) -> DataFrame:
    """Blocks in the order of (number of the longest frequent beginning, bytes), in ranges of
    that number and the PREFIX bytes after it: the bounds that the driver draws stay short."""
    n = wide(distinct.sparkSession)
    code, rest = F.lit(0), F.substring("block", 1, PREFIX)
    placed = distinct.select("block", code.alias("code"), rest.alias("rest"))
    numbers: dict[int, list[tuple[bytes, int]]] = {}
    for k, start in enumerate(sorted(beginnings), 1):
        numbers.setdefault(len(start), []).append((start, k))
    for size, rows in sorted(numbers.items()):  # longer ones replace shorter ones
        these = F.broadcast(distinct.sparkSession.createDataFrame(rows, "start binary, number int"))
        hit = F.col("number").isNotNull()
        placed = placed.join(these, F.substring("block", 1, size) == F.col("start"), "left").select(
            "block", F.when(hit, F.col("number")).otherwise(F.col("code")).alias("code"),
            F.when(hit, F.expr(f"substring(block, {size + 1}, {PREFIX})")).otherwise(F.col("rest")).alias("rest"),
        )
    return placed.repartitionByRange(n, "code", "rest").sortWithinPartitions("code", "rest", "block")


def _name_blocks(blocks: DataFrame, layout: int) -> tuple[DataFrame, int]:
    """Names of the distinct blocks in sorted order, found again by a salted hash that is
    checked to be free of collisions on exactly these blocks; another salt is taken if not."""
    ranked = _ranged(blocks.groupBy("block").agg(F.lit(1).alias("one")), _frequent_beginnings(blocks, layout))
    for salt in count(42):
        named = stash(ranked.select(F.xxhash64(F.lit(salt), "block").alias("h"), F.monotonically_increasing_id().alias("name")), "block-names")
        if named.groupBy("h").count().filter("count > 1").isEmpty():
            return named, salt


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, layout: int = LAYOUT) -> DataFrame:
    """doc_id, tk (a hash that keeps apart different texts under one doc_id), level, name."""
    blocks = _blocks(docs, id_col, text_col, block)
    named, salt = _name_blocks(blocks, layout)
    state = blocks.select("doc_id", "tk", "n", "pos", F.xxhash64(F.lit(salt), "block").alias("h")).join(named, "h").drop("h")
    state = stash(state, "block-sequence")
    whole = None
    for level in count():
        ready = state.filter("n = 1").select("doc_id", "tk", F.lit(level).alias("level"), "name")
        whole = ready if whole is None else whole.unionByName(ready)
        rest = state.filter("n > 1")
        if rest.isEmpty():
            return whole.dropDuplicates(["doc_id", "tk"])
        pairs = rest.groupBy("doc_id", "tk", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"),
            F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(-1)).alias("b"),
        )
        ranked = pairs.select("a", "b").distinct().orderBy("a", "b")
        names = stash(ranked.select("a", "b", F.monotonically_increasing_id().alias("name")), "pair-names")
        state = stash(pairs.join(names, ["a", "b"]).select("doc_id", "tk", F.floor((F.col("n") + 1) / 2).cast("int").alias("n"), "pos", "name"), "pair-sequence")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, level, name.

    Of equal texts the row with the largest doc_id stays. Null text counts as empty, a null
    doc_id as smaller than any other. Rows repeated with the same id and text count each in
    group_size, and one of them stays if the id is the largest. An empty table gives none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    members = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tk"), F.sha2(text, 256).alias("text_sha256"))
    members = members.groupBy("doc_id", "tk").agg(F.count("*").alias("m"), F.first("text_sha256").alias("text_sha256"))
    rows = stash(null_safe_join(members, identities(docs, id_col, text_col, block), ["doc_id", "tk"]), "named-documents")
    groups = rows.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("m").alias("group_size"))
    out = rows.join(groups, ["level", "name"]).withColumn("copy", F.explode(F.expr("sequence(1L, m)")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256", "level", "name")
