"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyorder.session import scratch_path

# The white space of the contracts and the ASCII capitals.
SPACE = " \t\n\x0b\f\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows of text that a Python task takes from an Arrow batch at a time, in bytes of text.
SLICE_BYTES = 8 << 20


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, CAPITALS, CAPITALS.lower())
    )


def text_key(text_col: str = "text") -> Column:
    """A hash that keeps apart rows of one doc_id with different texts; null is like empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared checkpoint folder and read it back: cuts the
    lineage, fixes values that depend on row order, and outlives a lost executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """`df` written once as a table bucketed by `key` in the shared folder: joins on the key
    then leave its rows, and so its texts, where they are."""
    spark = df.sparkSession
    path = scratch_path(spark, "bucketed")
    name = "bucketed_" + path.rsplit("-", 1)[-1]
    # a row of text goes to the file of its bucket straight from the scan
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(wide(spark), key).saveAsTable(name)
    return spark.table(name)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the keys of `left` are returned once."""
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"__{k}"]) for k in keys])
    return left.join(right, on, how).drop(*[f"__{k}" for k in keys])


def wide(spark: SparkSession) -> int:
    """Partitions of a shuffle with few bytes and much work."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their texts add up to `limit`; a longer text comes alone."""
    for batch in batches:
        data = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `docs` whose id and text key are in `kept` (doc_id, tk); all columns as they are."""
    wanted = kept.select(F.col("doc_id").alias("__kept_id"), F.col("tk").alias("__kept_tk"))
    tk = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(wanted, docs[id_col].eqNullSafe(wanted["__kept_id"]) & (tk == wanted["__kept_tk"]), "left_semi")
