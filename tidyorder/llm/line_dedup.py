"""Line dedup over range-partitioned hashes.

Lines are hashed to 128 bits and range-partitioned by (hash, document, position), so even one
line of a third of the corpus is spread over many tasks. Every task streams its sorted rows
once: the first document of a hash keeps its lines, later ones lose them. A hash that goes on
over a partition border gets its first document from a table with one row per partition. The
result is a compressed bitmap of kept lines per document; texts are not carried around.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from tidyorder.llm.common import SPACE, ascii_lower, null_safe_join, wide
from tidyorder.session import materialize

MIN_KEY = 10


def _text(text_col: str):
    return F.coalesce(F.col(text_col), F.lit(""))


def _lines(docs: DataFrame, id_col: str, text_col: str, min_key: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(_text(text_col)).alias("tk"), F.posexplode(F.split(_text(text_col), "\n")).alias("pos", "line"))
    rows = rows.withColumn("key", ascii_lower(F.btrim("line", F.lit(SPACE)))).filter(F.length("key") >= min_key)
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc_id", "tk", "pos")


class _Run:
    """State of a stream of rows sorted by (h1, h2, doc): the current hash and its first doc."""

    def __init__(self, carry: tuple | None, doc_type: pa.DataType):
        self.hash = carry[:2] if carry else None
        self.doc = pa.array([carry[2] if carry else None], doc_type)

    def dropped(self, batch: pa.RecordBatch) -> np.ndarray:
        h1, h2 = (batch.column(i).to_numpy() for i in (0, 1))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = self.hash is None or (h1[0], h2[0]) != self.hash
        docs = batch.column(2)
        first = np.maximum.accumulate(np.where(new, np.arange(1, len(h1) + 1), 0))
        firsts = pa.concat_arrays([self.doc, docs]).take(pa.array(first))
        same = pc.or_(pc.fill_null(pc.equal(docs, firsts), False), pc.and_(pc.is_null(docs), pc.is_null(firsts)))
        self.hash, self.doc = (h1[-1], h2[-1]), firsts.slice(len(h1) - 1, 1)
        return ~same.to_numpy(zero_copy_only=False)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run, head, part = None, None, None
    for batch in batches:
        if batch.num_rows:
            if run is None:
                run = _Run(None, batch.column(2).type)
                head, part = tuple(batch.column(i)[0].as_py() for i in (0, 1)), batch.column(5)[0].as_py()
            run.dropped(batch)
    if run is not None:
        cells = [part, *head, int(run.hash[0]), int(run.hash[1])]
        yield pa.RecordBatch.from_arrays([*[pa.array([c], pa.int64()) for c in cells], run.doc], ["p", "a1", "a2", "z1", "z2", "doc"])


def _drops(carries: dict):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = None
        for batch in batches:
            if batch.num_rows:
                run = run or _Run(carries.get(batch.column(5)[0].as_py()), batch.column(2).type)
                yield batch.filter(pa.array(run.dropped(batch))).select([2, 3, 4])

    return stream


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """doc_id, tk, pos of every line that an earlier document already has."""
    order = ["h1", "h2", "doc_id", "tk", "pos"]
    lines = _lines(docs, id_col, text_col, min_key)
    ranged = lines.repartitionByRange(wide(docs.sparkSession), *order).sortWithinPartitions(*order)
    # a checkpoint keeps partitions and their order; both passes below read the same one
    ranged = materialize(ranged).withColumn("p", F.spark_partition_id().cast("long"))
    doc = StructField("doc", ranged.schema["doc_id"].dataType)
    edge_type = StructType.fromDDL("p long, a1 long, a2 long, z1 long, z2 long").add(doc)
    carries, open_hash = {}, None
    for e in sorted(ranged.mapInArrow(_edges, edge_type).collect()):  # one row per partition
        if open_hash is not None and open_hash[:2] == (e.a1, e.a2):
            carries[e.p] = open_hash
        if open_hash is None or open_hash[:2] != (e.z1, e.z2):
            open_hash = (e.z1, e.z2, e.doc)
    out = StructType([ranged.schema[c] for c in ("doc_id", "tk", "pos")])
    return ranged.mapInArrow(_drops(carries), out)


@F.pandas_udf(BinaryType())
def _bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    def one(n, gone):
        keep = np.ones(n, bool)
        if gone is not None:
            keep[np.asarray(gone, np.int64)] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([one(n, g) for n, g in zip(n_lines, dropped)], dtype=object)


@F.pandas_udf(StringType())
def _kept_text(text: pd.Series, n_lines: pd.Series, bitmap: pd.Series) -> pd.Series:
    def one(t, n, bits):
        if t is None:
            return None
        keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n).astype(bool)
        return "\n".join([line for line, k in zip(t.split("\n"), keep) if k])

    return pd.Series([one(*x) for x in zip(text, n_lines, bitmap)], dtype=object)


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """One row per document: doc_id, tk, n_lines, n_dropped, keep_bitmap (zlib of packed bits).

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of at least
    `min_key` code points stay in the smallest doc_id that has them, all its lines, and go
    elsewhere. Null or empty text is one empty line. A null doc_id is smaller than any other;
    rows repeated with one id and text are one document (one row here), rows with one id and
    other texts are parts of one document. An empty table gives none.
    """
    gone = dropped_lines(docs, id_col, text_col, min_key).groupBy("doc_id", "tk").agg(F.collect_set("pos").alias("gone"))
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(_text(text_col)).alias("tk"), F.size(F.split(_text(text_col), "\n")).cast("long").alias("n_lines"))
    rows = null_safe_join(sizes.dropDuplicates(["doc_id", "tk"]), gone, ["doc_id", "tk"], "left")
    n_gone = F.coalesce(F.size("gone"), F.lit(0))
    return rows.select("doc_id", "tk", "n_lines", F.greatest(n_gone, F.lit(0)).cast("long").alias("n_dropped"), _bitmap("n_lines", "gone").alias("keep_bitmap"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every input row; only documents that lose
    lines pass through Python."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(_text(text_col)).alias("tk"), _text(text_col).alias("text"))
    rows = null_safe_join(texts, bitmaps, ["doc_id", "tk"])
    cut = _kept_text(F.expr("if(n_dropped > 0, text, null)"), "n_lines", "keep_bitmap")
    return rows.withColumn("cut", cut).select("doc_id", "n_lines", "n_dropped", F.expr("if(n_dropped > 0, cut, text)").alias("kept_text"))
