"""Benchmark decontamination with a broadcast set of normalised test n-grams.

The benchmark is cut into parts of at most INDEX_BYTES of text; the windows of one part are
hashed, sorted and broadcast, and the documents are scanned against it once per part. A scan
turns words into benchmark word numbers, hashes all windows of a batch with numpy, looks the
hashes up and verifies every hit word by word. The broadcast index is arrays only: the words,
one array of word numbers, and for each window its hash, one place where it stands and its items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tidyorder.llm.common import null_safe_join, slices, stash

WINDOW = 13
#: Benchmark text behind one broadcast; a larger benchmark takes several scans.
INDEX_BYTES = 16 << 20
#: Pairs of document and item that a scan holds before it drops repeated ones.
PAIRS = 1 << 20

# Word bytes are 0-9, a-z and everything beyond ASCII; A-Z are lower-cased, the rest parts words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def _hashes(ids: np.ndarray, starts: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    """Polynomial hash of the n numbers from each start."""
    out = np.zeros(len(starts), np.uint64)
    for j in range(n):
        out = out * factor + ids[starts + j].astype(np.uint64)
    return out


def _same(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """Whether the n numbers of `a` from each `at` are those of `b` from each `to`."""
    out = np.ones(len(at), bool)
    for j in range(n):
        out &= a[at + j] == b[to + j]
    return out


class _Windows:
    """The distinct windows of one length, sorted by hash: where each stands and its items."""

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, items: np.ndarray, size: int):
        for salt in count(1):  # a factor under which different windows have different hashes
            self.factor = np.uint64((0x9E3779B97F4A7C15 * (2 * salt - 1)) % (1 << 64))
            value = _hashes(tokens, starts, size, self.factor)
            order = np.argsort(value, kind="stable")
            equal = np.flatnonzero(value[order[1:]] == value[order[:-1]])
            if _same(tokens, starts[order[equal]], tokens, starts[order[equal + 1]], size).all():
                break
        new = np.ones(len(order), bool)
        new[equal + 1] = False
        self.hashes, self.places = value[order[new]], starts[order[new]].astype(np.int32)
        most = int(items.max()) + 1
        pairs = np.unique((np.cumsum(new) - 1) * most + items[order])
        self.items = (pairs % most).astype(np.int32)
        self.offsets = np.searchsorted(pairs // most, np.arange(len(self.places) + 1)).astype(np.int32)


class _Index:
    """Windows of benchmark items in arrays."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        names = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(names)}
        vocabulary: dict[bytes, int] = {}
        parts, at, found = [], 0, {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            parts.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int32))
            size = min(n, len(words))
            starts = at + np.arange(len(words) - size + 1)
            found.setdefault(size, []).append((starts, np.full(len(starts), number[item], np.int64)))
            at += len(words)
        self.names = pa.array(names, pa.string())
        self.vocabulary = pa.array(list(vocabulary), pa.binary())
        self.tokens = np.concatenate([np.zeros(0, np.int32), *parts])
        self.windows = {size: _Windows(self.tokens, *(np.concatenate(x) for x in zip(*found[size])), size) for size in sorted(found)}

    def scan(self, words: list[bytes], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hit flag per word, and sorted distinct document * items + item. words: of all
        documents, which end at bounds."""
        ids = pc.fill_null(pc.index_in(pa.array(words, pa.binary()), value_set=self.vocabulary), -1).to_numpy() + 1
        owner = np.repeat(np.arange(len(bounds)), np.diff(bounds, prepend=0))
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        marks, pairs, held, most = np.zeros(len(ids) + 1, np.int64), [], 0, max(1, len(self.names))
        for size, w in self.windows.items():
            if len(ids) < size:
                continue
            starts = np.flatnonzero(unknown[size:] == unknown[:-size])
            starts = starts[owner[starts] == owner[starts + size - 1]]
            value = _hashes(ids, starts, size, w.factor)
            at = np.minimum(np.searchsorted(w.hashes, value), len(w.hashes) - 1)
            hit = w.hashes[at] == value
            starts, at = starts[hit], at[hit]
            true = _same(ids, starts, self.tokens, w.places[at], size)
            starts, at = starts[true], at[true]
            np.add.at(marks, starts, 1)
            np.add.at(marks, starts + size, -1)
            once = np.unique(owner[starts] * len(w.places) + at)
            docs, at = once // len(w.places), once % len(w.places)
            sizes = w.offsets[at + 1] - w.offsets[at]
            cuts = np.searchsorted(np.cumsum(sizes), np.arange(PAIRS, int(sizes.sum()), PAIRS))
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                many = sizes[low:high]
                inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                pairs.append(np.repeat(docs[low:high], many) * most + w.items[np.repeat(w.offsets[at[low:high]], many) + inner])
                held += len(pairs[-1])
                if held > PAIRS:
                    pairs = [np.unique(np.concatenate(pairs))]
                    held = 0
        return np.cumsum(marks[:-1]) > 0, np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))


def _scanner(index, schema: StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices([b], "text")):
            texts = [words_of(t or b"") for t in batch.column(2).to_pylist()]
            bounds = np.cumsum([len(t) for t in texts])
            hit, pairs = index.value.scan([w for t in texts for w in t], bounds)
            names = index.value.names
            offsets = np.searchsorted(pairs, np.arange(len(texts) + 1) * max(1, len(names))).astype(np.int32)
            items = pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(pairs % max(1, len(names)))))
            edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
            spans = [[] for _ in texts]
            if len(edges):
                starts, stops = edges[::2], edges[1::2]
                for s, e in zip(starts.tolist(), stops.tolist()):
                    k = int(np.searchsorted(bounds, s, side="right"))
                    while s < e:  # runs of two documents may touch
                        base, stop = int(bounds[k]) - len(texts[k]), min(e, int(bounds[k]))
                        if s < stop:
                            spans[k] += [s - base, stop - base]
                        s, k = stop, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, pa.list_(pa.int64())), items],
                schema=arrow,
            )

    return stream


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, index_bytes: int = INDEX_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, tk, n_words, spans, items, n_hit, contaminated.

    Words are runs of 0-9, a-z (after lower-casing A-Z) and non-ASCII characters. A window is
    n consecutive words of an item, or all words of a shorter item. spans holds word numbers
    start, stop, start, stop...; items the ids, as sorted text, of items with a window in the
    document. Contaminated: hit words are at least a twentieth. Null text has no words; items
    with null text or no words and null ids of items match nothing. An empty benchmark hits
    nothing, an empty table gives no rows, repeated rows give a row each.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tk"), F.col(text_col).cast("binary").alias("text"))
    schema = StructType([
        StructField("doc_id", texts.schema["doc_id"].dataType), StructField("tk", LongType()), StructField("n_words", LongType()),
        StructField("spans", ArrayType(LongType())), StructField("items", ArrayType(StringType())),
    ])
    tests = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).dropna()
    parts = max(1, math.ceil((tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / index_bytes))
    tests = tests.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    out = None
    for part in range(parts):
        rows = tests.filter(F.col("part") == part).select("item_id", "text").collect()  # at most about index_bytes
        index = spark.sparkContext.broadcast(_Index([(r.item_id, bytes(r.text)) for r in rows], n))
        found = texts.mapInArrow(_scanner(index, schema), schema)
        out = found if out is None else out.unionByName(found)
    if parts > 1:
        out = _merge(stash(out, "contamination"), parts)
    n_hit = F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (s, x) -> s + x)")
    out = out.withColumn("n_hit", n_hit)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _merge(found: DataFrame, parts: int) -> DataFrame:
    """Spans and items of the scans of several parts, united per document."""

    key = ["doc_id", "tk"]
    hits = found.filter(F.size("spans") > 0)
    items = hits.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # spans that overlap or touch become one
    pair = F.expr("explode(transform(sequence(0, int(size(spans) / 2) - 1), i -> named_struct('a', spans[2 * i], 'b', spans[2 * i + 1])))")
    each = hits.select(*key, pair.alias("p")).select(*key, "p.a", "p.b").distinct()
    order = Window.partitionBy(*key).orderBy("a", "b")
    apart = F.col("a") > F.coalesce(F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    island = each.withColumn("new", apart.cast("int")).withColumn("island", F.sum("new").over(order))
    one = island.groupBy(*key, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    spans = one.groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("a", "b"))), lambda x: F.array(x["a"], x["b"]))).alias("spans"))
    hits = null_safe_join(spans, items, key)
    # every part returns each row once, so a row repeated k times is here k * parts times
    rows = found.groupBy("doc_id", "tk").agg((F.count("*") / parts).cast("int").alias("copies"), F.first("n_words").alias("n_words"))
    rows = null_safe_join(rows, hits, key, "left").withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    return rows.selectExpr("doc_id", "tk", "n_words", "coalesce(spans, array()) AS spans", "coalesce(items, array()) AS items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table without contaminated documents (mode "documents"), or with the hit words of
    all documents cut out of their texts, up to the next word (mode "spans")."""
    found = scan(docs, benchmark, n, id_col=id_col, text_col=text_col)
    if mode == "documents":
        gone = found.filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("tk").alias("__tk")).distinct()
        tk = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
        return docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]) & (tk == gone["__tk"]), "left_anti")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, span in zip(texts, spans):
            raw = text.encode()
            inside = np.frombuffer(raw.translate(_WORDS), np.uint8) != 32
            starts = np.append(np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0) == 1), len(raw))
            at = np.asarray(span, np.int64)
            lows, highs = starts[at[::2]].tolist(), starts[at[1::2]].tolist()
            out.append(b"".join(raw[a:b] for a, b in zip([0, *highs], [*lows, len(raw)])).decode())
        return pd.Series(out, dtype=object)

    hits = found.filter("n_hit > 0").select(F.col("doc_id").alias("__id"), F.col("tk").alias("__tk"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__tk"])
    tk = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    rows = docs.join(hits, docs[id_col].eqNullSafe(hits["__id"]) & (tk == hits["__tk"]), "left")
    text, hit = F.col(text_col), F.col("__spans").isNotNull()
    shown = cut(F.when(hit, text).otherwise(""), F.coalesce("__spans", F.array().cast("array<bigint>")))
    return rows.withColumn(text_col, F.when(hit, shown).otherwise(text)).drop("__id", "__tk", "__spans")
