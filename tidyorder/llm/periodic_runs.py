"""Periodic runs of words, found by a sparse diagonal DP, and texts with their repeats collapsed.

A run is a stretch of words with smallest period q (words q apart are identical), at least
max(24, 3 * q) words long, that no neighbouring word extends. On the diagonal of lag q a run is
one unbroken row of matches: when a word comes, its earlier occurrences add one to the match
length of their lag, and a lag that is not met again ends. A diagonal that ends long enough is
a run and is emitted there.

All earlier occurrences of a frequent word would be too many active lags, so occurrences are
looked up by context: of the 8, 16, 32, ... words that start at a word, only the nearest
earlier occurrence counts, and only for lags in (m/2, m] (up to 8 for m = 8). That loses
nothing: inside a run of smallest period q the m words (q <= m < 2 * q, or m = 8) that start
anywhere after the first q and end within it occur again exactly q words earlier, and not
nearer, since a nearer occurrence would make the period's word equal to a rotation of itself
and so give a smaller period; a run is long enough to hold q + m words. Each word has at most
one active lag per context length. Contexts are named by sorting pairs of names, so equality
is exact, and those that occur once in their document are dropped at once.

Rows are independent: nothing is shuffled, whole texts are read, and a task holds
`slice_bytes` of text or one document. Null and empty texts have no words and no run; ties of
the strongest run go to the smallest start, then period; repeated rows are treated one by
one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyorder.llm.common import slices

LEAST_WORDS = 24
LEAST_TURNS = 3
CONTEXT = 8
SLICE_BYTES = 4 << 20

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _named(codes: list[bytes], names: dict[bytes, int]) -> list[int]:
    return [names.setdefault(w, len(names)) for w in codes]


def find_runs(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, sorted by start, then period, of several documents
    laid end to end: `words` are codes below 2^31, `ends` the end of each document."""
    if not len(words):
        return (np.empty(0, np.int64),) * 3
    sizes = np.diff(ends, prepend=0)
    stop, begin = np.repeat(ends, sizes), np.repeat(ends - sizes, sizes)
    name, at, size = words.astype(np.int64), np.arange(len(words)), 1
    found = []
    while len(at):
        at = at[at + 2 * size <= stop[at]]
        left, right = name[at], name[np.minimum(at + size, len(words) - 1)]
        both = (left >= 0) & (right >= 0)
        at, key, size = at[both], (left[both] << 32) | right[both], 2 * size
        if not len(at):
            break
        order = np.argsort(key, kind="stable")  # by context, then position
        at, key = at[order], key[order]
        same = key[1:] == key[:-1]
        again = np.zeros(len(at), bool)
        again[1:] = same & (at[:-1] >= begin[at[1:]])  # the nearest earlier occurrence, in the document
        lag = np.zeros(len(at), np.int64)
        lag[1:][again[1:]] = (at[1:] - at[:-1])[again[1:]]
        name = np.full(len(words), -1, np.int64)
        repeated = again | np.append(again[1:], False)
        name[at[repeated]] = np.concatenate(([0], np.cumsum(~same)))[repeated]
        if size >= CONTEXT:
            active = again & (lag <= size) & ((lag > size // 2) | (size == CONTEXT))
            found.append(_ended(at[active], lag[active], size))
        at = np.sort(at[repeated])
    start, length, period = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _ended(at: np.ndarray, lag: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs among the diagonals: words in order, each adding one to the match length of its lag;
    a diagonal ends where the next word has another lag or none."""
    order = np.argsort(at)
    at, lag = at[order], lag[order]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1])
    heads = np.flatnonzero(first)
    matched = np.diff(np.append(heads, len(at))) + size - 1  # words that equal the word `lag` before
    at, lag = at[heads], lag[heads]
    length = matched + lag
    good = length >= np.maximum(LEAST_WORDS, LEAST_TURNS * lag)
    return (at - lag)[good], length[good], lag[good]


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _rows(batches: Iterator[pa.RecordBatch], slice_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", slice_bytes):
        names: dict[bytes, int] = {}
        texts = [(t or "").encode().split() for t in batch.column(1).to_pylist()]  # ASCII white space
        codes = np.fromiter((c for t in texts for c in _named(t, names)), np.int64)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        start, length, period = find_runs(codes, ends)
        doc = np.searchsorted(ends, start, side="right")
        change = np.zeros(len(codes) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        kept = np.cumsum(change[:-1]) == 0
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        runs, best, collapsed = [], [], []
        for k, words in enumerate(texts):
            base = ends[k] - len(words)
            mine = slice(bounds[k], bounds[k + 1])
            own = list(zip((start[mine] - base).tolist(), length[mine].tolist(), period[mine].tolist()))
            runs.append([dict(zip(("start", "length", "period"), r)) for r in own])
            top = _strongest(own)
            best.append(top and dict(zip(("start", "length", "period"), top)))
            left = words if not own else [w for w, keep in zip(words, kept[base : ends[k]].tolist()) if keep]
            collapsed.append(b" ".join(left).decode())
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(runs, pa.list_(run)), pa.array(best, run), pa.array(collapsed, pa.string())],
            names=["doc_id", "n_words", "runs", "strongest", "collapsed"],
        )


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, n_words, runs by start and period, the strongest run, the collapsed text: words
    of a run after its first period dropped, the others joined by one space)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, runs array<{RUN}>, strongest {RUN}, collapsed string"
    return rows.mapInArrow(lambda batches: _rows(batches, slice_bytes), schema)


def plant_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) in which every tenth document, by the checksum h of its id, goes on from
    word a = (h / 10) mod n by repeating the next 1 + (n - a) / (3 + (h / 10) mod 8) words to its
    end. Documents with a null id or without words stay as they are."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for h, text in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").encode().split()
                if words:
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    block, turns = words[a : a + p], -(-(n - a) // p)
                    words = words[:a] + (block * turns)[: n - a]
                out.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    planted = rows.filter(chosen).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.filter(~chosen).unionByName(planted.mapInArrow(plant, f"doc_id {kind}, text string"))
