"""Suffix-array dedup of repeated byte strings by bucket-pointer refinement.

A position is repeated if the `length` bytes from it also start anywhere else. Instead of all
suffixes, each window of `length` bytes is filed under one position inside it: its smallest
hashed q-gram, the leftmost of ties. Equal windows choose the same q-gram at the same offset,
so only positions in one q-gram bucket need to be told apart:

1. q-gram buckets. A position alone in its bucket has no repeated window.
2. Spans. A position's windows share a span, from the first byte of the first to the last byte
   of the last. Equal spans, known by 128 bits of BLAKE2b, repeat all their windows; one span of
   each kind goes on, so copies of a passage cost nothing more.
3. Bucket-pointer refinement. Spans that share a q-gram bucket come to one task. Their byte
   positions start in buckets of (q-gram bucket, distance from the q-gram, two bytes) and are
   sorted again and again by (own bucket, bucket of the position h bytes on); the new bucket
   numbers are written back and are what the next round reads at 2h bytes. Positions alone in
   their bucket leave. After `length` bytes a bucket holds equal windows: no hash decides here.

Only numbers are shuffled in 1 and 2, and the spans of step 3. Counts are combined before each
shuffle; a bucket with more than HOT spans is counted by the 128-bit digests of its windows
instead of being held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidyorder.llm.common import bucketed, slices, stash, wide

LENGTH, GRAM = 200, 32
#: Spans of one bucket that a task holds at once.
HOT = 20_000
_CHUNK = 1 << 20
#: Byte positions that are refined together, unless one bucket has more.
_PIECE = 1 << 19


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection that spreads close values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


_VALUE = _mixed(np.arange(1, 257, dtype=np.uint64))
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i < n, modulo 2**64."""
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _tables:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _tables[size] = tuple(both)
    return _tables[size]


class _Hashes:
    """Hashes of all substrings of a buffer: of any span by two lookups."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * power[: len(data)], out=self.sums[1:])

    def fixed(self, n: int) -> np.ndarray:
        return (self.sums[n:] - self.sums[:-n]) * self.inverse[: len(self.sums) - n]


def _digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2b of each stretch, as rows of two numbers."""
    view, make = memoryview(data), hashlib.blake2b
    raw = b"".join([make(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), stop.tolist())])
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows filed under one position, for texts that lie in `data` up to `ends`:
    (start of the first window, number of windows, offset of the position in the first window,
    bucket of its q-gram, digest of the span)."""
    found = []
    for at in range(0, len(data) - length + 1, _CHUNK):
        part = data[at : at + _CHUNK + length - 1]
        hashes = _Hashes(part)
        grams = hashes.fixed(gram)
        low = np.uint64((1 << 24) - 1)
        order = (_mixed(grams) & ~low) | np.arange(len(grams), dtype=np.uint64)
        place = (_sliding_min(order, length - gram + 1) & low).astype(np.int64)
        starts = np.arange(len(place))
        owner = np.searchsorted(ends, at + starts, side="right")
        whole = ends[owner] >= at + starts + length
        starts, place = starts[whole], place[whole]
        if not len(starts):
            continue
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(starts)))
        start, place = starts[first], place[first]
        offset = place - start
        found.append((at + start, count, offset, grams[place], _digests(part, start, start + count + length - 1)))
    if not found:
        return (*[np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64)], np.zeros((0, 2), np.int64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchor_rows(length: int, gram: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "b"):
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            ends = np.cumsum([len(t) for t in texts])
            start, count, offset, bucket, span = anchors(np.frombuffer(b"".join(texts), np.uint8), ends, length, gram)
            owner = np.searchsorted(ends, start, side="right")
            base = np.concatenate([[0], ends[:-1]])
            rid = batch.column(0).to_numpy()[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid), pa.array(start - base[owner]), pa.array(count.astype(np.int32)), pa.array(offset.astype(np.int32)), pa.array(bucket.view(np.int64)), pa.array(span[:, 0]), pa.array(span[:, 1])],
                ["rid", "start", "n", "offset", "bucket", "high", "low"],
            )

    return stream


def _cut_spans(length: int):
    """rows (b, wanted: start, n, offset, bucket, spans in the bucket, lone): their bytes."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "b"):
            rows = [(rid, w, text[w["start"] : w["start"] + w["n"] + length - 1]) for rid, text, wanted in zip(*(c.to_pylist() for c in batch.columns)) for w in wanted]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[1][k] for r in rows], t) for k, t in (("start", pa.int64()), ("n", pa.int32()), ("offset", pa.int32()), ("bucket", pa.int64()), ("spans", pa.int64()), ("lone", pa.bool_()))],
                    pa.array([r[2] for r in rows], pa.binary()),
                ],
                ["rid", "start", "n", "offset", "bucket", "spans", "lone", "b"],
            )

    return stream


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Bytes of the spans one after another; where each span starts; by window, its row and its
    number in the row."""
    n = batch.column("n").to_numpy().astype(np.int64)
    texts = batch.column("b").to_pylist()
    base = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    return np.frombuffer(b"".join(texts), np.uint8), base, row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _buckets(total: int, at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Numbers for `total` positions: equal for those of `at` with equal keys, -1 for positions
    that are alone with their key or not in `at`."""
    out = np.full(total, -1, np.int64)
    if not len(at):
        return out
    bits = len(at).bit_length()
    if int(key.max()) >> (62 - bits):
        order = np.argsort(key, kind="stable")
        key = key[order]
    else:  # key and place in one number: a plain sort
        key = np.sort(key << bits | np.arange(len(at)))
        order = key & ((1 << bits) - 1)
        key >>= bits
    same = key[1:] == key[:-1]
    shared = np.zeros(len(key), bool)
    shared[1:] = same
    shared[:-1] |= same
    number = np.concatenate([[0], np.cumsum(~same)])
    out[at[order[shared]]] = number[shared]
    return out


def shared_positions(data: np.ndarray, base: np.ndarray, bucket: np.ndarray, offset: np.ndarray, length: int) -> np.ndarray:
    """Flag per byte: the `length` bytes from it lie, at the same distance from the q-gram, in
    another span of its bucket. Spans lie in `data` from base[k] to base[k + 1], sorted by bucket."""
    size = np.diff(base)
    total = len(data)
    row = np.repeat(np.arange(len(size)), size)
    inner = np.arange(total) - base[row]
    left = size[row] - inner
    away = inner - offset[row] + offset.max()
    rank = np.concatenate([[0], np.cumsum(bucket[1:] != bucket[:-1])])
    at, h = np.flatnonzero(left >= 2), 2
    start = rank[row[at]] * (int(away.max()) + 1) + away[at]
    name = _buckets(total, at, (start << 16) | (data[at].astype(np.int64) << 8) | data[at + 1])
    while h < length:
        step = min(h, length - h)
        at = np.flatnonzero(name >= 0)
        at = at[left[at] >= h + step]
        at = at[name[at + step] >= 0]
        name = _buckets(total, at, name[at] * total + name[at + step])
        h += step
    return name >= 0


def _runs(batch: pa.RecordBatch, row: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
    """rid, start, n of runs of repeated windows of the spans that have no equal."""
    n = batch.column("n").to_numpy().astype(np.int64)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    hit = hit & batch.column("lone").to_numpy(zero_copy_only=False)[row]
    place = np.flatnonzero(hit)
    new = np.concatenate([[True], (place[1:] != place[:-1] + 1) | (row[place[1:]] != row[place[:-1]])]) if len(place) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    rows, count = row[place[first]], np.diff(np.append(first, len(place)))
    return pa.RecordBatch.from_arrays(
        [pa.array(batch.column("rid").to_numpy()[rows]), pa.array(batch.column("start").to_numpy()[rows] + inner[place[first]]), pa.array(count.astype(np.int32))], ["rid", "start", "n"]
    )


def _refined(length: int):
    """Streams spans sorted by bucket; whole buckets are refined together."""

    def solved(table: pa.Table) -> Iterator[pa.RecordBatch]:
        whole = table.combine_chunks().to_batches()[0]
        bucket = whole.column("bucket").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        before = np.cumsum(whole.column("n").to_numpy().astype(np.int64) + length - 1)[first - 1]
        before[0] = 0
        piece = before // _PIECE
        cuts = [*first[np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))].tolist(), whole.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            batch = whole.slice(a, b - a)
            data, base, row, inner = _places(batch)
            hit = shared_positions(data, base, bucket[a:b], batch.column("offset").to_numpy().astype(np.int64), length)
            yield _runs(batch, row, hit[base[row] + inner])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            bucket = now.column("bucket").to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1], side="left"))
            if cut:
                yield from solved(now.slice(0, cut))
            held = now.slice(cut)
        if held is not None:
            yield from solved(held)

    return stream


def _windows(length: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, base, row, inner = _places(batch)
            ids = _digests(data, base[row] + inner, base[row] + inner + length)
            lone = batch.column("lone").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(batch.column("rid").to_numpy()[row]), pa.array(batch.column("start").to_numpy()[row] + inner), pa.array(lone[row])], ["high", "low", "rid", "start", "lone"]
            )

    return stream


def repeated_windows(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """rid, start, n: runs of n repeated windows from byte `start`. texts: rid (unique), b."""
    rows = stash(texts.select("rid", "b").mapInArrow(_anchor_rows(length, gram), "rid long, start long, n int, offset int, bucket long, high long, low long"), "anchors")
    kinds = rows.groupBy("bucket", "high", "low").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "start", "n", "offset")).alias("one"))
    kinds = stash(kinds, "spans")
    buckets = kinds.groupBy("bucket").agg(F.count("*").alias("spans"), F.min("copies").alias("least")).filter("spans > 1 and least = 1")
    copied = rows.join(kinds.filter("copies > 1").select("bucket", "high", "low"), ["bucket", "high", "low"], "left_semi").select("rid", "start", "n")
    wanted = kinds.join(buckets, "bucket").select("one.*", "bucket", "spans", (F.col("copies") == 1).alias("lone"))
    wanted = wanted.groupBy("rid").agg(F.collect_list(F.struct("start", "n", "offset", "bucket", "spans", "lone")).alias("wanted"))
    cut = texts.select("rid", "b").join(wanted, "rid").select("rid", "b", "wanted")
    spans = stash(cut.mapInArrow(_cut_spans(length), "rid long, start long, n int, offset int, bucket long, spans long, lone boolean, b binary"), "shared-spans")
    cold = spans.filter(F.col("spans") <= hot).repartition(wide(texts.sparkSession), "bucket").sortWithinPartitions("bucket")
    out = copied.unionByName(cold.mapInArrow(_refined(length), "rid long, start long, n int"))
    large = spans.filter(F.col("spans") > hot)
    if not large.isEmpty():
        windows = large.mapInArrow(_windows(length), "high long, low long, rid long, start long, lone boolean")
        twice = windows.groupBy("high", "low").agg(F.count("*").alias("c")).filter("c > 1").select("high", "low")
        out = out.unionByName(windows.filter("lone").join(twice, ["high", "low"], "left_semi").select("rid", "start", F.lit(1).alias("n")))
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256, kept.

    spans holds byte positions start, stop, start, stop... of what a string of `length` bytes
    that starts twice covers; kept is the rest as bytes. Null text counts as empty, texts
    shorter than `length` lose nothing; repeated rows repeat each other; an empty table gives
    no rows.
    """
    bytes_ = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = bucketed(docs.select(F.col(id_col).alias("doc_id"), bytes_.alias("b")).withColumn("rid", F.monotonically_increasing_id()), "rid")
    runs = repeated_windows(texts, length, gram, hot).groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    joined = texts.join(runs, "rid", "left").select("doc_id", "b", "runs")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "b"):
            cells = []
            for text, got in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = []
                for s, e in sorted((r["start"], r["start"] + r["n"] - 1 + length) for r in got or ()):
                    if spans and s <= spans[-1]:
                        spans[-1] = max(spans[-1], e)
                    else:
                        spans += [s, e]
                edges = [0, *spans, len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                cells.append((len(text), len(text) - len(kept), len(spans) // 2, spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([c[k] for c in cells], t) for k, t in enumerate(kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"])

    out = StructType.fromDDL("n_bytes long, n_removed long, n_spans long, spans array<long>, kept_sha256 string, kept binary")
    return joined.mapInArrow(stream, StructType([joined.schema["doc_id"], *out.fields]))
