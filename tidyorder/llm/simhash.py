"""SimHash near-dedup with a pigeonring filter.

Fingerprints are 64-bit majorities over shingle hashes. Cut into m = distance + 1 segments on
a ring, two fingerprints within `distance` bits have a segment from which every chain of l
consecutive segments differs in at most l * distance / m bits. Candidates meet on the chain of
length two: first segment equal, second one bit apart at most. Longer chains then prune them
step by step before the full Hamming check. Only distinct fingerprints are compared, groups
are streamed in sorted order, and a group returns a spanning forest of its links, not its
pairs. Groups with more than GROUP fingerprints are cut into pairs of chunks, all compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidyorder.llm.common import slices, stash, text_key, wide

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Fingerprints of a group that are held and compared at once.
GROUP = 4096
#: Groups up to this size are compared in bulk with others.
SMALL = 48


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], "<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tk, fp (the 64 bits as a signed long) of every row; null and empty texts have 0."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), text_key(text_col).alias("tk"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t or b"", shingle, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], ["doc_id", "tk", "fp"])

    return texts.mapInArrow(stream, StructType([texts.schema["doc_id"], StructField("tk", LongType()), StructField("fp", LongType())]))


class _Ring:
    def __init__(self, distance: int):
        self.distance, self.m = distance, max(2, distance + 1)
        self.sizes = [64 // self.m + (j < 64 % self.m) for j in range(self.m)]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.masks = [np.uint64(((1 << s) - 1) << int(a)) for s, a in zip(self.sizes, self.starts)]

    def keys(self, fp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """segment, key, fingerprint, 0 for the key itself or 1 with a set bit of the second
        segment cleared: fingerprints one bit apart there meet, one of them unchanged."""
        for i in range(self.m):
            j = (i + 1) % self.m
            key = fp & (self.masks[i] | self.masks[j])
            yield i, key, fp, np.zeros(len(fp), np.int8)
            if 2 * self.distance >= self.m:
                for b in range(self.sizes[j]):
                    bit = np.uint64(1 << int(self.starts[j] + b))
                    has = (fp & bit) != 0
                    yield i, key[has] & ~bit, fp[has], np.ones(int(has.sum()), np.int8)

    def near(self, a: np.ndarray, b: np.ndarray, i: int) -> np.ndarray:
        """Indices of the pairs that keep to all chain budgets from segment i and to the distance."""
        x, at = a ^ b, np.arange(len(a))
        chain = np.zeros(len(a), np.int64)
        for step in range(self.m):
            chain = chain + np.bitwise_count(x & self.masks[(i + step) % self.m])
            ok = chain * self.m <= (step + 1) * self.distance
            x, at, chain = x[ok], at[ok], chain[ok]
        return at


def _key_rows(ring: _Ring):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, key, fp, flag in ring.keys(batch.column(0).to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i, np.int8)), pa.array(key.view(np.int64)), pa.array(flag), pa.array(fp.view(np.int64))], ["seg", "key", "flag", "fp"])

    return stream


def _forest(ring: _Ring, i: int, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of left x right that join parts not yet joined."""
    nodes = np.concatenate([left, right])
    part = np.arange(len(nodes))
    for k, x in enumerate(left):
        hits = len(left) + ring.near(np.broadcast_to(x, len(right)), right, i)
        hits = hits[part[hits] != part[k]]
        if len(hits):
            labels, first = np.unique(part[hits], return_index=True)
            part[np.isin(part, labels)] = part[k]
            yield np.full(len(first), x), nodes[hits[first]]


def _links(ring: _Ring):
    """Streams rows sorted by group (seg, key, ca, cb) with flag 0 first."""

    def pairs_of(seg, group, chunk, flag, fp, held):
        """Links among the rows of one batch, and with what the open group has held."""
        cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(cut, len(group)))
        exact = np.add.reduceat((flag == 0).astype(np.int64), cut)
        small = (size <= SMALL) & (size > 1) & (exact > 0) & (chunk[cut] < 0)
        small[0] &= not len(held)
        for s in np.unique(size[small]):
            a, b = np.triu_indices(int(s), 1)
            base = cut[small & (size == s)]
            left, right = (base[:, None] + a).ravel(), (base[:, None] + b).ravel()
            ok = flag[left] == 0
            left, right = left[ok], right[ok]
            for i in range(ring.m):
                of = seg[left] == i
                at = ring.near(fp[left[of]], fp[right[of]], i)
                yield fp[left[of][at]], fp[right[of][at]]
        rest = ~small & (exact > 0) & (size > 1)
        if len(held):
            rest[0] = True
        for g in np.flatnonzero(rest):
            rows = slice(int(cut[g]), int(cut[g] + size[g]))
            mine, kind, side = fp[rows], flag[rows], chunk[rows]
            old = held if g == 0 else held[:0]
            i = int(seg[cut[g]])
            if side[0] < 0 or side[0] == 0:  # one chunk: all exact rows with all rows
                yield from _forest(ring, i, np.concatenate([old, mine[kind == 0]]), mine)
            else:  # two chunks: flag 0 the first, 1 the second
                yield from _forest(ring, i, np.concatenate([old, mine[kind == 0]]), mine[kind != 0])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_group = np.zeros(0, np.uint64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            seg, key, ca, cb, flag, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            fp = fp.view(np.uint64)
            same = (seg[1:] == seg[:-1]) & (key[1:] == key[:-1]) & (ca[1:] == ca[:-1]) & (cb[1:] == cb[:-1])
            group = np.concatenate([[0], np.cumsum(~same)])
            if open_group != (seg[0], key[0], ca[0], cb[0]):
                held = held[:0]
            kind = np.where(ca < 0, -1, np.where(ca == cb, 0, 1))
            found = [x for x in pairs_of(seg, group, kind, flag, fp, held) if len(x[0])]
            last = group == group[-1]
            held = np.concatenate([held if group[-1] == 0 else held[:0], fp[last & (flag == 0)]])
            open_group = (seg[-1], key[-1], ca[-1], cb[-1])
            if found:
                a, b = (np.concatenate([x[k] for x in found]).view(np.int64) for k in (0, 1))
                a, b = a[a != b], b[a != b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return stream


def links(fps: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all those within
    `distance` bits; not every link, but every two linked fingerprints are connected."""
    ring = _Ring(distance)
    rows = fps.mapInArrow(_key_rows(ring), "seg byte, key long, flag byte, fp long")
    hot = stash(rows.filter("flag = 0").groupBy("seg", "key").count().filter(F.col("count") > group), "hot-groups")
    none = F.lit(-1)
    if hot.isEmpty():
        rows = rows.select("seg", "key", none.alias("ca"), none.alias("cb"), "flag", "fp")
    else:
        rows = rows.join(hot, ["seg", "key"], "left").withColumn("chunks", F.ceil(F.col("count") / group).cast("int"))
        cold = rows.filter("chunks is null").select("seg", "key", none.alias("ca"), none.alias("cb"), "flag", "fp")
        mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int").alias("mine")
        split = rows.filter("chunks is not null").select("seg", "key", "flag", "fp", mine, F.explode(F.expr("sequence(0, chunks - 1)")).alias("other"))
        # exact rows meet all chunks, in order; changed rows come as second part against each chunk
        pair = split.filter("flag = 0").select("seg", "key", F.least("mine", "other").alias("ca"), F.greatest("mine", "other").alias("cb"), F.expr("cast(if(mine > other, 1, 0) as byte)").alias("flag"), "fp")
        changed = split.filter("flag = 1").select("seg", "key", F.col("other").alias("ca"), F.col("other").alias("cb"), "flag", "fp")
        rows = cold.unionByName(pair).unionByName(changed)
    keys = ["seg", "key", "ca", "cb"]
    rows = rows.repartition(wide(fps.sparkSession), *keys).sortWithinPartitions(*keys, "flag", "fp")
    return rows.mapInArrow(_links(ring), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for the nodes of edges a, b.

    Every round a node takes the smallest label around it and then that label's label.
    """
    edges = stash(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "peer"), "component-edges")
    labels = stash(edges.groupBy("node").agg(F.least(F.min("peer"), F.col("node")).alias("root")), "component-labels")
    while True:
        around = edges.join(labels.withColumnsRenamed({"node": "peer"}), "peer").groupBy("node").agg(F.min("root").alias("low"))
        lowest = labels.join(around, "node").select("node", "root", F.least("root", "low").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        moved = stash(lowest.join(jump, "low", "left").select("node", F.least("low", "far").alias("next"), "root"), "component-labels")
        labels = moved.select("node", F.col("next").alias("root"))
        if moved.filter("next != root").isEmpty():
            return labels


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, tk, fp, component_id (smallest doc_id linked, itself included).

    Null and empty texts have fingerprint 0 and link like others; a text with fewer words than
    a shingle is one shingle. Repeated rows give a row each and link at distance 0. Null ids
    are never a component's id unless there is no other. An empty table gives no rows.
    """
    rows = stash(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    firsts = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(firsts.select("fp"), distance, group))
    rooted = firsts.join(roots.withColumnsRenamed({"node": "fp"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "tk", "fp", "component_id")
