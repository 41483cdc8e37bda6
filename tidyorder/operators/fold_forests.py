"""Random forests of several models grown together, one pass over the table per level.

Cross-fitting needs one forest per fold, and every row trains all models but one. Instead of a
fit per fold, the table is laid out once in blocks; in each pass a task walks its rows down all
unfinished trees of all models and counts (model, tree, node, feature, bin, class); the counts
of a tree are added up in one stream and give the best split of each of its nodes. Ten passes
grow any number of models. A row's bins and label are packed into a 64-bit word, so a step down a
tree is one sum, whose carry says where the row goes, for all rows of a chunk.

Counts are whole numbers and draws are hashes of the row id, so a forest does not depend on how
rows are laid out or in which order they come. A tree weighs rows by Poisson(1) draws, looks at
sqrt(d) features per node and splits by Gini impurity over at most `BINS` bins, whose edges come
from about `EDGE_SAMPLE` rows a model (as Spark's own forest does) and only from rows the model
trains on. The driver holds the nodes, at most models x trees x 2^(depth+1) of a few bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyorder.session import materialize, parallel_tasks

BINS = 32
EDGE_SAMPLE = 10_000
BLOCK_ROWS = 50_000
MOST_BLOCK_ROWS = 1_000_000  # every block sends its counts of all trees, so large tables have large blocks
CHUNK_ROWS = 8192  # rows that walk together: their arrays stay in the processor's cache
BITS = 6  # of a bin and a free bit above it, which a sum carries into
WORD_COLUMNS = 10
_CARRIES = np.int64(sum(1 << (BITS * (j + 1)) for j in range(WORD_COLUMNS)))
TREES_PER_BATCH = 25
COUNTS_AT_ONCE = 1 << 29  # of all blocks, about, in bytes; where there are more, fewer models are counted in a pass
_POISSON = np.repeat(  # a 16-bit draw to a Poisson(1) count
    np.arange(9, dtype=np.uint8),
    np.diff([0, *(round(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)), 65536]),
)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the result."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key(*parts: int) -> np.uint64:
    """One number from a few."""
    out = np.zeros(1, np.uint64)
    for p in parts:
        with np.errstate(over="ignore"):
            out = _mixed(out * np.uint64(31) + np.uint64(p % (1 << 64)) + np.uint64(0x9E3779B97F4A7C15))
    return out[0]


@dataclass(frozen=True)
class Layout:
    """Blocks of rows, one per partition, and what all models need to read them: per model the
    fills of missing cells and the edges of the bins, one array per column."""

    blocks: DataFrame
    columns: list[str]
    fills: np.ndarray
    edges: list[list[np.ndarray]]

    @property
    def models(self) -> int:
        return len(self.fills)


@dataclass
class Trees:
    """Nodes of all trees by (model, tree, heap position): the feature (-1: a leaf), the last bin
    that goes left, and the counts of both classes."""

    feature: np.ndarray
    cut: np.ndarray
    counts: np.ndarray
    weights: np.ndarray

    def shares(self) -> np.ndarray:
        """Weighted share of class 1 per node."""
        weighted = self.counts * self.weights[:, None, None, :]
        total = weighted.sum(axis=-1)
        return np.where(total > 0, weighted[..., 1] / np.where(total > 0, total, 1), 0.5)


class _Block:
    """The rows of one block as arrays; `bins(model)` codes them under a model's fills and edges."""

    def __init__(self, row: dict, d: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.label = np.frombuffer(row["label"], np.int8)
        self.fold = np.frombuffer(row["fold"], np.int16)
        self.only = np.frombuffer(row["only"], np.int16)
        self.values = np.frombuffer(row["values"], np.float64).reshape(-1, d)

    def trains(self, model: int) -> np.ndarray:
        """Rows that a model trains on: all of other folds, and those made for it alone."""
        return np.flatnonzero(np.where(self.only >= 0, self.only == model, self.fold != model))

    def bins(self, fills: np.ndarray, edges: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), self.values.shape[1]), np.uint8)
        for j, cuts in enumerate(edges):
            x = self.values[rows, j]
            out[:, j] = np.searchsorted(cuts, np.where(np.isnan(x), fills[j], x), side="left")
        return out

    def words(self, fills: np.ndarray, edges: list[np.ndarray], rows: np.ndarray) -> list[np.ndarray]:
        """The bins of WORD_COLUMNS columns and the label, in the lowest bit, as one number a row."""
        out = []
        for first in range(0, self.values.shape[1], WORD_COLUMNS):
            word = self.label[rows].astype(np.int64)
            for j in range(first, min(first + WORD_COLUMNS, self.values.shape[1])):
                x = self.values[rows, j]
                word |= np.searchsorted(edges[j], np.where(np.isnan(x), fills[j], x), side="left") << (BITS * (j - first) + 1)
            out.append(word)
        return out


def lay_out(rows: DataFrame, columns: list[str], fills: np.ndarray, seed: int, block_rows: int = BLOCK_ROWS) -> Layout:
    """`rows` (row_id, label, fold, only, columns) in blocks. `fold` is the model that must not
    see a row; a row with `only` >= 0 belongs to that model alone; `fills` has a row per model."""
    n = rows.count()
    enough = max(4 * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / MOST_BLOCK_ROWS))
    tasks = max(parallel_tasks(rows.sparkSession), min(math.ceil(n / block_rows), enough))
    cells = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns])
    packed = rows.select("row_id", F.col("label").cast("int").alias("label"), F.col("fold").cast("int").alias("fold"), F.col("only").cast("int").alias("only"), cells.alias("values"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[] for _ in range(5)]
        for batch in batches:
            for k, kind in enumerate((np.int64, np.int8, np.int16, np.int16)):
                held[k].append(batch.column(k).to_numpy(zero_copy_only=False).astype(kind))
            held[4].append(batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(h).tobytes()], pa.binary()) for h in held], names=["ids", "label", "fold", "only", "values"])

    schema = "ids binary, label binary, fold binary, only binary, values binary"
    blocks = materialize(packed.repartition(tasks, "row_id").mapInArrow(pack, schema))
    return Layout(blocks, columns, fills, _edges(packed, fills, n, seed))


def _edges(packed: DataFrame, fills: np.ndarray, n: int, seed: int) -> list[list[np.ndarray]]:
    """Bin edges per model and column from a keyed sample of the rows it trains on."""
    models, d = fills.shape
    share = min(1.0, EDGE_SAMPLE * models / max(1, n * max(1, models - 1)))
    draw = F.pmod(F.xxhash64(F.lit(seed), "row_id"), F.lit(1 << 30)) < math.ceil(share * (1 << 30))
    sample = packed.where(draw).select("fold", "only", "values").toPandas()  # about EDGE_SAMPLE rows a model
    values = np.stack(sample["values"].to_numpy()).astype(float) if len(sample) else np.empty((0, d))
    fold, only = sample["fold"].to_numpy(), sample["only"].to_numpy()
    out = []
    for m in range(models):
        mine = values[np.where(only >= 0, only == m, fold != m)]
        mine = np.where(np.isnan(mine), fills[m], mine)
        out.append([_cuts(np.sort(mine[:, j])) for j in range(d)])
    return out


def _cuts(values: np.ndarray) -> np.ndarray:
    """At most BINS - 1 edges between values, at equal counts where there are more values."""
    distinct = np.unique(values)
    if len(distinct) < 2:
        return np.empty(0)
    if len(distinct) > BINS:
        at = (np.arange(1, BINS) * len(values)) // BINS
        low = np.unique(values[at - 1])
        low = low[low < distinct[-1]]
    else:
        low = distinct[:-1]
    high = distinct[np.searchsorted(distinct, low, side="right")]
    return (low + high) / 2


def _draws(ids: np.ndarray, seed: int, model: int, tree: int) -> np.ndarray:
    """How often a tree draws each row."""
    return _drawn(_lanes(ids, seed, model, tree // 4), tree % 4)


def _lanes(ids: np.ndarray, seed: int, model: int, four: int) -> np.ndarray:
    """One hash a row, which serves four trees."""
    return _mixed(ids.astype(np.uint64) ^ _key(seed, 1, model, four))


def _drawn(lanes: np.ndarray, lane: int) -> np.ndarray:
    return _POISSON.take(((lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64))


@lru_cache(maxsize=None)
def _feature_keys(d: int) -> np.ndarray:
    return np.array([_key(3, j) for j in range(d)])


def _looked_at(seed: int, model: int, tree: int, nodes: np.ndarray, d: int, some: int) -> np.ndarray:
    """The features that each node looks at."""
    grid = _mixed(_mixed(nodes.astype(np.uint64) ^ _key(seed, 2, model, tree))[:, None] ^ _feature_keys(d)[None, :])
    return np.sort(np.argsort(grid, axis=1, kind="stable")[:, :some], axis=1)


def _walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Heap positions of the rows after at most `levels` steps down one tree."""
    at = np.zeros(len(bins), np.int64)
    each = np.arange(len(bins))
    for _ in range(levels):
        f = feature[at]
        inner = f >= 0
        if inner.all():
            at = 2 * at + 1 + (bins[each, f] > cut[at])
        else:
            some = each[inner]
            if not len(some):
                break
            was = at[some]
            at[some] = 2 * was + 1 + (bins[some, f[some]] > cut[was])
    return at


def _steps(feature: np.ndarray, cut: np.ndarray, d: int) -> list[np.ndarray]:
    """Per word a number for each node, counted from 1: a row goes right where the sum with its
    word carries. From a leaf rows go on to the left."""
    out = []
    for first in range(0, d, WORD_COLUMNS):
        mine = (feature >= first) & (feature < first + WORD_COLUMNS)
        place = np.where(mine, BITS * (feature.astype(np.int64) - first) + 1, 0)
        out.append(np.append(0, np.where(mine, (BINS - 1 - cut.astype(np.int64)) << place, 0)))
    return out


def _descend(words: list[np.ndarray], steps: list[np.ndarray], levels: int) -> np.ndarray:
    """Places within their level of the rows of a chunk after `levels` steps."""
    at = np.ones(len(words[0]), np.int64)
    right, more = np.empty_like(at), np.empty_like(at)
    for _ in range(levels):
        for k, (word, step) in enumerate(zip(words, steps)):
            carried = more if k else right
            step.take(at, out=carried, mode="clip")
            np.add(word, carried, out=carried)
            np.bitwise_and(carried, _CARRIES, out=carried)
            if k:
                np.bitwise_or(right, more, out=right)
        np.minimum(right, 1, out=right)
        np.add(at, at, out=at)
        np.add(at, right, out=at)
    at -= 2**levels
    return at


def _counted(
    words: list[np.ndarray], drawn: np.ndarray, steps: list[np.ndarray], looked: np.ndarray, open_nodes: np.ndarray, level: int
) -> np.ndarray:
    """Draws of a tree by (slot of a feature looked at, open node of the level, bin, class)."""
    rows = np.flatnonzero(drawn)
    cells, weight, end = np.empty((looked.shape[1], len(rows)), np.int64), np.empty(len(rows)), 0
    word_of, place = looked // WORD_COLUMNS, BITS * (looked % WORD_COLUMNS)
    places = [[(np.ascontiguousarray(place[:, s]), np.where(word_of[:, s] == k, 2 * BINS - 2, 0)) for k in range(len(words))] for s in range(looked.shape[1])]
    for low in range(0, len(rows), CHUNK_ROWS):
        part = rows[low : low + CHUNK_ROWS]
        held = [w.take(part) for w in words]
        at = _descend(held, steps, level)
        keep = open_nodes.take(at)
        if not keep.all():
            at, part, held = at[keep], part[keep], [w[keep] for w in held]
        here = slice(end, end + len(part))
        end += len(part)
        first = at * (2 * BINS)
        first += held[0] & 1
        value = np.empty(len(part), np.int64)
        for s, shifts in enumerate(places):
            out = cells[s, here]
            out[:] = first
            for word, (shift, bits) in zip(held, shifts):
                shift.take(at, out=value, mode="clip")
                np.right_shift(word, value, out=value)
                value &= bits[0] if len(held) == 1 else bits.take(at)
                out += value
        weight[here] = drawn.take(part)
    return np.concatenate([np.bincount(c[:end], weight[:end], 2 * BINS * len(open_nodes)) for c in cells])


def _packed(counts: np.ndarray) -> tuple[str, bytes]:
    """Counts in the smallest whole-number type that holds them; few that are not zero with
    their places."""
    kind = next(k for k in ("u1", "u2", "u4", "u8") if counts.max(initial=0) <= np.iinfo(k).max)
    full = np.flatnonzero(counts)
    if len(full) * (4 + np.dtype(kind).itemsize) < counts.size * np.dtype(kind).itemsize:
        return f"s{kind}", full.astype("u4").tobytes() + counts[full].astype(kind).tobytes()
    return kind, counts.astype(kind).tobytes()


def _add(total: np.ndarray, kind: str, data: bytes) -> None:
    if kind[0] != "s":
        total += np.frombuffer(data, kind)
        return
    n = len(data) // (4 + np.dtype(kind[1:]).itemsize)
    total[np.frombuffer(data, "u4", n)] += np.frombuffer(data, kind[1:], n, 4 * n)  # places are distinct


def _splits(counts: np.ndarray, looked: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best split of each node from its counts (node, feature, bin, class): feature or -1, last
    bin to the left, counts of the left part and of the node."""
    whole = counts[:, 0].sum(axis=1)
    full = np.flatnonzero(whole.any(axis=1))
    zeros, ones = counts[full, :, :, 0].cumsum(axis=2), counts[full, :, :, 1].cumsum(axis=2)
    left0, left1 = zeros[:, :, :-1], ones[:, :, :-1]
    right0, right1 = zeros[:, :, -1:] - left0, ones[:, :, -1:] - left1

    def impurity(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
        a, b = n0 * weights[0], n1 * weights[1]
        return 2 * a * b / np.maximum(a + b, 1e-300)

    loss = impurity(left0, left1) + impurity(right0, right1)
    loss[(left0 + left1 == 0) | (right0 + right1 == 0)] = np.inf
    loss = loss.reshape(len(full), counts.shape[1] * (counts.shape[2] - 1))
    best = loss.argmin(axis=1)
    each = np.arange(len(full))
    slot, at = np.divmod(best, counts.shape[2] - 1)
    better = impurity(whole[full, 0], whole[full, 1]) - loss[each, best] > 1e-9
    feature, cut, left = np.full(len(counts), -1), np.zeros(len(counts), np.int64), np.zeros_like(whole)
    feature[full] = np.where(better, looked[full, slot], -1)
    cut[full] = at
    left[full] = np.stack([left0[each, slot, at], left1[each, slot, at]], axis=1)
    return feature, cut, left, whole


def grow(layout: Layout, seed: int, trees: int, depth: int, weights: np.ndarray | None = None) -> Trees:
    """Forests of all models. `weights` (model, class) weigh the classes."""
    models, d = layout.fills.shape
    some = max(1, round(math.sqrt(d)))
    size = 2 ** (depth + 1) - 1
    grown = Trees(
        np.full((models, trees, size), -1, np.int16), np.zeros((models, trees, size), np.uint8), np.zeros((models, trees, size, 2), np.int64),
        np.ones((models, 2)) if weights is None else weights,
    )
    context = layout.blocks.sparkSession.sparkContext
    tasks = parallel_tasks(layout.blocks.sparkSession)
    fills, edges = layout.fills, layout.edges
    for level in range(depth):
        width, base = 2**level, 2**level - 1
        # nodes of this level that their parent's split made
        open_nodes = np.ones((models, trees, 1), bool) if level == 0 else np.repeat(grown.feature[:, :, (base - 1) // 2 : base] >= 0, 2, axis=2)
        if not open_nodes.any():
            break
        known = context.broadcast((grown.feature[:, :, :base], grown.cut[:, :, :base], open_nodes))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            feature, cut, nodes = known.value
            for row in (r for b in batches for r in b.to_pylist()):
                block, ready = _Block(row, d), []
                for m in mine:
                    rows = block.trains(m)
                    words, ids, four = block.words(fills[m], edges[m], rows), block.ids[rows], -1
                    for t in np.flatnonzero(nodes[m].any(axis=1)).tolist():
                        if t // 4 != four:
                            four, lanes = t // 4, _lanes(ids, seed, m, t // 4)
                        looked = _looked_at(seed, m, t, np.arange(base, base + width), d, some)
                        counts = _counted(words, _drawn(lanes, t % 4), _steps(feature[m, t], cut[m, t], d), looked, nodes[m, t], level)
                        ready.append((m, t, *_packed(counts)))
                        if len(ready) == TREES_PER_BATCH:
                            yield counted_trees(ready)
                            ready = []
                if ready:
                    yield counted_trees(ready)

        def counted_trees(ready: list[tuple[int, int, str, bytes]]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ready), kinds)], names=["model", "tree", "kind", "counts"])

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, total = None, None

            def best() -> pa.RecordBatch:
                looked = _looked_at(seed, *at, np.arange(base, base + width), d, some)
                found = _splits(total.reshape(some, width, BINS, 2).swapaxes(0, 1), looked, grown_weights[at[0]])
                values = [pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in zip(found, ("i2", "u1", "i8", "i8"))]
                return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), *values], names=["model", "tree", "feature", "cut", "left", "whole"])

            for batch in batches:
                for r in batch.to_pylist():
                    if (r["model"], r["tree"]) != at:
                        if at is not None:
                            yield best()
                        at, total = (r["model"], r["tree"]), np.zeros(width * some * BINS * 2, np.int64)
                    _add(total, r["kind"], r["counts"])
            if at is not None:
                yield best()

        grown_weights = grown.weights
        passes = min(models, math.ceil(layout.blocks.rdd.getNumPartitions() * models * trees * width * some * BINS * 2 / COUNTS_AT_ONCE))
        for mine in np.array_split(np.arange(models), passes):
            mine = mine.tolist()
            counted = layout.blocks.mapInArrow(count, "model int, tree int, kind string, counts binary")
            dealt = counted.repartition(tasks, "model", "tree").sortWithinPartitions("model", "tree")
            for r in dealt.mapInArrow(split, "model int, tree int, feature binary, cut binary, left binary, whole binary").collect():  # one row a tree
                m, t, here = r.model, r.tree, slice(base, base + width)
                feature, whole = np.frombuffer(r.feature, "i2"), np.frombuffer(r.whole, "i8").reshape(-1, 2)
                left = np.frombuffer(r.left, "i8").reshape(-1, 2)
                feature = np.where(open_nodes[m, t], feature, -1)
                grown.feature[m, t, here], grown.cut[m, t, here] = feature, np.frombuffer(r.cut, "u1")
                if level == 0:
                    grown.counts[m, t, here] = whole
                below = slice(2 * base + 1, 2 * base + 1 + 2 * width)
                parts = np.stack([left, whole - left], axis=1)
                grown.counts[m, t, below] = np.where((feature >= 0)[:, None, None], parts, 0).reshape(-1, 2)
        known.unpersist()
    return grown


def held_out(layout: Layout, grown: Trees) -> DataFrame:
    """(row_id, label, p0, p1) of every original row under the model that did not see it: the
    mean over its trees of the class shares in the row's leaf."""
    models, d = layout.fills.shape
    shares = grown.shares()
    fills, edges = layout.fills, layout.edges
    depth = int(math.log2(grown.feature.shape[2] + 1)) - 1
    inner = 2**depth - 1
    for node in range(inner):  # rows of a leaf go on to the left below it
        shares[:, :, 2 * node + 1] = np.where(grown.feature[:, :, node] < 0, shares[:, :, node], shares[:, :, 2 * node + 1])
    known = layout.blocks.sparkSession.sparkContext.broadcast((grown.feature[:, :, :inner], grown.cut[:, :, :inner], shares[:, :, inner:]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, cut, share = known.value
        for row in (r for b in batches for r in b.to_pylist()):
            block = _Block(row, d)
            for m in range(models):
                rows = np.flatnonzero((block.only < 0) & (block.fold == m))
                words, total = block.words(fills[m], edges[m], rows), np.zeros(len(rows))
                steps = [_steps(feature[m, t], cut[m, t], d) for t in range(feature.shape[1])]
                for low in range(0, len(rows), CHUNK_ROWS):
                    here = slice(low, low + CHUNK_ROWS)
                    held = [w[here] for w in words]
                    for t in range(feature.shape[1]):
                        total[here] += share[m, t].take(_descend(held, steps[t], depth))
                p1 = total / feature.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids[rows]), pa.array(block.label[rows].astype(np.int32)), pa.array(1 - p1), pa.array(p1)], names=["row_id", "label", "p0", "p1"]
                )

    return layout.blocks.mapInArrow(score, "row_id bigint, label int, p0 double, p1 double")
