"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed once per document in Arrow batches. Trees are grown level by level
from histograms of binned statistics over a keyed sample of labelled rows of bounded expected
size (`sample`, a parameter). A model is a few flat arrays, all trees complete to one depth,
so a batch of documents walks all trees together with numpy.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, LongType, StructField, StructType

from tidyorder.llm.common import slices, stash, text_key

SAMPLE = 20_000
BINS = 64

# Byte classes: capitals, small letters, digits, white space, ASCII marks, beyond ASCII.
_CLASS = np.array([0 if 65 <= c <= 90 else 1 if 97 <= c <= 122 else 2 if 48 <= c <= 57 else 3 if c == 32 or 9 <= c <= 13 else 5 if c >= 128 else 4 for c in range(256)])
_MARKS = [ord(c) for c in "!?.,;:'\"-#$%&*|<>{}()[]/\\=_@+~^`"]


def statistics(text: bytes) -> list[float]:
    """Statistics of one text; all are defined for an empty one."""
    n = max(1, len(text))
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    classes = np.bincount(_CLASS, weights=count, minlength=6) / n
    p = count[count > 0] / n
    entropy = float(-(p * np.log2(p)).sum()) if text else 0.0
    words = text.split()
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    w = max(1, len(words))
    often = Counter(words)
    pairs = len(set(zip(words, words[1:]))) / max(1, len(words) - 1)
    lines = text.split(b"\n")
    line_sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    seen = often.most_common(3)
    endings = sum(1 for x in lines if x.rstrip()[-1:] in b".!?" and x.strip()) / len(lines)
    capital = sum(1 for x in words if x.isupper() and len(x) > 1) / w
    marked = sum(1 for x in words if not (x[-1:].isalnum() or x[-1] >= 128 or x[-1:] in b".,;:!?")) / w
    packed = len(zlib.compress(text, 1)) / n
    return [
        np.log1p(len(text)), np.log1p(len(words)), *classes, entropy, packed,
        sizes.mean(), sizes.std(), float((sizes <= 3).sum()) / w, float((sizes >= 15).sum()) / w, np.log1p(sizes.max()),
        len(often) / w, pairs, sum(c for _, c in seen) / w, (seen[0][1] / w if seen else 0.0), np.log1p(seen[0][1]) if seen else 0.0,
        np.log1p(len(lines)), np.log1p(line_sizes.mean()), np.log1p(line_sizes.max()), len(set(lines)) / len(lines), endings,
        capital, marked, *(count[_MARKS] / w),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tk, x: the statistics of every row; null text counts as empty."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), text_key(text_col).alias("tk"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [np.asarray(statistics(t or b""), np.float32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float32()))], ["doc_id", "tk", "x"])

    return texts.mapInArrow(stream, StructType([texts.schema["doc_id"], StructField("tk", LongType()), StructField("x", ArrayType(FloatType()))]))


@dataclass
class Trees:
    """Complete trees of one depth. Node k of a tree has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; larger values go right
    value: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), 1 / (1 + np.exp(-self.start)))
        tree, node = np.arange(trees), np.zeros((len(x), trees), np.int64)
        rows = np.arange(len(x))[:, None]
        while len(x) and node[0, 0] < inner:
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
        raw = self.start + self.value[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, shrink: float = 4.0, bins: int = BINS) -> Trees:
    """Boosting by Newton steps. Without rows of both labels the score is their constant share."""
    share = (y.sum() + 1) / (len(y) + 2)
    start, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j]) for j in range(d)], axis=1)  # value > cuts[c - 1]
    cell = code + np.arange(d) * bins
    raw = np.full(n, start)
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            at = ((node - (width - 1))[:, None] * (d * bins) + cell).ravel()
            g, h = (np.bincount(at, weights=np.repeat(v, d), minlength=width * d * bins).reshape(width, d, bins) for v in (grad, hess))
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + shrink) + (gt - gl) ** 2 / (ht - hl + shrink) - gt**2 / (ht + shrink)
            gain[(hl < 1) | (ht - hl < 1)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                    feature[t, width - 1 + k], threshold[t, width - 1 + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = rate * np.bincount(leaf, weights=grad, minlength=inner + 1) / (np.bincount(leaf, weights=hess, minlength=inner + 1) + shrink)
        raw += value[t, leaf]
    return Trees(feature, threshold, value, start)


def train(rows: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, **how) -> Trees:
    """Fit on features `rows` of documents with a label 0 or 1 in `labels`; ids labelled twice
    take the mean, rounded up. Above `sample` labelled ids a keyed part of that expected size."""
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg((F.avg(label_col) >= 0.5).cast("double").alias("y"))
    marked = stash(marked, "quality-labels")
    n = marked.count()
    if n > sample:
        marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * sample / n))
    got = rows.join(marked, "doc_id").orderBy("doc_id").select("x", "y").toArrow()  # about `sample` rows at most
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(len(got), -1 if len(got) else 0)
    return fit(x, np.array(got.column("y").to_pylist(), np.float64), **how)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.7, folds: int = 4, held: int = 2, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, tk, held_out, score, predicted.

    Labels of held-out ids are not used. Null and empty texts get the score of an empty text;
    repeated rows get equal scores; without usable labels all scores are equal. An empty table
    gives no rows. Inputs of the score are statistics of the text only.
    """
    rows = stash(features(docs, id_col, text_col), "quality-features")
    model = docs.sparkSession.sparkContext.broadcast(train(rows, labels.filter(fold("doc_id", folds) != held), label_col, sample))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(2).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(model.value.score(x))], ["doc_id", "tk", "held_out", "score"])

    out = StructType([rows.schema["doc_id"], rows.schema["tk"], StructField("held_out", BooleanType()), StructField("score", DoubleType())])
    scored = rows.select("doc_id", "tk", "x", (fold("doc_id", folds) == held).alias("held_out")).mapInArrow(stream, out)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
