"""LM scoring by online logistic context mixing.

A text is the sequence of its lower-cased words and an end. Frequent words have Huffman codes;
a word is the binary decisions of its code. A rarer word is an escape and the bits of its
letters. For every decision several contexts look up a prediction: for words the node of the
code, the node hashed with the last short word and with the word before, and the way that the
word before went there; for letters the last three and the last five bytes, hashed. Predictions are added in the
logistic domain with weights gated by depth (bit) and repetition. The weights of words follow
the coding error online, after every STEP words. The sum of -log2 of what was predicted is the
length of the text in bits.

Everything is learned from all training texts: words are counted, texts are coded once, then
each task counts decisions in hashed cells, and the compressed parts of a table are summed by
key. The counts of words grow with the corpus; tables of decisions have a fixed size. Starting
weights are the logistic regression on the decisions of all training texts: equal texts lie in
one of two halves, each is predicted from the counts of the other, tasks tally decisions by
gate, bit and predictions in steps, and the regression is solved on the sum of the tallies. It
is solved from, and where a gate has hardly any decisions stays near, a first guess from a
few texts. Weights start again in every block of BLOCK words: a task mixes many blocks in step,
and no text, however long, is one sequential job. Long words are spelled in pieces of SEGMENT
bytes, each of which sees the letters before it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tidyorder.llm.common import slices, stash, wide
from tidyorder.llm.quality import fold
from tidyorder.llm.suffix_dedup import _mixed

CELL_BITS, CHUNK_BITS = 22, 16
BLOCK, STEP, SEGMENT, TOKENS = 256, 8, 1 << 16, 1 << 15
#: Bytes of text behind the first guess of the weights; words with a code; distinct words, and
#: bytes of them, whose spelling a task holds; bytes of text, and of word numbers (as they are
#: counted, and mixed) at a time.
SAMPLE_BYTES, HEAD_WORDS, FLUSH_WORDS, FLUSH_BYTES, SLICE, NUMBERS, MIXED = 2 << 20, 1 << 17, 400_000, 128 << 20, 4 << 20, 1 << 20, 1 << 19
RATE, SCALE, PRIOR = 0.02, 16.0, 0.2
FIT_RATES = (0.2, 0.1, 0.05, 0.02)
#: Decisions that the first guess of a gate counts for; most that a weight moves in a round.
PULL, MOVE, ROUNDS = 64.0, 0.5, 50
END, ESCAPE = b"", b"\n"  # no word of a text


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts, the place among them of every word, and words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string())))
    coded = lists.flatten().dictionary_encode()
    names, at = coded.dictionary.view(pa.binary()), coded.indices.to_numpy()
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    empty = np.flatnonzero(pc.binary_length(names).to_numpy() == 0)  # from white space at an end
    if len(empty):
        kept = at != empty[0]
        sizes = np.add.reduceat(kept.astype(np.int64), np.cumsum(sizes) - sizes)
        at = at[kept] - (at[kept] > empty[0])
        names = names.filter(pa.array(np.arange(len(names)) != empty[0]))
    return names, at, sizes


def _stretched(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(SCALE * np.log((ones + PRIOR) / (zeros + PRIOR))), -127, 127).astype(np.int8)


class Code:
    """Huffman code of the frequent words: node and bit of every decision of each word."""

    def __init__(self, counts: dict[bytes, int]):
        names = sorted(counts, key=lambda w: (counts[w], w))
        self.number = {w: k for k, w in enumerate(names)}
        self.leaves = node = len(names)
        parent, bit = np.full(2 * node, -1, np.int32), np.zeros(2 * node, np.int32)
        heap = [(counts[w], k) for k, w in enumerate(names)]
        heapq.heapify(heap)
        while len(heap) > 1:
            (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
            parent[left] = parent[right] = node
            bit[right] = 1
            heapq.heappush(heap, (a + b, node))
            node += 1
        # all words go up their paths together
        up, levels, sizes = np.arange(self.leaves), [], np.zeros(self.leaves, np.int32)
        words = np.arange(self.leaves)
        while len(words := words[parent[up[words]] >= 0]):
            levels.append((words, (parent[up[words]] - self.leaves) * 2 + bit[up[words]]))
            sizes[words] += 1
            up[words] = parent[up[words]]
        self.sizes = sizes
        self.starts = (np.cumsum(sizes) - sizes).astype(np.int32)
        self.steps = np.zeros(int(sizes.sum()), np.int32)  # node and bit
        for above, (words, step) in enumerate(levels):
            self.steps[self.starts[words] + sizes[words] - 1 - above] = step
        # the whole code of a word as the leading bits of an integer
        lead = np.uint64(1) << (63 - (np.arange(len(self.steps)) - np.repeat(self.starts, sizes))).astype(np.uint64)
        self.codes = np.zeros(len(names), np.uint64)
        np.bitwise_or.at(self.codes, np.repeat(np.arange(len(names)), sizes), lead * (self.steps & 1).astype(np.uint64))
        self.short = np.array([0 < len(w) <= 3 for w in names])
        self.counts = np.array([counts[w] for w in names], np.int64)
        self.lengths = np.array([len(w) + 1 for w in names], np.int64)  # with a byte after it
        self.escape = self.number[ESCAPE]

    def node_table(self) -> np.ndarray:
        """Predictions of the nodes alone, from the counts of the words."""
        total = np.zeros(2 * max(1, self.leaves - 1))
        np.add.at(total, self.steps, np.repeat(self.counts, self.sizes))
        return _stretched(total[1::2], total[::2])

    def decisions(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the decisions of the words one after another: depth, node, bit."""
        sizes = self.sizes[words]
        before = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum()), dtype=np.int32)
        step = self.steps[np.repeat((self.starts[words] - before).astype(np.int32), sizes) + at]
        return at - np.repeat(before.astype(np.int32), sizes), step >> 1, (step & 1).astype(np.int8)


def _after(words: np.ndarray, kind: int, sizes: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Cells of hashed nodes after `words` (-1: none), which are one of two kinds of context."""
    context = (_mixed(((words + 1).astype(np.uint64) << np.uint64(2)) | np.uint64(kind)) >> np.uint64(32)).astype(np.uint32)
    cell = np.repeat(context, sizes)
    cell ^= node
    cell *= np.uint32(0x9E3779B1)
    cell >>= np.uint32(32 - CELL_BITS)
    return cell


def _hashed(node: np.ndarray) -> np.ndarray:
    return (node + 1).astype(np.uint32) * np.uint32(0x85EBCA6B)


class _Decisions:
    """Decisions of texts given as word numbers, the ends of texts among them; worked out for
    TOKENS words at a time, as they take much more memory than the words."""

    def __init__(self, code: Code, words: np.ndarray, ends: np.ndarray):
        at, self.code, self.words = np.arange(len(words)), code, words
        begins = np.concatenate([[0], ends])[:-1]
        first = np.repeat(begins, ends - begins)
        self.before = np.where(at > first, words[np.maximum(at - 1, 0)], -1)
        self.again = self.before == np.where(at > first + 1, words[np.maximum(at - 2, 0)], -2)
        last = np.concatenate([[0], np.maximum.accumulate(np.where(code.short[words], at + 1, 0)) if len(at) else at])[:-1]
        self.short = np.where(last > first, words[np.maximum(last - 1, 0)], -1)
        self.stop = np.concatenate([[0], np.cumsum(code.sizes[words], dtype=np.int64)])
        # groups of STEP words at most, of one block; blocks of BLOCK words at most, of one text
        per = -(-(ends - begins) // STEP)
        inner = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        text = np.repeat(np.arange(len(ends)), per)
        self.stops = self.stop[np.concatenate([[0], np.minimum(begins[text] + (inner + 1) * STEP, ends[text])])]
        new = inner % (BLOCK // STEP) == 0
        self.block = np.cumsum(new) - 1
        self.owner = text[new]

    def inputs(self, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predictions, bit and gate of every decision."""
        n, code = int(self.stop[-1]), self.code
        x, bits, gates = np.empty((n, 4), np.int8), np.empty(n, np.int8), np.empty(n, np.int8)
        # how far the word before went the same way
        old = np.maximum(self.before, 0)
        apart = code.codes[self.words] ^ code.codes[old]
        common = np.where(apart == 0, 64, 64 - np.frexp(apart.astype(np.float64))[1])
        common = np.where(self.before < 0, -1, np.minimum(np.minimum(common, code.sizes[self.words]), code.sizes[old])).astype(np.int8)
        for at in range(0, len(self.words), TOKENS):
            here = slice(at, at + TOKENS)
            words = self.words[here]
            sizes = code.sizes[words]
            depth, node, bit = code.decisions(words)
            low = int(self.stop[at])
            to = slice(low, low + len(node))
            x[to, 0] = tables[0][node]
            node = _hashed(node)
            for kind, context in ((1, self.short), (2, self.before)):
                x[to, kind] = tables[kind][_after(context[here], kind, sizes, node)]
            depth = depth.astype(np.int8)
            shared = np.repeat(common[here], sizes)
            way = 32 * bit - 16
            x[to, 3] = np.where(depth < shared, way, np.where(depth == shared, -way, 0))
            bits[to], gates[to] = bit, np.minimum(depth, 11) + np.repeat(np.where(self.again[here], 12, 0).astype(np.int8), sizes)
        return x, bits, gates

    def count(self, tables: np.ndarray) -> None:
        """Adds the decisions after each short word, and after each word, to the hashed cells.
        A pair of words that comes often is worked out once."""
        n = len(self.code.sizes)
        for kind, context in ((1, self.short), (2, self.before)):
            pairs, times = np.unique((context + 1) * n + self.words, return_counts=True)
            for at in range(0, len(pairs), TOKENS):
                here = slice(at, at + TOKENS)
                words = pairs[here] % n
                sizes = self.code.sizes[words]
                _, node, bit = self.code.decisions(words)
                cell = _after(pairs[here] // n - 1, kind, sizes, _hashed(node)).astype(np.int64) * 2 + bit
                np.add.at(tables[kind - 1], cell, np.repeat(times[here].astype(np.uint32), sizes))


def _run(x: np.ndarray, bit: np.ndarray, gate: np.ndarray, stops: np.ndarray, owner: np.ndarray, weights: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Codes blocks of groups of decisions: bits of each block, and its final weights.

    x: predictions of each decision; stops: 0 and where each group ends; owner: block of each
    group, in order; weights: gates x predictions. Groups of one block follow each other, each
    with the weights that the one before left; blocks go in step."""
    blocks, (gates, inputs) = int(owner[-1]) + 1 if len(owner) else 0, weights.shape
    w = np.repeat(weights[None], blocks, axis=0).reshape(-1, inputs)
    cost = np.zeros(blocks)
    # four predictions of a decision, and four weights, are fetched as one value each
    four = inputs == 4
    rows_x = np.ascontiguousarray(x).view(np.int32).ravel() if four else x
    rows_w = w.view(np.complex128).ravel() if four else w
    facts = gate + 64 * bit
    first = np.searchsorted(owner, np.arange(blocks))
    turn = np.arange(len(owner)) - first[owner]
    order = np.argsort(turn, kind="stable")
    cuts = np.searchsorted(turn[order], np.arange(turn.max() + 2)) if len(owner) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        groups = order[a:b]
        low, size = stops[groups], stops[groups + 1] - stops[groups]
        begin = np.cumsum(size) - size
        place = np.repeat(low - begin, size) + np.arange(int(size.sum()))
        fact = facts[place]
        row = np.repeat(owner[groups] * gates, size) + (fact & 63)
        xs, own = rows_x[place], rows_w[row]
        if four:
            xs, own = xs.view(np.int8).reshape(-1, 4), own.view(np.float32).reshape(-1, 4)
        xs = xs.astype(np.float32)
        logit = own[:, 0] * xs[:, 0]
        for k in range(1, inputs):
            logit += own[:, k] * xs[:, k]
        logit *= np.float32(1 / SCALE)
        sign = np.where(fact >= 64, np.float32(-1), np.float32(1))
        q = 1 + np.exp(np.minimum(sign * logit, np.float32(30)))
        if len(groups):
            cost[owner[groups]] += np.add.reduceat(np.log2(q), begin)
        step = (np.float32(rate / SCALE) * sign * (1 / q - 1)).astype(np.float64)
        for k in range(inputs):
            w[:, k] += np.bincount(row, weights=step * xs[:, k], minlength=len(w))
    return cost, w.reshape(blocks, gates, inputs)


def _fit(x, bit, gate, stops, owner, weights: np.ndarray) -> np.ndarray:
    """Starting weights: again and again the mean of where blocks end that start there."""
    used = np.bincount(gate, minlength=len(weights)) > 0
    for rate in FIT_RATES if len(owner) else ():
        _, w = _run(x, bit, gate, stops, owner, weights, rate)
        weights = np.where(used[:, None], w.mean(axis=0, dtype=np.float64), weights).astype(np.float32)
    return weights


# words


def word_start() -> np.ndarray:
    return np.tile(np.array([0.3, 0.4, 0.3, 0.0], np.float32), (24, 1))


def numbered(code: Code, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of texts with their ends, and where texts end."""
    flat = [w for t in texts for w in t]
    stops = np.cumsum(np.array([len(t) for t in texts], np.int64))
    numbers = np.fromiter(map(code.number.get, flat, repeat(code.escape)), np.int64, len(flat))
    return np.insert(numbers, stops, code.number[END]), stops + np.arange(1, len(stops) + 1)


def _coded(shared):
    """Texts as the numbers of their words and an end, and the rarer words of each."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        for batch in slices(batches, "b", SLICE):
            names, at, sizes = split_words(batch.column(3))
            numbers = np.fromiter(map(code.number.get, names.to_pylist(), repeat(code.escape)), np.int32, len(names))[at]
            stops = np.cumsum(sizes)
            words = np.insert(numbers, stops, code.number[END]).astype(np.int32)
            ends = np.concatenate([[0], stops + np.arange(1, len(stops) + 1)])
            place = np.flatnonzero(numbers == code.escape)
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.searchsorted(place, stops)]), pa.int32()), names.take(pa.array(at[place])))
            texts = pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(words)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], texts, rare], ["doc_id", "held_out", "half", "words", "rare"])

    return stream


def _numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of coded texts, and where texts end."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) // 4)
    return np.frombuffer(b"".join(texts.to_pylist()), np.int32).astype(np.int64), ends


# letters of rare words

_BIT = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int8)
_TREE = np.array([[(1 << j) | (b >> (8 - j)) for j in range(8)] for b in range(256)], np.uint32) * np.uint32(0x85EBCA6B)


def _pieces(words: list[bytes]) -> Iterator[tuple[list[bytes], list[bytes], np.ndarray]]:
    """Batches of pieces of words, each with its end or cut at SEGMENT bytes, the five bytes
    before each piece, and the number of its word; about SEGMENT bytes in a batch."""
    before, pieces, owner, size = [], [], [], 0
    for k, w in enumerate(words):
        whole = w + b"\n"
        for at in range(0, len(whole), SEGMENT):
            piece = whole[at : at + SEGMENT]
            before.append(whole[at - 5 : at] if at else b"\n" * 5)
            pieces.append(piece)
            owner.append(k)
            size += len(piece) + 5
            if size >= SEGMENT:
                yield before, pieces, np.array(owner)
                before, pieces, owner, size = [], [], [], 0
    if pieces:
        yield before, pieces, np.array(owner)


class _Letters:
    """Decisions of pieces of rare words, each after the five bytes before it."""

    def __init__(self, before: list[bytes], pieces: list[bytes]):
        data = np.frombuffer(b"".join([x for pair in zip(before, pieces) for x in pair]), np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        first = np.cumsum(sizes + 5) - sizes
        self.word = np.repeat(np.arange(len(pieces)), sizes)
        at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        b = data.astype(np.uint64)
        three = b[at - 1] | (b[at - 2] << np.uint64(8)) | (b[at - 3] << np.uint64(16))
        five = three | (b[at - 4] << np.uint64(24)) | (b[at - 5] << np.uint64(32)) | np.uint64(1 << 41)
        tree = _TREE[data[at]]
        self.bit = _BIT[data[at]]
        self.cells = [(((_mixed(c) >> np.uint64(32)).astype(np.uint32)[:, None] ^ tree) * np.uint32(0x9E3779B1)) >> np.uint32(32 - CELL_BITS) for c in (three, five)]

    def count(self, tables: np.ndarray, times: np.ndarray) -> None:
        """Adds the decisions of each piece, `times` often, to the hashed cells."""
        weight = np.repeat(times[self.word].astype(np.uint32), 8)
        for k, cell in enumerate(self.cells):
            np.add.at(tables[k], (cell.astype(np.int64) * 2 + self.bit).ravel(), weight)

    def inputs(self, tables: list[np.ndarray]) -> np.ndarray:
        return np.stack([t[c] for t, c in zip(tables, self.cells)], axis=2)

    def bits(self, tables: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
        """Code length of each piece; weights: bit of the byte x predictions."""
        logit = np.zeros(self.bit.shape, np.float32)
        for k, (table, cell) in enumerate(zip(tables, self.cells)):
            logit += table[cell] * (weights[:, k] / np.float32(SCALE))
        cost = np.log2(1 + np.exp(np.minimum((1 - 2 * self.bit) * logit, np.float32(30)))).sum(axis=1)
        return np.bincount(self.word, weights=cost)


def letter_bits(words: list[bytes], tables: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words))
    for before, pieces, owner in _pieces(words):
        np.add.at(out, owner, _Letters(before, pieces).bits(tables, weights))
    return out


def letter_start() -> np.ndarray:
    return np.tile(np.array([0.4, 0.4], np.float32), (8, 1))


# tables that tasks count in parts


def _parts(tables: np.ndarray, half: int = 0) -> Iterator[pa.RecordBatch]:
    chunks = tables.reshape(-1, 1 << CHUNK_BITS)
    for k in np.flatnonzero(chunks.any(axis=1)).tolist():
        yield pa.RecordBatch.from_arrays([pa.array([k + half * len(chunks)], pa.int32()), pa.array([_pressed(chunks[k])], pa.binary())], ["chunk", "blob"])


def _pressed(chunk: np.ndarray) -> bytes:
    """Numbers of four bytes, or of eight where four do not do, after a byte that says which."""
    size = 4 if chunk.max() < 1 << 32 else 8
    return b"%d" % size + pa.Codec("zstd", 1).compress(chunk.astype(f"u{size}").tobytes(), asbytes=True)


def _opened(blob: bytes) -> np.ndarray:
    size = int(blob[:1])
    return np.frombuffer(pa.Codec("zstd").decompress(blob[1:], size << CHUNK_BITS, asbytes=True), f"u{size}")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams parts sorted by (chunk, lane) and yields their sums."""
    key, total = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([_pressed(total)], pa.binary())], ["chunk", "blob"])

    for batch in batches:
        for chunk, lane, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (chunk, lane):
                if key is not None:
                    yield done()
                key, total = (chunk, lane), np.zeros(1 << CHUNK_BITS, np.uint64)
            total += _opened(blob)
    if key is not None:
        yield done()


def _predictions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sums sorted by chunk and yields predictions of all counts, and for each half of
    the counts of the other."""
    key, total = None, None

    def done():
        kinds = (total[0] + total[1], total[1], total[0])
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), *(pa.array([_stretched(t[1::2], t[::2]).tobytes()], pa.binary()) for t in kinds)], ["chunk", "blob", "fit0", "fit1"])

    for batch in batches:
        for chunk, half, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if key != chunk:
                if key is not None:
                    yield done()
                key, total = chunk, np.zeros((2, 1 << CHUNK_BITS))
            total[half] += _opened(blob)
    if key is not None:
        yield done()


def _in_lanes(parts: DataFrame) -> DataFrame:
    """Parts of each chunk summed to a few."""
    lanes = parts.select("chunk", F.pmod(F.xxhash64("blob"), F.lit(8)).alias("lane"), "blob")
    return lanes.repartition(wide(parts.sparkSession), "chunk", "lane").sortWithinPartitions("chunk", "lane").mapInArrow(_summed, "chunk int, blob binary")


def _tables(parts: DataFrame) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
    """Sums the parts of all tasks, two tables of each half, in two steps; the tables have a
    fixed size. First the tables of all, then those to predict each half from the other."""
    per = 2 << (CELL_BITS + 1 - CHUNK_BITS)
    both = _in_lanes(parts).select((F.col("chunk") % per).alias("chunk"), F.floor(F.col("chunk") / per).cast("int").alias("half"), "blob")
    whole = both.repartition(wide(parts.sparkSession), "chunk").sortWithinPartitions("chunk")
    tables = np.zeros((3, per, 1 << (CHUNK_BITS - 1)), np.int8)
    for r in whole.mapInArrow(_predictions, "chunk int, blob binary, fit0 binary, fit1 binary").collect():  # 8 MB a table at most
        for k, blob in enumerate((r.blob, r.fit0, r.fit1)):
            tables[k, r.chunk] = np.frombuffer(blob, np.int8)
    every, *fits = (list(t.reshape(2, -1)) for t in tables)
    return every, fits


# the regression behind the starting weights

#: Steps of predictions: of the four of words (the last has three values) and the two of letters.
_WORD_STEPS = np.stack(np.meshgrid(*[np.arange(-7.5, 8)] * 3, [-1.0, 0.0, 1.0], indexing="ij"), axis=-1).reshape(-1, 4)
_LETTER_STEPS = np.stack(np.meshgrid(*[np.arange(-126.5, 128, 4) / SCALE] * 2, indexing="ij"), axis=-1).reshape(-1, 2)


def _tally(total: np.ndarray, x: np.ndarray, bit: np.ndarray, gate: np.ndarray) -> None:
    """Adds decisions of words to (gate, step of each prediction, bit)."""
    cell = gate.astype(np.int64)
    for at in range(0, len(bit), 1 << CHUNK_BITS):
        here = slice(at, at + (1 << CHUNK_BITS))
        steps, to = x[here] >> 4, cell[here]
        for k in range(3):
            to *= 16
            to += steps[:, k] + np.int8(8)
        to *= 3
        to += steps[:, 3] + np.int8(1)
        to *= 2
        to += bit[here]
    total += np.bincount(cell, minlength=len(total))


def _tally_letters(total: np.ndarray, x: np.ndarray, bit: np.ndarray) -> None:
    """Adds decisions of letters, (byte, bit of the byte, prediction), as `_tally` does."""
    steps = (x >> 2).astype(np.int32) + 32
    cell = (np.arange(8) * 64 + steps[:, :, 0]) * 64 + steps[:, :, 1]
    total += np.bincount((2 * cell + bit).ravel(), minlength=len(total))


def solve(tally: np.ndarray, steps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weights (gate x predictions) of the logistic regression of the bits on the predictions.
    tally: decisions by (gate, step of the predictions, bit); steps: the predictions of a step."""
    out = start.astype(np.float64)
    for g, (zeros, ones) in enumerate(tally.reshape(len(start), len(steps), 2).transpose(0, 2, 1).astype(np.float64)):
        seen = np.flatnonzero(zeros + ones)
        x, one, n = steps[seen], ones[seen], (zeros + ones)[seen]
        for _ in range(ROUNDS if len(seen) else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ out[g], -30, 30)))
            slope = x.T @ (one - n * p) + PULL * (start[g] - out[g])
            bend = (x * (n * p * (1 - p))[:, None]).T @ x + PULL * np.eye(x.shape[1])
            move = np.linalg.solve(bend, slope)
            out[g] += move * min(1, MOVE / max(np.abs(move).max(), 1e-300))
            if np.abs(move).max() < 1e-6:
                break
    return out.astype(np.float32)


def _tallied(parts: DataFrame, cells: int) -> np.ndarray:
    """The sum of the tallies of all tasks, of a fixed size."""
    total = np.zeros(-(-cells >> CHUNK_BITS) << CHUNK_BITS, np.uint64)
    for r in _in_lanes(parts).collect():
        total[r.chunk << CHUNK_BITS :][: 1 << CHUNK_BITS] += _opened(bytes(r.blob))
    return total[:cells]


def _padded(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield from _parts(np.append(total, np.zeros(-len(total) % (1 << CHUNK_BITS), total.dtype)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a slice of texts and how often they come, the ends of texts among them."""
    for batch in slices(batches, "b"):
        names, at, _ = split_words(batch.column(0))
        counts = np.append(np.bincount(at, minlength=len(names)), batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([names, pa.array([END], pa.binary())]), pa.array(counts, pa.int64())], ["word", "n"])


def _halves(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of each half, which the column `half` tells."""
    for half in (0, 1):
        rows = batch.filter(pc.equal(batch.column("half"), half))
        if rows.num_rows:
            yield half, rows


def _count_code(shared, half: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((2, 2 << CELL_BITS), np.uint32)
        for batch in slices(batches, "words", NUMBERS):
            _Decisions(shared.value, *_numbers(batch.column("words"))).count(tables)
        yield from _parts(tables, half)

    return stream


def _tally_code(shared, fits):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(24 * 2 * len(_WORD_STEPS), np.int64)
        for batch in slices(batches, "words", MIXED):
            for half, rows in _halves(batch):
                _tally(total, *_Decisions(shared.value, *_numbers(rows.column("words"))).inputs(fits.value[half]))
        yield from _padded(total)

    return stream


def _count_letters(half: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((2, 2 << CELL_BITS), np.uint32)
        for batch in batches:
            words, times = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for before, pieces, owner in _pieces(words):
                _Letters(before, pieces).count(tables, times[owner])
        yield from _parts(tables, half)

    return stream


def _by_half(rows: DataFrame, count) -> DataFrame:
    """The parts of both halves; a task counts one half, so that it holds the tables of one."""
    first, second = (rows.filter(F.col("half") == half).mapInArrow(count(half), "chunk int, blob binary") for half in (0, 1))
    return first.unionByName(second)


def _tally_spelling(fits):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(8 * 2 * len(_LETTER_STEPS), np.int64)
        for batch in batches:
            for half, rows in _halves(batch):
                for before, pieces, _ in _pieces(rows.column("word").to_pylist()):
                    d = _Letters(before, pieces)
                    _tally_letters(total, d.inputs(fits.value[half]), d.bit)
        yield from _padded(total)

    return stream


def _frequent(counts: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Words with at least the smallest count that `most` words at most have, and that count,
    found from a histogram of a few thousand bins."""
    step = F.floor(F.log2("n") * 64).cast("int")
    total, lowest = 0, 1 << 30
    for b in sorted(counts.groupBy(step.alias("bin")).count().collect(), reverse=True):
        total += b["count"]
        if total > most:
            break
        lowest = b["bin"]
    return counts.filter(step >= lowest), lowest


def score_texts(docs: DataFrame, folds: int = 7, held: int = 2, sample_bytes: int = SAMPLE_BYTES, head_words: int = HEAD_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, n_bytes (words, a byte after each, an end), bits_per_byte.

    Rows whose crc32(id as text) mod `folds` is `held` are scored but not learned from. Null
    and empty texts are an end only; null ids count as empty text; repeated rows are learned
    from each time and scored equally; a word of any length is spelled in pieces; an empty table gives no rows.
    """
    spark = docs.sparkSession
    half = F.pmod(F.xxhash64("b"), F.lit(2)).cast("int").alias("half")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("b"), (fold(id_col, folds) == held).alias("held_out"))
    training = rows.filter(~F.col("held_out")).select("doc_id", "b")

    counts = stash(training.select("b").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct"), F.sum(F.col("n") * (F.octet_length("word") + 1)).alias("bytes")).first()
    frequent, lowest = _frequent(counts, head_words)
    found = frequent.toArrow()  # at most head_words
    head = dict(zip(found["word"].to_pylist(), found["n"].to_pylist()))
    rest = max(1, totals.tokens - sum(head.values()))
    code = Code({END: 1, **head, ESCAPE: rest})
    shared = spark.sparkContext.broadcast(code)

    out = StructType([rows.schema["doc_id"], StructField("held_out", BooleanType()), *StructType.fromDDL("half int, words binary, rare array<binary>").fields])
    coded = stash(rows.select("doc_id", "held_out", half, "b").mapInArrow(_coded(shared), out), "lm-coded")
    learned = coded.filter(~F.col("held_out")).select("half", "words")
    tables, fits = _tables(_by_half(learned, lambda half: _count_code(shared, half)))
    tables, *fits = ([code.node_table(), *t] for t in (tables, *fits))

    # The first guess: distinct pairs of id and text of one half, each with the same chance, so
    # rows repeated or without an id weigh no more than others; no text holds more than an eighth
    # of them, so that all are above four times their mean size with a chance below e^-20.
    cut = int((1 << 40) * min(0.05, sample_bytes / max(totals.bytes or 0, 1)))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "b"), F.lit(1 << 40))
    short = training.filter(F.octet_length("b").between(1, sample_bytes // 8) & (half == 0)).select("b", draw.alias("draw")).filter(F.col("draw") < cut)
    sample = [bytes(r.b) for r in short.distinct().orderBy("draw", "b").select("b").collect()]
    d = _Decisions(code, *numbered(code, [words_of(t) for t in sample]))
    weights = _fit(*d.inputs(fits[0]), d.stops, d.block, word_start())
    del d, sample
    lent = spark.sparkContext.broadcast(fits)
    tally = _tallied(learned.mapInArrow(_tally_code(shared, lent), "chunk int, blob binary"), 24 * 2 * len(_WORD_STEPS))
    weights = solve(tally, _WORD_STEPS, weights)
    lent.unpersist()

    rare = counts.filter(F.floor(F.log2("n") * 64).cast("int") < lowest).select("word", "n", F.pmod(F.xxhash64("word"), F.lit(2)).cast("int").alias("half"))
    letters, fits = _tables(_by_half(rare, _count_letters))
    lent = spark.sparkContext.broadcast(fits)
    tally = _tallied(rare.mapInArrow(_tally_spelling(lent), "chunk int, blob binary"), 8 * 2 * len(_LETTER_STEPS))
    letter_weights = solve(tally, _LETTER_STEPS, letter_start())
    lent.unpersist()
    del fits
    logs = np.array([np.log10(head.get(w, 0) + 1) for w in code.number])
    model = spark.sparkContext.broadcast((tables, weights, letters, letter_weights, logs))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, (tables, weights, letters, letter_weights, logs) = shared.value, model.value
        end_known, spell = logs[code.number[END]] > 0, {}
        spelt = 0
        for batch in slices(batches, "words", MIXED):
            words, ends = _numbers(batch.column(2))
            d = _Decisions(code, words, ends)
            cost, _ = _run(*d.inputs(tables), d.stops, d.block, weights, RATE)
            bits = np.bincount(d.owner, weights=cost, minlength=len(ends))
            if len(spell) > FLUSH_WORDS or spelt > FLUSH_BYTES:
                spell, spelt = {}, 0
            rare = batch.column(3)
            seen = rare.flatten().dictionary_encode()
            names = seen.dictionary.to_pylist()
            kinds = [w for w in names if w not in spell]
            spelt += sum(map(len, kinds))
            spell.update(zip(kinds, letter_bits(kinds, letters, letter_weights).tolist()))
            at, many = seen.indices.to_numpy(), np.diff(rare.offsets.to_numpy()).astype(np.int64)
            owner = np.repeat(np.arange(len(ends)), many)
            bits += np.bincount(owner, weights=np.array([spell[w] for w in names], float)[at], minlength=len(ends))
            begins = np.concatenate([[0], ends])[:-1]
            base = np.add.reduceat(np.where(words == code.escape, 0.0, logs[words]), begins)
            sizes = np.add.reduceat(np.where(words == code.escape, 0, code.lengths[words]), begins)
            sizes = sizes + np.bincount(owner, weights=np.array([len(w) + 1 for w in names], float)[at], minlength=len(ends)).astype(np.int64)
            n = ends - begins
            cells = [pa.array(n), pa.array(n - 1 + int(end_known) - many), pa.array(base), pa.array(bits), pa.array(sizes), rare]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cells], ["doc_id", "held_out", "n_tokens", "known", "base", "bits", "n_bytes", "rare"])

    out = StructType([rows.schema["doc_id"], StructField("held_out", BooleanType()), *StructType.fromDDL("n_tokens long, known long, base double, bits double, n_bytes long, rare array<binary>").fields])
    scored = stash(coded.select("doc_id", "held_out", "words", "rare").mapInArrow(stream, out).withColumn("rid", F.monotonically_increasing_id()), "lm-scores")
    more = scored.select("rid", F.explode("rare").alias("word")).join(counts, "word").groupBy("rid").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count("*").alias("also"))
    total, zero = int(totals.tokens + totals.distinct + 1), F.lit(0)
    return scored.drop("rare").join(more, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also", zero)).alias("n_known"), F.lit(int(totals.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", zero) - F.col("n_tokens") * float(np.log10(total))).alias("base_score"),
        (-F.col("bits") * float(np.log10(2))).alias("score"), "n_bytes", (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )
