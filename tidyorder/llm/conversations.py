"""Repair of conversation structure: cheapest edits that make the turns alternate.

A conversation is well formed if its role initials read `(s?(ua)+)?`. Each row is kept, given
another role, or deleted, and empty turns may be inserted anywhere; blank rows and repeats of an
earlier (role, text) must go. The edits of one conversation are a path through a lattice of
(rows read, state of the grammar). Bidirectional Dijkstra searches it: a forward heap from the
start and a reverse heap from the end grow until the sum of their least costs passes the best
meeting; all crossings of that cost are then compared, and the least concatenated audit wins.
Among equal costs heaps go on by position, since keeping a row costs nothing, so that a node
is settled with its least audit. Two audits of one node at one cost never start with each
other, hence the least whole is made of least parts.

Rows are counted once per (conversation, turn, role, text), so copies travel once, and
range-partitioned by conversation and turn; a task streams its sorted rows and answers every
conversation that lies wholly inside its range. What crosses a border or exceeds `hold_rows` or
`hold_bytes` is left in pieces, and only that is shuffled again: repeats are found by a join
on digests, blocks of 256 rows get their least path from each state to each other, blocks are
multiplied together as a tree per range and then per conversation, and the repaired text
streams through a hash. So a conversation with a third of all rows is searched by many tasks;
only its audit (about a byte a row) and the stream into its one hash are in one task.

Null ids form one conversation. Null turns come first; rows of one turn are in order of role,
then text; null roles and texts are one space. Copies of a row stand next to each other and
all but the first are repeats. A conversation without rows has zeros, an empty audit and the
hash of nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyorder.llm.common import null_safe_join, stash, wide

# Costs of the edits, white space, ends of sentences, legal neighbours.
RENAME, DELETE, INSERT, CUT = 2, 3, 2, 1
SPACE = " \t\n\x0b\f\r"
ENDS = ".!?"
LEGAL = {"su", "ua", "au"}

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
FINAL = (START, ASSISTANT)
#: State after the turn that a state asks for, and the role of that turn.
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
BLANK, REPEAT, TRUNCATED = 1, 2, 3
BLOCK = 256
HOLD_ROWS = 512
HOLD_BYTES = 16 << 20
PREFIX = 32


class Turn(NamedTuple):
    """What the search needs of a row: the initial of its role, its first fault, its copies."""

    initial: str
    fault: int | None
    copies: int


def kept_state(state: int, initial: str) -> int | None:
    """State after keeping a row, None if the grammar does not allow it."""
    if state == START and initial == "s":
        return SYSTEM
    after, role = NEXT[state]
    return after if initial == role[0] else None


def _positions(turns: list[Turn]) -> list[tuple[Turn | None, int]]:
    """A position per row, and one for its further copies, which go together."""
    out: list[tuple[Turn | None, int]] = []
    for t in turns:
        out.append((t, 0))
        if t.copies > 1:
            out.append((None, t.copies - 1))
    return out


def _steps(position: tuple[Turn | None, int], state: int) -> list[tuple[int, int, str]]:
    """(next state, cost, audit) of the ways to read one position."""
    turn, copies = position
    if turn is None:
        return [(state, DELETE * copies, "D" * copies)]
    out = [(state, DELETE, "D")]
    if turn.fault not in (BLANK, REPEAT):
        extra = CUT if turn.fault == TRUNCATED else 0
        out.append((NEXT[state][0], RENAME + extra, "R"))
        if (after := kept_state(state, turn.initial)) is not None:
            out.append((after, extra, "K"))
    return out


def least_path(turns: list[Turn], entry: int = START, exits: tuple[int, ...] = FINAL) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from `entry` to one of `exits`, ties to the least
    audit; None if no edits lead there."""
    spots = _positions(turns)
    n = len(spots)
    ahead: dict[tuple[int, int], list[tuple[tuple[int, int], int, str]]] = {}
    behind: dict[tuple[int, int], list[tuple[tuple[int, int], int, str]]] = {}

    def out_of(node):
        if node not in ahead:
            i, state = node
            ahead[node] = [((i, NEXT[state][0]), INSERT, "I")]
            if i < n:
                ahead[node] += [((i + 1, s), c, x) for s, c, x in _steps(spots[i], state)]
        return ahead[node]

    def into(node):
        if node not in behind:
            i, state = node
            behind[node] = [((j, s), c, x) for j in (i - 1, i) if j >= 0 for s in STATES for to, c, x in out_of((j, s)) if to == node]
        return behind[node]

    forth, back = {}, {}  # settled: node -> (cost, audit)
    seen_forth, seen_back = {(0, entry): 0}, {(n, s): 0 for s in exits}
    heap_forth = [(0, 0, "", entry)]
    heap_back = sorted((0, -n, "", s) for s in exits)
    best = 0 if n == 0 and entry in exits else None
    while heap_forth and heap_back and (best is None or heap_forth[0][0] + heap_back[0][0] <= best or len(back) < len(exits) or not forth):
        reverse = len(back) < len(exits) or heap_back[0][0] < heap_forth[0][0]
        cost, i, audit, state = heapq.heappop(heap_back if reverse else heap_forth)
        node = (-i if reverse else i, state)
        settled, seen, other = (back, seen_back, seen_forth) if reverse else (forth, seen_forth, seen_back)
        if node in settled:
            continue
        settled[node] = (cost, audit)
        for to, step, letter in into(node) if reverse else out_of(node):
            total = cost + step
            if to in other and (best is None or total + other[to] < best):
                best = total + other[to]
            if to not in settled and total <= seen.get(to, total):
                seen[to] = total
                item = (total, -to[0], letter + audit, to[1]) if reverse else (total, to[0], audit + letter, to[1])
                heapq.heappush(heap_back if reverse else heap_forth, item)
    crossings = [(c + back[v][0], a + back[v][1]) for v, (c, a) in forth.items() if v in back]
    for v, (c, a) in forth.items():
        crossings += [(c + step + back[w][0], a + x + back[w][1]) for w, step, x in out_of(v) if w in back]
    return min(crossings, default=None)


Matrix = dict[tuple[int, int], tuple[int, str]]


def block_matrix(turns: list[Turn]) -> Matrix:
    """Least path of a block of rows from each state to each other."""
    found = {(a, b): least_path(turns, a, (b,)) for a in STATES for b in STATES}
    return {k: v for k, v in found.items() if v is not None}


def product(left: Matrix, right: Matrix) -> Matrix:
    """Least paths through two neighbouring blocks."""
    out: Matrix = {}
    for (a, m), (c1, x1) in left.items():
        for (k, b), (c2, x2) in right.items():
            if m == k and (c1 + c2, x1 + x2) < out.get((a, b), (c1 + c2 + 1, "")):
                out[a, b] = (c1 + c2, x1 + x2)
    return out


def tree_product(parts: list[Matrix]) -> Matrix:
    while len(parts) > 1:
        parts = [product(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def fault_of(text: str, repeated: bool) -> int | None:
    """The first fault of a row."""
    text = text.rstrip(SPACE)
    return BLANK if not text else REPEAT if repeated else None if text[-1] in ENDS else TRUNCATED


def _illegal(turns: list[Turn], before: str | None = None) -> int:
    """Neighbours that may not stand next to each other."""
    count = 0
    for t in turns:
        count += before is not None and before + t.initial not in LEGAL
        count += (t.copies - 1) * (t.initial * 2 not in LEGAL)
        before = t.initial
    return count


class Repairer:
    """Follows an audit along the rows: for each row the turns to write in its place."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _written(self) -> tuple[str, str]:
        self.state, role = NEXT[self.state]
        return role, ""

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._written()

    def row(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str]]:
        for _ in range(copies):
            yield from self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.state = kept_state(self.state, role[:1])
                yield role, text
            elif edit == "R":
                yield self._written()[0], text


class _Digest:
    """SHA-256 of `role:text` lines as they come."""

    def __init__(self):
        self.sha, self.first = hashlib.sha256(), True

    def add(self, turns: Iterator[tuple[str, str]]) -> None:
        for role, text in turns:
            self.sha.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
            self.first = False


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
PIECE = "part int, idx bigint, turn bigint, role string, text string, copies bigint, fault int, digest binary"
_PIECE_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary()]
_RESULT_TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def _gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _answer(rows: list[tuple]) -> tuple:
    """The result of a whole conversation from its sorted (turn, role, text, copies)."""
    seen, turns = set(), []
    for _, role, text, copies in rows:
        turns.append(Turn(role[:1], fault_of(text, (role, text) in seen), copies))
        seen.add((role, text))
    cost, audit = least_path(turns)
    repair, digest = Repairer(audit), _Digest()
    for _, role, text, copies in rows:
        digest.add(repair.row(role, text, copies))
    digest.add(repair.inserted())
    blank = sum(t.copies for t in turns if t.fault == BLANK)
    again = sum(t.fault == REPEAT for t in turns) + sum(t.copies - 1 for t in turns if t.fault != BLANK)
    cut = sum(t.fault == TRUNCATED for t in turns)
    return _gaps([r[0] for r in rows]), blank, again, cut, _illegal(turns), cost, audit, digest.sha.hexdigest()


class _Batch:
    """Rows of the stream's output, in the order of the schema, sent out in batches."""

    def __init__(self, id_type: pa.DataType, limit: int = 4 << 20):
        self.types = [id_type, pa.bool_(), *_RESULT_TYPES, *_PIECE_TYPES]
        self.rows, self.bytes, self.limit = [], 0, limit

    def done(self, conv, result: tuple) -> None:
        self.rows.append((conv, True, *result, *[None] * len(_PIECE_TYPES)))
        self.bytes += len(result[6]) + 200

    def piece(self, conv, values: tuple) -> None:
        self.rows.append((conv, False, *[None] * len(_RESULT_TYPES), *values))
        self.bytes += len(values[4] or "") + 200

    def out(self, force: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (force or self.bytes > self.limit):
            columns = zip(*self.rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types)], names=[f"c{i}" for i in range(len(self.types))])
            self.rows, self.bytes = [], 0


def _stream(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, hold_rows: int, hold_bytes: int) -> Iterator[pa.RecordBatch]:
    """Answers of the conversations inside the range of this task, rows of the others."""
    part, out = TaskContext.get().partitionId(), _Batch(id_type)
    conv, held, size, whole, idx = None, [], 0, False, 0

    def leave() -> None:
        nonlocal idx
        for present, turn, role, text, copies in held:
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest() if present else None
            out.piece(conv, (part, idx, turn, role, text, copies, fault_of(text, False) if present else None, digest))
            idx += 1

    began = False
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if not began or row[0] != conv:
                if began and whole:
                    out.done(conv, _answer([r[1:] for r in held if r[0]]))
                elif began:
                    leave()
                whole = began  # the first conversation may have begun in an earlier range
                conv, held, size, began = row[0], [], 0, True
            held.append(row[1:])
            size += len(row[4] or "")
            if len(held) >= hold_rows or size >= hold_bytes:
                whole = False
                leave()
                held, size = [], 0
            yield from out.out()
    if began:
        leave()  # the last one may go on in a later range
    yield from out.out(force=True)


def _sorted_rows(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present_col: str | None) -> DataFrame:
    """(conv_id, present, turn, role, text, copies), copies counted, in ranges of (conversation,
    turn, role, start of the text)."""
    present = F.coalesce(F.col(present_col), F.lit(False)) if present_col else F.lit(True)
    role, text = (F.when(present, F.coalesce(F.col(c), F.lit(" "))) for c in (role_col, text_col))
    each = rows.select(
        F.col(conv_col).alias("conv_id"), present.alias("present"), F.when(present, F.col(turn_col)).cast("long").alias("turn"), role.alias("role"), text.alias("text")
    )
    counted = each.groupBy("conv_id", "present", "turn", "role", "text").agg(F.count("*").alias("copies"))
    ranged = counted.repartitionByRange(wide(rows.sparkSession), "conv_id", "turn", "role", F.substring("text", 1, PREFIX))
    return ranged.sortWithinPartitions("conv_id", "turn", "role", "text")


def _matrices(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (conv, part, block, rows) to their summary."""
    for batch in batches:
        out = []
        for conv, part, block, rows in zip(*(c.to_pylist() for c in batch.columns)):
            turns = [Turn(r["initial"], r["fault"], r["copies"]) for r in rows]
            cells = [{"a": a, "b": b, "cost": c, "audit": x} for (a, b), (c, x) in block_matrix(turns).items()]
            out.append((conv, part, block, turns[0].initial, turns[-1].initial, _illegal(turns), cells))
        cell = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
        types = [id_type, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(cell)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=list("abcdefg"))


def _joined(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Summaries of neighbouring blocks (conv, part, list) to one summary each."""
    for batch in batches:
        out = []
        for conv, part, blocks in zip(*(c.to_pylist() for c in batch.columns)):
            cells = tree_product([{(c["a"], c["b"]): (c["cost"], c["audit"]) for c in b["cells"]} for b in blocks])
            illegal = sum(b["illegal"] for b in blocks) + sum(x["last"] + y["first"] not in LEGAL for x, y in zip(blocks, blocks[1:]))
            cells = [{"a": a, "b": b, "cost": c, "audit": x} for (a, b), (c, x) in cells.items()]
            out.append((conv, part, 0, blocks[0]["first"], blocks[-1]["last"], illegal, cells))
        cell = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
        types = [id_type, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(cell)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=list("abcdefg"))


def _hashes(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Streams (conv, part, idx, role, text, copies, audit), an audit before its rows."""
    began, conv, repair, digest, out = False, None, None, None, []

    def close() -> None:
        digest.add(repair.inserted())
        out.append((conv, digest.sha.hexdigest()))

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if not began or row[0] != conv:
                if began:
                    close()
                began, conv, repair, digest = True, row[0], Repairer(row[6] or ""), _Digest()
            elif row[6] is None:
                digest.add(repair.row(row[3], row[4], row[5]))
    if began:
        close()
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], id_type), pa.array([r[1] for r in out], pa.string())], names=["conv_id", "sha"])


def _pieced(left: DataFrame, kind: str, id_type: pa.DataType) -> DataFrame:
    """Results of the conversations that no task saw whole."""
    present = left.filter("digest is not null")
    narrow = present.select("conv_id", "part", "idx", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "copies", "digest")
    firsts = narrow.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "idx")).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    marked = null_safe_join(narrow, firsts.select("conv_id", "digest", "first"), ["conv_id", "digest"], "left")
    repeated = F.col("first").isNotNull() & (F.struct("part", "idx") != F.col("first"))
    first_fault = F.when(F.coalesce(F.col("fault") == BLANK, F.lit(False)), F.col("fault")).when(repeated, F.lit(REPEAT)).otherwise(F.col("fault"))
    marked = stash(marked.select("conv_id", "part", "idx", "turn", "initial", "copies", first_fault.alias("fault")), "conversation-rows")

    blank, again = F.col("fault") == BLANK, F.col("fault") == REPEAT
    counts = marked.groupBy("conv_id").agg(
        F.sum(F.when(blank, F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(blank, 0).when(again, F.col("copies")).otherwise(F.col("copies") - 1)).alias("duplicate"),
        F.count_if(F.col("fault") == TRUNCATED).alias("truncated"),
        F.max("turn").alias("top"), F.min("turn").alias("low"))
    distinct = marked.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.count("turn").alias("turns"))

    summary = f"conv_id {kind}, part int, block bigint, first string, last string, illegal bigint, cells array<struct<a:int,b:int,cost:bigint,audit:string>>"
    block = F.sort_array(F.collect_list(F.struct("idx", "initial", "fault", "copies"))).alias("rows")
    blocks = marked.groupBy("conv_id", "part", F.expr(f"idx div {BLOCK}").alias("block")).agg(block)
    blocks = blocks.mapInArrow(lambda b: _matrices(b, id_type), summary)
    row = F.struct("block", "first", "last", "illegal", "cells")
    parts = blocks.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(row))).mapInArrow(lambda b: _joined(b, id_type), summary)
    row = F.struct("part", "first", "last", "illegal", "cells")
    wholes = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("parts"))
    wholes = wholes.select("conv_id", F.lit(0).alias("part"), "parts").mapInArrow(lambda b: _joined(b, id_type), summary)
    ways = F.filter("cells", lambda c: (c["a"] == START) & c["b"].isin(*FINAL))
    best = F.array_min(F.transform(ways, lambda c: F.struct(c["cost"], c["audit"])))
    best = stash(wholes.select("conv_id", "illegal", best["cost"].alias("cost"), best["audit"].alias("audit")), "conversation-audits")

    texts = present.select("conv_id", "part", "idx", "role", "text", "copies", F.lit(None).cast("string").alias("audit"))
    heads = best.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("idx"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), "audit")
    ordered = heads.unionByName(texts).repartition(wide(left.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "idx")
    hashed = ordered.mapInArrow(lambda b: _hashes(b, id_type), f"conv_id {kind}, sha string")

    ids = left.select("conv_id").distinct()
    out = ids
    for more in (counts, distinct, best, hashed):
        out = null_safe_join(out, more, ["conv_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", F.coalesce(F.col("top") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps"),
        *[zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repair_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    present_col: str | None = None, hold_rows: int = HOLD_ROWS, hold_bytes: int = HOLD_BYTES,
) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per
    conversation. Rows whose `present_col` is not true only name their conversation.
    `apply_audits` writes the repaired turns."""
    ordered = _sorted_rows(rows, conv_col, turn_col, role_col, text_col, present_col)
    kind = ordered.schema["conv_id"].dataType.simpleString()
    id_type = _arrow_type(kind)
    streamed = ordered.mapInArrow(lambda b: _stream(b, id_type, hold_rows, hold_bytes), f"conv_id {kind}, done boolean, {RESULT}, {PIECE}")
    streamed = stash(streamed, "conversations")
    names = [c.split()[0] for c in RESULT.split(", ")]
    done = streamed.filter("done").select("conv_id", *names)
    return done.unionByName(_pieced(streamed.filter("not done"), kind, id_type))


def _arrow_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def apply_audits(rows: DataFrame, audits: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired turns (conv_id, position, role, text) of `rows` under (conv_id, audit)."""
    texts = _sorted_rows(rows, conv_col, turn_col, role_col, text_col, None)
    texts = texts.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copies", F.lit(None).cast("string").alias("audit"))
    heads = audits.select(F.col("conv_id"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), "audit")
    kind = texts.schema["conv_id"].dataType.simpleString()
    id_type = _arrow_type(kind)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, conv, repair, at, out = False, None, None, 0, []

        def add(turns) -> None:
            nonlocal at
            for role, text in turns:
                out.append((conv, at, role, text))
                at += 1

        def sent() -> Iterator[pa.RecordBatch]:
            if out:
                types = [id_type, pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv_id", "position", "role", "text"])
                out.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if not began or row[0] != conv:
                    if began:
                        add(repair.inserted())
                    began, conv, at, repair = True, row[0], 0, Repairer(row[6] or "")
                elif row[6] is None:
                    add(repair.row(row[3], row[4], row[5]))
            yield from sent()
        if began:
            add(repair.inserted())
            yield from sent()

    ordered = heads.unionByName(texts).repartition(wide(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
    return ordered.mapInArrow(write, f"conv_id {kind}, position bigint, role string, text string")


def damage(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text) damaged by a checksum of `conv_id:turn`: some are
    dropped (present = false), emptied, robbed of their sentence ends, repeated or given to the
    user; nulls count as one space."""
    h = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    each = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), h.alias("h"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1)))
    each = each.select("*", times.alias("time"))
    return each.select(
        "conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"), (F.col("h") != 0).alias("present"))
