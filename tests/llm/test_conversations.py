"""Conversation repair against plain relaxation, a listing of all audits, edge cases, the query."""

import hashlib
import itertools
import random
import re
import zlib

from tidyorder.llm import conversations as cv
from tidyorder.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\f\r"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def steps(state, row):
    """(next state, cost, letter, written) for one row (role, text, fault)."""
    role, text, fault = row
    asks = {"": "user", "s": "user", "a": "user", "u": "assistant"}[state]
    out = [(state, 3, "D", None)]
    if fault not in ("blank", "duplicate"):
        extra = fault == "truncated"
        out += [(x[0], 2 + extra, "R", (x, text)) for x in ("user", "assistant") if x == asks]
        if role[:1] == asks[0] or (state == "" and role[:1] == "s"):
            out.append((role[:1], extra, "K", (role, text)))
    return out


def relaxed(rows):
    """Least (cost, audit, written) by relaxing from the end until nothing changes."""
    n = len(rows)
    best = {(n, ""): (0, "", ()), (n, "a"): (0, "", ())}
    changed = True
    while changed:
        changed = False
        for i in range(n, -1, -1):
            for s in ("", "s", "u", "a"):
                asks = "assistant" if s == "u" else "user"
                moves = [((i, asks[0]), 2, "I", ((asks, ""),))]
                if i < n:
                    moves += [((i + 1, t), c, x, () if w is None else (w,)) for t, c, x, w in steps(s, rows[i])]
                for to, c, x, w in moves:
                    if to in best:
                        new = (best[to][0] + c, x + best[to][1], w + best[to][2])
                        if (i, s) not in best or new[:2] < best[i, s][:2]:
                            best[i, s] = new
                            changed = True
    return best[0, ""]


def expected(rows):
    """The contract's result from (turn, role, text) rows in order."""
    seen, marked = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = lambda f: sum(m[2] == f for m in marked)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    cost, audit, written = relaxed(marked)
    text = "\n".join(f"{r}:{t}" for r, t in written)
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = "%s:%s" % tuple(" " if v is None else v for v in (conv, turn))
        h = zlib.crc32(key.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def by_conversation(original, rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3].encode())
    return {c: expected([r[1:] for r in sorted((r for r in rows if r[0] == c), key=order)]) for c in {r[0] for r in original}}


def collected(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}


def random_rows(seed, n):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "subject"]
    return [(r.choice(roles), r.choice(["Yes.", "No", " ", "What?", "So it is!\n", "x%d." % k]), r.randint(0, 1)) for k in range(n)]


def turns_of(rows):
    """Neighbouring equal rows become copies, as the operator has them."""
    seen, out = set(), []
    for role, text in ((a, b) for a, b, _ in rows):
        if out and (role, text) == out[-1][1]:
            out[-1] = (cv.Turn(role[:1], out[-1][0].fault, out[-1][0].copies + 1), (role, text))
        else:
            out.append((cv.Turn(role[:1], cv.fault_of(text, (role, text) in seen), 1), (role, text)))
        seen.add((role, text))
    return [t for t, _ in out]


def test_search_equals_relaxation():
    for seed in range(400):
        rows = random_rows(seed, seed % 13)
        want = expected([(0, a, b) for a, b, _ in rows])
        assert cv.least_path(turns_of(rows)) == want[5:7]


def test_search_equals_listing_of_audits():
    def outcome(audit, rows):
        i, cost, initials = 0, 0, ""
        for x in audit:
            if x == "I":
                cost, initials = cost + 2, initials + "?"
                continue
            if i == len(rows):
                return None
            role, text, fault = rows[i]
            i += 1
            if x == "D":
                cost += 3
            elif fault in ("blank", "duplicate"):
                return None
            else:
                cost, initials = cost + (2 if x == "R" else 0) + (fault == "truncated"), initials + ("?" if x == "R" else role[:1] or "-")
        fits = any(re.fullmatch("(s?(ua)+)?", "".join(p)) for p in itertools.product(*[("u", "a") if c == "?" else (c,) for c in initials]))
        return cost if i == len(rows) and fits else None

    for seed in range(25):
        rows, seen = [], set()
        for role, text, _ in random_rows(seed + 900, seed % 4):
            fault = {1: "blank", 2: "duplicate", 3: "truncated"}.get(cv.fault_of(text, (role, text) in seen))
            seen.add((role, text))
            rows.append((role, text, fault))
        audits = ("".join(a) for k in range(6) for a in itertools.product("KRDI", repeat=k))
        want = min((c, a) for a in audits if (c := outcome(a, rows)) is not None)
        assert cv.least_path([cv.Turn(r[0][:1], {"blank": 1, "duplicate": 2, "truncated": 3}.get(r[2]), 1) for r in rows]) == want


def test_blocks_multiply_to_the_whole():
    for seed in range(40):
        turns = turns_of(random_rows(seed + 50, 24))
        cells = cv.tree_product([cv.block_matrix(turns[i : i + 5]) for i in range(0, len(turns), 5)])
        assert min(cells[cv.START, b] for b in cv.FINAL if (cv.START, b) in cells) == cv.least_path(turns)


def test_edge_cases(spark):
    rows = [
        (1, 0, "user", "Hello."), (1, 1, "assistant", "Hi!"), (2, None, None, None), (2, None, "user", "Why?"), (3, 5, "", ""), (4, 2, "user", "x" * 2_000_000 + "."),
        (4, 9, "assistant", "cut off"), (None, 1, "user", "Null id."), (None, 1, "user", "Null id."), (None, 3, "assistant", "Fine."), (5, 1, "assistant", "A."), (5, 1, "user", "U."),
        (6, 7, "system", "S."), (6, 8, "user", "Q?"), (6, 8, "user", "Q?"), (6, 8, "user", "Q?"), (6, 12, "user", "Q?"), (7, None, "user", "\xa0"), (8, -3, "user", "a."), (8, 4, "user", "a."),
    ]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, part int, audit string, copies int").repartition(3)
    want = by_conversation(rows, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    assert collected(cv.repair_conversations(docs)) == want
    assert collected(cv.repair_conversations(docs, hold_rows=1)) == want  # all in pieces
    assert collected(cv.repair_conversations(cv.damage(docs), present_col="present")) == by_conversation(rows, damaged(rows))
    assert cv.repair_conversations(docs.limit(0)).count() == 0
    none = docs.withColumn("present", docs.conv_id == 3)
    assert {c: v for c, v in collected(cv.repair_conversations(none, present_col="present")).items() if c == 1} == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_hot_conversation_over_many_ranges(spark):
    r = random.Random(3)
    hot = [(7, k // 2, r.choice(["user", "assistant"]), r.choice(["Same.", "t%d." % k, "cut %d" % k])) for k in range(1500)]
    rows = hot + [(7, 5000, "user", "copy.")] * 700 + [(k, 0, "user", "Only.") for k in range(8, 60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = cv.repair_conversations(df)
        assert collected(got) == by_conversation(rows, rows)
        written = cv.apply_audits(df, got.select("conv_id", "audit")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    lines = {}
    for w in sorted(written, key=lambda w: (w.conv_id, w.position)):
        lines.setdefault(w.conv_id, []).append(f"{w.role}:{w.text}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()} == {r.conv_id: r.repaired_sha256 for r in got.collect()}


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(QUERIES["op11_conversation_repair"](spark, FOLDER)) == by_conversation(rows, damaged(rows))
