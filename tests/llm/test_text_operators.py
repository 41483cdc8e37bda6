"""Line dedup, decontamination, exact dedup: edge cases against plain Python, SQL twins."""

import hashlib
import pickle
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, difference
from tidyorder.llm import decontaminate as dc
from tidyorder.llm import exact_dedup as ed
from tidyorder.llm.exact_dedup import exact_dedup
from tidyorder.llm.line_dedup import apply_bitmaps, dropped_lines, line_bitmaps
from tidyorder.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
ROWS = [
    (1, "Alpha beta gamma\n  ALPHA BETA GAMMA\t\nshort\nshort"),
    (2, "alpha beta gamma\nonly here, long enough\n\n"),
    (3, None),
    (4, ""),
    (5, "\n\nalpha beta gamma"),
    (6, "x" * 300_000 + "\nonly here, long enough"),
    (7, "ÉÉÉÉÉÉÉÉÉÉ\néééééééééé"),
    (8, "ÉÉÉÉÉÉÉÉÉÉ"),
    (9, "alpha beta gamma\nonly here, long enough\n\n"),
]
EXTRA = "doc_id long, text string, pos int, h1 string, name string, level int, tk string, spans int, items int"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(*r, 1, "a", "b", 2, "c", 3, 4) for r in ROWS], EXTRA).repartition(3)


@pytest.mark.parametrize("name", ["op4_line_dedup", "op7_decontamination", "op9_exact_dedup"])
def test_twin_agrees(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name]) is None


def test_line_dedup_edge_cases(spark, docs):
    def key(line):
        k = line.strip(" \t\n\x0b\f\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)

    first = {}
    for i, t in ROWS:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                first.setdefault(key(line), i)
    want = {}
    for i, t in ROWS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if first.get(key(x), i) == i]
        want[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    bitmaps = line_bitmaps(docs)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in apply_bitmaps(docs, bitmaps).collect()}
    assert got == want
    for r in bitmaps.collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r.keep_bitmap), np.uint8), count=r.n_lines)
        assert bits.sum() == r.n_lines - r.n_dropped
    assert line_bitmaps(docs.limit(0)).count() == 0


def test_line_of_every_document_over_many_partitions(spark):
    docs = spark.createDataFrame([(i, "the same long line\nown line of number %d" % i) for i in range(500)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        gone = dropped_lines(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r.doc_id, r.pos) for r in gone) == [(i, 0) for i in range(1, 500)]


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a line of ten"), (1, "a line of ten"), (None, "a line of ten"), (2, "a line of ten")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.n_dropped) for r in apply_bitmaps(docs, line_bitmaps(docs)).collect())
    assert got == [(-1, 0), (1, 1), (1, 1), (2, 1)]


def plain_scan(text, items, n=13):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    hit, found = [False] * len(words), set()
    for item, body in items:
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), body or "")) if x]
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == w[i : i + size]:
                    hit[j : j + size] = [True] * size
                    found.add(str(item))
    return len(words), sum(hit), tuple(sorted(found)), sum(hit) > 0 and 20 * sum(hit) >= len(words)


@pytest.mark.parametrize("index_bytes", [40, 1 << 20])
def test_decontamination_edge_cases(spark, index_bytes):
    long = " ".join(f"w{k}" for k in range(40))
    items = [(1, long), (2, "One two"), (3, None), (4, "..."), (5, "Ünder"), (10, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (11, long)]
    rows = [
        (1, long), (2, "x " + " ".join(f"W{k}," for k in range(5, 18)) + " y"), (3, " ".join(f"w{k}" for k in range(12))), (4, None), (5, ""), (6, "--- !!!"),
        (7, "one TWO three " * 30), (8, "Ünder ünder"), (9, "a " * 20000 + "one two"), (10, long + "|" + long), (11, "one"), (12, "two w0"),
    ]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n_hit int, part string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in dc.scan(docs, bench, index_bytes=index_bytes).collect()}
    assert got == {i: plain_scan(t, items) for i, t in rows}
    assert dc.scan(docs.limit(0), bench).count() == 0
    assert dc.scan(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_index_of_a_large_benchmark_is_small_and_exact():
    rng = np.random.default_rng(5)
    words = np.array([f"term{k}" for k in range(50_000)])
    items = [(f"i{k:04d}", " ".join(words[rng.integers(0, 50_000, 1000)])) for k in range(400)]
    items += [(f"j{k:04d}", items[0][1][:200]) for k in range(2000)]  # windows of many items
    index = dc._Index([(k, t.encode()) for k, t in items], 13)
    assert len(pickle.dumps(index)) < 12 * sum(len(t) for _, t in items)
    texts = [items[7][1][:500], "nothing here", items[0][1], "", " ".join(words[:40])]
    flat = [dc.words_of(t.encode()) for t in texts]
    hit, pairs = index.scan([w for t in flat for w in t], np.cumsum([len(t) for t in flat]))
    names = index.names.to_pylist()
    found = [[names[p % len(names)] for p in pairs if p // len(names) == k] for k in range(len(texts))]
    assert found == [["i0007"], [], ["i0000", *(f"j{k:04d}" for k in range(2000))], [], []]
    assert hit.sum() == len(flat[0]) - (not items[7][1].startswith(texts[0] + " ")) + len(flat[2])


def test_decontamination_removes(spark):
    bench = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Say: red, green; blue! and more"), (2, "clean"), (None, None), (3, "red green blue " + "x " * 100)], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in dc.decontaminate(docs, bench).collect()) == [0, 2, 3]
    cut = {r.doc_id: r.text for r in dc.decontaminate(docs, bench, "spans").collect()}
    assert cut == {1: "Say: and more", 2: "clean", None: None, 3: "x " * 100}


def test_blocks_with_a_common_header_spread(spark):
    header = "".join(chr(97 + k % 23) for k in range(203))
    texts = [f"{header}{k % 3000:07d}" for k in range(4000)] + [f"{k:05d}" for k in range(1000)] + [header, header[:64], header[:32]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    blocks = ed._blocks(docs, "doc_id", "text", 1024)
    beginnings = ed._frequent_beginnings(blocks, 1)
    assert {len(b) for b in beginnings} == {32 * k for k in range(1, 7)}
    ranged = ed._ranged(blocks.select("block").distinct(), beginnings)
    sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4003 and max(sizes) < 3 * 4003 / ranged.rdd.getNumPartitions()
    groups = defaultdict(list)
    for k, t in enumerate(texts):
        groups[t].append(k)
    got = ed.identities(docs, layout=1).collect()
    assert len({(r.level, r.name) for r in got}) == len(groups)
    keep = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(docs).collect()}
    assert keep == {k: (max(groups[t]), len(groups[t])) for k, t in enumerate(texts)}


@pytest.mark.parametrize("block", [4, 1024])
def test_exact_dedup_edge_cases(spark, block):
    rows = [*ROWS, (10, "abcdabcd"), (11, "abcdabcdabcd"), (12, "abcdabcd"), (13, "abcd"), (None, "abcd"), (13, "abcd"), (13, "other")]
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, n int, block string").repartition(3)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for t, ids in groups.items():
        best = max(i for i in ids if i is not None)
        seen = False
        for i in ids:
            want.append((i, best, len(ids), i == best and not seen, hashlib.sha256(t.encode()).hexdigest()))
            seen = seen or i == best
    got = [tuple(r)[:5] for r in exact_dedup(docs, block=block).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup(docs.limit(0)).count() == 0
