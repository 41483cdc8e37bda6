"""Periodic runs against a listing of all stretches, edge cases, the registered query."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidyorder.llm.periodic_runs import find_runs, plant_periods, word_runs
from tidyorder.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def listed(words):
    """All maximal stretches by comparing every word with every earlier one."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(24, 3 * q) and not any(all(words[k] == words[k - d] for k in range(start + d, j)) for d in range(1, q)):
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def arrays(docs):
    ids = {}
    return (np.array([ids.setdefault(w, len(ids)) for d in docs for w in d], np.int64), np.cumsum([len(d) for d in docs], dtype=np.int64))


def made(seed):
    r = random.Random(seed)
    words = []
    while len(words) < r.choice([5, 60, 300]):
        block = [r.choice("abcd"[: r.randint(1, 4)]) for _ in range(r.randint(1, 40))]
        words += (block * r.randint(1, 30))[: r.randint(1, 150)]
    return words


def test_runs_equal_the_listing():
    for seed in range(150):
        docs = [made(1000 * seed + k) for k in range(3)] + [[]]
        start, length, period = find_runs(*arrays(docs))
        want, base = [], 0
        for d in docs:
            want += [(s + base, n, q) for s, n, q in listed(d)]
            base += len(d)
        assert list(zip(start.tolist(), length.tolist(), period.tolist())) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=120))
def test_runs_of_two_words(words):
    start, length, period = find_runs(*arrays([words]))
    assert list(zip(start.tolist(), length.tolist(), period.tolist())) == listed(words)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "ha " * 200_000), (5, "x" * 3_000_000), (6, "a b c " * 8), (6, "a b c " * 8), (None, "a " * 24), (7, "a " * 23), (8, "  é" * 30)]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, runs int, start int, h string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in word_runs(docs).collect()), key=repr)
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = [(0, 200_000, 1)] if i == 4 else listed(words)
        want.append((i, len(words), runs, collapsed(words, runs)))
    assert got == sorted(want, key=repr)
    assert word_runs(docs.limit(0)).count() == 0 and plant_periods(docs.limit(0)).count() == 0
    assert plant_periods(docs).count() == len(rows)


def test_query_equals_brute_force(spark):
    want = {}
    for i, text in [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = listed(words)
        top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[i] = (len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(collapsed(words, runs)))
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, FOLDER).collect()}
    assert got == want and sum(1 for w in want.values() if w[0]) > 5
