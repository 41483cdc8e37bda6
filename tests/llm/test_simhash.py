"""SimHash groups against all pairs."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidyorder.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps, distance=4):
    """{fp: smallest fp reachable} by comparing all pairs."""
    left, out = set(fps), {}
    while left:
        todo = [min(left)]
        root = todo[0]
        left.discard(root)
        while todo:
            x = todo.pop()
            out[x] = root
            near = {y for y in left if (x ^ y).bit_count() <= distance}
            left -= near
            todo += near
    return out


def expected(rows):
    fps = {i: plain_fingerprint(t) for i, t in rows}
    root = roots(fps.values())
    first = {}
    for i, f in sorted(fps.items()):
        first.setdefault(root[f], i)
    return {i: (fps[i], first[root[f]]) for i, f in fps.items()}


def test_edge_cases(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "É é a b c"), (7, " ".join(words)), (8, " ".join(words)), (9, " ".join(words[1:])), (10, "x " * 50000)]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, fp string, seg int")
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.simhash_groups(docs).collect()}
    assert got == expected(rows)
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def near_fingerprints(rng, n):
    centres = [rng.getrandbits(64) for _ in range(n // 50)]
    out = {rng.getrandbits(64) for _ in range(n)}
    for _ in range(n):
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    hub = centres[0]
    out |= {hub ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    return sorted(out)


@pytest.mark.parametrize("group", [16, 4096])
@pytest.mark.parametrize("distance", [1, 4])
def test_links_connect_all_pairs(spark, group, distance):
    fps = near_fingerprints(random.Random(group + distance), 900)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(table, distance, group).collect()]
    assert all(0 < (a ^ b).bit_count() <= distance for a, b in edges)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert {f: find(f) for f in fps} == roots(fps, distance)


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 100 + k) for k in range(1, 60)]
    random.Random(1).shuffle(edges)
    found = simhash.components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.root) for r in found.collect()} == {(k, 1) for k in range(1, 41)} | {(100 + k, 100) for k in range(60)}


def test_query_on_the_small_table(spark):
    from tidyorder.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in QUERIES["op5_simhash"](spark, folder).collect()}
    assert got == want
    assert all(len(r[0]) == 16 for r in QUERIES["op5_simhash"](spark, folder).select(F.col("fingerprint")).take(5))
