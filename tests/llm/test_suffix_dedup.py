"""Repeated byte strings against a table of all windows."""

import hashlib
import random
from collections import Counter

import pytest

from tidyorder.llm import suffix_dedup


def expected(rows, length=200):
    texts = {i: (t or "").encode() for i, t in rows}
    seen = Counter(t[k : k + length] for t in texts.values() for k in range(len(t) - length + 1))
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.mark.parametrize("hot", [3, 20_000])
def test_planted_repeats(spark, hot):
    rng = random.Random(5)
    passages = [words(rng, 60) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "x" * 199), (3, "y" * 200), (4, "z" * 201), (5, "ab" * 300), (6, "w" * 3000)]
    for i in range(7, 60):
        parts = [words(rng, rng.randint(0, 80)) for _ in range(3)]
        p = rng.choice(passages)
        a, b = sorted(rng.sample(range(len(p) + 1), 2))
        rows.append((i, rng.choice([parts[0] + p + parts[1], parts[0] + p[a:b] + parts[2], p + p, words(rng, 5), p[a:]])))
    rows += [(100 + k, rows[20][1]) for k in range(3)]
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, rid int, b string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_spans(docs, hot=hot).collect()}
    assert got == expected(rows)
    assert suffix_dedup.repeated_spans(docs.limit(0)).count() == 0


def test_colliding_grams_lose_nothing(spark, monkeypatch):
    """Texts whose linear hashes are all equal, as a crafted pair of texts can make them."""
    import numpy as np

    values = suffix_dedup._VALUE.copy()
    values[ord("b")] = values[ord("a")]
    monkeypatch.setattr(suffix_dedup, "_VALUE", values)
    rng = random.Random(3)
    one = "".join(rng.choice("ab") if k % 9 == 0 else rng.choice("cdefgh ") for k in range(320))
    two = one.translate(str.maketrans("ab", "ba"))
    texts = [one.encode(), two.encode(), (one[:230] + two[230:]).encode()]
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    start, count, offset, bucket, digest = suffix_dedup.anchors(data, ends, 200, 32)
    order = np.argsort(bucket, kind="stable")
    start, count, offset, bucket = start[order], count[order], offset[order], bucket[order]
    assert len(np.unique(bucket)) * 2 < len(bucket) + 2 and len(np.unique(digest, axis=0)) == len(digest)
    base = np.concatenate([[0], np.cumsum(count + 199)])
    spans = np.concatenate([data[s : s + n + 199] for s, n in zip(start, count)])
    hit = suffix_dedup.shared_positions(spans, base, bucket, offset, 200)
    found = {int(s + k) for s, n, b in zip(start, count, base) for k in range(n) if hit[b + k]}
    seen = Counter(bytes(data[k : k + 200]) for e in ends for k in range(e - 320, e - 199))
    assert found == {k for e in ends for k in range(e - 320, e - 199) if seen[bytes(data[k : k + 200])] > 1}
    assert any(k < 320 for k in found)


def test_chunks_of_a_long_text(spark, monkeypatch):
    rng = random.Random(9)
    long = words(rng, 3000)
    rows = [(1, long + "#" + long[300:9000]), (2, long[5000:7000])]
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 1000)
    import numpy as np

    texts = [t.encode() for _, t in rows]
    ends = np.cumsum([len(t) for t in texts])
    start, count, *_ = suffix_dedup.anchors(np.frombuffer(b"".join(texts), np.uint8), ends, 200, 32)
    covered = np.concatenate([np.arange(s, s + n) for s, n in zip(start, count)])
    assert sorted(covered) == [k for k in range(ends[-1] - 199) if not ends[0] - 200 < k < ends[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_spans(docs).collect()}
    assert got == expected(rows)


def test_query_on_the_small_table(spark):
    from tidyorder.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op6_suffix_dedup"](spark, folder).collect()}
    assert got == expected(rows)
