import hashlib
import random

import numpy as np

from tests.llm.fixtures import documents, frame
from worklode.llm import suffix_dedup as sd


def brute(rows):
    least = {}
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    for d, t in texts:
        if d is not None:
            for i in range(len(t) - 49):
                s = t[i : i + 50]
                least[s] = min(least.get(s, d), d)
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if d is not None and least[t[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def same(spark, rows):
    got = sd.dedup_spans(frame(spark, rows).withColumn("g", sd.F.lit(1))).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sd, "GROUP_BYTES", 3000)
    same(spark, documents() + [(None, documents()[0][1], "en", "s", 0), (None, None, None, None, None)])


def test_many_shapes(spark, monkeypatch):
    monkeypatch.setattr(sd, "GROUP_BYTES", 6000)
    monkeypatch.setattr(sd, "CHUNK_WINDOWS", 300)
    r = random.Random(3)
    parts = ["".join(r.choice("ab é") for _ in range(r.randint(30, 140))) for _ in range(12)] + ["a" * 130, "ab" * 60, "x" * 49, "y" * 50]
    rows = [(i if i % 9 else 5, "".join(r.choice(parts) for _ in range(r.randint(0, 5))), "en", "s", 0) for i in range(150)]
    same(spark, rows)


def test_one_beginning_in_every_document(spark, monkeypatch):
    """Sixteen bytes that are every suffix's anchor in ever other surroundings: splitters coincide, and one anchor exceeds a chunk."""
    monkeypatch.setattr(sd, "GROUP_BYTES", 4000)
    monkeypatch.setattr(sd, "CHUNK_WINDOWS", 200)
    r = random.Random(11)
    hot = "the same sixteen"
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    sides = [(text(60), text(60)) for _ in range(25)]
    rows = []
    for i in range(160):
        parts = []
        for _ in range(4):
            left, right = r.choice(sides)[0], r.choice(sides)[1]
            parts.append(left[-r.randint(5, 60) :] + hot + right[: r.randint(5, 60)] + text(r.randint(0, 3)))
        rows.append((i, text(20).join(parts), "en", "s", 0))
    same(spark, rows)
    tokens = tuple((int.from_bytes(hot[k : k + 8].encode(), "big") ^ 1 << 63) - (1 << 64) for k in (0, 8))
    tokens = tuple(t + (1 << 64) if t < -(1 << 63) else t for t in tokens)
    monkeypatch.setattr(sd, "_sample_splitters", lambda *_: [tokens] * 7)
    same(spark, rows)


def test_hash_buckets_hold_equal_shares():
    r = np.random.default_rng(4)
    data = r.integers(97, 123, 400_000).astype(np.uint8)
    _, _, _, _, h = sd.anchors(data, np.array([0, len(data)]))
    n = np.diff(np.r_[0, np.searchsorted(np.sort(h), sd._hash_splitters(40)), len(h)])
    assert n.min() > 0.75 * n.mean() and n.max() < 1.25 * n.mean()


def test_groups_and_buckets_grow_together(spark, monkeypatch):
    monkeypatch.setattr(sd, "GROUP_BYTES", 1000)
    monkeypatch.setattr(sd, "SCALE_BYTES", 16_000)
    rows = {}
    for k in (1, 4):
        base = spark.createDataFrame([(i, bytearray(1000)) for i in range(32 * k)], "doc_id long, text binary")
        _, groups, _, total = sd._grouped(base)
        rows[k] = groups * groups
        assert total == 32_000 * k
    assert rows[4] <= 4.5 * rows[1]


def test_empty_and_quicksort(spark):
    assert sd.dedup_spans(frame(spark, [])).count() == 0
    r = np.random.default_rng(1)
    words = r.integers(0, 3, (500, 4)).astype(np.uint64)
    order, new = sd.multikey_quicksort(words)
    rows = [tuple(x) for x in words[order].tolist()]
    assert rows == sorted(rows)
    assert new.tolist() == [i == 0 or rows[i] != rows[i - 1] for i in range(500)]
