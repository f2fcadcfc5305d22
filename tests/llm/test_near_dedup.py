import random
import re

import numpy as np

from tests.llm.fixtures import documents, frame
from worklode.llm import near_dedup as nd
from worklode.llm.components import components


def brute_components(rows, percent=85):
    sets = {}
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(seed=8, groups=14):
    r = random.Random(seed)
    rows, i = [], 0
    for g in range(groups):
        base = [f"w{r.randint(0, 3000)}" for _ in range(r.randint(20, 120))]
        for _ in range(r.choice([1, 2, 3, 40 if g == 0 else 6])):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"x{r.randint(0, 99999)}"
            rows.append((i, " ".join(w), "en", "s", 0))
            i += 1
    r.shuffle(rows)
    return rows


def check(spark, rows, **kw):
    got = nd.near_duplicates(frame(spark, rows), **kw).collect()
    assert len(got) == len(rows)
    want = brute_components([x for x in rows if x[0] is not None])
    for g in got:
        if g.doc_id is None:
            assert g.component_id is None and g.kept
        else:
            assert (g.n_shingles, g.component_id) == want[g.doc_id] and g.kept == (g.doc_id == g.component_id), g


def test_components_match_brute_force(spark):
    check(spark, documents() + [(None, documents()[0][1], "en", "s", 0), (None, None, None, None, None)])
    check(spark, near_copies())
    assert nd.near_duplicates(frame(spark, [])).count() == 0


def test_large_buckets_are_blocked_without_loss(spark):
    check(spark, near_copies(seed=3), block=5)


def test_estimate_and_merge():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**63, 900, dtype=np.uint64), r.integers(0, 2**63, 100, dtype=np.uint64)
    x = np.unique(np.r_[a, b])
    y = np.unique(np.r_[a, r.integers(0, 2**63, 100, dtype=np.uint64)])
    k = nd.sketch(np.r_[x, y], np.array([len(x), len(y)]))
    j = nd.likelihood_estimate((k[0] > k[1]).sum(), (k[0] < k[1]).sum(), len(x), np.array([len(y)]))[0]
    assert abs(j - 900 / 1100) < 0.15
    union = np.unique(np.r_[x, y])
    assert (nd.merge(k[0], k[1]) == nd.sketch(union, np.array([len(union)]))[0]).all()


def test_connected_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(500, 500)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}
