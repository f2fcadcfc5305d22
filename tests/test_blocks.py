"""All-pairs steps in blocks, against plain Python and columns."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from worklode import schemas as S
from worklode.functions import hashes as H
from worklode.functions import text as X
from worklode.plans import ask as A
from worklode.plans import blocks


def test_neighbours_are_those_of_the_columns(spark, monkeypatch):
    """Ties, copies, odd and zero vectors, other dimensions, models and projects; several blocks of either side."""
    monkeypatch.setattr(S, "VECTOR_BATCH", 8)
    monkeypatch.setattr(S, "VECTOR_BLOCK", 100)
    rng = np.random.default_rng(5)
    vec = [[float(np.float32(x)) for x in rng.normal(size=6)] for _ in range(300)]
    vec += [vec[0]] * 60 + [[2.0 * x for x in vec[0]]] * 20 + [[0.0] * 6, [1e30] * 6, [1e-30] * 6, [float("nan")] * 6, [float("inf")] + [0.0] * 5, [None] * 6, [1.0] * 5, None]
    rows = [(f"v{i:04}", "q" if i % 50 == 7 else "p", "o" if i % 50 == 8 else "m", v) for i, v in enumerate(vec)]
    v = spark.createDataFrame(rows, "record_id string, project_key string, model string, vec array<float>")
    q = v.where("substring(record_id, 5, 1) = '0' or record_id > 'v0379'").select(F.col("record_id").alias("request_id"), "project_key", "model", F.col("vec").alias("query_vec"))
    near = q.join(v, ["project_key", "model"]).where(F.size("vec") == F.size("query_vec")).withColumn("cosine", H.cosine("query_vec", "vec")).where("cosine > 0")
    want = near.withColumn("pos", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("cosine"), "record_id"))).where("pos <= 9")
    got = A.vector_hits(q, v, v.select(F.col("record_id").alias("id")), 9)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.select("request_id", "record_id", "cosine", "pos").collect()}


def test_neighbours_make_no_row_for_each_pair(spark):
    """A product of requests and vectors in the plan took time and memory with the square of the table."""
    v = spark.range(10).select(F.col("id").alias("record_id"), F.lit("p").alias("project_key"), F.lit("m").alias("model"), F.array(F.lit(1.0), F.col("id").cast("double")).cast("array<float>").alias("vec"))
    q = v.select(F.col("record_id").alias("request_id"), "project_key", "model", F.col("vec").alias("query_vec"))
    hits = A.vector_hits(q, v, v.select(F.col("record_id").alias("id")))
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "query_vec" not in "".join(x for x in plan.splitlines() if "Join Inner" in x) and "CoGroup" in plan and hits.count() == 100


def _claims(spark, rng):
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(160):
        own = rng.sample(words, rng.randint(0, 12)) if i % 3 else rng.sample(words[:9], rng.randint(3, 9))
        when = None if i == 5 else f"2026-01-{1 + rng.randint(0, 8):02}"
        rows.append((f"r{i % 2}", f"c{i:03}", ("failed", "decision", "constraint", "state")[rng.randint(0, 3)], when, i, rng.sample(["a.ts", "b.ts"], rng.randint(0, 2)), own + own[:2] + [""], own[:5]))
    return rows, spark.createDataFrame(rows, "request_id string, id string, type string, created_at string, n long, cluster array<string>, words array<string>, topic array<string>")


def _pairs(c, left, right):
    k = c.select("*", F.explode("cluster").alias("k"))
    a = k.where(left).select("request_id", "k", *[F.col(x).alias(f"a_{x}") for x in ("id", "type", "created_at", "n", "words", "topic")])
    b = k.where(right).select("request_id", "k", *[F.col(x).alias(f"b_{x}") for x in ("id", "type", "created_at", "n", "words", "topic")])
    return a.join(b, ["request_id", "k"])


def test_conflicts_and_invalidated_are_those_of_all_pairs(spark, monkeypatch):
    for block in (16384, 7):  # one block a group, and many
        monkeypatch.setattr(S, "SET_BLOCK", block)
        _, c = _claims(spark, random.Random(block))
        lasting = F.col("type").isin("decision", "constraint")
        p = _pairs(c, lasting, lasting).where((F.col("a_n") < F.col("b_n")) & (F.col("a_type") == F.col("b_type"))).where(X.jaccard("a_words", "b_words") >= S.CONFLICT)
        want = p.select("request_id", F.when(F.col("a_created_at") >= F.col("b_created_at"), F.col("b_id")).otherwise(F.col("a_id"))).distinct().collect()
        got = [tuple(r) for r in A.conflicts(c).collect()]
        assert sorted(got) == sorted(map(tuple, want)) and len(got) > 5
        p = _pairs(c, F.col("type") == "failed", lasting).where("a_created_at > b_created_at").where(X.jaccard("a_topic", "b_topic") >= S.INVALIDATE)
        got = [tuple(r) for r in A.invalidated(c).collect()]
        assert sorted(got) == sorted(map(tuple, p.select("request_id", "b_id").distinct().collect())) and len(got) > 5
        for df in (A.conflicts(c), A.invalidated(c)):
            assert "Join Inner" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_similar_counts_large_sets_exactly():
    """Over 255 and over 65,535 shared values, and pieces of more than 512 sets."""
    sets = [np.arange(70000), np.arange(35000, 105000), np.arange(300), np.arange(100, 400), *[np.array([i, i + 1, 10**6]) for i in range(600)], np.array([], int)]
    flat = np.concatenate(sets).astype(np.int64), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    full = [set(s.tolist()) for s in sets]
    near = lambda i, j: len(full[i] & full[j]) / len(full[i] | full[j]) >= 1 / 3 if full[i] and full[j] else False
    want = {(i, j) for i in range(len(sets)) for j in range(i) if near(i, j)}
    got = [(max(i, j), min(i, j)) for x, y in blocks.similar(flat, flat, 1 / 3, True) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and (1, 0) in want and len(want) > 600
    cross = {(i, j) for x, y in blocks.similar(flat, flat, 1 / 3) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert cross == {p for i, j in want for p in ((i, j), (j, i))} | {(i, i) for i in range(len(sets) - 1)}
