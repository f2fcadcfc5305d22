from pyspark.sql import functions as F

from tests.seed import SEED, claims, requests
from worklode import schemas as S
from worklode.plans import ask as A
from worklode.plans import pack
from worklode.plans.index import Index


def test_batch_of_asks(spark):
    ix = Index.build(claims(spark))
    req = requests(
        spark,
        {"question": "add redis rate limiting", "paths": ["src/mw/auth.ts"]},
        {"question": "what is the state of the invoice export"},
        {},
        {"question": "anything", "project": "other/repo"},
        {"question": "which library for jwt"},
    )
    packed = A.cut(A.ask(req, ix))
    hits = packed.collect()
    by = {}
    for h in sorted(hits, key=lambda h: h["rank"]):
        by.setdefault(h.request_id, []).append(h)
    assert by["r0"][0].id == "S1" and by["r0"][0].warning.startswith("A prior attempt")
    assert {h.id for h in by["r0"]} >= {"S1", "S4"} and all(h.id != "S5" for h in by["r0"])
    assert by["r1"][0].id == "S5" and "r3" not in by
    assert "S2" in {h.id for h in by["r4"]}, "jwt and jsonwebtoken are one identifier"
    assert len(by["r2"]) == len({h.id for h in by["r2"]}) and by["r2"][0].type == "failed"
    assert all(len(v) <= S.PACK_CAP for v in by.values())
    out = {r.request_id: r for r in A.responses(packed).collect()}
    assert out["r0"].warnings and out["r0"].tokens > 20 and [c.id for c in out["r0"].context][0] == "S1"


def test_conflict_invalidation_and_noise(spark):
    rows = [
        ("C1", "decision", "Use the token bucket limiter in the gateway.", ["a/index.ts"], "2026-01-01T00:00:00Z"),
        ("C2", "decision", "Use the sliding token bucket limiter in the gateway.", ["b/index.ts"], "2026-02-01T00:00:00Z"),
        ("F1", "failed", "The sliding bucket limiter failed in the Gateway.", ["b/index.ts"], "2026-03-01T00:00:00Z"),
        ("N1", "failed", "I'll check why the gateway limiter failed.", ["b/index.ts"], "2026-03-02T00:00:00Z"),
    ]
    ix = Index.build(claims(spark, rows))
    out = {r.id: r for r in A.explain(requests(spark, {"question": "gateway limiter bucket", "paths": ["b/index.ts"]}), ix).collect()}
    assert out["C1"].reason == "older-conflict" and out["C2"].reason == "invalidated" and out["N1"].reason == "extract-noise"
    assert out["F1"]["rank"] == 1 and out["F1"].why.startswith("packed #1")


def test_hydrate_continue_and_served(spark):
    ix = Index.build(claims(spark))
    acts = spark.createDataFrame(
        [(1, "acme/api", "default", "ask", "S3", ["src/mw/auth.ts"], ["rate", "limiting"], "2026-08-14T10:00:00Z"), (2, "acme/api", "default", "get", "S1", ["src/mw/auth.ts"], [], "2026-08-14T10:01:00Z")], S.ACTIONS
    )
    req = requests(spark, {"question": "continue"}, {"question": "rate limiting"}, {"question": "look", "paths": ["src/billing/export.ts"]})
    q = {r.request_id: r for r in A.hydrate(A.normalise(req), acts, ix.claims).collect()}
    assert q["r0"].continued and "src/mw/auth.ts" in q["r0"].path_keys and q["r0"].served == ["S3"] and "redis" in q["r0"].lookup
    assert q["r1"].continued and q["r1"].served == [] and q["r1"].dwell == ["S1"]
    assert not q["r2"].continued and q["r2"].path_keys == ["src/billing/export.ts", "export.ts"]
    hits = A.ask(req.where("request_id = 'r0'"), ix, actions=acts).collect()
    assert "S1" in {h.id for h in hits}


def test_compile_thin_request(spark):
    ix = Index.build(claims(spark))
    msgs = spark.createDataFrame([("acme/api", "s", "cli", "turn", 0, "user", "Please fix src/mw/auth.ts limiter", False, False), ("acme/api", "s", "cli", "turn", 40, "assistant", "That failed with Quota trouble", False, False)], S.MESSAGES)
    q = {r.request_id: r for r in A.compile_thin(A.normalise(requests(spark, {}, {"question": "two tokens"})), A.tails(msgs), ix.claims).collect()}
    assert q["r0"].question.startswith("Please fix") and q["r0"].path_keys[:2] == ["src/mw/auth.ts", "auth.ts"] and "quota" in q["r0"].lookup
    assert q["r1"].path_keys == [] and "quota" not in q["r1"].lookup


def test_vectors_and_staleness(spark):
    base = claims(spark).withColumn("path_mtime", F.map_from_arrays("paths", F.transform("paths", lambda p: F.lit(1000).cast("bigint")))).withColumn("workspace_root", F.lit("/w"))
    ix = Index.build(base)
    vec = spark.createDataFrame([("S5", "acme/api", "m", 2, [1.0, 0.0]), ("S1", "acme/api", "m", 2, [0.0, 1.0]), ("S2", "acme/api", "other", 2, [1.0, 0.0])], S.VECTORS)
    req = requests(spark, {"question": "zzz unrelated words"}).withColumn("model", F.lit("m")).withColumn("query_vec", F.array(F.lit(1.0), F.lit(0.1)).cast("array<float>"))
    files = spark.createDataFrame([("/w", "src/billing/export.ts", 2000)], "workspace_root string, path string, mtime_ms bigint")
    q = A.hydrate(A.normalise(req), None, ix.claims)
    near = {r.id: r.cosine for r in A.vector_hits(q, vec, ix.claims).collect()}
    assert set(near) == {"S5", "S1"} and near["S5"] > 0.99
    hits = {h.id: h for h in A.ask(req, ix, vectors=vec, files=files).collect()}
    assert hits["S5"].text.startswith("[verify] ")


def row(i, kind, text, score, **kw):
    base = {"request_id": "r", "id": i, "type": kind, "text": text, "created_at": f"2026-01-0{len(i)}", "paths": [], "harness": "h", "status": "active", "source": "", "has_ref": False, "claim_hash": i, "cluster": [], "score": score, "path": 0.0, "symbol": 0.0, "hop": 0.0, "failed_overlap": 0.0, "shipped_overlap": 0.0, "off_path": False}
    return base | kw


def test_packer_rules():
    rows = [row("a", "failed", "alpha one two", 1, failed_overlap=1.0, path=1.0), row("b", "failed", "beta three four", 9, hop=1.0), row("c", "failed", "gamma five six", 8, hop=1.0), row("d", "failed", "delta seven eight", 7, hop=1.0), row("e", "decision", "epsilon nine ten", 6), row("f", "decision", "epsilon nine ten", 5)]
    packed, left = pack.run(rows, 1200, False)
    assert {c["id"] for c in packed} >= {"a", "b", "e"} and sum(c["type"] == "failed" for c in packed) == 2
    reasons = {c["id"]: r for c, r in left}
    assert reasons["f"] == "diversity" and reasons["c"] == "type-cap"
    only, _ = pack.run([row(i, "state", f"{i} unique text {i * 3}", 3) for i in "uvwxyz"], 1200, True)
    assert len(only) == 5, "the type cap is waived where no other type is left"
    tiny, _ = pack.run(rows, 1, False)
    assert len(tiny) == 1
    states, _ = pack.run([row("s", "state", "alpha beta", 3, off_path=True)], 1200, False)
    assert len(states) == 1, "a filter that would empty the pool does nothing"
    full = [row(f"k{i}", "constraint" if i % 2 else "decision", f"text{i} other{i}", 9 - i) for i in range(6)] + [row("z", "failed", "zeta miss", 0.5, failed_overlap=0.0, path=1.0)]
    full[-1]["failed_overlap"] = 1.0
    packed, left = pack.run(full, 1200, False)
    assert "z" in {c["id"] for c in packed}


def test_large_decoy_store(spark):
    decoys = [(f"D{i:05}", "state", f"Working on widget number {i} today.", [f"src/w{i}/file{i}.ts"], f"2026-07-{1 + i % 28:02}T00:00:00Z") for i in range(10_000)]
    ix = Index.build(claims(spark, [*SEED, *decoys]))
    req = requests(spark, *[{"question": "redis limiter", "paths": ["src/mw/auth.ts"]} for _ in range(32)])
    hits = A.ask(req, ix).where("rank = 1").collect()
    assert len(hits) == 32 and {h.id for h in hits} == {"S1"}
