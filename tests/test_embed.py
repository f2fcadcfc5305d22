from tests.seed import claims, requests
from worklode.functions import embed as E
from worklode.operators import store
from worklode.plans import ask as A


def test_embedders(spark):
    e = E.TokenEmbedder([["redis", "cache store"]])
    a, b, c = e.embed(["redis is slow", "the cache store lags", "invoice export"])
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    assert dot(a, b) > 0.8 > 0.5 > dot(a, c) and abs(dot(a, a) - 1) < 1e-6 and e._hash("a") == 0xE40C292C
    vec = E.vectors_for(claims(spark), e)
    assert vec.count() == 5 and store.stale_vectors(claims(spark), vec, e.name, 32).count() == 0
    assert store.stale_vectors(claims(spark), vec, e.name, 33).count() == 5
    q = A.normalise(E.with_query_vectors(requests(spark, {"question": "cache store trouble"}, {}), e))
    hits = A.vector_hits(q, vec, claims(spark)).where("pos = 1").collect()
    assert [(h.request_id, h.id) for h in hits] == [("r0", "S1")]
    cmd = E.CommandEmbedder("""python -c 'import json,sys; t=json.load(sys.stdin)["texts"]; print(json.dumps({"vectors": [[3, 4] for _ in t]}))'""", dim=2)
    assert E.unit([3, 4]) == cmd.embed(["x"])[0]
    assert E.vectors_for(claims(spark), E.CommandEmbedder("false", dim=2)).count() == 0
