import json
import os

import pytest
from pyspark.sql import functions as F

from worklode.functions import embed
from worklode.operators import scorecard, store
from worklode.sources import files, locate


def test_locating_sessions(spark, tmp_path):
    def put(path, *lines):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("".join(json.dumps(x) + "\n" for x in lines))
        return str(p)

    uid = "0f8fad5b-d9cb-469f-a165-70867728950e"
    a = put(".claude/projects/-w-api/s-1.jsonl", {"type": "x"}, {"type": "user", "cwd": "/w/api", "sessionId": "s-1"})
    put(f".codex/sessions/2026/rollout-2026-{uid}.jsonl", {"type": "session_meta", "payload": {"id": uid, "cwd": "/w/web"}})
    put(".grok/sessions/%2Fw%2Fapi/g7/chat_history.jsonl", {"type": "user"})
    put(".grok/sessions/%2Fw%2Fapi/g7/other.jsonl", {"type": "user"})
    found = locate.sessions_at(spark, str(tmp_path)).cache()
    assert {(r.harness, r.session_id) for r in found.collect()} == {("claude", "s-1"), ("codex", uid), ("grok", "g7")}
    assert locate.locate(found, "s-1").first().path.endswith("/s-1.jsonl") and locate.locate(found, "s-1", "codex").isEmpty()
    said = locate.peek(spark, [r.path for r in found.collect()])
    assert {(r.session_id, r.cwd) for r in said.collect()} == {("s-1", "/w/api"), (uid, "/w/web")}
    assert locate.latest_by_cwd(found, said, "/w/web").first().path.endswith(f"{uid}.jsonl")
    known = spark.createDataFrame([(a, "mine", "s-1")], "jsonl string, harness string, session_id string")
    assert sorted(r.harness for r in locate.discover_home(known, found).collect()) == ["codex", "grok", "mine"]
    assert locate.claude_slug("/w/my_api") == "-w-my-api" and locate.grok_folder("/w/a") == "%2Fw%2Fa"
    assert locate.sessions_at(spark, str(tmp_path / "none")).isEmpty()
    assert {r.note for r in locate.inspection(spark, str(tmp_path / ".claude")).collect()} == {""}


def test_sealing_and_guards(spark, tmp_path):
    p = tmp_path / "t" / "a.jsonl"
    p.parent.mkdir()
    p.write_text('{"a":1}\n')
    os.utime(p, (1_000_000, 1_000_000))
    (tmp_path / "t" / "b.jsonl").write_text("{}\n")
    due = files.idle(files.listing(spark, str(tmp_path / "t")), 1_000_000_000 + 86_400_000)
    assert [r.sealed for r in files.seal_tapes(due).collect()] == [True] and not p.exists()
    assert {r.chunk for r in files.read_sealed(spark, str(tmp_path / "t")).collect()} == {'{"a":1}\n', "{}\n"}
    assert files.confined("/s", "acme", "x.md") == "/s/acme/x.md"
    for bad in ("..", "", "a/b"):
        with pytest.raises(ValueError):
            files.confined("/s", bad)
    rows = spark.createDataFrame([("/home/s", "/w", "/x.jsonl", "real"), ("/home/s", "/tmp/TestRun123/w", "/x.jsonl", "real"), ("/tmp/TestRun123/s", "/w", "/x", "sess1"), ("/home/s", "/w", "/x", "sess1")], "root string, workspace string, jsonl string, session_id string")
    assert [r.r for r in rows.select(store.refuse_test_ingest().alias("r")).collect()] == [False, True, False, True]
    assert store.of_path(rows, "/w/").count() == 3
    assert embed.unpack_vector(embed.pack_vector([0.5, -2.0])) == [0.5, -2.0]
    assert embed.open_embedder({}) is None and embed.open_embedder({"WORKLODE_EMBED_CMD": "cat"}).command == "cat"


def test_scorecard(spark, tmp_path):
    case = {"id": "c1", "project": "p", "write": {"min_extracted": 2, "must_extract_types": ["failed"], "must_not_extract_substrings": ["secret"]}, "asks": [{"name": "a", "must_include_types": ["failed"], "must_include_substrings": ["redis", "absent"], "must_warn": "prior attempt"}, {"name": "b", "must_be_empty": True}]}
    (tmp_path / "c1.json").write_text(json.dumps(case, indent=1))
    cases = scorecard.load_cases(spark, str(tmp_path))
    claims = spark.createDataFrame([("c1", "failed", "redis failed")], "case_id string, type string, text string")
    w = scorecard.write_scores(cases, claims)
    assert w.first().errors == ["extracted 1 want >= 2"]
    hits = spark.createDataFrame([("c1", "a", 1, "failed", "redis failed", "A prior attempt at this")], "case_id string, name string, rank int, type string, text string, warning string")
    asks = scorecard.ask_scores(cases, hits)
    got = {r.name: r for r in asks.collect()}
    assert (got["a"].needles, got["a"].hit, got["a"].errors, got["a"].recall) == (4, 3, ["missing absent"], 0.75)
    assert (got["b"].recall, got["b"].errors) == (1.0, [])
    rolled = scorecard.rollup(cases, w, asks)
    lines = [r.line for r in scorecard.report(rolled).collect()]
    assert lines[0].startswith("c1") and "FAIL" in lines[0] and "a: missing absent" in lines[0] and lines[1] == "0/1 cases pass, mean recall 0.88"
