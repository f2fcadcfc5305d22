"""Phrase lists as one pattern, and how often texts are judged."""

import random

from worklode import queries as Q
from worklode.functions import gates, rules
from worklode.operators import extract


def test_a_tree_finds_what_the_phrases_do(spark):
    """Every list, over texts made of pieces of its phrases, and one list with a phrase that begins another."""
    lists = [rules.PLANNING, rules.SESSION_OP, rules.NARRATIVE, rules.STATUS_FAILED, rules.FAILED_OBJECT, rules.SKILL_TALK, rules.PRODUCT_COPY, rules.META_FAILED, rules.RECAP, ("ab", "abc", "b]-^", "a.c")]
    rng = random.Random(3)
    for phrases in lists:
        assert gates._tree(phrases).count("|") < len(phrases) and gates._tree(phrases).startswith("(?=[")
        texts = ["", *phrases, *[p[:-1] for p in phrases], *[p[1:] for p in phrases]]
        texts += ["".join(rng.choice(phrases)[: rng.randint(1, 9)] for _ in range(4)) for _ in range(200)]
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", gates.has_any("t", phrases).alias("got")).collect()
        assert [(r.t, any(p in r.t for p in phrases)) for r in rows] == [(r.t, r.got) for r in rows]


def test_noise_judges_a_sentence_once_for_all_types(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "It failed. We chose x.")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = Q.QUERIES["noise"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = plan[: next(i for i, x in enumerate(plan) if "Generate explode([failed" in x)]
    assert above and not any("RLIKE" in x for x in above) and df.where("text = 'We chose x.'").count() == 5


def test_forms_of_a_sentence_are_made_once(spark):
    """Each gate folded and trimmed the sentence anew."""
    m = spark.createDataFrame([("p", "s", "cli", "turn", 0, "user", "Redis failed again in a/b.go.", False, False)], "project_key string, session_id string, harness string, source string, offset long, role string, text string, error boolean, skip boolean")
    df = extract.judged_sentences(m, typed=True)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("translate(lower") < 20
    assert [(r.type, r.reason) for r in df.collect()] == [("failed", None)] and not [c for c in df.columns if c.startswith("_")]
