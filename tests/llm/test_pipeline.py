import random
import re

import corpus_pipeline
from tests.llm.fixtures import documents, frame
from tests.llm.test_near_dedup import brute_components
from worklode.llm import language_id, pii
from worklode.llm import sentencepiece as sp


def test_stages_against_brute_force(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(14))
    docs = [list(d) for d in documents(80)]
    docs[40][1] = f"{docs[40][1]} {item} {docs[41][1]}"
    docs[42][1] = item
    docs[43][0] = None
    rows = [(*d, "x", "y") for d in docs]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key string, _lang_pred string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")

    table = spark.read.parquet(f"{path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    one = stage["language_id"](spark, table, path).collect()
    model = language_id.fit(table.where(~language_id.held_out()))
    langs, scores = model.score([d[1] or "" for d in docs])
    want = [d[0] for d, lang, s in zip(docs, langs, scores, strict=True) if lang != "und" and s >= 0.5]
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in one)

    assert all(r._lang_pred == "y" for r in one)
    kept = spark.createDataFrame(one, table.schema)
    two = stage["near_dedup"](spark, kept, path).collect()
    comp = brute_components([(r.doc_id, r.text) for r in one if r.doc_id is not None])
    assert sorted(map(str, [d for d, (_, c) in comp.items() if d == c] + [None] * sum(r.doc_id is None for r in one))) == sorted(str(r.doc_id) for r in two)

    three = {r.doc_id: r for r in stage["decontamination"](spark, spark.createDataFrame(two, table.schema), path).collect()}
    assert docs[42][0] not in three and item not in three[docs[40][0]].text
    assert all(three[r.doc_id].text == r.text for r in two if r.doc_id not in (docs[40][0], docs[42][0]))

    four = {r.doc_id: r for r in stage["pii"](spark, spark.createDataFrame(list(three.values()), table.schema), path).collect()}
    assert set(four) == set(three) and all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in four.values())
    assert all(four[d].text == r.text for d, r in three.items() if not re.search("[0-9@]", r.text))

    out = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(out) == set(four) and all(r.round_trip for r in out.values())
    enc = sp.Encoder(sp.Vocabulary.load())
    for d, r in out.items():
        assert enc.decode(sp.np.array(r.ids), sp.np.array([len(r.ids)]))[0].decode() == four[d].text


def test_near_dedup_stage_links_from_80_percent(spark, tmp_path):
    r = random.Random(12)
    rows = []
    for i in range(0, 60, 2):
        w = [f"w{r.randint(0, 9999)}" for _ in range(60)]
        rows.append((i, " ".join(w), "en", "s", 0))
        w[30] = "other"
        if i % 4:
            w[20] = "more"
        rows.append((i + 1, " ".join(w), "en", "s", 0))  # 51 of 61 shingles (0.836), or 46 of 66 (0.697)
    want = {d for d, (_, c) in brute_components(rows, 80).items() if d == c}
    assert len(want) == 45 and len({c for _, c in brute_components(rows).values()}) == 60
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, frame(spark, rows), str(tmp_path)).collect()
    assert sorted(x.doc_id for x in got) == sorted(want)


def test_near_dedup_stage_judges_texts_that_share_an_id_each_by_itself(spark, tmp_path):
    r = random.Random(13)
    a, b, c, d, e, f = ([f"{x}{r.randint(0, 9999)}" for _ in range(60)] for x in "abcdef")
    near = lambda w: [*w[:30], "other", *w[31:]]
    texts = [(2, near(a)), (5, a), (5, b), (7, c), (7, d), (8, near(c)), (9, near(d)), (10, e), (10, near(e)), (11, f), (11, [w.upper() for w in f]), (12, []), (12, ["z"]), (12, ["z"])]
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in texts]
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, frame(spark, rows), str(tmp_path)).collect()
    comp = {i: g for i, (_, g) in brute_components([(i, x[1]) for i, x in enumerate(rows)], 80).items()}
    left = [next(i for i, x in enumerate(rows) if x[:2] == (y.doc_id, y.text)) for y in got]
    assert sorted(comp[i] for i in left) == sorted(set(comp.values()))
    assert all(rows[i][0] == rows[comp[i]][0] for i in left)
