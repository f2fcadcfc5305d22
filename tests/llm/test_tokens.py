import heapq
import random

import numpy as np
import pytest

from tests.llm.fixtures import documents, frame
from worklode.llm import packing
from worklode.llm import sentencepiece as sp

VOCAB = sp.Vocabulary.load()


def scalar(enc, text, key):
    """The agenda of a whole text on one heap."""
    if not text:
        return []
    v = enc.v
    s = " " + text
    sym = [int(enc.table[ord(c)]) for c in s]
    nxt, prv = [*range(1, len(sym)), -1], list(range(-1, len(sym) - 1))
    heap = []
    k = sp.mix64(np.array([key], np.int64).astype(np.uint64) + np.uint64(1))

    def push(i):
        j = nxt[i] if i >= 0 else -1
        if i < 0 or j < 0 or sym[i] < 0 or sym[j] < 0:
            return
        m = v.merges.get(sym[i] << 20 | sym[j])
        if m and not (enc.cut and enc._dropped(k, np.array([i]), np.array([m[1]]))[0]):
            heapq.heappush(heap, (m[0], i, m[1], sym[i], sym[j], j))

    for i in range(len(sym)):
        push(i)
    while heap:
        _, i, p, a, b, j = heapq.heappop(heap)
        if sym[i] != a or nxt[i] != j or sym[j] != b:
            continue
        sym[i], sym[j] = p, -2
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prv[nxt[j]] = i
        push(prv[i])
        push(i)
    out = []
    for i, x in enumerate(sym):
        out += [x] if x >= 0 else [v.first_byte + b for b in s[i].encode()] if x == -1 else []
    return out


TEXTS = ["", "a", "Hello world, the quick  brown   fox", "x▁y  \n\t é𐍈中文 naïve", "a" * 700 + " b", " lead", "the " * 50, "12 3.4-5 z", "    "]


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_rounds_match_the_scalar_agenda(dropout):
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("theing ouraslt é中▁") for _ in range(r.randint(1, 300))) for _ in range(60)]
    keys = np.arange(len(texts)) - 5
    enc = sp.Encoder(VOCAB, dropout, 7)
    ids, counts = enc.encode(texts, keys)
    cut = np.r_[0, np.cumsum(counts)]
    for i, t in enumerate(texts):
        assert ids[cut[i] : cut[i + 1]].tolist() == scalar(enc, t, int(keys[i])), t
    assert [d.decode() for d in enc.decode(ids, counts)] == texts


def test_without_dropout_equals_the_library():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sp.DEFAULT_MODEL)
    texts = [t for t in TEXTS if "▁" not in t] + [d[1] for d in documents() if d[1]]
    ids, counts = sp.Encoder(VOCAB).encode(texts, np.zeros(len(texts), np.int64))
    cut = np.r_[0, np.cumsum(counts)]
    for i, t in enumerate(texts):
        assert ids[cut[i] : cut[i + 1]].tolist() == lib.encode(t), t


def test_encode_decode_frames(spark):
    docs = documents()
    rows = sp.encode(frame(spark, docs), dropout=0.2).collect()
    assert len(rows) == len(docs) and all(r.round_trip for r in rows)
    again = {r.doc_id: r.ids for r in sp.encode(frame(spark, docs).repartition(3), dropout=0.2).collect()}
    assert all(again[r.doc_id] == r.ids for r in rows)
    other = {r.doc_id: r.ids for r in sp.encode(frame(spark, docs), dropout=0.2, seed=4).collect()}
    assert sum(other[r.doc_id] != r.ids for r in rows) > len(rows) / 2
    texts = {r.doc_id: r.text for r in sp.decode(sp.encode(frame(spark, docs))).collect()}
    assert all(texts[d] == (t or "") for d, t, *_ in docs)
    assert sp.encode(frame(spark, [])).count() == 0


def test_best_fit_against_a_plain_search():
    r = random.Random(2)
    for _ in range(50):
        lengths = np.array([r.randint(1, 40) for _ in range(r.randint(0, 120))])
        room, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [x for x in room if x >= lengths[i]]
            best = min(fits) if fits else 40
            if fits:
                room.remove(best)
            room.append(best - lengths[i])
            want.append(best)
        rows = packing.best_fit(lengths, 40)
        assert sorted(i for x in rows for i in x) == list(range(len(lengths)))
        assert sorted(40 - sum(lengths[i] for i in x) for x in rows) == sorted(room)


def test_pack_is_round_trip(spark):
    import tiktoken

    docs = documents()
    rows = packing.pack(frame(spark, docs), row=64, buffer=2000).collect()
    enc = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=packing.load_encoding(), special_tokens={})
    tokens = packing.unpack([r for r in rows], 64)
    twice = {d for d in (x[0] for x in docs) if sum(x[0] == d for x in docs) > 1}
    for d, t, *_ in docs:
        if d not in twice:
            assert enc.decode(tokens[d].tolist()) == (t or "")
    assert sum(len(r.doc_ids) for r in rows) >= len(docs)
    for r in rows:
        pos = np.frombuffer(r.positions, "<u2")
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64 and r.resets == r.cu_seqlens[:-1]
        assert all((pos[a:b] == np.arange(b - a)).all() for a, b in zip(r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True))
    assert len({r.pack_id for r in rows}) == len(rows)
    assert packing.matrix([r for r in packing.pack(frame(spark, docs)).collect()]).shape[1] == 2048
    assert packing.pack(frame(spark, [])).count() == 0


def test_long_texts_are_encoded_in_pieces(spark):
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=packing.load_encoding(), special_tokens={})
    r = random.Random(5)
    for _ in range(40):
        t = "".join(r.choice(["a", " ", "\n", "1", "!", " b", "  ", "é", "'s", "\t", " \n", "-x"]) for _ in range(400))
        parts = list(packing.pieces_of(t, 30))
        assert "".join(parts) == t and len(parts) > 3
        assert [x for p in parts for x in enc.encode_ordinary(p)] == enc.encode_ordinary(t)
    blanks = [" " * 5_000_000, "a" + "\n" * 200_000 + "b c", "x " * 400_000 + "\t" * 70_000, "z" * 3_000_000]
    rows = packing.pack(frame(spark, [(i, t, "", "", 0) for i, t in enumerate(blanks)]), row=1 << 16).collect()
    tokens = packing.unpack(rows, 1 << 16)
    assert all(enc.decode(tokens[i].tolist()) == t for i, t in enumerate(blanks))
    assert tokens[2].tolist()[:400_000] == enc.encode_ordinary("x " * 400_000)[:400_000]


def test_stable_packs_and_wide_positions(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 4000)
    docs = documents() + [(None, "no id here", "en", "s", 0)]
    one = packing.pack(frame(spark, docs).coalesce(1), row=64, stable=True).collect()
    two = packing.pack(frame(spark, docs[::-1]).repartition(7), row=64, stable=True).collect()
    key = lambda r: r.pack_id
    assert sorted(one, key=key) == sorted(two, key=key) and len({r.pack_id for r in one}) == len(one)
    assert {d for r in one for d in r.doc_ids} == {d[0] for d in docs}
    wide = packing.pack(frame(spark, [(1, "b c " * 50_000, "", "", 0)]), row=80_000).collect()
    assert len(wide) == 2 and np.frombuffer(wide[0].positions, "<u4").max() == 79_999
    assert packing.pack(frame(spark, []), stable=True).count() == 0


def test_long_texts_in_pieces_have_the_tokens_of_the_whole(monkeypatch):
    r = random.Random(4)
    texts = ["".join(r.choice(["the ", "ing", " a", "é", "▁", "中", "zz", "\n", "ou"]) for _ in range(n)) for n in (0, 5, 300, 900)] + ["a" * 500, "short"]
    keys = np.arange(len(texts))
    for dropout in (0.0, 0.3):
        enc = sp.Encoder(VOCAB, dropout, 2)
        whole = enc.encode(texts, keys)
        monkeypatch.setattr(sp, "PIECE", 40)
        parts = enc.encode(texts, keys)
        monkeypatch.undo()
        assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()
    monkeypatch.setattr(sp, "PIECE", 40)
    monkeypatch.setattr(sp, "SEGMENT", 100)
    ids, counts = enc.encode(texts, keys)
    assert [d.decode() for d in enc.decode(ids, counts)] == texts
