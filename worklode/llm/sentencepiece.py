"""SentencePiece BPE encoding with seeded merge-dropout, and exact decoding.

The vocabulary comes from a public model file (a parameter); nothing is
trained. A text is a dummy space and its characters, spaces shown as one sign.
The agenda takes, again and again, the best-scored candidate merge of two
neighbours (ties: leftmost). With dropout, a candidate is skipped if a hash of
(seed, document, position, merged piece) falls below the rate: the same
document and seed give the same segmentation, other seeds and documents other
ones. What is no piece in the end becomes byte pieces; so does the space sign
itself where a text contains it, and decoding is exact.

Segments that no piece can cross are independent, so one round pops the best
candidate of every segment of a slice at once; segments of over ``LONG`` symbols
run their own heap. Long texts go a piece at a time, cut between segments, so a
worker holds one piece's arrays and the tokens are those of the whole.

Defined results: null and empty texts have no tokens and decode to the empty
text; a segment of over ``SEGMENT`` symbols (one word or run of that length) is
encoded in parts of that many, so no merge crosses a part's end; repeated rows have equal tokens; a null doc_id hashes as 0; extra columns
are ignored by ``encode``.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklode.llm.common import bounded, column, mix64, ranges, text_slices

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONG = 64
#: Characters encoded at once, and symbols of one segment that are.
PIECE, SEGMENT = 1 << 18, 1 << 19
#: Bytes of a slice: its arrays stay in a core's cache.
SLICE = 1 << 17
_NONE = np.int64(1 << 62)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_CROSS_BITS = 22


@dataclass
class Vocabulary:
    """Arrays of fixed size for a vocabulary: what workers need of the model file."""

    chars: dict[int, int]
    merges: dict[int, tuple[int, int]]  # left << 20 | right -> (rank, piece)
    pieces: list[bytes]
    first_byte: int
    slots: np.ndarray = None
    slot_rank: np.ndarray = None
    slot_piece: np.ndarray = None
    cross: np.ndarray = None
    probes: int = 1

    @staticmethod
    def load(model_file: str = DEFAULT_MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        plain = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        scores = sorted({sp.get_score(i) for i in plain.values()}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        merges, inside = {}, set()
        for p, i in plain.items():
            for k in range(1, len(p)):
                inside.add((plain.get(p[k - 1], -1), plain.get(p[k], -1)))
                a, b = plain.get(p[:k]), plain.get(p[k:])
                if a is not None and b is not None:
                    merges[a << 20 | b] = (rank[sp.get_score(i)], i)
        first = next(i for i in range(n) if sp.is_byte(i))
        pieces = [b""] * n
        for p, i in plain.items():
            pieces[i] = p.replace(SPACE, " ").encode()
        for b in range(256):
            pieces[first + b] = bytes([b])
        v = Vocabulary({ord(p): i for p, i in plain.items() if len(p) == 1}, merges, pieces, first)
        v._build(inside)
        return v

    def _build(self, inside) -> None:
        bits = max(10, (2 * len(self.merges)).bit_length())
        self.slots = np.full(1 << bits, -1, np.int64)
        self.slot_rank = np.zeros(1 << bits, np.int32)
        self.slot_piece = np.zeros(1 << bits, np.int32)
        keys = np.array(list(self.merges), np.int64)
        home = self._home(keys)
        for k, h, (r, p) in zip(keys.tolist(), home.tolist(), self.merges.values(), strict=True):
            step = 1
            while self.slots[h] >= 0:
                h = (h + 1) & ((1 << bits) - 1)
                step += 1
            self.slots[h], self.slot_rank[h], self.slot_piece[h] = k, r, p
            self.probes = max(self.probes, step)
        pairs = np.array(sorted(inside), np.int64).reshape(-1, 2)
        self.cross = np.zeros(1 << _CROSS_BITS, bool)
        self.cross[self._pair_slot(pairs[:, 0], pairs[:, 1])] = True

    def _home(self, keys):
        return (keys.astype(np.uint64) * _MUL >> np.uint64(64 - (len(self.slots).bit_length() - 1))).astype(np.int64)

    def packed(self) -> Vocabulary:
        """What workers need: the merges in their slots only."""
        return replace(self, merges={})

    @staticmethod
    def _pair_slot(a, b):
        return (((a << 20) + b).astype(np.uint64) * _MUL >> np.uint64(64 - _CROSS_BITS)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray):
        """(rank or _NONE, piece) of each pair."""
        key = (left << 20) | right
        at = self._home(key)
        rank, piece = np.full(len(key), _NONE), np.zeros(len(key), np.int64)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            found = self.slots[at[todo]]
            hit = found == key[todo]
            h = todo[hit]
            rank[h], piece[h] = self.slot_rank[at[h]], self.slot_piece[at[h]]
            todo = todo[~hit & (found >= 0)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
        rank[(left < 0) | (right < 0)] = _NONE
        return rank, piece


class Encoder:
    def __init__(self, vocabulary: Vocabulary, dropout: float = 0.0, seed: int = 0):
        self.v = vocabulary
        self.cut = np.uint64(min(int(dropout * 2**64), 2**64 - 1))
        self.seed = np.uint64(seed * int(_MUL) % 2**64)
        self.table = np.full(0x110000, -1, np.int32)
        for c, i in vocabulary.chars.items():
            self.table[c] = i
        self.table[32] = vocabulary.chars[ord(SPACE)]
        self.table[ord(SPACE)] = -1
        self.piece_bytes = np.frombuffer(b"".join(vocabulary.pieces), np.uint8)
        self.piece_size = np.array([len(p) for p in vocabulary.pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size

    def _dropped(self, key: np.ndarray, pos: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return mix64(key ^ (pos.astype(np.uint64) * _MUL) ^ mix64(piece.astype(np.uint64) + self.seed)) < self.cut

    def _candidates(self, left, right, key, pos):
        rank, piece = self.v.look_up(left, right)
        if self.cut:
            at = np.flatnonzero(rank < _NONE)
            rank[at[self._dropped(key[at], pos[at], piece[at])]] = _NONE
        return rank, piece

    def _merge_long(self, sym, key, pos):
        """The agenda of one segment on a heap; returns (symbols, positions in the segment)."""
        n = len(sym)
        sym = sym.tolist()
        right, left, heap = [*range(1, n), -1], list(range(-1, n - 1)), []

        def push(pairs):
            i = np.array(pairs, np.int64)
            a = np.array([sym[x] for x in pairs], np.int64)
            b = np.array([sym[right[x]] for x in pairs], np.int64)
            rank, piece = self._candidates(a, b, np.full(len(i), key), pos[i])
            for x, r, p, s, t in zip(pairs, rank.tolist(), piece.tolist(), a.tolist(), b.tolist(), strict=True):
                if r < _NONE:
                    heapq.heappush(heap, (r, x, p, s, t, right[x]))

        push(list(range(n - 1)))
        while heap:
            _, x, p, s, t, y = heapq.heappop(heap)
            if sym[x] != s or right[x] != y or sym[y] != t:
                continue
            sym[x], sym[y] = p, -2
            right[x] = right[y]
            if right[y] >= 0:
                left[right[y]] = x
            fresh = [i for i in (left[x], x) if i >= 0 and right[i] >= 0]
            if fresh:
                push(fresh)
        at = [i for i in range(n) if sym[i] != -2]
        return np.array([sym[i] for i in at], np.int64), np.array(at, np.int64)

    def encode(self, texts: list[str], doc_keys: np.ndarray):
        """(ids of all texts one after another, number of ids of each text)."""
        long = [d for d, t in enumerate(texts) if len(t) > PIECE]
        if long:
            parts, sizes, lo = [], [], 0
            for d in [*long, len(texts)]:
                ids, counts = self.encode(texts[lo:d], doc_keys[lo:d])
                parts.append(ids)
                sizes += counts.tolist()
                if d < len(texts):
                    found = list(self._encode_long(texts[d], doc_keys[d : d + 1]))
                    parts += found
                    sizes.append(sum(map(len, found)))
                lo = d + 1
            return np.concatenate(parts), np.array(sizes, np.int64)
        n_docs = len(texts)
        joined = "".join(" " + t if t else "" for t in texts)
        if not joined:
            return np.zeros(0, np.int64), np.zeros(n_docs, np.int64)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        first = np.cumsum(sizes) - sizes
        sym = self.table[cp].astype(np.int64)
        n = len(sym)
        doc = np.repeat(np.arange(n_docs), sizes)
        pos = np.arange(n) - first[doc]
        key = mix64(doc_keys.astype(np.uint64) + np.uint64(1))[doc]
        return self._merge(cp, sym, doc, pos, key, n_docs)

    def _begins(self, sym: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Does a segment begin at each symbol?"""
        begins = np.ones(len(sym), bool)
        begins[1:] = (doc[1:] != doc[:-1]) | (sym[1:] < 0) | (sym[:-1] < 0)
        inner = np.flatnonzero(~begins)
        begins[inner] = ~self.v.cross[self.v._pair_slot(sym[inner - 1], sym[inner])]
        return begins

    def _encode_long(self, text: str, key: np.ndarray):
        """Ids of one text, a piece between segments at a time."""
        key = mix64(key.astype(np.uint64) + np.uint64(1))
        lo, size, n = 0, PIECE, len(text) + 1
        while lo < n:
            part = (" " + text[: size - 1]) if not lo else text[lo - 1 : lo - 1 + size]
            cp = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            sym = self.table[cp].astype(np.int64)
            m = len(sym)
            if lo + m < n:
                at = np.flatnonzero(self._begins(sym, np.zeros(m, np.int8)))
                if at[-1] == 0 and size < SEGMENT:
                    size *= 2
                    continue
                m = int(at[-1]) or m
            yield self._merge(cp[:m], sym[:m], np.zeros(m, np.int64), np.arange(lo, lo + m), np.repeat(key, m), 1)[0]
            lo, size = lo + m, PIECE

    def _merge(self, cp, sym, doc, pos, key, n_docs):
        """(ids, number of ids of each document) of symbols that begin with a segment."""
        n = len(sym)
        begins = self._begins(sym, doc)
        start = np.flatnonzero(begins)
        length = np.diff(np.r_[start, n])
        out_sym, out_at = [sym[start[length == 1]]], [start[length == 1]]
        for s, k in zip(start[length > LONG].tolist(), length[length > LONG].tolist(), strict=True):
            x, at = self._merge_long(sym[s : s + k], key[s], pos[s : s + k])
            out_sym.append(x)
            out_at.append(at + s)
        own = (length > 1) & (length <= LONG)
        at = ranges(start[own], length[own])
        seg = np.repeat(np.arange(int(own.sum())), length[own])
        x = sym[at]

        def pairs(i):
            return self._candidates(x[i], x[i + 1], key[at[i]], pos[at[i]])

        rank, piece = np.full(len(x), _NONE), np.zeros(len(x), np.int64)
        i = np.flatnonzero(seg[1:] == seg[:-1])
        rank[i], piece[i] = pairs(i)
        while len(x):
            heads = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            count = np.diff(np.r_[heads, len(x)])
            # ranks are below 2**31 and places in a slice too: one minimum finds rank and leftmost place
            best = np.minimum.reduceat(np.where(rank < _NONE, (rank << 32) | np.arange(len(x)), _NONE), heads)
            live = best < _NONE
            if not live.all():
                stay = np.repeat(live, count)
                out_sym.append(x[~stay])
                out_at.append(at[~stay])
                move = np.cumsum(stay) - 1
                x, at, seg, rank, piece = x[stay], at[stay], seg[stay], rank[stay], piece[stay]
                m = move[best[live] & 0xFFFFFFFF]
            else:
                m = best & 0xFFFFFFFF
            if not len(x):
                break
            x[m] = piece[m]
            keep = np.ones(len(x), bool)
            keep[m + 1] = False
            move = np.cumsum(keep) - 1
            x, at, seg, rank, piece = x[keep], at[keep], seg[keep], rank[keep], piece[keep]
            m = move[m]
            rank[m] = _NONE
            fresh = np.concatenate([m, m[m > 0] - 1])
            rank[fresh] = _NONE
            fresh = fresh[fresh + 1 < len(x)]
            fresh = fresh[seg[fresh] == seg[fresh + 1]]
            rank[fresh], piece[fresh] = pairs(fresh)
        sym, at = np.concatenate(out_sym), np.concatenate(out_at)
        o = np.argsort(at, kind="stable")
        sym, at = sym[o], at[o]
        count = np.bincount(doc[at], minlength=n_docs)
        lost = np.flatnonzero(sym < 0)
        if len(lost):  # byte pieces
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in cp[at[lost]].tolist()]
            width = np.ones(len(sym), np.int64)
            width[lost] = [len(b) for b in raw]
            count = np.bincount(doc[at], weights=width, minlength=n_docs).astype(np.int64)
            place = np.cumsum(width) - width
            full = np.repeat(sym, width)
            full[ranges(place[lost], width[lost])] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64) + self.v.first_byte
            sym = full
        return sym, count

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of ``encode``'s result, as UTF-8."""
        ids = np.asarray(ids, np.int64)
        data = self.piece_bytes[ranges(self.piece_at[ids], self.piece_size[ids])].tobytes()
        ends = np.r_[0, np.cumsum(self.piece_size[ids])][np.r_[0, np.cumsum(counts)]].tolist()
        return [data[a + 1 : b] if b > a else b"" for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encode(docs: DataFrame, id_col="doc_id", text_col="text", dropout: float = 0.1, seed: int = 3, model_file: str = DEFAULT_MODEL) -> DataFrame:
    """doc id, n_tokens, ids, and whether decoding gave the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file).packed())  # a vocabulary's size
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])

    def run(batches):
        e = Encoder(shared.value, dropout, seed)
        for b, data, offs in text_slices(batches, text_col, SLICE):
            texts = [t or "" for t in column(b, text_col).to_pylist()]
            ids, counts = e.encode(texts, np.array(column(b, "_key").to_pylist(), np.int64))
            raw, o = data.tobytes(), offs.tolist()
            same = [d == raw[x:y] for d, x, y in zip(e.decode(ids, counts), o[:-1], o[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([column(b, id_col), pa.array(counts, pa.int64()), lists, pa.array(same)], schema.names)

    return bounded(docs.select(id_col, text_col, F.xxhash64(F.col(id_col).cast("string")).alias("_key"))).mapInArrow(run, schema)


def decode(tokens: DataFrame, id_col="doc_id", ids_col="ids", text_col="text", model_file: str = DEFAULT_MODEL) -> DataFrame:
    """doc id and text."""
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file).packed())
    schema = T.StructType([tokens.schema[id_col], T.StructField(text_col, T.StringType())])

    def run(batches):
        e = Encoder(shared.value)
        for b in batches:
            lists = [x or [] for x in column(b, ids_col).to_pylist()]
            texts = e.decode(np.array([i for x in lists for i in x], np.int64), np.array([len(x) for x in lists], np.int64))
            yield pa.RecordBatch.from_arrays([column(b, id_col), pa.array([t.decode() for t in texts], pa.string())], schema.names)

    return bounded(tokens.select(id_col, ids_col)).mapInArrow(run, schema)
