"""Token-id output: best-fit-decreasing packing into fixed rows.

Each document becomes byte-level BPE ids (a public vocabulary file, a
parameter) and an end id. Documents longer than a row are split into whole rows
and a rest; nothing is cut off. Pieces are then packed longest first, each into
the open row with the least room that still holds it, found by a segment tree
over room sizes. Packing is local to what a task reads, ``BUFFER`` tokens (and
the rest of one document) at a time: no exchange at all, and only the last rows
of a buffer stay part empty. Which documents share a row, and the pack ids, then
follow the splits of the input, which a retried task sees again; ``stable``
deals documents by hash into groups of bounded size instead (one exchange), so
the packs are the same however the input is split.

A packed row holds its ids and positions (little-endian, padded with the end id
and zeros; uint16 where the vocabulary and the row fit, else uint32), cumulative
segment lengths, the places where positions restart, and for each segment the
document, its part and its first token there.

Long texts are encoded a piece at a time. They are cut only where a pre-token
ends anyway (one space or line break between two printable ASCII characters), so
ids are those of the whole; a run of at least ``BLANKS`` white-space characters
is encoded in pieces of that size, as the tokenizer's pattern cannot take runs
of any length. Decoding gives back every text either way.

Defined results: null and empty texts are an end id alone; every row of the
input has its segments, repeated rows too; a null doc_id stays null in the
lists; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklode.llm.common import bounded, column, partitions_for, text_slices

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-splitting pattern of the byte-level vocabulary (a fixed value of that public file).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of a row, the end id, and tokens that a task packs at once.
ROW, END, BUFFER = 2048, 50256, 1 << 22
#: Characters encoded at once, about, and white space of one run that is.
PIECE, BLANKS = 1 << 18, 1 << 16
#: Bytes of text in a group of stable packs.
GROUP_BYTES = 16 << 20
_SAFE = re.compile(r"[!-~](?: |\n)(?=[!-~])")
_LONG_BLANK = re.compile(r"(?<!\s)\s{%d,}" % BLANKS)
SCHEMA = T.StructType(
    [
        T.StructField("pack_id", T.LongType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("positions", T.BinaryType()),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
        T.StructField("resets", T.ArrayType(T.IntegerType())),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("parts", T.ArrayType(T.IntegerType())),
        T.StructField("starts", T.ArrayType(T.LongType())),
    ]
)


class RoomTree:
    """Segment tree over room sizes 0..row: how many open rows have just that room; finds the least room that fits."""

    def __init__(self, row: int):
        self.leaves = 1 << row.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(row + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the least room of at least ``need``, removed; None if no row has it."""
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i ^ 1]):
                i >>= 1
            if i <= 1:
                return None
            i ^= 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit(lengths: np.ndarray, row: int = ROW) -> list[list[int]]:
    """Rows of piece numbers, by best-fit decreasing (ties: input order)."""
    tree, rows = RoomTree(row), []
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            rows.append([i])
            tree.put(row - need, len(rows) - 1)
        else:
            room, r = found
            rows[r].append(i)
            tree.put(room - need, r)
    return rows


def split(sizes: list[int], row: int = ROW):
    """(document, part, start, length) pieces of documents of the given token counts."""
    for d, n in enumerate(sizes):
        for part, start in enumerate(range(0, n, row)):
            yield d, part, start, min(row, n - start)


def load_encoding(path: str = DEFAULT_RANKS) -> dict:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pieces_of(text: str, size: int = PIECE):
    """Pieces of ``text``, in order and whole, whose ids are those of the whole one after another."""
    if len(text) <= size:
        yield text
        return
    cuts, lo = [], 0
    for m in [*_LONG_BLANK.finditer(text), None]:
        hi = m.start() if m else len(text)
        while hi - lo > size and (safe := _SAFE.search(text, lo + size, hi)):
            lo = safe.start() + (1 if text[safe.start() + 1] == " " else 2)
            cuts.append(lo)
        if m:
            cuts += range(m.start(), m.end(), BLANKS)
            lo = m.end()
            cuts.append(lo)
    cuts = [0, *(c for c in cuts if 0 < c < len(text)), len(text)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield text[a:b]


def width(largest: int) -> np.dtype:
    return np.dtype("<u2" if largest < 1 << 16 else "<u4")


def pack_buffer(docs: list, tokens: list[np.ndarray], row: int = ROW, end: int = END, kind=np.dtype("<u2")):
    """Packed rows of one buffer, without their ids."""
    pieces = list(split([len(t) for t in tokens], row))
    for members in best_fit(np.array([p[3] for p in pieces], np.int64), row):
        ids, pos = np.full(row, end, kind), np.zeros(row, width(row - 1))
        cu = [0]
        for m in members:
            d, _, start, n = pieces[m]
            ids[cu[-1] : cu[-1] + n] = tokens[d][start : start + n]
            pos[cu[-1] : cu[-1] + n] = np.arange(n)
            cu.append(cu[-1] + n)
        yield cu[-1], ids.tobytes(), pos.tobytes(), cu, cu[:-1], [docs[pieces[m][0]] for m in members], [pieces[m][1] for m in members], [pieces[m][2] for m in members]


_TYPES = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))


def pack(docs: DataFrame, id_col="doc_id", text_col="text", row: int = ROW, end: int = END, buffer: int = BUFFER, ranks_file: str = DEFAULT_RANKS, stable: bool = False) -> DataFrame:
    """One row for each packed sequence."""
    ranks = load_encoding(ranks_file)
    kind = width(max(end, *ranks.values()))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary's size
    names = SCHEMA.names

    def encoded(batches):
        """(id, token ids with the end id) of each document."""
        import tiktoken

        enc = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        for b, _, _ in text_slices(batches, "t"):
            for i, t in zip(column(b, "i").to_pylist(), column(b, "t").to_pylist(), strict=True):
                yield i, np.concatenate([*(np.array(enc.encode_ordinary(p), kind) for p in pieces_of(t or "")), np.array([end], kind)])

    def packed(found, base):
        made = held = 0
        ids: list = []
        tokens: list[np.ndarray] = []

        def flush():
            nonlocal made
            rows = [(base + made + k, *r) for k, r in enumerate(pack_buffer(ids, tokens, row, end, kind))]
            made += len(rows)
            for lo in range(0, len(rows), 512):
                cols = zip(*rows[lo : lo + 512], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names)

        for i, x in found:
            ids.append(i)
            tokens.append(x)
            held += len(x)
            if held >= buffer:
                yield from flush()
                ids, tokens, held = [], [], 0
        if ids:
            yield from flush()

    base = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    if not stable:
        return bounded(base).mapInArrow(lambda batches: packed(encoded(batches), TaskContext.get().partitionId() << 40), SCHEMA)

    total = base.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    groups = partitions_for(total, GROUP_BYTES)
    dealt = base.withColumn("g", F.pmod(F.xxhash64(F.lit(3), "i", "t"), F.lit(groups)))

    def group(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(sorted(encoded(batches), key=lambda d: (d[0] is None, d[0] or 0, d[1].tobytes())), key[0].as_py() << 40)

    return bounded(dealt).groupBy("g").applyInArrow(group, SCHEMA)


def matrix(rows, row: int = ROW) -> np.ndarray:
    """The packed id matrix of collected rows."""
    return np.stack([np.frombuffer(r["ids"], _kind(r, row)) for r in rows]) if rows else np.zeros((0, row), "<u2")


def _kind(r, row: int) -> str:
    return f"<u{len(r['ids']) // row}"


def unpack(rows, row: int = ROW) -> dict:
    """Token ids (end id left out) of each document in collected rows."""
    parts: dict = {}
    for r in rows:
        ids, cu = np.frombuffer(r["ids"], _kind(r, row)), r["cu_seqlens"]
        for k, d in enumerate(r["doc_ids"]):
            parts.setdefault(d, []).append((r["parts"][k], ids[cu[k] : cu[k + 1]]))
    return {d: np.concatenate([x for _, x in sorted(p, key=lambda q: q[0])])[:-1] for d, p in parts.items()}
