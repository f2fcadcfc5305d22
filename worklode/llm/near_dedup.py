"""Near-duplicate documents by SetSketch registers, banding, and full-set verification.

A document's set is its distinct 5-word shingles as 64-bit hashes. A SetSketch
keeps, for each of ``REGISTERS`` hash functions, the largest exponentially
spaced level of the element minima (mergeable by maximum); equal registers are
the more frequent the more similar two sets are. Equal sets collapse first to
their least doc_id. The rest meet in buckets of ``ROWS`` equal registers in one
of ``BANDS`` bands (a pair at the threshold meets in none with probability under
3e-8 at 85 percent and about 3e-6 at 80). In a bucket, pairs are estimated by the joint likelihood of the register
comparison, those within reach of the threshold are verified on the full sets
(48-bit hashes), and the links come out as stars, never as all pairs.

Buckets with equal members count once. A bucket of more than ``BLOCK`` members is
dealt over blocks that share its least member; what is then still outside the
bucket's largest component is a query set against all its members, in blocks.
So memory is bounded by blocks, and no member or link is given up.

Defined results: a text of fewer than five words is one shingle of its whole
sequence; null, empty and blank texts have the empty set and link with nothing,
not with each other; rows with a null doc_id are their own (null component,
kept); repeated rows share id and component; unrelated texts under one doc_id are
linked and kept each by itself; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklode.llm.common import bounded, column, materialize, mix64, text_slices
from worklode.llm.components import components

SHINGLE = 5
REGISTERS, ROWS, BANDS = 96, 4, 24
#: Spacing of the register levels, and the highest level.
BASE, LEVELS = 1.02, 2400
#: Members of a bucket that one task compares at once.
BLOCK = 256
#: Bits of the filter that keeps sets without a candidate partner out of the exchange: 16 MB at most.
FILTER_BITS = 27
#: A pair whose estimate is this many standard errors below the threshold is not verified.
MARGIN = 6.1
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_seeds = mix64(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * _P)
_XOR, _ODD = _seeds[:REGISTERS], _seeds[REGISTERS:] | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int):
    if len(_powers[0]) < n:
        for k, p in enumerate((_P, _P_INVERSE)):
            x = np.full(n, p, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray, offs: np.ndarray):
    """64-bit hash and document of every word of a slice (words never cross documents)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLD[data].astype(np.uint64) + np.uint64(1)) * up, out=s[1:])
    h = mix64((s[end] - s[start]) * down[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(offs, start, "right") - 1


def shingles(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE):
    """(shingle hashes sorted within each document and distinct, their counts per document)."""
    n_docs = len(offs) - 1
    w, doc = word_hashes(data, offs)
    n_words = np.bincount(doc, minlength=n_docs)
    m = max(0, len(w) - k + 1)
    h = np.zeros(m, np.uint64)
    for i in range(k):
        h = h * _P + w[i : i + m]
    ok = doc[:m] == doc[k - 1 :][:m] if m else np.zeros(0, bool)
    hashes, owner = [mix64(h[ok])], [doc[:m][ok]]
    first = np.cumsum(n_words) - n_words
    for size in range(1, k):
        own = np.flatnonzero(n_words == size)
        if len(own):
            h = np.full(len(own), size, np.uint64)
            for i in range(size):
                h = h * _P + w[first[own] + i]
            hashes.append(mix64(h ^ np.uint64(0xABCDEF)))
            owner.append(own)
    h, d = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.bincount(d, minlength=n_docs)


def sketch(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SetSketch registers (documents with a shingle, REGISTERS), uint16."""
    counts = counts[counts > 0]
    at = np.cumsum(counts) - counts
    out = np.zeros((len(counts), REGISTERS), np.uint16)
    if not len(counts):
        return out
    for i in range(REGISTERS):
        least = np.minimum.reduceat((h ^ _XOR[i]) * _ODD[i], at)
        x = -np.log1p(-(least.astype(np.float64) + 1) / 2**64 * (1 - 1e-12))
        out[:, i] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LEVELS)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def likelihood_estimate(above: np.ndarray, below: np.ndarray, n1: float, n2: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from the numbers of larger and smaller registers and the set sizes."""
    n2 = np.asarray(n2, float)
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    grid = np.linspace(0, 1, 101)[:, None] * np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * grid), p(v - u * grid)
    tie = np.maximum(1 - up - down, 1e-12)
    ll = above * np.log(np.maximum(up, 1e-12)) + below * np.log(np.maximum(down, 1e-12)) + (REGISTERS - above - below) * np.log(tie)
    return np.take_along_axis(grid, ll.argmax(0)[None], 0)[0]


def band_keys(regs: np.ndarray) -> np.ndarray:
    x = regs.astype(np.uint64).reshape(len(regs), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _P, x.shape[:2])
    for r in range(ROWS):
        h = mix64(h * _P + x[:, :, r] + np.uint64(1))
    return h.view(np.int64)


def _set_bytes(h: np.ndarray, counts: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray((h >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    offs = np.r_[0, np.cumsum(counts) * 6]
    if offs[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
    return pa.array([raw[a:b].tobytes() for a, b in zip(offs[:-1] // 6, offs[1:] // 6, strict=True)], pa.binary())


def _get_set(blob: bytes) -> np.ndarray:
    x = np.zeros((len(blob) // 6, 8), np.uint8)
    x[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return x.view("<u8").reshape(-1)


_SKETCHED = "doc_id long, n long, s1 long, s2 long, bands array<long>, regs binary, elements binary, h long"


def sketch_table(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    def run(batches):
        for b, data, offs in text_slices(batches, "t"):
            h, counts = shingles(data, offs)
            has = counts > 0
            regs = sketch(h, counts)
            at = np.cumsum(counts[has]) - counts[has]
            sums = np.zeros((2, len(counts)), np.uint64)
            if len(h):
                sums[0, has] = np.add.reduceat(mix64(h), at)
                sums[1, has] = np.bitwise_xor.reduceat(mix64(h * _P + np.uint64(7)), at)
            keys = np.zeros((len(counts), BANDS), np.int64)
            keys[has] = band_keys(regs)
            full = np.zeros((len(counts), REGISTERS), np.uint16)
            full[has] = regs
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), pa.array(counts, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.reshape(-1))), pa.array([r.tobytes() for r in full], pa.binary()), _set_bytes(h, counts), column(b, "h")],
                ["doc_id", "n", "s1", "s2", "bands", "regs", "elements", "h"],
            )

    return bounded(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))).mapInArrow(run, _SKETCHED)


class Bucket:
    """Members of one block, with what verification needs."""

    def __init__(self, ids, sets, regs, query):
        self.ids, self.n = ids, len(ids)
        self.size = np.array([len(s) for s in sets], np.int64)
        self.regs = np.array(regs)
        self.query = query  # positions compared with all, or None for every pair
        flat = np.concatenate(sets)
        _, inverse = np.unique(flat, return_inverse=True)
        # shared elements alone can meet: one bit for each of them
        shared = np.bincount(inverse)[inverse] > 1
        number = np.unique(inverse[shared], return_inverse=True)[1]
        width = int(number.max()) // 64 + 1 if len(number) else 1
        owner = np.repeat(np.arange(self.n), self.size)[shared]
        self.bits = np.zeros((self.n, width), np.uint64)
        np.bitwise_or.at(self.bits, (owner, number >> 6), np.uint64(1) << (number & 63).astype(np.uint64))

    def links(self, percent: int):
        """(member, least member of its linked group) stars over exact similarities."""
        root = np.arange(self.n)

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        group = np.arange(self.n)  # flat labels, for whole-array tests
        cut = percent / 100 - MARGIN * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5
        for i in range(self.n) if self.query is None else self.query:
            other = np.flatnonzero(group != group[i])
            if self.query is None:
                other = other[other > i]
            small, big = np.minimum(self.size[other], self.size[i]), np.maximum(self.size[other], self.size[i])
            other = other[100 * small >= percent * big]
            if not len(other):
                continue
            if len(other) > 4:
                above, below = (self.regs[i] > self.regs[other]).sum(1), (self.regs[i] < self.regs[other]).sum(1)
                other = other[likelihood_estimate(above, below, self.size[i], self.size[other]) >= cut]
            common = np.bitwise_count(self.bits[other] & self.bits[i]).sum(1, dtype=np.int64)
            hit = other[100 * common >= percent * (self.size[other] + self.size[i] - common)]
            if len(hit):
                labels = np.unique(np.r_[group[hit], group[i]])
                for x in labels[1:]:
                    root[find(int(x))] = find(int(labels[0]))
                group[np.isin(group, labels)] = labels[0]
        for g in np.unique(group):
            own = np.flatnonzero(group == g)
            if len(own) > 1:
                least = min(self.ids[k] for k in own)
                yield from ((self.ids[k], least) for k in own if self.ids[k] != least)


class Filter:
    """A Bloom filter of ids: of at most 2 ** FILTER_BITS bits, so its broadcast is bounded; fuller ones only pass more."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _places(ids: np.ndarray, size: int):
        h = ids.astype(np.int64).view(np.uint64)
        for k in range(4):
            yield (mix64(h + np.uint64(k * int(_P) % 2**64)) & np.uint64(size - 1)).astype(np.int64)

    @staticmethod
    def of(ids: DataFrame, count: int) -> Filter:
        size = 1 << min(FILTER_BITS, max(16, (16 * count).bit_length()))
        page = min(size // 8, 1 << 15)

        def mark(batches):
            bits = np.zeros(size, bool)
            for b in batches:
                for at in Filter._places(np.array(b.column(0)), size):
                    bits[at] = True
            packed = np.packbits(bits)
            pages = [(k, packed[k * page : (k + 1) * page]) for k in range(size // 8 // page)]
            pages = [(k, p.tobytes()) for k, p in pages if p.any()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pages], pa.int32()), pa.array([p for _, p in pages], pa.binary())], ["page", "bits"])

        def unite(key, t):
            rows = [np.frombuffer(x, np.uint8) for x in t.column("bits").to_pylist()]
            return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.bitwise_or.reduce(rows).tobytes()], pa.binary())})

        out = np.zeros(size // 8, np.uint8)
        for r in bounded(ids).mapInArrow(mark, "page int, bits binary").groupBy("page").applyInArrow(unite, "page int, bits binary").toLocalIterator():
            out[r.page * page : (r.page + 1) * page] = np.frombuffer(bytes(r.bits), np.uint8)
        return Filter(out)

    def may_have(self, ids: np.ndarray) -> np.ndarray:
        ok = np.ones(len(ids), bool)
        for at in self._places(ids, len(self.bits) * 8):
            ok &= (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return ok


def _linked(rows: DataFrame, table: DataFrame, percent: int, parts: int) -> DataFrame:
    """Verified links of the nodes of (key, block, rep, s1, s2, node, query) rows; only a block's members are held at once."""
    wanted = rows.select("rep").distinct()
    shared = rows.sparkSession.sparkContext.broadcast(Filter.of(wanted, wanted.count()))

    def needed(batches):
        for b in batches:
            ids = b.column(0)
            keep = np.zeros(len(ids), bool)
            own = np.flatnonzero(np.array(ids.is_valid()))
            keep[own] = shared.value.may_have(np.array(ids.drop_null()))
            yield b.filter(pa.array(keep))

    sets = table.select(F.col("doc_id").alias("rep"), "s1", "s2", "regs", "elements")
    full = rows.join(bounded(sets).mapInArrow(needed, sets.schema), ["rep", "s1", "s2"])
    full = full.select("key", "block", "node", "query", "regs", "elements").repartition(parts, "key", "block").sortWithinPartitions("key", "block")

    def run(batches):
        held, name = [], None

        def flush():
            seen = {}
            for node, q, regs, elements in held:
                seen[node] = (q or seen.get(node, (False,))[0], regs, elements)
            if len(seen) < 2:
                return []
            ids = sorted(seen)
            query = [k for k, i in enumerate(ids) if seen[i][0]]
            b = Bucket(ids, [_get_set(seen[i][2]) for i in ids], [np.frombuffer(seen[i][1], np.uint16) for i in ids], query or None)
            return list(b.links(percent))

        for batch in batches:
            out = []
            for key, block, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, block) != name:
                    out += flush() if held else []
                    held, name = [], (key, block)
                held.append(rest)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])
        out = flush() if held else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return bounded(full).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", percent: int = 85, block: int = BLOCK, text_hash: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row, with its xxhash64 as ``text_hash`` if named; links are 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = materialize(sketch_table(docs, id_col, text_col), "uncompressed")
    linkable = table.where("doc_id is not null and n > 0")
    reps = linkable.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "h")).alias("least"), F.first("bands").alias("bands"))
    reps = materialize(reps.select("s1", "s2", "n", F.col("least.doc_id").alias("rep"), F.col("least.h").alias("rep_h"), "bands", F.col("least.doc_id").alias("node")))
    shares = not reps.groupBy("rep").count().where("count > 1").isEmpty()
    if shares:  # different sets with one least doc_id: number the sets in the order of their ids
        reps = reps.drop("node").repartitionByRange("rep", "s1", "s2", "n").sortWithinPartitions("rep", "s1", "s2", "n")
        reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()))
    entries = reps.select("rep", "s1", "s2", "node", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum((F.xxhash64("node") / 4096).cast("long")).alias("p"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("q"), F.min("node").alias("least")).where("m > 1")
    once = buckets.groupBy("m", "p", "q").agg(F.min("key").alias("key"), F.min("least").alias("least"))
    members = entries.join(once.select("key", "m", "least"), "key")
    blocks = F.ceil(F.col("m") / block).cast("int")
    members = materialize(members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    first = members.select("key", "block", "rep", "s1", "s2", "node")
    hot = members.where("blocks > 1")
    shared = hot.where("node = least").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", "s1", "s2", "node")
    links = materialize(_linked(first.union(shared).withColumn("query", F.lit(False)), table, percent, parts))
    if not hot.isEmpty():
        links = materialize(links.union(_rest(hot, components(links), table, percent, block, parts)))
    found = components(links)
    named = reps.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    if shares:
        named = named.join(reps.select(F.col("node").alias("component"), F.col("rep").alias("component_id")), "component")
    else:
        named = named.withColumn("component_id", F.col("component"))
    named = named.select("s1", "s2", "n", "component_id", "rep_h", (F.col("node") == F.col("component")).alias("least"))
    rows = table.select("doc_id", "n", "h", *(F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col(c)).alias(c) for c in ("s1", "s2")))
    out = rows.join(named, ["s1", "s2", "n"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = (F.col("doc_id") == F.col("component_id")) & F.col("least") & (F.col("h") == F.col("rep_h"))
    hashed = [F.col("h").alias(text_hash)] if text_hash else []
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(kept, F.lit(True)).alias("kept"), *hashed)


def _rest(hot: DataFrame, found: DataFrame, table: DataFrame, percent: int, block: int, parts: int) -> DataFrame:
    """Links of large buckets across blocks: members outside the bucket's largest component against all its members."""
    named = hot.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("c", F.coalesce("component", "node"))
    sizes = named.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("key").agg(F.max(F.struct("k", "c")).getField("c").alias("main"), (F.sum("k") - F.max("k")).alias("outside")).where("outside > 0")
    named = materialize(named.join(main, "key").withColumn("sets", F.ceil(F.col("outside") / block).cast("int")))
    minor = named.where("c <> main").withColumn("set", F.pmod(F.xxhash64("node", F.lit(3)), F.col("sets")).cast("int"))
    across = F.sequence(F.lit(0), F.col("blocks") - 1)
    queries = minor.select("key", F.explode(across).alias("block"), "set", "blocks", "rep", "s1", "s2", "node").withColumn("query", F.lit(True))
    against = named.select("key", "block", F.explode(F.sequence(F.lit(0), F.col("sets") - 1)).alias("set"), "blocks", "rep", "s1", "s2", "node").withColumn("query", F.lit(False))
    both = queries.union(against).withColumn("block", F.col("set") * F.col("blocks") + F.col("block"))
    return _linked(both.select("key", "block", "rep", "s1", "s2", "node", "query"), table, percent, parts)
