"""Exact substring deduplication over documents with a sparse, distributed suffix array.

A byte goes when a ``LENGTH``-byte string that covers it also starts in a
document with a smaller doc_id. Sorting every suffix would move the corpus many
times over, so the suffix array is sparse: each ``LENGTH``-byte window names one
anchor, its leftmost position of least ``K``-byte hash, and equal windows name
equal anchors at equal distances. The steps:

1. Documents are dealt into groups of bounded size. Each group reports its
   anchors' hashes, packed, once each, to buckets that are ranges of the hash
   with equal shares of anchors (least hashes are small, so the ranges follow
   their known distribution); a hash found in two documents marks a candidate,
   and the marks return to the groups.
2. Candidate suffixes (the anchor and the windows around it that name it, equal
   ones of a group once, with their least doc_id and their occurrences) are
   range-partitioned by their leading tokens, twice eight bytes at the anchor,
   with splitters sampled in proportion to the buckets. Where sixteen bytes are
   so frequent that splitters coincide, their suffixes are cut into ``CLASSES``
   of neighbouring distances from the anchor and spread over those splitters'
   buckets by the 44 bytes that all windows of a class share.
3. Each bucket sorts the suffixes of all its windows by multikey quicksort with
   eight-byte words as keys (NumPy's quicksort for each word; a run of ties is
   refined by the next word, and only such runs are), compares neighbours, and
   takes the least doc_id of each equal run. It takes whole anchors, about
   ``CHUNK_WINDOWS`` at a time; a larger anchor goes by ranges of distances.
4. Removed runs go back to the groups, are united, and the rest is hashed.

Neighbours across a bucket's boundary need no comparison: equal windows have
equal leading tokens, distance and shared bytes, and these alone choose the
bucket, so no two suffixes with a common window lie on different sides.

A group and a bucket exchange one row, so their sizes grow together with the
square root of the input (to 16 times): the rows grow in proportion to it. A
third of all rows under one key stays harmless: copies in a group collapse
before the exchange to one suffix with a list of occurrences.

Defined results: null and empty texts keep nothing and lose nothing; texts
shorter than ``LENGTH`` are whole; rows with a null doc_id neither lose nor
remove bytes, and take part in no exchange; rows with the same doc_id do not
remove from each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklode.llm.common import SLICE_BYTES, bounded, column, materialize, mix64, pack_sorted, pack_u64, ranges, text_slices, unpack_sorted, unpack_u64

LENGTH, K = 50, 16
#: Bytes of text in a group (up to SCALE_BYTES of input), and windows that a bucket sorts at once.
GROUP_BYTES, SCALE_BYTES = 8 << 20, 1 << 30
CHUNK_WINDOWS = 1 << 20
_W = LENGTH - K + 1
#: Classes of distances from the anchor, and the bytes that all windows of a class share.
CLASSES = 5
_CLASS = -(-_W // CLASSES)
_SHARED = LENGTH - _CLASS + 1
_POS_BITS = 24
_WORDS = -(-LENGTH // 8)


def _words_at(data: np.ndarray, n: int) -> np.ndarray:
    """Little-endian 8-byte word at each of n positions (data padded by 8)."""
    return np.ndarray((n,), "<u8", data, 0, (1,)).copy()


def anchors(data: np.ndarray, offs: np.ndarray):
    """Runs of window starts with the same anchor: (document, first start, last start, anchor), and the anchors' hashes.

    Positions are in the slice; windows never cross documents.
    """
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return empty, empty, empty, empty, empty.astype(np.uint64)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    v = _words_at(padded, n)
    h = mix64(v[: n - K + 1] * np.uint64(0x9E3779B97F4A7C15) + mix64(v[8 : n - K + 9]))
    runs = []
    step = (1 << _POS_BITS) - 2 * LENGTH
    for lo in range(0, n - LENGTH + 1, step):  # positions of one pass fit beside 40 bits of hash
        hi = min(n - LENGTH + 1, lo + step)
        c = (h[lo : hi + _W - 1] >> np.uint64(_POS_BITS) << np.uint64(_POS_BITS)) | np.arange(hi + _W - 1 - lo, dtype=np.uint64)
        size = 1
        while 2 * size <= _W:
            c = np.minimum(c[:-size], c[size:])
            size *= 2
        c = np.minimum(c[: hi - lo], c[_W - size :][: hi - lo])
        runs.append((c & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64) + lo)
    at = np.concatenate(runs)
    doc_last = np.repeat(offs[1:], np.diff(offs))[: len(at)] - LENGTH  # the last start in each start's document
    start = np.arange(len(at))
    valid = start <= doc_last
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1] | (doc_last[1:] != doc_last[:-1])
    first = np.flatnonzero(new)
    end = valid.copy()
    end[:-1] &= new[1:] | ~valid[1:]
    last = np.flatnonzero(end)
    doc = np.searchsorted(offs, first, "right") - 1
    return doc, first, last, at[first], h[at[first]]


def _grouped(base: DataFrame):
    """Documents dealt by hash into groups, with their numbers of partitions, of groups, and of hash buckets."""
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = GROUP_BYTES * min(16.0, max(1.0, math.sqrt(total / SCALE_BYTES)))
    groups = max(1, math.ceil(total / size))
    parts = max(1, -(-groups // 2), min(groups, int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    g = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(groups)).cast("int")
    return base.withColumn("g", g).repartition(parts, "g"), groups, -(-groups // 8), total


def _hash_splitters(buckets: int) -> np.ndarray:
    """Hash values between which lie equal shares of anchors, the positions of a least hash in some window of _W."""
    x = np.linspace(0, 1, 1 << 16)
    q = 1 - x
    share = 1 - ((_W + 1) * q**_W - (_W - 1) * q ** (_W + 1)) / 2
    at = np.interp(np.arange(1, buckets) / buckets, share, x)
    return (at * 2.0**63).astype(np.uint64) << np.uint64(1)


def _sorted_docs(t: pa.Table):
    """The rows of a group in a fixed order (doc_id, then bytes), whatever order they arrived in."""
    ids = t.column("doc_id").to_pylist()
    texts = t.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]


def _slices(texts: list[bytes]):
    """(first document, bytes, offsets) of consecutive documents, SLICE_BYTES at most or one document."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= SLICE_BYTES):
            size += len(texts[hi])
            hi += 1
        yield lo, np.frombuffer(b"".join(texts[lo:hi]), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts[lo:hi]], dtype=np.int64)]
        lo = hi


def _in_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def multikey_quicksort(words: np.ndarray):
    """Order of rows of big-endian words, and for each place whether it starts a new string.

    Quicksort by the first word; a run of ties is refined by the next word, and
    only such runs are.
    """
    n = len(words)
    order = np.argsort(words[:, 0], kind="quicksort")
    new = np.ones(n, bool)
    new[1:] = words[order[1:], 0] != words[order[:-1], 0]
    for d in range(1, words.shape[1]):
        run = np.cumsum(new) - 1
        open_ = np.flatnonzero(np.bincount(run, minlength=n)[run] > 1)
        if not len(open_):
            break
        rows = order[open_]
        key = words[rows, d]
        o = np.lexsort((key, run[open_]))
        order[open_] = rows[o]
        r, key = run[open_], key[o]
        new[open_[1:]] |= (key[1:] != key[:-1]) | (r[1:] != r[:-1])
    return order, new


def _resolve(entries):
    """Least doc_id of every window of every suffix of a bucket.

    entries: (bytes of the windows, least doc_id). Yields (entry, first window, last window, least doc_id) runs.
    """
    sizes = np.array([len(e[0]) for e in entries], np.int64)
    data = np.frombuffer(b"".join(e[0] for e in entries) + b"\0" * 8, np.uint8)
    offs = np.cumsum(sizes) - sizes
    counts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(entries)), counts)
    start = ranges(offs, counts)
    words = np.empty((len(start), _WORDS), np.uint64)
    v = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))
    for d in range(_WORDS):
        at = min(8 * d, LENGTH - 8)  # the last word overlaps the one before
        words[:, d] = v[start + at]
    order, new = multikey_quicksort(words)
    least = np.array([e[1] for e in entries], np.int64)[owner]
    heads = np.flatnonzero(new)
    low = np.minimum.reduceat(least[order], heads)
    size = np.diff(np.r_[heads, len(order)])
    result = np.empty(len(order), np.int64)
    result[order] = np.repeat(low, size)
    cut = np.ones(len(order), bool)
    cut[1:] = (owner[1:] != owner[:-1]) | (result[1:] != result[:-1])
    a = np.flatnonzero(cut)
    b = np.r_[a[1:], len(order)] - 1
    base = np.cumsum(counts) - counts
    return owner[a], a - base[owner[a]], b - base[owner[a]], result[a]


def _of_distances(head: int, windows: int, lo: int, hi: int) -> tuple[int, int]:
    """First and last window of an entry whose anchor lies ``lo`` to ``hi`` bytes in; none if first > last."""
    return max(0, head - hi), min(windows - 1, head - lo)


def _in_chunks(entries):
    """Resolve (anchor, bytes, least doc_id, head) entries, sorted by anchor, about CHUNK_WINDOWS at a time."""
    lo = 0
    while lo < len(entries):
        hi, windows = lo, 0
        while hi < len(entries) and (windows < CHUNK_WINDOWS or entries[hi][0] == entries[hi - 1][0]):
            windows += len(entries[hi][1]) - LENGTH + 1
            hi += 1
        wide = max(1, _W * CHUNK_WINDOWS // windows)
        if windows < 2 * CHUNK_WINDOWS or entries[lo][0] != entries[hi - 1][0]:
            wide = _W
        if wide == _W:
            owner, first, last, least = _resolve([e[1:3] for e in entries[lo:hi]])
            yield owner + lo, first, last, least
            lo = hi
            continue
        for near in range(0, _W, wide):  # windows at different distances from the anchor are never equal
            part, owners, starts = [], [], []
            for i in range(lo, hi):
                _, s, least, head = entries[i]
                a, b = _of_distances(head, len(s) - LENGTH + 1, near, near + wide - 1)
                if a <= b:
                    part.append((s[a : b + LENGTH], least))
                    owners.append(i)
                    starts.append(a)
            if part:
                owner, first, last, least = _resolve(part)
                shift = np.array(starts, np.int64)[owner]
                yield np.array(owners, np.int64)[owner], first + shift, last + shift, least
        lo = hi


def _sample_splitters(base: DataFrame, buckets: int, total: int, seed: int = 1):
    """Quantiles of (leading token, next token) over the anchors of a hashed fiftieth of the documents: about buckets - 1 pairs.

    The sample, some 400 anchors a bucket, only balances; it is sorted by range
    partitions, and only the quantiles come to the driver.
    """
    if buckets < 2:
        return []
    thin = np.uint64((1 << max(0, int(math.log2(total / 18 / 50 / (400 * buckets) + 1)))) - 1)

    def run(batches):
        for b, data, offs in text_slices(batches, "text"):
            _, _, _, at, h = anchors(data, offs)
            at = at[(h & thin) == 0]
            padded = np.r_[data, np.zeros(16, np.uint8)]
            v = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,))
            # signed order of the flipped word is the byte order
            yield pa.RecordBatch.from_arrays([pa.array((v[at + s].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)) for s in (0, 8)], ["a", "b"])

    sample = base.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(50)) == 0).select("text")
    tokens = materialize(bounded(sample).mapInArrow(run, "a long, b long"))
    parts = max(1, min(buckets, int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranked = materialize(tokens.repartitionByRange(parts, "a", "b").sortWithinPartitions("a", "b").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = sorted((r.p, r["count"]) for r in ranked.groupBy(part.alias("p")).count().collect())
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    step = max(1, before[-1] // buckets)
    starts = base.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "p long, before long")  # a row for each partition
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    found = ranked.withColumn("p", part).join(F.broadcast(starts), "p").where(((rank + 1) % step == 0) & (rank + 1 < before[-1]))
    return sorted((r.a, r.b) for r in found.select("a", "b").collect())


def dedup_spans(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges, flat) of each row."""
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    base = every.where("doc_id is not null")
    grouped, groups, buckets, total = _grouped(base)
    ends = _hash_splitters(buckets)

    def report(batches):
        held: dict[int, list] = {}
        for b, data, offs in text_slices(batches, "text"):
            gs = np.array(column(b, "g").to_pylist())
            doc, _, _, _, h = anchors(data, offs)
            o = np.lexsort((doc, h))
            h, doc = h[o], doc[o]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            # twice: in two documents of this slice
            heads = np.flatnonzero(first)
            many = np.maximum.reduceat(doc, heads) != np.minimum.reduceat(doc, heads) if len(heads) else heads.astype(bool)
            for g in np.unique(gs[doc]):
                own = np.zeros(len(heads), bool)
                own[np.unique(np.cumsum(first)[gs[doc] == g] - 1)] = True
                held.setdefault(int(g), []).append((h[heads[own]], many[own]))
        for g, found in held.items():
            x = np.concatenate([a for a, _ in found])
            m = np.concatenate([a for _, a in found])
            o = np.argsort(x, kind="stable")
            x, m = x[o], m[o]
            heads = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
            if not len(heads):
                continue
            twice = (np.diff(np.r_[heads, len(x)]) > 1) | np.logical_or.reduceat(m, heads)
            x = x[heads]
            cut = np.r_[0, np.searchsorted(x, ends), len(x)]
            rows = [(k, cut[k], cut[k + 1]) for k in range(buckets) if cut[k] < cut[k + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _, _ in rows], pa.int32()), pa.array([g] * len(rows), pa.int32()), pa.array([pack_sorted(x[a:b]) for _, a, b in rows], pa.binary()), pa.array([np.packbits(twice[a:b]).tobytes() for _, a, b in rows], pa.binary())],
                ["bucket", "g", "hashes", "twice"],
            )

    def repeated(key, t):
        gs = t.column("g").to_pylist()
        lists = [unpack_sorted(x) for x in t.column("hashes").to_pylist()]
        flags = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(v)].astype(bool) for x, v in zip(t.column("twice").to_pylist(), lists, strict=True)]
        x = np.sort(np.concatenate(lists))
        again = np.unique(np.concatenate([x[1:][x[1:] == x[:-1]], *(v[f] for v, f in zip(lists, flags, strict=True))]))
        out = [(g, pack_sorted(v[keep])) for g, v in zip(gs, lists, strict=True) if (keep := _in_sorted(v, again)).any()]
        return pa.table({"g": pa.array([g for g, _ in out], pa.int32()), "hashes": pa.array([b for _, b in out], pa.binary())})

    marks = bounded(grouped).mapInArrow(report, "bucket int, g int, hashes binary, twice binary").groupBy("bucket").applyInArrow(repeated, "g int, hashes binary")
    splitters = _sample_splitters(base, groups, total)
    split_a = (np.array([a for a, _ in splitters], np.int64)).view(np.uint64) ^ np.uint64(1 << 63)
    split_b = (np.array([b for _, b in splitters], np.int64)).view(np.uint64) ^ np.uint64(1 << 63)

    def buckets_of(a, b):
        """First and last bucket of each pair of tokens: more than one for pairs that several splitters share."""
        lo, hi = np.searchsorted(split_a, a, "left"), np.searchsorted(split_a, a, "right")
        for i in np.flatnonzero(hi - lo > 1):  # a token that several splitters share: by the next token
            own = split_b[lo[i] : hi[i]]
            x, y = lo[i] + np.searchsorted(own, b[i], "left"), lo[i] + np.searchsorted(own, b[i], "right")
            lo[i], hi[i] = (x + 1 if y > x + 1 else y), y
        return np.where(hi > lo + 1, lo, hi), hi

    def candidates(key, left, right):
        """The group's distinct candidate suffixes, packed a bucket a row."""
        schema = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("sizes", pa.binary()), ("heads", pa.binary()), ("bytes", pa.binary()), ("least", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary())])
        hashes = [unpack_sorted(x) for x in right.column("hashes").to_pylist()]
        if not hashes or not left.num_rows:
            return schema.empty_table()
        table = np.sort(np.concatenate(hashes))
        ids, texts = _sorted_docs(left)
        found: dict[tuple[int, bytes], list] = {}
        for lo, data, offs in _slices(texts):
            doc, first, last, at, h = anchors(data, offs)
            keep = np.flatnonzero(_in_sorted(h, table))
            raw = data.tobytes()
            local = first - offs[doc]
            for d, a, b, p, s in zip((doc[keep] + lo).tolist(), first[keep].tolist(), last[keep].tolist(), at[keep].tolist(), local[keep].tolist(), strict=True):
                found.setdefault((p - a, raw[a : b + LENGTH]), []).append((d, s))
        if not found:
            return schema.empty_table()
        items = list(found.items())
        padded = [s[p : p + 16] for (p, s), _ in items]
        tokens = np.frombuffer(b"".join(padded), ">u8").astype(np.uint64).reshape(-1, 2)
        low, high = buckets_of(tokens[:, 0], tokens[:, 1])
        divided: dict[int, dict] = {}
        for i in np.flatnonzero(low != high).tolist():
            (p, s), occ = items[i]
            a, b = int(low[i]), int(high[i])
            for near in range(0, _W, _CLASS):
                first, last = _of_distances(p, len(s) - LENGTH + 1, near, near + _CLASS - 1)
                if first <= last:
                    k = a + zlib.crc32(s[p - near : p - near + _SHARED]) % (b - a + 1)
                    divided.setdefault(k, {}).setdefault((p - first, s[first : last + LENGTH]), []).extend((d, x + first) for d, x in occ)
        rows = []
        order = np.argsort(low, kind="stable")
        order = order[low[order] == high[order]]
        cuts = np.searchsorted(low[order], np.arange(len(split_a) + 2))
        for k in range(len(split_a) + 1):
            own = [items[i] for i in order[cuts[k] : cuts[k + 1]].tolist()] + list(divided.get(k, {}).items())
            if not own:
                continue
            occ = [o for _, os in own for o in os]
            z = lambda x: pack_u64(np.array(x, np.int64).view(np.uint64))
            rows.append((k, key[0].as_py(), z([len(s) for (_, s), _ in own]), z([p for (p, _), _ in own]), zlib.compress(b"".join(s for (_, s), _ in own), 1), z([ids[min(os)[0]] for _, os in own]), z([len(os) for _, os in own]), z([d for d, _ in occ]), z([s for _, s in occ])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def resolve(key, t):
        """Removed runs of bytes for each group: an occurrence goes where the least doc_id is another, smaller one."""
        rows = t.select(["g", "sizes", "heads", "bytes", "least", "counts", "docs", "starts"]).to_pylist()
        best: dict[bytes, list] = {}
        parts_ = []
        for r in rows:
            sizes, least, heads = (unpack_u64(r[c]).view(np.int64) for c in ("sizes", "least", "heads"))
            raw = zlib.decompress(r["bytes"])
            ends = np.cumsum(sizes)
            strings = [raw[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            parts_.append((r, strings, unpack_u64(r["counts"]).astype(np.int64)))
            for s, d, p in zip(strings, least.tolist(), heads.tolist(), strict=True):
                e = best.setdefault(s, [d, p])
                e[0] = min(e[0], d)
        entries = sorted(((s[p : p + K], s, d, p) for s, (d, p) in best.items()), key=lambda e: e[0])
        number = {e[1]: i for i, e in enumerate(entries)}
        owner, lo, hi, least = (np.concatenate(c) for c in zip(*_in_chunks(entries), strict=True))
        order = np.lexsort((lo, owner))
        owner, lo, hi, least = owner[order], lo[order], hi[order], least[order]
        cut = np.searchsorted(owner, np.arange(len(entries) + 1))
        out = []
        for r, strings, counts in parts_:
            docs_, starts = unpack_u64(r["docs"]).astype(np.int64), unpack_u64(r["starts"]).astype(np.int64)
            e = np.repeat(np.array([number[s] for s in strings], np.int64), counts)
            runs = cut[e + 1] - cut[e]
            at = ranges(cut[e], runs)
            which = np.repeat(np.arange(len(e)), runs)
            out.append((r["g"], pack_u64(docs_[which].view(np.uint64)), pack_u64((starts[which] + lo[at]).view(np.uint64)), pack_u64((hi[at] - lo[at] + LENGTH).view(np.uint64)), pack_u64(least[at].view(np.uint64))))
        return pa.table({"g": pa.array([o[0] for o in out], pa.int32()), **{n: pa.array([o[i] for o in out], pa.binary()) for i, n in ((1, "docs"), (2, "starts"), (3, "lengths"), (4, "least"))}})

    def finish(key, left, right):
        ids, texts = _sorted_docs(left)
        d, s, n, low = (np.concatenate([unpack_u64(x).view(np.int64) for x in right.column(c).to_pylist()] or [np.zeros(0, np.int64)]) for c in ("docs", "starts", "lengths", "least"))
        own = np.array(ids, np.int64)
        go = low < own[d]
        d, s, n = d[go], s[go], n[go]
        o = np.lexsort((s, d))
        d, s, e = d[o], s[o], s[o] + n[o]
        cut = np.searchsorted(d, np.arange(len(ids) + 1))
        out = []
        for i, t in enumerate(texts):
            a, b = s[cut[i] : cut[i + 1]], e[cut[i] : cut[i + 1]]
            spans: list[int] = []
            if len(a):
                far = np.maximum.accumulate(b)
                new = np.flatnonzero(np.r_[True, a[1:] > far[:-1]])
                spans = np.stack([a[new], far[np.r_[new[1:], len(a)] - 1]], 1).reshape(-1).tolist()
            kept, done = [], 0
            for x, y in zip(spans[::2], spans[1::2], strict=True):
                kept.append(t[done:x])
                done = y
            kept.append(t[done:])
            left_bytes = sum(map(len, kept))
            out.append((ids[i], len(t), len(t) - left_bytes, len(spans) // 2, hashlib.sha256(b"".join(kept)).hexdigest(), spans))
        return pa.Table.from_arrays([pa.array(c, f) for c, f in zip(zip(*out, strict=True), _FINISHED.values(), strict=True)], list(_FINISHED)) if out else pa.schema(list(_FINISHED.items())).empty_table()

    packed = grouped.groupBy("g").cogroup(marks.groupBy("g")).applyInArrow(candidates, "bucket int, g int, sizes binary, heads binary, bytes binary, least binary, counts binary, docs binary, starts binary")
    removed = packed.groupBy("bucket").applyInArrow(resolve, "g int, docs binary, starts binary, lengths binary, least binary")
    out = grouped.groupBy("g").cogroup(removed.groupBy("g")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    whole = every.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.sha2("text", 256), F.lit(None).cast("array<long>"))
    return out.union(whole.toDF(*out.columns)).withColumn("spans", F.coalesce("spans", F.array().cast("array<long>"))).withColumnRenamed("doc_id", id_col)


_FINISHED = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.int64())}

