"""All-pairs steps in blocks: rows of bounded tables meet in an Arrow task each, and only results leave it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklode import schemas as S

_F32 = 6e-8
#: Sides of the piece of a block that is compared at once.
_SETS, _ASKED = 512, 256


def block_of(column: str, parts) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts) if isinstance(parts, int) else parts).cast("int")


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    a = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    off = a.offsets.to_numpy()
    return a.values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False), (off - off[0]).astype(np.int64)


def _ranks(column) -> np.ndarray:
    """Places in sorted order, equal ones alike; -1 for null."""
    d = column.combine_chunks().dictionary_encode()
    d = pa.chunked_array([d]).combine_chunks() if not isinstance(d, pa.ChunkedArray) else d.unify_dictionaries().combine_chunks()
    d = d.chunk(0) if isinstance(d, pa.ChunkedArray) else d
    order = np.empty(len(d.dictionary), np.int64)
    order[pc.sort_indices(d.dictionary).to_numpy()] = np.arange(len(order))
    at = pc.fill_null(d.indices, -1).to_numpy(zero_copy_only=False)
    return np.where(at < 0, -1, order[np.maximum(at, 0)]) if len(order) else np.full(len(at), -1)


# -- sets ---------------------------------------------------------------------------
def similar(z, w, at_least: float, same: bool = False):
    """Yield (i, j) arrays of the pairs of sets with a Jaccard of ``at_least`` or more; each once if both sides are the same.

    A set is a run of distinct 64-bit values. The shared ones of a set with 512
    others are counted exactly, by adding the rows of a table of 512 columns.
    """
    (zv, zo), (wv, wo) = z, w
    ids = np.unique(zv if same else np.concatenate([zv, wv]), return_inverse=True)[1].astype(np.int32)
    n_ids = int(ids.max(initial=-1)) + 1
    zi, wi = ids[: len(zv)], ids if same else ids[len(zv) :]
    zn, wn = np.diff(zo), np.diff(wo)
    zs, ws = np.argsort(zn, kind="stable"), np.argsort(wn, kind="stable")
    zs, ws = zs[zn[zs] > 0], ws[wn[ws] > 0]
    run = lambda values, off, rows: (np.concatenate([values[off[r] : off[r + 1]] for r in rows]) if len(rows) else values[:0], np.concatenate([[0], np.cumsum(off[rows + 1] - off[rows])]))
    w_ids, w_off = run(wi, wo, ws)
    w_size = wn[ws]
    wide = np.uint16 if max(zn.max(initial=0), wn.max(initial=0)) < 1 << 16 else np.uint32
    lut = np.full(n_ids, -1, np.int32)
    for a in range(0, len(zs), _SETS):
        rows = zs[a : a + _SETS]
        size = zn[rows]
        # of sizes too far apart no pair can reach the bound
        lo = int(np.searchsorted(w_size, np.floor(size[0] * at_least)))
        hi = int(np.searchsorted(w_size, np.ceil(size[-1] / at_least), "right"))
        lo = max(lo, a) if same else lo
        if lo >= hi:
            continue
        mine, off = run(zi, zo, rows)
        seen, at = np.unique(mine, return_inverse=True)
        table = np.zeros((len(seen), len(rows)), np.uint8)
        table[at, np.repeat(np.arange(len(rows)), np.diff(off))] = 1
        lut[seen] = np.arange(len(seen), dtype=np.int32)
        local = lut[w_ids[w_off[lo] : w_off[hi]]]
        lut[seen] = -1
        known = local >= 0
        ends = np.concatenate([[0], np.cumsum(known)])[w_off[lo : hi + 1] - w_off[lo]]
        local = local[known]
        for b in range(lo, hi, _SETS):
            e = min(b + _SETS, hi)
            shared = np.zeros((e - b, len(rows)), wide)
            for k in range(b, e):
                p, q = ends[k - lo], ends[k - lo + 1]
                for c in range(p, q, 255):  # a byte holds so many
                    shared[k - b] += np.add.reduce(table[local[c : min(c + 255, q)]], axis=0, dtype=np.uint8)
            union = w_size[b:e, None] + size[None, :] - shared
            j, i = np.nonzero(shared / union >= at_least)
            j += b
            if same:
                later = j > i + a
                i, j = i[later], j[later]
            yield rows[i], ws[j]


def _parts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``_parts``, the number of blocks of their group."""
    big = []
    if rows.count() > S.SET_BLOCK:
        big = rows.groupBy(*keys).count().where(F.col("count") > S.SET_BLOCK).collect()
    if not big:
        return rows.withColumn("_parts", F.lit(1))
    spark = rows.sparkSession
    at = spark.createDataFrame([(*r[:-1], -(-r[-1] // S.SET_BLOCK)) for r in big], rows.select(*keys, F.lit(1).alias("_parts")).schema)
    return rows.join(F.broadcast(at), keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))


def _hashed(words) -> Column:
    known = F.filter(F.array_distinct(F.coalesce(words, F.array().cast("array<string>"))), lambda t: t.isNotNull() & (t != ""))
    return F.array_distinct(F.transform(known, lambda t: F.xxhash64(t)))


def within(rows: DataFrame, keys: list[str], words: str, at_least: float, marks) -> DataFrame:
    """(request_id, id) of the rows that ``marks(i, j, rank of created_at, n)`` picks from the similar pairs of each group."""
    slim = _parts(rows.select(*keys, "id", "created_at", "n", words), keys).withColumn("_own", block_of("id", F.col("_parts")))
    slim = slim.select(*keys, "id", "created_at", "n", "_own", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other"), _hashed(F.col(words)).alias("_set"))
    cells = slim.select(*keys, F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "id", "created_at", "n", "_own", "_set")
    schema = rows.select("request_id", "id").schema

    def judge(key: tuple, t: pa.Table) -> pa.Table:
        first, second = key[-2].as_py(), key[-1].as_py()
        own, at, n = t["_own"].to_numpy(), _ranks(t["created_at"]), t["n"].to_numpy()
        left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
        gone = np.zeros(len(own), bool)
        sets = lambda rows: _lists(t["_set"].take(pa.array(rows)))
        z = sets(left)
        for i, j in similar(z, z if first == second else sets(right), at_least, first == second):
            gone[marks(left[i], right[j], at, n)] = True
        ids = t["id"].filter(pa.array(gone))
        return pa.table({"request_id": pa.array([key[0].as_py()] * len(ids), t.schema.field("request_id").type), "id": ids})

    return cells.groupBy(*keys, "_i", "_j").applyInArrow(judge, schema).distinct()


def between(left: DataFrame, right: DataFrame, keys: list[str], words: str, at_least: float) -> DataFrame:
    """(request_id, id) of ``right`` rows with a similar, newer ``left`` row in the group."""

    def side(df, mark):
        return df.select(*keys, "id", "created_at", words, F.lit(mark).alias("_left"))

    both = side(left, True).unionByName(side(right, False)).where("created_at is not null")
    both = _parts(both, keys).withColumn("_own", block_of("id", F.col("_parts")))
    cells = both.select(*keys, "id", "created_at", "_left", "_own", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other"), _hashed(F.col(words)).alias("_set"))
    pick = lambda yes, no: F.when(F.col("_left"), F.col(yes)).otherwise(F.col(no))
    cells = cells.select(*keys, pick("_own", "_other").alias("_i"), pick("_other", "_own").alias("_j"), "id", "created_at", "_left", "_set")
    schema = right.select("request_id", "id").schema

    def judge(key: tuple, t: pa.Table) -> pa.Table:
        first, at = t["_left"].to_numpy(), _ranks(t["created_at"])
        a, b = np.flatnonzero(first), np.flatnonzero(~first)
        gone = np.zeros(len(first), bool)
        sets = lambda rows: _lists(t["_set"].take(pa.array(rows)))
        if len(a) and len(b):
            for i, j in similar(sets(a), sets(b), at_least):
                i, j = a[i], b[j]
                gone[j[at[i] > at[j]]] = True
        ids = t["id"].filter(pa.array(gone))
        return pa.table({"request_id": pa.array([key[0].as_py()] * len(ids), t.schema.field("request_id").type), "id": ids})

    return cells.groupBy(*keys, "_i", "_j").applyInArrow(judge, schema).distinct()


# -- vectors -------------------------------------------------------------------------
def _norms(m: np.ndarray) -> np.ndarray:
    """As ``hashes.dot``: the squares are added in order."""
    total = np.zeros(len(m))
    for k in range(m.shape[1]):
        total = total + m[:, k] * m[:, k]
    return np.sqrt(total)


def _exact(q, v, qn, vn, rows, cols) -> np.ndarray:
    """``hashes.cosine`` of pairs, operation by operation."""
    out = np.empty(len(rows), np.float32)
    for a in range(0, len(rows), 1 << 16):
        r, c = rows[a : a + (1 << 16)], cols[a : a + (1 << 16)]
        total = np.zeros(len(r))
        for k in range(q.shape[1]):
            total = total + q[r, k] * v[c, k]
        norm = qn[r] * vn[c]
        value = np.where(norm == 0, 0.0, total / norm)
        out[a : a + (1 << 16)] = np.where(np.isnan(value), 1.0, np.clip(value, 0.0, 1.0))  # Spark's NaN is above all numbers
    return out


def nearest(q: np.ndarray, v: np.ndarray, order: np.ndarray, cap: int):
    """(rows of q, rows of v, cosine): the first ``cap`` of each row of ``q`` by cosine, then ``order``; only cosines above 0.

    A float32 product finds what may be among them, within its error; those are
    computed again exactly.
    """
    # of equal vectors only the first ``cap`` can be among the nearest
    by = np.argsort(order, kind="stable")
    raw = np.ascontiguousarray(v[by]).view(np.dtype((np.void, v.itemsize * v.shape[1])))[:, 0]
    kind = np.unique(raw, return_inverse=True)[1].ravel()
    group = np.argsort(kind, kind="stable")
    starts = np.flatnonzero(np.diff(kind[group], prepend=-1))
    nth = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
    kept = np.sort(by[group[nth < cap]])
    order, vs = order[kept], v[kept]
    qn, vn = _norms(q), _norms(vs)
    plain = lambda n: (n > 1e-30) & (n < 1e30)
    even, odd = np.flatnonzero(plain(vn)), np.flatnonzero(~plain(vn))
    unit = (vs[even] / vn[even, None]).astype(np.float32).T.copy()
    slack = 4 * (v.shape[1] + 8) * _F32
    found = []
    for a in range(0, len(q), _ASKED):
        mine = np.arange(a, min(a + _ASKED, len(q)))
        good, bad = mine[plain(qn[mine])], mine[~plain(qn[mine])]
        near = (q[good] / qn[good, None]).astype(np.float32) @ unit
        least = np.full(len(good), -slack, np.float32)
        if len(even) > cap:
            least = np.maximum(least, np.partition(near, len(even) - cap, axis=1)[:, len(even) - cap] - np.float32(slack))
        r, c = np.nonzero(near >= least[:, None])
        rows = [good[r], np.repeat(good, len(odd)), np.repeat(bad, len(vs))]
        cols = [even[c], np.tile(odd, len(good)), np.tile(np.arange(len(vs)), len(bad))]
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        cos = _exact(q, vs, qn, vn, rows, cols)
        some = cos > 0
        rows, cols, cos = rows[some], cols[some], cos[some]
        first = np.lexsort((order[cols], -cos, rows))
        rows, cols, cos = rows[first], cols[first], cos[first]
        begin = np.flatnonzero(np.diff(rows, prepend=-1))
        place = np.arange(len(rows)) - np.repeat(begin, np.diff(np.append(begin, len(rows))))
        found.append((rows[place < cap], kept[cols[place < cap]], cos[place < cap]))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def neighbours(asked: DataFrame, vectors: DataFrame, cap: int) -> DataFrame:
    """(request_id, id, cosine): the ``cap`` nearest of each block of vectors for each request; both sides move in blocks."""
    keys = ["project_key", "model"]
    whole = lambda v: F.forall(v, lambda x: x.isNotNull())
    asked = asked.dropna(subset=[*keys, "query_vec"]).where(whole("query_vec"))
    vectors = vectors.dropna(subset=[*keys, "vec"]).where(whole("vec"))
    n, m = asked.count(), vectors.count()
    if n <= S.VECTOR_BATCH:
        vectors = vectors.join(F.broadcast(asked.select(*keys).distinct()), keys, "left_semi")
    chunks, buckets = -(-n // (2 * S.VECTOR_BATCH)) or 1, max(-(-m // S.VECTOR_BLOCK), min(12, -(-m // 4096)), 1)
    own = F.pmod(F.hash("request_id"), F.lit(chunks)), F.pmod(F.hash("record_id"), F.lit(buckets))
    span = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = asked.select(*[F.col(k).alias(k) for k in keys], own[0].alias("_i"), span(buckets).alias("_j"), "request_id", "query_vec")
    right = vectors.select(*keys, own[1].alias("_j"), span(chunks).alias("_i"), "record_id", "vec")
    schema = asked.select("request_id").join(vectors.select(F.col("record_id").alias("id")), how="cross").select("request_id", "id", F.lit(0.0).cast("float").alias("cosine")).schema

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"request_id": a["request_id"].slice(0, 0), "id": b["record_id"].slice(0, 0), "cosine": pa.array([], pa.float32())})
        (qv, qo), (vv, vo) = _lists(a["query_vec"]), _lists(b["vec"])
        order, got = _ranks(b["record_id"]), []
        for dim in np.unique(np.diff(qo)):
            r, c = np.flatnonzero(np.diff(qo) == dim), np.flatnonzero(np.diff(vo) == dim)
            if dim and len(c):
                square = lambda x, off, rows, d=dim: x[off[rows][:, None] + np.arange(d)].astype(np.float64)
                i, j, cos = nearest(square(qv, qo, r), square(vv, vo, c), order[c], cap)
                got.append((r[i], c[j], cos))
        i, j, cos = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.array([], int), np.array([], int), np.array([], np.float32))
        return pa.table({"request_id": a["request_id"].take(pa.array(i)), "id": b["record_id"].take(pa.array(j)), "cosine": pa.array(cos, pa.float32())})

    by = [*keys, "_i", "_j"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, schema)
