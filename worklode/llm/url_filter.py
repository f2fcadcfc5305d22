"""URL filters: host and path rules, and a character language-model ratio for the rest.

Two variable-order Markov models (orders 0 to ``ORDER``, each order smoothed
into the next lower one by Witten-Bell weights) are counted over the URLs that
the rules accept and reject, all of them. The counts are exact: a context and
its byte are one integer, and they stay a distributed table that grows with the
distinct grams; nothing of it is gathered but order 0 (256 bytes). URLs are
scored in slices of bounded size: the distinct grams of a slice are joined with
the counts, so a frequent gram costs one row a slice. A URL without a rule is
judged by the difference of its two log-likelihoods per byte, over the whole
URL from scheme to fragment, against a threshold calibrated on a fifth of the
ruled hosts, whose URLs the counting leaves out: the lowest one with the least
sum of error rates, so that what is like neither class is allowed.

Defined results: a null url or one without ``://`` has an empty host and path
and no rule; a null or empty url carries no evidence and is allowed, as is any
very long one judged like the others; if no URL is accepted or none rejected by
rule outside the calibrating fifth, the ratio has nothing to compare and allows;
with none inside it the threshold is the lowest; ties at the threshold are
allowed; repeated rows each get a verdict; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklode.llm.common import SLICE_BYTES, bounded, column, free_name, materialize, text_slices

#: (verdict, host, path) of the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 4
#: Bits of a symbol: 0 before the URL's start, else the byte and one. The current byte is lowest, then the one before it, and so on.
_BITS = 9
#: Bytes counted at once by a task.
_HELD = 1 << 20
_BINS = 400
_SPAN = 4.0


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(df: DataFrame, rules=RULES, host="host", path="path") -> tuple[Column, Column]:
    """(rule, verdict) columns: the longest rule that fits wins; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        rule = F.when(fits, h + p).otherwise(rule)
        verdict = F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER symbols before it; the URL's start is a context of its own."""
    pos = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs))
    x = data.astype(np.int64) + 1
    g = x.copy()
    for k in range(1, ORDER + 1):
        before = np.zeros(len(x), np.int64)
        before[k:] = x[:-k]
        g |= np.where(pos >= k, before, 0) << (_BITS * k)
    return g


def _suffix(g, k: int) -> Column:
    """The gram of order ``k`` that ends a gram of a higher order."""
    return F.col(g).bitwiseAND(F.lit((1 << (_BITS * (k + 1))) - 1))


def _orders(g="g") -> Column:
    return F.inline(F.array(*(F.struct(F.lit(k).alias("k"), _suffix(g, k).alias("g")) for k in range(ORDER + 1))))


def _slices(df: DataFrame, text: str) -> DataFrame:
    """Rows of ``df`` packed in slices of bounded size, with the distinct grams of each; written once, so a slice's number is fixed."""

    def run(batches):
        name, held, size = TaskContext.get().partitionId() << 32, [], 0

        def pack():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0][0].schema) as out:
                for b, _ in held:
                    out.write_batch(b)
            grams = np.unique(np.concatenate([g for _, g in held]))
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(grams)], pa.int32()), pa.array(grams))], ["slice", "rows", "grams"])

        for b, data, offs in text_slices(batches, text):
            if held and size + b.nbytes > SLICE_BYTES:
                yield pack()
                name, held, size = name + 1, [], 0
            held.append((b, np.unique(_grams(data, offs))))
            size += b.nbytes
        if held:
            yield pack()

    return materialize(bounded(df).mapInArrow(run, "slice long, rows binary, grams array<long>"))


@dataclass
class UrlModel:
    """grams: exact (k, g, n0, n1) of every order and gram in either class, distributed.

    counts[class, 0, table] is order 0 of it: 0 the total, 1 counts of bytes, 2 the number of distinct bytes.
    """

    grams: DataFrame
    counts: np.ndarray
    threshold: float = 0.0
    usable: bool = True

    def gram_scores(self, grams: DataFrame) -> DataFrame:
        """(g, score) of each distinct full gram: difference of the two log-probabilities of its byte after its context."""
        wanted = grams.distinct().select(_orders()).distinct().select("k", "g", F.lit(0).cast("long").alias("n0"), F.lit(0).cast("long").alias("n1"), F.lit(True).alias("wanted"))
        both = self.grams.withColumn("wanted", F.lit(False)).unionByName(wanted).groupBy("k", "g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.max("wanted").alias("wanted"))
        context = Window.partitionBy("k", F.shiftright("g", _BITS))  # at most 256 rows
        both = both.withColumns({f"{x}{c}": f.over(context) for c in (0, 1) for x, f in (("t", F.sum(f"n{c}")), ("u", F.count_if(F.col(f"n{c}") > 0)))})
        both = materialize(both.where("wanted"))
        found = None
        for k in range(ORDER + 1):
            own = both.where(F.col("k") == k)
            if found is None:
                own = own.withColumns({f"p{c}": F.lit(1 / 256) for c in (0, 1)})
            else:
                found = found.withColumnRenamed("g", "lower")  # at most 65,536 rows up to order 1; larger ones are not broadcast
                own = own.withColumn("lower", _suffix("g", k - 1)).join(found.hint("merge") if k > 2 else found, "lower")
            p = [F.when(F.col(f"t{c}") > 0, (F.col(f"n{c}") + F.col(f"u{c}") * F.col(f"p{c}")) / (F.col(f"t{c}") + F.col(f"u{c}"))).otherwise(F.col(f"p{c}")).alias(f"p{c}") for c in (0, 1)]
            found = own.select("g", *p)
        return found.select("g", (F.ln("p0") - F.ln("p1")).alias("score"))

    def ratios(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """``df`` with the length-normalised difference of log-likelihoods, accepted minus rejected, as ``out``."""
        slices = _slices(df, text)
        parts = slices.select("slice", F.explode("grams").alias("g"))
        scores = parts.join(self.gram_scores(parts.select("g")).hint("merge"), "g").select("slice", "g", "score")

        def run(left, right):
            order = np.argsort(g := np.array(right.column("g")))
            g, score = g[order], np.array(right.column("score"))[order]
            done = []
            for blob in left.column("rows"):
                for b, data, offs in text_slices(iter(pa.ipc.open_stream(blob.as_buffer())), text):
                    s = np.r_[0.0, np.cumsum(score[np.searchsorted(g, _grams(data, offs))])]
                    r = (s[offs[1:]] - s[offs[:-1]]) / np.maximum(np.diff(offs), 1)
                    done.append(pa.RecordBatch.from_arrays([*b.columns, pa.array(r)], [*b.schema.names, out]))
            return pa.Table.from_batches(done)

        schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
        return slices.select(F.col("slice").alias("own"), "rows").groupBy("own").cogroup(scores.groupBy("slice")).applyInArrow(run, schema)

    def ratio(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The same for a few texts at hand."""
        texts = [(i, bytearray(data[a:b].tobytes())) for i, (a, b) in enumerate(zip(offs[:-1], offs[1:], strict=True))]
        rows = self.ratios(self.grams.sparkSession.createDataFrame(texts, "i long, s binary"), "s", "r").collect()
        return np.array([r.r for r in sorted(rows, key=lambda r: r.i)])

    def allows(self, data, offs) -> np.ndarray:
        if not self.usable:
            return np.ones(len(offs) - 1, bool)
        return (self.ratio(data, offs) >= self.threshold) | (np.diff(offs) == 0)


def host_fifth(host="host") -> Column:
    """Is the host among the fifth that calibrates?"""
    return F.conv(F.substring(F.md5(F.col(host).cast("binary")), 1, 8), 16, 10).cast("long") % 5 == 0


def fit(ruled: DataFrame, text="s", verdict="verdict", key="u", calibrates: Column | None = None) -> UrlModel:
    """Count both models over all ruled URLs but those that calibrate (a hashed fifth by ``key`` if not said), and calibrate on these."""
    part = F.pmod(F.xxhash64(F.lit(5), key), F.lit(5)) == 0 if calibrates is None else calibrates
    ruled = ruled.select(text, (F.col(verdict) == "block").cast("int").alias("c"), part.alias("cal"))

    def count(batches):
        held, size = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            c = keys & 1
            return pa.RecordBatch.from_arrays([pa.array(keys >> 1), pa.array(n * (1 - c)), pa.array(n * c)], ["g", "n0", "n1"])

        for b, data, offs in text_slices(batches, text):
            held.append(_grams(data, offs) << 1 | np.repeat(np.array(column(b, "c").to_pylist(), np.int64), np.diff(offs)))
            size += len(data)
            if size >= _HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    sums = [F.sum(n).alias(n) for n in ("n0", "n1")]
    full = bounded(ruled.where(~F.col("cal")).select(text, "c")).mapInArrow(count, "g long, n0 long, n1 long").groupBy("g").agg(*sums)
    grams = materialize(full.select(_orders(), "n0", "n1").groupBy("k", "g").agg(*sums))
    counts = np.zeros((2, 1, 3, 256))
    for r in grams.where("k = 0").collect():  # a row for each byte at most
        counts[:, 0, 1, r.g - 1] = r.n0, r.n1
    counts[:, 0, 0, 0], counts[:, 0, 2, 0] = counts[:, 0, 1].sum(1), (counts[:, 0, 1] > 0).sum(1)
    model = UrlModel(grams, counts, usable=bool(counts[:, 0, 0, 0].all()))
    if not model.usable:
        return model
    place = F.floor((F.col("r") + _SPAN) / (2 * _SPAN) * _BINS)
    place = F.greatest(F.lit(0), F.least(F.lit(_BINS - 1), place)) + F.col("c") * _BINS
    h = np.zeros(2 * _BINS)
    for r in model.ratios(ruled.where("cal").select(text, "c"), text, "r").groupBy(place.alias("i")).count().collect():  # a row for each bin at most
        h[r.i] = r["count"]
    accepted, rejected = h.reshape(2, _BINS)
    wrong = np.r_[0, np.cumsum(accepted)] / max(accepted.sum(), 1) + (rejected.sum() - np.r_[0, np.cumsum(rejected)]) / max(rejected.sum(), 1)
    best = np.flatnonzero(wrong == wrong.min())
    model.threshold = float(best[0] / _BINS * 2 * _SPAN - _SPAN)
    return model


def judge(pages: DataFrame, id_col="page_id", url_col="url", rules=RULES) -> DataFrame:
    """page id, host, path, rule and verdict of each row."""
    df = pages.select(F.col(id_col), F.col(url_col).alias("u")).withColumns({"host": host_of(F.col("u")), "path": path_of(F.col("u"))})
    rule, verdict = apply_rules(df, rules)
    df = df.withColumns({"rule": rule, "verdict": verdict, "s": F.coalesce("u", F.lit(""))})
    model = fit(df.where("verdict is not null").select("host", "s", "verdict"), calibrates=host_fifth())
    names = [c for c in df.columns if c not in ("u", "s")]
    if not model.usable:
        return df.withColumn("verdict", F.coalesce("verdict", F.lit("allow"))).select(names)
    ratio = free_name("_ratio", df.columns)
    rest = model.ratios(df.where("verdict is null").drop("u"), "s", ratio)
    rest = rest.withColumn("verdict", F.when((F.col(ratio) >= model.threshold) | (F.col("s") == ""), "allow").otherwise("block"))
    return df.where("verdict is not null").select(names).unionByName(rest.select(names))
