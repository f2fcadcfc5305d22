"""Language identification by sparse multinomial logistic regression.

Features are hashed character 1-, 2- and 3-grams of the lower-cased text, every
non-letter counted as one blank, weighted by TF (share of the n-grams of that
length) times IDF. Weights are trained by follow-the-regularised-leader with
elastic-net (L1 and L2) penalties, and probabilities are calibrated by one
temperature fitted on documents kept out of the weight training.

Document frequencies cover every training document; the weights are fitted on
at most ``train_rows`` labelled documents for each language (a documented
bound), chosen by hash. Whole texts are read at either step.

Long texts are counted a piece at a time, so a worker holds one piece's arrays.
Languages with fewer than ``min_rows`` labelled documents are no class, so the
classes are at most the labelled rows divided by that.

Defined results: null, empty and letterless texts give ``und`` with score 0;
with no labelled document at all, and for an empty table, no text is anything
else; repeated rows each get their own answer; other columns are ignored by the
query and kept by ``identify``, but for those named as its outputs, which it
replaces (callers who need them pass other names).
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklode.llm.common import bounded, column, text_slices

#: Hash buckets for each n-gram length, and characters counted at once.
DIM = 1 << 14
PIECE = 1 << 20
LENGTHS = (1, 2, 3)
UNDETERMINED = "und"
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def pieces(texts: list[str]):
    """Lower-cased texts as (documents, pieces, n-gram starts in each piece) lists of about PIECE characters.

    A piece of a longer text sees two characters on, so every n-gram starts in one piece.
    """
    held, size = [], 0
    for d, t in enumerate(texts):
        low = t.lower()
        for lo in range(0, max(1, len(low)), PIECE):
            last = lo + PIECE >= len(low)
            part = low if last and not lo else low[lo:] if last else low[lo : lo + PIECE + LENGTHS[-1] - 1]
            held.append((d, part, len(part) + 1 if last else PIECE))
            size += len(part)
            if size >= PIECE:
                yield tuple(zip(*held, strict=True))
                held, size = [], 0
    if held:
        yield tuple(zip(*held, strict=True))


def featurise(low: list[str], limits: list[int] | None = None):
    """(document of each n-gram, feature of each n-gram) by n-gram length, and has_letter per document, of lower-cased texts."""
    lens = np.fromiter(map(len, low), np.int64, len(low)) + 1
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    starts = np.cumsum(lens) - lens
    has = np.add.reduceat(letter, starts) > 0
    x = np.where(letter, codes, np.uint32(32))
    doc = np.repeat(np.arange(len(low), dtype=np.int32), lens)
    mine = np.ones(len(x), bool)
    if limits is not None:
        for i in np.flatnonzero(np.array(limits) < lens):
            mine[starts[i] + limits[i] : starts[i] + lens[i]] = False
    out = []
    h = np.zeros(len(x), np.uint32)
    any_letter = np.zeros(len(x), bool)
    for k, n in enumerate(LENGTHS):
        m = len(x) - n + 1
        if m <= 0:
            break
        h = (h[:m] + x[n - 1 :][:m]) * np.uint32(0x9E3779B1)
        h = h ^ (h >> np.uint32(15))
        any_letter = any_letter[:m] | letter[n - 1 :][:m]
        keep = any_letter & (doc[:m] == doc[n - 1 :][:m]) & mine[:m]
        out.append((doc[:m][keep], (h[keep] & np.uint32(DIM - 1)).astype(np.int32) + k * DIM))
    return out, has


def _document_counts(texts: list[str]):
    """For each document its sparse TF: (feature ids, values)."""
    for t in texts:
        counts, sizes = np.zeros(DIM * len(LENGTHS)), np.zeros(len(LENGTHS))
        for _, low, limits in pieces([t]):
            for k, (_, f) in enumerate(featurise(low, limits)[0]):
                counts += np.bincount(f, minlength=len(counts))
                sizes[k] += len(f)
        ids = np.flatnonzero(counts).astype(np.int32)
        yield ids, counts[ids] / sizes[ids // DIM]


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # IDF times weight, (features, languages) float32
    bias: np.ndarray
    temperature: float

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.langs:
            return [UNDETERMINED] * n, np.zeros(n)
        has, sums, sizes = np.zeros(n, bool), np.zeros((len(LENGTHS), n, len(self.langs))), np.zeros((len(LENGTHS), n))
        for owner, low, limits in pieces(texts):
            owner = np.array(owner)
            grams, some = featurise(low, limits)
            has[owner[some]] = True
            for g, (doc, f) in enumerate(grams):
                if len(doc):
                    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                    to = owner[doc[at]]
                    np.add.at(sizes[g], to, np.diff(np.r_[at, len(doc)]))
                    for k in range(len(self.langs)):
                        np.add.at(sums[g, :, k], to, np.add.reduceat(self.table[:, k][f], at, dtype=np.float64))
        z = self.bias + (sums / np.maximum(sizes, 1)[:, :, None]).sum(0)
        p = _softmax(z / self.temperature)
        best = p.argmax(1)
        return [self.langs[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)], np.where(has, p.max(1), 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_ftrl(rows, n_features: int, n_classes: int, alpha=1.0, beta=1.0, l1=1e-3, l2=1e-4, epochs=3):
    """Follow-the-regularised-leader with elastic net; rows are (ids, values, class)."""
    z = np.zeros((n_features, n_classes))
    n = np.zeros_like(z)
    zb, nb = np.zeros(n_classes), np.zeros(n_classes)

    def weight(zz, nn):
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    for _ in range(epochs):
        for ids, values, y in rows:
            w = weight(z[ids], n[ids])
            b = weight(zb, nb)
            p = _softmax(values @ w + b)
            p[y] -= 1
            g = values[:, None] * p
            s = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha
            z[ids] += g - s * w
            n[ids] += g * g
            sb = (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha
            zb += p - sb * b
            nb += p * p
    return weight(z, n), weight(zb, nb)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0
    lo, hi, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2

    def loss(t):
        p = _softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(train: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", train_rows=300, seed=9, min_rows=2) -> LanguageModel:
    """Fit on ``train``: counts over all its rows, weights on ``train_rows`` documents a language at most, of languages with ``min_rows``."""
    base = train.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("l is not null and t is not null")
    size = DIM * len(LENGTHS)

    def count(batches):
        df, docs, seen = np.zeros(size + 1, np.int64), 0, np.zeros(size, bool)
        for b, _, _ in text_slices(batches, "t"):
            current = 0
            for owner, low, limits in pieces(column(b, "t").to_pylist()):
                grams, _ = featurise(low, limits)
                cuts = [np.searchsorted(doc, np.arange(len(low) + 1)) for doc, _ in grams]
                for i, d in enumerate(owner):
                    if d != current:
                        df[:size] += seen
                        seen[:] = False
                        current = d
                    for (_, f), c in zip(grams, cuts, strict=True):
                        seen[f[c[i] : c[i + 1]]] = True
            df[:size] += seen
            seen[:] = False
            docs += b.num_rows
        df[size] = docs
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["f", "n"])

    df = np.zeros(size + 1)
    for r in bounded(base.select("t")).mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toLocalIterator():
        df[r.f] = r.n
    docs = df[size]
    if not docs:
        return LanguageModel([], np.zeros((size, 0), np.float32), np.zeros(0), 1.0)
    idf = np.log((1 + docs) / (1 + df[:size])) + 1

    def sparse(batches):
        for b, _, _ in text_slices(batches, "t"):
            found = list(_document_counts(column(b, "t").to_pylist()))
            yield pa.RecordBatch.from_arrays([column(b, "k"), column(b, "l"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64()))], ["k", "l", "ids", "vals"])

    # a bounded top-k of hash keys for each language, on ids alone; then one scan for the texts of those keys
    keyed = base.withColumn("k", F.xxhash64(F.lit(seed), F.col("i").cast("string")))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("k"))
    cut = {r.l: r.k for r in keyed.select("k", "l").withColumn("r", rank).where(F.col("r") <= train_rows).groupBy("l").agg(F.max("k").alias("k"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows).collect()}
    langs = sorted(cut)
    chosen = F.lit(False)
    for lang in langs:
        chosen = chosen | ((F.col("l") == lang) & (F.col("k") <= F.lit(cut[lang])))
    rows = bounded(keyed.where(chosen).select("k", "l", "t")).mapInArrow(sparse, "k long, l string, ids array<int>, vals array<double>").collect()
    rows.sort(key=lambda r: (r.k, r.l))
    data = [(np.array(r.ids, np.int64), np.array(r.vals) * idf[r.ids], langs.index(r.l)) for r in rows if r.ids]
    cal, fitted = data[::5], [x for i, x in enumerate(data) if i % 5] or data
    w, b = train_ftrl(fitted, size, len(langs))
    logits = np.array([v @ w[i] + b for i, v, _ in cal]).reshape(len(cal), len(langs))
    t = fit_temperature(logits, np.array([y for *_, y in cal], int))
    return LanguageModel(langs, (idf[:, None] * w).astype(np.float32), b, t)


def identify(df: DataFrame, model: LanguageModel, text_col="text", lang_out="lang_pred", score_out="score") -> DataFrame:
    """Append the predicted language and its calibrated probability to every row."""
    clash = [c for c in df.columns if c.lower() in (lang_out.lower(), score_out.lower())]
    if clash:
        df = df.drop(*clash)
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most DIM * 3 features by the number of languages
    schema = T.StructType([*df.schema.fields]).add(lang_out, "string").add(score_out, "double")

    def run(batches):
        m = shared.value
        for b, _, _ in text_slices(batches, text_col):
            langs, p = m.score([t or "" for t in column(b, text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(p, pa.float64())], [*b.schema.names, lang_out, score_out])

    return bounded(df).mapInArrow(run, schema)


def held_out(id_col="doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
