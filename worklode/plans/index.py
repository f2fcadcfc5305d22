"""Derived relations of active claims: full-text terms, postings, statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklode.functions import paths as P
from worklode.functions import text as X
from worklode.plans.cut import cut

#: Rows of requests that are broadcast.
SENT = 1 << 16


def bodies(claims: DataFrame, status: str | None = "active") -> DataFrame:
    """(record_id, project_key, body): text, symbols, path keys and their stems of active claims, or of all."""
    keys = P.path_keys("paths")
    stems = F.flatten(F.transform(keys, lambda k: F.array(k, F.when((X.stem(k) != "") & (X.stem(k) != k), X.stem(k)))))
    body = F.concat_ws(" ", F.col("text"), F.array_join("symbols", " "), F.array_join(F.filter(stems, lambda s: s.isNotNull()), " "))
    if status is not None:
        claims = claims.where(F.col("status") == status)
    return claims.select(F.col("id").alias("record_id"), "project_key", body.alias("body"))


def terms(docs: DataFrame) -> DataFrame:
    """(record_id, project_key, term, tf, doc_len) of (record_id, project_key, body)."""
    listed = docs.select("record_id", "project_key", X.index_terms("body").alias("_t"))
    one = listed.select("record_id", "project_key", F.size("_t").alias("doc_len"), F.explode("_t").alias("term"))
    return one.groupBy("record_id", "project_key", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("doc_len").alias("doc_len"))


def wanted_terms(docs: DataFrame, wanted: list[str]) -> tuple[DataFrame, int, float]:
    """(terms, number of documents, mean length) of a few terms over unindexed documents, in one scan: others are never exploded."""
    listed = docs.select("record_id", "project_key", X.index_terms("body").alias("_t"))
    few = cut(listed.select("record_id", "project_key", F.size("_t").alias("doc_len"), F.filter("_t", lambda t: t.isin(wanted)).alias("_t")))
    n, mean = few.agg(F.count(F.lit(1)), F.avg("doc_len")).first()
    one = few.select("record_id", "project_key", "doc_len", F.explode("_t").alias("term"))
    return one.groupBy("record_id", "project_key", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("doc_len").alias("doc_len")), int(n), float(mean or 1.0)


def path_postings(claims: DataFrame) -> DataFrame:
    return claims.where("status = 'active'").select("project_key", F.explode(P.path_keys("paths")).alias("key"), F.col("id").alias("record_id"), "type").distinct()


def symbol_postings(claims: DataFrame) -> DataFrame:
    lowered = F.transform("symbols", F.lower)
    return claims.where("status = 'active'").select("project_key", F.explode(X.uniq(lowered)).alias("key"), F.col("id").alias("record_id"), "type").distinct()


@dataclass
class Index:
    """What retrieval reads."""

    claims: DataFrame
    terms: DataFrame
    paths: DataFrame
    symbols: DataFrame
    n: int
    mean_len: float

    @staticmethod
    def build(claims: DataFrame) -> Index:
        """Statistics span all projects; only results are kept to one."""
        claims = cut(claims.where("status = 'active'"))
        docs = bodies(claims)
        lengths = docs.select(F.size(X.index_terms("body")).alias("n")).agg(F.count(F.lit(1)), F.avg("n")).first()
        return Index(claims, cut(terms(docs)), cut(path_postings(claims)), cut(symbol_postings(claims)), int(lengths[0]), float(lengths[1] or 1.0))


    @staticmethod
    def of(claims: DataFrame, terms: DataFrame, n: int, mean_len: float) -> Index:
        """From stored terms of all projects; the claims may be those of a few."""
        claims = cut(claims.where("status = 'active'"))
        return Index(claims, terms, cut(path_postings(claims)), cut(symbol_postings(claims)), n, mean_len)


def bm25(tf, df, doc_len, n, mean_len):
    """The score of one term, the larger the better; k1 1.2, b 0.75, idf not below 1e-6."""
    idf = F.greatest(F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / F.lit(float(mean_len))))


def few(df: DataFrame, n: int = SENT) -> DataFrame:
    """A relation of requests, to be sent to what grows if it has at most ``n`` rows; so no key that many records share gathers them in a task."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= n else df


def search(queries: DataFrame, index_terms: DataFrame, n: int, mean_len: float) -> DataFrame:
    """(request_id, record_id, project_key, bm25) of any claim with a term of (request_id, term) rows, or of the row's project if it has one."""
    terms = few(queries.select("term").distinct())
    wanted = index_terms.join(terms, "term", "left_semi")
    df = few(wanted.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df")))
    on = ["term", "project_key"] if "project_key" in queries.columns else ["term"]
    hit = wanted.join(few(queries), on).join(df, "term")
    return hit.groupBy("request_id", "record_id", "project_key").agg(F.sum(bm25(F.col("tf"), F.col("df"), F.col("doc_len"), n, mean_len)).alias("bm25"))
