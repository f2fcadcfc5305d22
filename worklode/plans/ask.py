"""Ask: a batch of requests to packed hits (R1-R47). A request is a row, so many asks are one job.

request -> normalised query -> thin ones filled from the tape -> the action log's
continuity -> united candidate generators (400) -> noise, duplicate, conflict and
invalidation anti-joins -> features -> score -> greedy pack (5) -> warnings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklode import schemas as S
from worklode.functions import hashes as H
from worklode.functions import paths as P
from worklode.functions import rules
from worklode.functions import text as X
from worklode.operators import store
from worklode.plans import blocks, pack
from worklode.plans.cut import cut
from worklode.plans.index import Index, few, search

def query_symbols(tokens: Column) -> Column:
    """Identifiers among tokens, with aliases, first seen."""
    good = F.filter(F.transform(tokens, F.lower), lambda t: (t != "") & ~t.isin(*rules.IDENT_STOP) & (X.is_lower_identifier(t) | t.rlike("[/.]")))
    return X.uniq(F.flatten(F.transform(good, lambda t: F.transform(X.expand_ident(t), F.lower))))


def is_content(t: Column) -> Column:
    """X9."""
    return (t != "") & ~t.isin(*rules.OVERLAP_STOP) & ((F.char_length(t) > 3) | X.is_lower_identifier(t))


def content_overlap(query_tokens, text) -> Column:
    """Distinct content tokens of the query that a text has, aliases included."""
    t = X.tokens(text)
    hay = F.filter(F.array_union(t, F.flatten(F.transform(t, lambda w: F.transform(X.expand_ident(w), F.lower)))), is_content)
    mine = F.array_distinct(F.filter(F.transform(X.col(query_tokens), F.lower), is_content))
    return F.size(F.filter(mine, lambda q: F.array_contains(hay, q) | F.arrays_overlap(hay, F.transform(X.expand_ident(q), F.lower))))


def job_text(x) -> Column:
    """Text without back-tick spans and talk about types."""
    s = F.lower(F.regexp_replace(X.col(x), r"`[^`]*(?:`|\z)", " "))
    for w in rules.JOB_STOP:
        s = F.replace(s, F.lit(w), F.lit(" "))
    return s


def strong_ident(symbols) -> Column:
    """X8."""
    return F.exists(X.col(symbols), lambda s: ~s.isin(*rules.IDENT_STOP) & (X.is_lower_identifier(s) | s.rlike("[_-]")))


def normalise(requests: DataFrame) -> DataFrame:
    """Tokens, path keys, symbols, default limit; a request needs a project or a workspace."""
    project = F.when(X.trim(F.coalesce("project", F.lit(""))) != "", P.project_key("project")).when(X.trim(F.coalesce("workspace_root", F.lit(""))) != "", P.path_project("workspace_root"))
    q = requests.withColumn("project_key", project).where("project_key is not null")
    q = q.withColumn("q_tokens", X.tokens(F.coalesce("question", F.lit("")))).withColumn("g_tokens", X.tokens(F.coalesce("goal", F.lit(""))))
    q = q.withColumn("tokens", F.concat("q_tokens", "g_tokens")).withColumn("path_keys", P.path_keys(F.coalesce("paths", X.strings(()))))
    q = q.withColumn("symbols", query_symbols(F.col("tokens"))).withColumn("lookup", X.uniq("tokens"))
    limit = F.when(F.coalesce("limit_tokens", F.lit(0)) > 0, F.col("limit_tokens")).otherwise(S.DEFAULT_LIMIT)
    session = X.trim(F.coalesce("session_id", F.lit("")))
    return q.withColumn("limit_tokens", limit).withColumn("session_id", F.when(session == "", "default").otherwise(session))


def tails(messages: DataFrame, newest: DataFrame | None = None) -> DataFrame:
    """(project, last_user, tail_paths, failed_tokens) of each project's newest tape.

    Offsets of different tapes cannot be compared: ``messages`` holds one tape a
    project, or ``newest`` says which (project_key, session_id).
    """
    if newest is not None:
        messages = messages.join(newest.select("project_key", "session_id"), ["project_key", "session_id"], "left_semi")
    usable = messages.where("not skip").where(X.trim("text") != "")
    w = Window.partitionBy("project_key").orderBy(F.desc("offset"))
    size = F.sum(F.octet_length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    t = usable.withColumn("_n", F.row_number().over(w)).withColumn("_s", size).where((F.col("_n") <= S.TAIL_MESSAGES) & (F.col("_s") <= S.TAIL_BYTES))
    failed = F.when(F.col("error") | F.col("text").rlike(rules.TAIL_FAILED), X.tokens("text")).otherwise(X.strings(()))
    rows = t.groupBy("project_key").agg(F.sort_array(F.collect_list(F.struct("offset", "role", "text", P.find_paths("text").alias("paths"), failed.alias("failed")))).alias("m"))
    users = F.filter("m", lambda m: m["role"] == "user")
    return rows.select("project_key", F.get(F.transform(users, lambda m: m["text"]), F.size(users) - 1).alias("last_user"), P.path_keys(F.flatten(F.transform("m", lambda m: m["paths"]))).alias("tail_paths"), F.flatten(F.transform("m", lambda m: m["failed"])).alias("failed_tokens"))


def compile_thin(q: DataFrame, tail: DataFrame | None, claims: DataFrame) -> DataFrame:
    """Fill the empty fields of thin requests from the tape and recent claims."""
    if tail is None:
        return q
    recent = store.recent_paths(claims, S.RECENT_CLAIMS).groupBy("project_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "path_key"))), lambda x: x["path_key"]).alias("recent"))
    j = q.join(tail, "project_key", "left").join(recent, "project_key", "left")
    thin = (F.size("path_keys") == 0) & (F.size("tokens") < S.RICH_TOKENS)
    clipped = F.make_valid_utf8(F.substring(F.encode("last_user", "utf-8"), 1, S.QUESTION_BYTES).cast("string"))
    filled = F.when(thin & (F.coalesce("question", F.lit("")) == "") & F.col("last_user").isNotNull(), clipped).otherwise(F.col("question"))
    more = F.slice(X.uniq(F.concat(F.coalesce("tail_paths", X.strings(())), F.when(F.col("tail_paths").isNotNull(), F.coalesce("recent", X.strings(()))).otherwise(X.strings(())))), 1, S.COMPILE_PATHS)
    j = j.withColumn("question", filled).withColumn("paths", F.when(thin & (F.coalesce(F.size("paths"), F.lit(0)) <= 0), more).otherwise(F.col("paths")))
    j = j.withColumn("_extra", F.when(thin, F.coalesce("failed_tokens", X.strings(()))).otherwise(X.strings(())))
    keep = [c for c in j.columns if c not in ("project_key", "q_tokens", "g_tokens", "tokens", "path_keys", "symbols", "lookup", "last_user", "tail_paths", "failed_tokens", "recent")]
    out = normalise(j.select(*keep))
    return out.withColumn("lookup", X.uniq(F.concat("lookup", "_extra"))).drop("_extra")


def hydrate(q: DataFrame, actions: DataFrame | None, claims: DataFrame) -> DataFrame:
    """Continuity from the last 40 actions of the session."""
    none = X.strings(())
    q = q.withColumn("seed_paths", F.col("path_keys"))
    if actions is None:
        out = q.withColumns({"served": none, "dwell": none, "continued": F.lit(False)})
    else:
        act = F.struct("at", "seq", "kind", "claim_id", "paths", "tokens")
        recent = store.recent_actions(actions, S.ACTION_CAP).groupBy("project_key", "session_id").agg(F.sort_array(F.collect_list(act), False).alias("acts"))
        j = q.join(recent, ["project_key", "session_id"], "left").withColumn("acts", F.coalesce("acts", F.array().cast(recent.schema["acts"].dataType)))
        asks = F.filter("acts", lambda a: a["kind"] == "ask")
        last = F.get(asks, F.lit(0))
        j = j.withColumn("_last", last)
        group = F.filter(asks, lambda a: a["at"] == F.col("_last.at"))
        ids = lambda kinds: X.uniq(F.transform(F.filter("acts", lambda a: a["kind"].isin(*kinds)), lambda a: a["claim_id"]))
        j = j.withColumns({"served": X.uniq(F.transform(group, lambda a: a["claim_id"])), "dwell": ids(("get", "remember")), "_toks": F.coalesce(F.col("_last.tokens"), none), "_paths": F.flatten(F.transform(group, lambda a: F.coalesce(a["paths"], none)))})
        same = X.same_set(X.uniq("tokens"), "_toks")
        thin = (F.size("path_keys") == 0) & ~strong_ident("symbols")
        files = (F.size("path_keys") > 0) & (F.size("_paths") > 0) & (X.jaccard("path_keys", P.path_keys("_paths")) > 0)
        j = j.withColumn("continued", (F.size("acts") > 0) & (same | thin | files))
        texts = claims.select(F.col("id").alias("_id"), X.tokens("text").alias("_t"))
        dwelt = j.where("continued").select("request_id", F.explode("dwell").alias("_id")).join(texts, "_id").groupBy("request_id").agg(F.flatten(F.collect_list("_t")).alias("_dwelt"))
        j = j.join(dwelt, "request_id", "left")
        told = F.concat(F.flatten(F.transform(asks, lambda a: F.coalesce(a["tokens"], none))), F.coalesce("_dwelt", none))
        extra = F.when(F.col("continued"), told).otherwise(none)
        tape = F.flatten(F.transform(F.filter("acts", lambda a: a["kind"].isin("ask", "get", "remember")), lambda a: F.coalesce(a["paths"], none)))
        fill = (F.size("path_keys") == 0) & (F.size("acts") > 0)
        paths = F.when(fill & F.col("continued"), F.slice(P.path_keys(tape), 1, S.COMPILE_PATHS)).otherwise(F.col("path_keys"))
        j = j.withColumn("_extra", extra).withColumn("path_keys", paths)
        j = j.withColumns({"lookup": X.uniq(F.concat("lookup", F.filter("_extra", is_content))), "symbols": X.uniq(F.concat("symbols", query_symbols(F.col("_extra")))), "served": F.when(same, none).otherwise(F.col("served"))})
        out = j.drop("acts", "_last", "_toks", "_paths", "_dwelt", "_extra")
    head = (F.size("path_keys") == 0) & (F.size("symbols") == 0) & (F.size("lookup") == 0)
    profile = F.when(head, "head").when(F.size("path_keys") > 0, "path").when(strong_ident("symbols"), "ident").otherwise("prose")
    return out.withColumn("head", head).withColumn("profile", profile)


def posting_hits(keys: DataFrame, postings: DataFrame, per: int = S.PER_KEY_CAP, total: int = S.POSTING_CAP) -> DataFrame:
    """(request_id, id, pos): ``per`` records of each key in id order, first seen, ``total`` altogether."""
    hit = keys.join(postings, ["project_key", "key"])
    hit = store.top(hit, ["request_id", "key_pos"], ["record_id"], per)
    first = hit.groupBy("request_id", F.col("record_id").alias("id")).agg(F.min(F.struct("key_pos", "record_id")).alias("_at"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("request_id").orderBy("_at"))).where(F.col("pos") <= total).drop("_at")


TYPED = ("failed", "decision", "constraint")
#: Kinds of keys.
_PATH, _SYMBOL = 0, 1


def _keys(q: DataFrame, column: str, kind: int) -> DataFrame:
    return q.select("request_id", "project_key", F.lit(kind).alias("kind"), F.posexplode(column).alias("key_pos", "key"))


def key_hits(keys: DataFrame, ix: Index, kinds=(_PATH, _SYMBOL)) -> DataFrame:
    """(request_id, kind, key_pos, id, type) of the records with a key: paths and symbols in one join."""
    both = [p.withColumn("kind", F.lit(k)) for k, p in ((_PATH, ix.paths), (_SYMBOL, ix.symbols)) if k in kinds]
    postings = both[0] if len(both) == 1 else both[0].unionByName(both[1])
    return postings.join(few(keys), ["project_key", "kind", "key"]).select("request_id", "kind", "key_pos", F.col("record_id").alias("id"), "type")


def first_hits(hits: DataFrame, by: list[str], per: int, total: int) -> DataFrame:
    """(request_id, kind, *by, id, pos): ``per`` records of each key in id order, first seen, ``total`` altogether."""
    few = store.top(hits, ["request_id", "kind", *by, "key_pos"], ["id"], per)
    first = few.groupBy("request_id", "kind", *by, "id").agg(F.min(F.struct("key_pos", "id")).alias("_at"))
    w = Window.partitionBy("request_id", "kind", *by).orderBy("_at")
    return first.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= total).drop("_at")


def typed_hits(hits: DataFrame, limit: int, src: int) -> DataFrame:
    """(request_id, id, src, pos): path hits, then symbol hits of each lasting type, ``limit`` together."""
    found = first_hits(hits.where(F.col("type").isin(*TYPED)), ["type"], S.PER_KEY_CAP, limit)
    both = found.groupBy("request_id", "type", "id").agg(F.min(F.col("pos") + 1000 * F.col("kind")).alias("pos"))
    order = F.array_position(F.array(*map(F.lit, TYPED)), F.col("type")).cast("int")
    return store.top(both, ["request_id", "type"], ["pos"], limit).select("request_id", "id", (order - 1 + src).alias("src"), F.col("pos").cast("int").alias("pos"))


def unite(parts: list[tuple[int, DataFrame]], limit: int = S.CANDIDATE_CAP) -> DataFrame:
    """Ordered union of (rank, generator): first seen stays, at most ``limit`` (U2, K9). Rank None: the rows' own ``src``."""
    rows = None
    for rank, p in parts:
        p = p.select("request_id", "id", F.col("src") if rank is None else F.lit(rank).alias("src"), F.col("pos").cast("int").alias("pos"))
        rows = p if rows is None else rows.unionByName(p)
    first = rows.groupBy("request_id", "id").agg(F.min(F.struct("src", "pos")).alias("_at"))
    w = Window.partitionBy("request_id").orderBy("_at", "id")
    return first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select("request_id", "id", "n")


def vector_hits(q: DataFrame, vectors: DataFrame, claims: DataFrame, cap: int = S.VECTOR_CAP) -> DataFrame:
    """(request_id, id, cosine, pos): exact neighbours inside the project, model and dimension."""
    v = vectors.join(claims.select(F.col("id").alias("record_id")), "record_id", "left_semi")
    asked = q.where("query_vec is not null").select("request_id", "project_key", "model", "query_vec")
    near = blocks.neighbours(asked, v.select("record_id", "project_key", "model", "vec"), cap)
    w = Window.partitionBy("request_id").orderBy(F.desc("cosine"), "id")
    return near.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= cap).select("request_id", "id", "cosine", "pos")


def candidates(q: DataFrame, ix: Index, vectors: DataFrame | None = None):
    """(candidates, full-text scores, cosines, hop paths) of all requests."""
    head, rest = q.where("head"), q.where("not head")
    priority = head.join(store.head_priority(ix.claims), "project_key").select("request_id", "id", "pos")
    few = priority.groupBy("request_id").agg(F.count(F.lit(1)).alias("k"))
    states = store.by_type(ix.claims, "state", S.COLD_STATE_CAP)
    states = states.withColumn("pos", F.row_number().over(Window.partitionBy("project_key").orderBy(F.desc("created_at"), F.desc("seq"))))
    cold = head.join(few, "request_id", "left").where(F.coalesce("k", F.lit(0)) < S.COLD_PRIORITY_CAP).join(states.select("project_key", "id", "pos"), "project_key").select("request_id", "id", "pos")

    terms = rest.select("request_id", "project_key", F.explode("lookup").alias("_t")).select("request_id", "project_key", F.explode(X.index_terms("_t")).alias("term")).distinct()
    fts = search(terms, ix.terms, ix.n, ix.mean_len)
    w = Window.partitionBy("request_id").orderBy(F.desc("bm25"), "record_id")
    fts = fts.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= S.FTS_CAP).select("request_id", F.col("record_id").alias("id"), "bm25", "pos")
    hits = key_hits(_keys(rest, "path_keys", _PATH).unionByName(_keys(rest, "symbols", _SYMBOL)), ix)
    plain = first_hits(hits, [], S.PER_KEY_CAP, S.POSTING_CAP).withColumn("src", F.col("kind") + 3)
    parts = [(0, priority), (1, cold), (2, fts), (None, plain), (None, typed_hits(hits, S.TYPE_CAP, 5))]
    knn = vector_hits(rest, vectors, ix.claims) if vectors is not None else None
    if knn is not None:
        parts.append((8, knn))
    found = cut(unite(parts))

    # two hops: files of the first hits of pathless requests
    pathless = rest.where(F.size("path_keys") == 0).select("request_id", "project_key")
    seen = found.where(F.col("n") <= S.INFER_FIRST).join(pathless, "request_id").join(ix.claims.select("id", "paths"), "id")
    keys = seen.select("request_id", "project_key", "n", F.posexplode(P.path_keys("paths")).alias("p", "key"))
    keys = keys.groupBy("request_id", "project_key", "key").agg(F.min(F.struct("n", "p")).alias("_at"))
    keys = cut(keys.withColumn("key_pos", F.row_number().over(Window.partitionBy("request_id").orderBy("_at"))).where(F.col("key_pos") <= S.INFER_PATHS).drop("_at"))
    hops = typed_hits(key_hits(keys.withColumn("kind", F.lit(_PATH)), ix, (_PATH,)), S.INFER_TYPE_CAP, 9)
    hop = keys.groupBy("request_id").agg(F.collect_list("key").alias("hop_paths"))
    recent = store.by_type(ix.claims, "failed", S.RECENT_FAILED_CAP)
    recent = recent.withColumn("pos", F.row_number().over(Window.partitionBy("project_key").orderBy(F.desc("created_at"), F.desc("seq"))))
    empty = rest.join(found, "request_id", "left_anti").select("request_id", "project_key").join(recent.select("project_key", "id", "pos"), "project_key")
    all_ = unite([(0, found.withColumnRenamed("n", "pos")), (None, hops), (20, empty)])
    return all_, fts.select("request_id", "id", "bm25"), (knn.select("request_id", "id", "cosine") if knn is not None else None), hop


def topic_tokens(text="text", paths="paths") -> Column:
    """Tokens without the claim's own paths, base names and stems."""
    none = F.lit(" ")

    def cut(s, p):
        n = P.slashes(p)
        base = X.base_name(p)
        s = F.replace(F.replace(s, p, none), n, none)
        s = F.when(base != "", F.replace(s, base, none)).otherwise(s)
        return F.when((X.stem(p) != base) & (X.stem(p) != ""), F.replace(s, X.stem(p), none)).otherwise(s)

    return X.tokens(F.aggregate(X.col(paths), X.col(text), cut))


def _by_file(c: DataFrame) -> DataFrame:
    """A row for each base name of a candidate."""
    return c.withColumn("k", F.explode("cluster"))


def conflicts(c: DataFrame) -> DataFrame:
    """(request_id, id) of older decisions and constraints that a newer one of the type replaces."""

    def older(i, j, at, n):
        first, last = np.where(n[i] < n[j], i, j), np.where(n[i] < n[j], j, i)
        dated = (at[i] >= 0) & (at[j] >= 0)
        return np.where(dated & (at[first] >= at[last]), last, first)[n[i] != n[j]]

    return blocks.within(_by_file(c.where(F.col("type").isin("decision", "constraint"))), ["request_id", "k", "type"], "words", S.CONFLICT, older)


def invalidated(c: DataFrame) -> DataFrame:
    """(request_id, id) of decisions and constraints that a newer failed on the same file and topic undoes."""
    return blocks.between(_by_file(c.where("type = 'failed'")), _by_file(c.where(F.col("type").isin("decision", "constraint"))), ["request_id", "k"], "topic", S.INVALIDATE)


def type_recency(kind, age) -> Column:
    """R23."""
    half = F.coalesce(F.try_element_at(F.create_map(*[x for t, d in S.HALF_LIFE_DAYS.items() for x in (F.lit(t), F.lit(float(d)))]), X.col(kind)), F.lit(14.0))
    return F.when(X.col(kind) == "constraint", 1.0).otherwise(F.pow(F.lit(0.5), age / half))


def features(c: DataFrame) -> DataFrame:
    """Feature columns of request x candidate rows."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[x for t, r in rules.TYPE_PRIORITY.items() for x in (F.lit(t), F.lit(r))]), F.col("type")), F.lit(0))
    keys, mine = P.path_keys("paths"), F.transform("symbols", F.lower)
    c = c.withColumns({"type_rank": rank.cast("double"), "recency": type_recency("type", H.age_days("created_at", "now")), "path": X.jaccard("path_keys", keys), "symbol": X.jaccard("query_symbols", mine), "vector": F.when(F.col("cosine") > 0, F.least("cosine", F.lit(1.0))).otherwise(0.0).cast("double"), "is_fts": F.col("bm25_raw").isNotNull()})
    c = c.withColumn("hop", F.when((F.col("path") == 0) & F.col("hop_paths").isNotNull(), X.jaccard("hop_paths", keys)).otherwise(0.0))
    yes = lambda x: F.when(x, 1.0).otherwise(0.0)
    c = c.withColumn("agree", (yes(F.col("is_fts")) + yes(F.col("path") > 0) + yes(F.col("symbol") > 0)) / 3)
    c = c.withColumn("hits", content_overlap("tokens", job_text("text")))
    strong = (F.col("path") > 0) | F.arrays_overlap("query_symbols", mine) | (F.col("symbol") >= S.STRONG_SYMBOL) | (F.col("hits") >= S.STRONG_TOKENS) | (F.col("vector") >= S.VECTOR_GATE)
    c = c.withColumn("strong", F.coalesce(strong, F.lit(False))).withColumn("weak", ~F.col("strong") & (F.col("hits") >= 1))
    failed, shipped = F.col("type") == "failed", F.col("type").isin("decision", "state", "constraint")
    c = c.withColumns({"failed_overlap": yes(failed & F.col("strong")), "failed_weak": yes(failed & F.col("weak")), "shipped_overlap": yes(shipped & F.col("strong")), "shipped_weak": yes(shipped & F.col("weak"))})
    topical = (F.col("path") > 0) | (F.col("symbol") > 0) | (content_overlap("tokens", "text") > 0)
    c = c.withColumn("dwelt", yes(F.array_contains("dwell", F.col("id")) & (F.col("continued") | topical)))
    again = F.array_contains("served", F.col("id")) & (F.col("dwelt") == 0) & (F.col("failed_overlap") == 0) & (F.col("shipped_overlap") == 0)
    return c.withColumn("was_served", yes(again)).withColumn("off_path", (F.size("path_keys") > 0) & (F.col("path") == 0))


def normal_bm25() -> Column:
    """Min-max over the request's full-text hits; all equal is 1, others 0."""
    w = Window.partitionBy("request_id")
    lo, hi = F.min("bm25_raw").over(w), F.max("bm25_raw").over(w)
    return F.when(F.col("bm25_raw").isNull(), 0.0).when(lo == hi, 1.0).otherwise((F.col("bm25_raw") - lo) / (hi - lo))


def pre_stale() -> Column:
    """The score before staleness."""

    def weight(i):
        return F.try_element_at(F.create_map(*[x for p, m in S.MIX.items() for x in (F.lit(p), F.lit(m[i]))]), F.col("profile"))

    parts = [F.col("type_rank") / 5, F.col("path"), F.col("symbol"), F.col("bm25"), F.col("vector"), F.col("recency"), F.col("agree")]
    answer = sum((weight(i) * p for i, p in enumerate(parts)), F.lit(0.0))
    mixed = F.when(F.col("off_path"), answer * (1 - S.W_OFF_PATH)).otherwise(answer)
    jobs = S.W_FAILED * (F.col("failed_overlap") + S.W_FAILED_WEAK * F.col("failed_weak")) + S.W_SHIPPED * (F.col("shipped_overlap") + S.W_SHIPPED_WEAK * F.col("shipped_weak"))
    return F.when(F.col("head"), answer).otherwise(jobs + mixed + S.W_DWELL * F.col("dwelt") - S.W_SERVED * F.col("was_served"))


def stale(c: DataFrame, files: DataFrame | None) -> DataFrame:
    """``stale``: among a request's first 30, a file of the claim is newer than the claim saw it."""
    if files is None:
        return c.withColumn("stale", F.lit(False))
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), F.desc("created_at"), F.desc("id"))
    first = c.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= S.STALE_CAP)
    seen = first.select("request_id", "id", "workspace_root", F.explode("path_mtime").alias("path", "_seen"))
    newer = seen.join(files.select("workspace_root", "path", "mtime_ms"), ["workspace_root", "path"]).where("mtime_ms > _seen").select("request_id", "id").distinct().withColumn("stale", F.lit(True))
    return c.join(newer, ["request_id", "id"], "left").withColumn("stale", F.coalesce("stale", F.lit(False)))


_PACKED = "request_id string, rank int, id string, score double, stale boolean, warning string, reason string"
_ROW = ["request_id", "id", "type", "text", "created_at", "paths", "harness", "status", "source", "has_ref", "claim_hash", "cluster", "score", "path", "symbol", "hop", "failed_overlap", "shipped_overlap", "off_path", "stale", "limit_tokens", "head"]


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = pdf.to_dict("records")
    packed, left = pack.run(rows, int(rows[0]["limit_tokens"]), bool(rows[0]["head"]))
    out = [(c["request_id"], i + 1, c["id"], c["score"], c["stale"], pack.warning(c), None) for i, c in enumerate(packed)]
    out += [(c["request_id"], None, c["id"], c["score"], c["stale"], None, r) for c, r in left]
    return pd.DataFrame(out, columns=["request_id", "rank", "id", "score", "stale", "warning", "reason"]).astype({"rank": "Int32"})


def prepare(requests: DataFrame, ix: Index, actions=None, tail=None, vectors=None, files=None):
    """(query rows, scored candidates, dropped (request_id, id, reason))."""
    q = cut(hydrate(compile_thin(normalise(requests), tail, ix.claims), actions, ix.claims))
    found, fts, knn, hop = candidates(q, ix, vectors)
    # names of the query's columns that claims have too
    asked = q.select("request_id", "tokens", "path_keys", F.col("symbols").alias("query_symbols"), "served", "dwell", "continued", "limit_tokens", "now", "head", "profile", F.col("project_key").alias("asked_project"))
    c = found.join(asked, "request_id").join(ix.claims, "id")
    c = c.join(fts.withColumnRenamed("bm25", "bm25_raw"), ["request_id", "id"], "left").join(hop, "request_id", "left")
    c = c.join(knn, ["request_id", "id"], "left") if knn is not None else c.withColumn("cosine", F.lit(None).cast("float"))
    c = c.join(store.has_live_work(ix.claims).select(F.col("project_key").alias("asked_project"), "live"), "asked_project", "left")
    newest = Window.partitionBy("request_id", "claim_hash").orderBy(F.desc("created_at"), F.desc("n"))
    place = F.min("n").over(Window.partitionBy("request_id", "claim_hash"))
    c = c.withColumn("reason", F.when(F.coalesce("live", F.lit(False)) & store.is_fixture("session_id"), "fixture-session").when(store.is_noise(), "extract-noise"))
    c = cut(c)
    noisy = c.where("reason is not null").select("request_id", "id", "reason")
    c = c.where("reason is null").withColumn("_d", F.row_number().over(newest)).withColumn("n", place)
    doubles = c.where("_d > 1").select("request_id", "id", F.lit("duplicate").alias("reason"))
    c = c.where("_d = 1").drop("_d", "reason").withColumns({"cluster": P.cluster(P.path_keys("paths")), "words": X.tokens("text"), "topic": topic_tokens()})
    c = cut(c)
    old = cut(conflicts(c))
    c = c.join(old, ["request_id", "id"], "left_anti")
    undone = cut(invalidated(c))
    c = features(c.join(undone, ["request_id", "id"], "left_anti"))
    c = c.withColumn("bm25", normal_bm25()).withColumn("score", pre_stale())
    c = stale(c, files).withColumn("score", F.col("score") - F.when(F.col("stale"), S.W_STALE).otherwise(0.0))
    dropped = noisy.union(doubles).union(old.withColumn("reason", F.lit("older-conflict"))).union(undone.withColumn("reason", F.lit("invalidated")))
    return q, c.withColumn("has_ref", F.col("transcript_ref").isNotNull()), dropped


def explain(requests: DataFrame, ix: Index, **more) -> DataFrame:
    """Every candidate with its score, its rank if packed, or the reason why not."""
    _, c, dropped = prepare(requests, ix, **more)
    packed = c.select(*_ROW).groupBy("request_id").applyInPandas(_pack, _PACKED)
    why = F.when(F.col("rank").isNotNull(), F.format_string("packed #%d score %.3f", "rank", "score")).otherwise(F.concat_ws(" ", F.lit("dropped:"), F.col("reason"), F.when(F.col("score").isNotNull(), F.format_string("score %.3f", "score"))))
    early = dropped.select("request_id", F.lit(None).cast("int").alias("rank"), "id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("stale"), F.lit(None).cast("string").alias("warning"), "reason")
    return packed.unionByName(early).withColumn("why", why)


def ask(requests: DataFrame, ix: Index, excerpts: DataFrame | None = None, **more) -> DataFrame:
    """Packed hits of every request, best first."""
    from worklode.operators.extract import covering_excerpt

    picked = cut(explain(requests, ix, **more).where("rank is not null").select("request_id", "rank", "id", "score", "stale", "warning"))
    hits = picked.join(ix.claims, "id")
    if excerpts is None:
        hits = hits.withColumn("has_excerpt", F.col("transcript_ref").isNotNull())
    else:
        covered = covering_excerpt(ix.claims.join(picked.select("id").distinct(), "id", "left_semi"), excerpts).select("id", F.lit(True).alias("has_excerpt"))
        hits = hits.join(covered, "id", "left").withColumn("has_excerpt", F.coalesce("has_excerpt", F.lit(False)))
    text = F.when(F.col("stale"), F.concat(F.lit("[verify] "), F.col("text"))).otherwise(F.col("text"))
    return hits.select("request_id", "rank", "id", "type", text.alias("text"), F.col("created_at").alias("when"), "paths", "harness", "status", "source", "has_excerpt", "score", "warning")


def responses(hits: DataFrame) -> DataFrame:
    """(request_id, context, warnings, tokens): one row for each request with hits."""
    hit = F.struct("rank", "id", "type", "text", "when", "paths", "harness", "status", "source", "has_excerpt")
    r = hits.groupBy("request_id").agg(F.sort_array(F.collect_list(hit)).alias("context"), F.sort_array(F.collect_list(F.when(F.col("warning").isNotNull(), F.struct("rank", "warning")))).alias("w"))
    r = r.withColumn("warnings", F.array_distinct(F.transform("w", lambda x: x["warning"])))
    body = F.to_json(F.transform("context", lambda x: x.dropFields("rank")))
    size = F.octet_length(body) + 5 * F.regexp_count(body, F.lit("[<>&]"))
    told = F.array_join("warnings", "\n")
    tokens = F.greatest(F.lit(1), F.floor((size + 3) / 4)) + F.when(F.size("warnings") > 0, X.estimate_tokens(told)).otherwise(0)
    return r.select("request_id", "context", "warnings", tokens.cast("int").alias("tokens"))
