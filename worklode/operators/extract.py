"""Claims from messages (T1, W4, W6, W8) and excerpt windows."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklode import schemas as S
from worklode.functions import gates, rules
from worklode.functions import paths as P
from worklode.functions import sentences as C
from worklode.functions import text as X
from worklode.functions.hashes import claim_hash, new_id

#: Bytes of a range of offsets in which spans and excerpts meet.
_NEARBY = 1 << 16
_SESSION = ("project_key", "session_id")


def in_tail(messages: DataFrame, n: int = S.TAIL_MESSAGES, size: int = S.TAIL_BYTES) -> Column:
    """Is a message among the last ``n`` and last ``size`` bytes of its session? The last one always is."""
    w = Window.partitionBy(*_SESSION).orderBy(F.desc("offset"))
    at = F.row_number().over(w)
    total = F.sum(F.octet_length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (at == 1) | ((at <= n) & (total <= size))


def with_nearby(messages: DataFrame) -> DataFrame:
    """``near``: paths of up to three preceding user messages, latest first; none for user messages.

    Users' paths are chained over user rows only, so no row gathers its history.
    """
    own = F.when(F.col("role") == "user", X.uniq(P.find_paths("text")))
    users = Window.partitionBy(*_SESSION, F.col("role") == "user").orderBy("offset")
    three = F.when(F.col("role") == "user", F.flatten(F.filter(F.array("_own", F.lag("_own", 1).over(users), F.lag("_own", 2).over(users)), lambda p: p.isNotNull())))
    before = Window.partitionBy(*_SESSION).orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    out = messages.withColumn("_own", own).withColumn("_three", three)
    near = F.when(F.col("role") == "user", X.strings(())).otherwise(F.coalesce(F.last("_three", True).over(before), X.strings(())))
    return out.withColumn("near", near).drop("_own", "_three")


def _here(c: Column) -> Column:
    """``c``, made in this step only: a filter on it is not moved below, where all its parts would be made again for each use."""
    return F.when(F.spark_partition_id() >= 0, c)


def judged_sentences(messages: DataFrame, typed: bool = False) -> DataFrame:
    """Every sentence of usable, non-tool messages with its type and, if it is no claim, the reason.

    ``typed`` leaves out those that can be no claim for their length or want of a
    type, before the costly rules.
    """
    usable = messages.where("not skip")
    m = with_nearby(usable.withColumn("tail", in_tail(usable))).where("role <> 'tool'")
    s = m.select("*", F.posexplode(C.split_sentences("text")).alias("sentence_no", "sentence"))
    size = F.octet_length("sentence")
    if typed:
        s = s.where(size.between(12, 600))
    s, said = gates.held(s, "sentence")
    s = s.withColumn("_probe", C.probe(said.s.low)).withColumn("type", _here(C.classify(said.s, "error", "role", "_probe")))
    if typed:
        s = s.where("type is not null")
    s = s.withColumn("paths", P.filter_paths(X.uniq(F.concat(P.find_paths("sentence"), F.col("near")))))
    failed = F.col("type") == "failed"
    reason = (
        F.when(gates.skip_prose(said), "skip-prose")
        .when(C.skip_sentence(said), "list-chrome")
        .when((F.col("type") == "state") & gates.process_state(said.s), "process-state")
        .when(failed & gates.status_failed(said.s), "status-failed")
        .when(failed & gates.failed_as_object(said.s), "failed-as-object")
        .when(failed & ~C.grounded_failed(said.s, "paths"), "ungrounded-failed")
        .when(F.col("type").isNull(), "untyped")
        .when(F.col("type").isin("state", "thread") & ~F.col("tail"), "state-not-in-tail")
        .when((size < 12) | (size > 600), "length")
        .when(P.drop_claim("sentence", "paths"), "redact")
    )
    return s.withColumn("reason", _here(reason)).drop(*[c for c in s.columns if c.startswith("_sentence_")], "_probe")


def cap(rows: list[dict]) -> list[dict]:
    """At most 12 drafts, 5 of a type, few of a directory; those with paths first."""
    rows = sorted(rows, key=lambda r: (-rules.TYPE_PRIORITY[r["type"]], r["offset"], r["sentence_no"]))
    if len(rows) <= S.EXTRACT_CAP:
        return rows
    of_type: dict = {}
    of_dir: dict = {}
    kept: list[dict] = []
    for r in sorted(rows, key=lambda r: not len(r["paths"])):
        where = r["paths"][0] if len(r["paths"]) else ""
        where = where.rsplit("/", 1)[0] if where.rfind("/") > 0 else where
        limit = S.DIR_CAP_LASTING if r["type"] in ("decision", "constraint") else S.DIR_CAP
        slot = (r["type"], where)
        if of_type.get(r["type"], 0) >= S.EXTRACT_TYPE_CAP or (where and of_dir.get(slot, 0) >= limit) or len(kept) >= S.EXTRACT_CAP:
            continue
        kept.append(r)
        of_type[r["type"]] = of_type.get(r["type"], 0) + 1
        of_dir[slot] = of_dir.get(slot, 0) + 1
    return kept


def extract(messages: DataFrame, now: Column | None = None) -> DataFrame:
    """Claims of each (project, session) batch of messages, with ``created_at`` of ``now``."""
    drafts = judged_sentences(messages, typed=True).where("reason is null").withColumn("claim_hash", claim_hash("project_key", "type", "sentence"))
    first = Window.partitionBy(*_SESSION, "claim_hash").orderBy("offset", "sentence_no")
    drafts = drafts.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    drafts = drafts.select(*_SESSION, "harness", "source", "type", F.col("sentence").alias("text"), F.slice("paths", 1, 8).alias("paths"), "claim_hash", "offset", "sentence_no", F.octet_length("text").alias("size"))

    def limited(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(cap(pdf.to_dict("records")), columns=pdf.columns)

    kept = drafts.groupBy(*_SESSION).applyInPandas(limited, drafts.schema)
    at = F.current_timestamp() if now is None else now
    end = F.greatest(F.col("offset") + F.col("size"), F.col("offset") + 1)
    return kept.select(
        new_id(at, "project_key", "session_id", "claim_hash", "offset").alias("id"),
        "type",
        "project_key",
        F.lit(None).cast("string").alias("workspace_root"),
        "harness",
        "session_id",
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        "text",
        F.lit(None).cast("string").alias("why"),
        "paths",
        X.symbols("text", "paths").alias("symbols"),
        F.create_map().cast("map<string,bigint>").alias("path_mtime"),
        F.lit("active").alias("status"),
        F.lit(None).cast("string").alias("supersedes"),
        "source",
        "claim_hash",
        F.struct(F.col("session_id"), F.col("offset").alias("start_offset"), end.alias("end_offset")).alias("transcript_ref"),
        (F.col("offset") * 1000 + F.col("sentence_no")).alias("seq"),
    )


def trace(messages: DataFrame) -> DataFrame:
    """Sentences for each reason of skipping, and those that became drafts."""
    return judged_sentences(messages).groupBy(F.coalesce("reason", F.lit("draft")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def chunk_pieces(pieces: list[tuple[int, int, str]]):
    """(start, end, text) windows of at least 800 and about 1200 bytes; one piece of overlap after two or more."""
    i = 0
    while i < len(pieces):
        text, size, j = [], 0, i
        while j < len(pieces):
            n = len(pieces[j][2].encode())
            if size >= S.EXCERPT_MIN and size + n > S.EXCERPT_TARGET:
                break
            text.append(pieces[j][2])
            size += n
            j += 1
            if size >= S.EXCERPT_TARGET:
                break
        yield pieces[i][0], pieces[j - 1][1], "".join(text)
        if j >= len(pieces):
            return
        i = j - 1 if j - i > 1 else j


def excerpts(messages: DataFrame, month: Column) -> DataFrame:
    """Excerpt windows of each (project, session) batch."""
    body = X.clip("text")
    end = F.greatest(F.col("offset") + F.octet_length("text"), F.col("offset") + 1)
    piece = F.concat(F.when(F.col("role") == "", "other").otherwise(F.col("role")), F.lit(": "), body, F.lit("\n"))
    pieces = messages.where(X.trim(body) != "").select(*_SESSION, "offset", end.alias("end"), piece.alias("piece"))

    def windows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        project, session = pdf.project_key.iloc[0], pdf.session_id.iloc[0]
        rows = [
            (hashlib.sha256(f"{session}\0{a}\0{b}".encode()).hexdigest(), session, project, a, b, t)
            for a, b, t in chunk_pieces(list(zip(pdf.offset.tolist(), pdf.end.tolist(), pdf.piece.tolist(), strict=True)))
        ]
        return pd.DataFrame(rows, columns=["id", "session_id", "project_key", "start_offset", "end_offset", "text"])

    out = pieces.groupBy(*_SESSION).applyInPandas(windows, S.EXCERPTS.rsplit(", ", 1)[0])
    return out.withColumn("month", month)


def covering_excerpt(claims: DataFrame, stored: DataFrame) -> DataFrame:
    """The smallest excerpt that covers a claim's span, in the newest of 13 months back that has one.

    An equi-join on the session and a range of offsets with bounds beside it, so spans meet only excerpts nearby.
    """
    c = claims.where("transcript_ref is not null").select("id", "created_at", F.col("transcript_ref.session_id").alias("session_id"), F.col("transcript_ref.start_offset").alias("a"), F.greatest("transcript_ref.end_offset", "transcript_ref.start_offset").alias("b"))
    first = F.trunc(F.coalesce(F.try_to_timestamp("created_at"), F.current_timestamp()), "month")
    c = c.withColumns({"newest": F.date_format(first, "yyyy-MM"), "oldest": F.date_format(F.add_months(first, -12), "yyyy-MM")})
    place = lambda x: F.floor(F.col(x) / _NEARBY).cast("long")
    c = c.withColumn("place", place("a"))
    e = stored.select(F.col("session_id"), F.col("id").alias("excerpt_id"), "start_offset", "end_offset", F.col("text").alias("excerpt"), "month")
    e = e.withColumn("place", F.explode(F.sequence(place("start_offset"), F.greatest(place("start_offset"), place("end_offset")))))
    both = c.join(e, (c.session_id == e.session_id) & (c.place == e.place) & (e.start_offset <= c.a) & (e.end_offset >= c.b) & e.month.between(c.oldest, c.newest))
    w = Window.partitionBy("id").orderBy(F.desc("month"), F.col("end_offset") - F.col("start_offset"), "excerpt_id")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("id", "excerpt_id", "excerpt", "month")
