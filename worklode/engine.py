"""The engine: a store of relations, and the calls a user makes on it (§ API).

Every call that writes adds its rows to all relations by one version of the
ledger; what a relation is follows from its rows when it is read (the latest
cursor, one active claim for each hash, the last 40 actions). A streaming batch
leaves its number in the version that holds its rows, so a replay does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklode import schemas as S
from worklode.functions import embed
from worklode.functions import hashes as H
from worklode.functions import paths as P
from worklode.functions import text as X
from worklode.ledger import SEQ_BITS, Ledger
from worklode.operators import extract, store
from worklode.plans import ask as A
from worklode.plans import index as I
from worklode.sources import locate as L
from worklode.sources.files import allowed
from worklode.sources.sqlite import SqliteSource
from worklode.sources.transcripts import parse_sessions
from worklode.streaming.tail import TailSource

#: Relations as they are read.
RELATIONS = {"claims": S.CLAIMS, "excerpts": S.EXCERPTS, "actions": S.ACTIONS, "sessions": S.SESSIONS, "cursors": "path string, cursor bigint, seq bigint", "tape": "project_key string, session_id string, month string, line string, seq bigint", "vectors": S.VECTORS, "terms": S.TERMS}
#: Columns that are only stored.
_EXTRA = {"claims": ", doc_len int", "excerpts": ", seq bigint", "vectors": ", seq bigint"}
_RESOLVE = {
    "claims": store.resolve_claims,
    "excerpts": lambda t: store.top(t, ["id", "month"], [F.desc("seq")], 1),
    "actions": lambda t: store.top(t, ["project_key", "session_id"], [F.desc("at"), F.desc("seq")], S.ACTION_CAP),
    "sessions": lambda t: store.latest(t, "jsonl"),
    "cursors": lambda t: store.latest(t, "path"),
    "vectors": lambda t: store.top(t, ["record_id", "model", "dim"], [F.desc("seq")], 1),
}
#: Projects whose keys are told to the scan one by one.
_LISTED = 1000


def is_compact(source: str) -> bool:
    """Does a source end in a compaction (H11)?"""
    return "compact" in source.strip().lower()


class Conflict(Exception):
    """An append at another offset than the accepted one."""

    def __init__(self, accepted: int):
        super().__init__(f"offset conflict: accepted {accepted}")
        self.accepted = accepted


class Engine:
    def __init__(self, spark: SparkSession, root: str, embedder=None):
        self.spark, self.root, self.embedder = spark, root.rstrip("/"), embedder
        self.ledger = Ledger(spark, root)
        spark.dataSource.register(TailSource)
        spark.dataSource.register(SqliteSource)

    # -- relations --------------------------------------------------------------------
    def _rows(self, name: str, projects: list[str] | None = None) -> DataFrame:
        raw = self.ledger.rows(name, RELATIONS[name] + _EXTRA.get(name, ""))
        return raw if projects is None else raw.where(F.col("project_key").isin(projects))

    def read(self, name: str, projects: list[str] | None = None) -> DataFrame:
        """A relation as the newest version has it, of some projects if named."""
        raw = self._rows(name, projects)
        resolved = _RESOLVE[name](raw) if name in _RESOLVE else raw
        return resolved.select(*[f.split()[0] for f in _fields(RELATIONS[name])])

    def _base(self) -> int:
        """The first sequence number of the next version."""
        return (self.ledger.head()["number"] + 1) << SEQ_BITS

    @staticmethod
    def _numbered(df: DataFrame, base: int) -> DataFrame:
        n = F.monotonically_increasing_id()
        return df.withColumn("seq", F.lit(base) + F.shiftright(n, 33) * (1 << 24) + n.bitwiseAND(F.lit((1 << 33) - 1)))

    def _claim_parts(self, claims: DataFrame, base: int) -> dict[str, DataFrame]:
        """What a write of claims adds: the claims, their full-text terms, their vectors."""
        ready = store.prepare(claims)
        docs = I.bodies(ready, status=None)
        sized = docs.select(F.col("record_id").alias("id"), F.size(X.index_terms("body")).alias("doc_len"))
        parts = {"claims": ready.join(sized.dropDuplicates(["id"]), "id"), "terms": I.terms(docs).join(ready.select(F.col("id").alias("record_id"), "seq"), "record_id")}
        if self.embedder is not None:
            parts["vectors"] = embed.vectors_for(ready, self.embedder).withColumn("seq", F.lit(base))
        return parts

    def _commit(self, parts: dict[str, DataFrame], applied: tuple[str, int] | None = None, check=None) -> None:
        staged = {}
        for name, df in parts.items():
            columns = [f.split()[0] for f in _fields(RELATIONS[name] + _EXTRA.get(name, ""))]
            staged[name] = self.ledger.stage(name, df.select(*columns))
        self.ledger.commit(staged, applied, check)

    # -- ingest ----------------------------------------------------------------------
    def ingest(self, chunks: DataFrame, now=None, applied: tuple[str, int] | None = None, check=None) -> None:
        """Chunks (project_key, session_id, harness, source, base, chunk, path, end): tape, excerpts, claims, sessions, cursors.

        ``base`` is the byte at which a chunk begins, ``end`` its path's cursor
        afterwards. ``applied`` is a stream and its batch: done once.
        """
        with self.ledger.lock:
            if applied and self.ledger.head()["applied"].get(applied[0], -1) >= applied[1]:
                return
            base = self._base()
            chunks = chunks.withColumn("project_key", P.project_key("project_key")).persist()
            now = F.current_timestamp() if now is None else now
            month = F.date_format(now, "yyyy-MM")
            lines = chunks.select("project_key", "session_id", "base", F.posexplode(F.split("chunk", "\n")).alias("n", "line"))
            tape = lines.where(X.trim("line") != "").select("project_key", "session_id", month.alias("month"), P.redact_line("line").alias("line"), (F.lit(base) + F.col("base") + F.col("n")).alias("seq"))
            clean = chunks.withColumn("chunk", F.array_join(F.transform(F.split("chunk", "\n"), lambda x: F.when(P.has_secret(x), F.rpad(F.lit('{"_redacted":1}'), F.octet_length(x), " ")).otherwise(x)), "\n"))
            messages = parse_sessions(clean).persist()
            claims = A.cut(extract.extract(messages, now).withColumn("seq", F.lit(base) + F.col("seq")))
            seen = chunks.select(F.col("path").alias("jsonl"), "session_id", "harness", F.lit(None).cast("string").alias("workspace"), "project_key", F.lit(base).alias("seq"))
            cursors = chunks.select("path", F.col("end").alias("cursor"), F.lit(base).alias("seq"))
            windows = extract.excerpts(messages.where("not skip"), month).withColumn("seq", F.lit(base))
            try:
                self._commit({"tape": tape, "excerpts": windows, **self._claim_parts(claims, base), "sessions": seen, "cursors": cursors}, applied, check)
            finally:
                messages.unpersist()
                chunks.unpersist()

    def _unread(self, chunks: DataFrame) -> DataFrame:
        """Chunks without the bytes before their path's cursor; a file that ends before it was begun anew and counts whole."""
        known = self._rows("cursors").join(F.broadcast(chunks.select("path").distinct()), "path", "left_semi")  # a batch's paths
        j = chunks.join(store.latest(known, "path").select("path", "cursor"), "path", "left")
        cut = F.when((F.col("base") < F.col("cursor")) & (F.col("cursor") <= F.col("end")), F.col("cursor")).otherwise(F.col("base"))
        rest = F.substring(F.col("chunk").cast("binary"), (cut - F.col("base") + 1).cast("int"), F.lit(1 << 30)).cast("string")
        return j.withColumn("chunk", rest).withColumn("base", cut).where("base < end").drop("cursor")

    def watch(self, folder: str, checkpoint: str, project: str | None = None, harness: str = "other", interval: str | None = None):
        """Tail a folder: once over what is there, or every ``interval`` (ST1, ST2)."""

        def batch(df: DataFrame, number: int) -> None:
            session = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
            key = F.lit(project) if project else P.decode_key(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
            with self.ledger.lock:
                fresh = self._unread(df.select(key.alias("project_key"), session.alias("session_id"), F.lit(harness).alias("harness"), F.lit("turn").alias("source"), "base", "end", "chunk", "path"))
                self.ingest(fresh, applied=(checkpoint.rstrip("/"), number))

        stream = self.spark.readStream.format("worklode_tail").option("path", folder).load().writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (stream.trigger(processingTime=interval) if interval else stream.trigger(availableNow=True)).start()

    def catch_up_sqlite(self, db: str, project: str, harness: str = "opencode", now=None) -> None:
        """All sessions of a SQLite store that changed since their cursor (S10, S11, ST4, ST5)."""
        found = self.spark.read.format("worklode_sqlite").option("path", db).load()
        with self.ledger.lock:
            cursor = self.read("cursors").select("path", F.col("cursor").alias("_c"))
            due = found.withColumn("path", F.concat(F.lit(f"sqlite:{harness}:"), "session_id")).join(cursor, "path", "left").where("_c is null or _c < updated")
            self.ingest(due.select(F.lit(project).alias("project_key"), "session_id", F.lit(harness).alias("harness"), F.lit("turn").alias("source"), F.lit(0).cast("long").alias("base"), F.col("updated").alias("end"), "chunk", "path"), now)

    def append(self, client: str, session: str, project: str, offset: int, body: str, harness: str = "other", now=None) -> int:
        """Push ingest at an expected offset; the accepted offset afterwards."""
        name = f"append:{client}:{session}"

        def check() -> None:
            row = self.read("cursors").where(F.col("path") == name).first()
            if offset != (row.cursor if row else 0):
                raise Conflict(row.cursor if row else 0)

        with self.ledger.lock:
            check()
            end = offset + len(body[: body.rfind("\n") + 1].encode())
            df = self.spark.createDataFrame([(project, session, harness, "append", offset, end, body, name)], "project_key string, session_id string, harness string, source string, base bigint, end bigint, chunk string, path string")
            self.ingest(df, now, check=check)
            return end

    def remember(self, kind: str, text: str, project: str, paths=(), session: str = "manual", now=None) -> str:
        """A claim by hand: no gate, but its paths are filtered and secrets refused."""
        if not kind or not text or not project:
            raise ValueError("type, text and project are required")
        self.ledger.lock.acquire()
        try:
            return self._remember(kind, text, project, paths, session, F.current_timestamp() if now is None else now)
        finally:
            self.ledger.lock.release()

    def _remember(self, kind, text, project, paths, session, at) -> str:
        base = self._base()
        row = self.spark.createDataFrame([(kind, text, project, list(paths), session)], "type string, text string, project_key string, paths array<string>, session_id string")
        row = row.withColumn("project_key", P.project_key("project_key")).withColumn("paths", P.filter_paths("paths")).where(~P.drop_claim("text", "paths"))
        stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        ref = F.struct("session_id", F.lit(0).cast("long").alias("start_offset"), F.octet_length("text").cast("long").alias("end_offset"))
        null = lambda t: F.lit(None).cast(t)
        hashed = row.withColumn("claim_hash", H.claim_hash("project_key", "type", "text"))
        full = hashed.select(H.new_id(at, "project_key", "claim_hash", F.lit(base)).alias("id"), "type", "project_key", null("string").alias("workspace_root"), F.lit("other").alias("harness"), "session_id", stamp.alias("created_at"), "text", null("string").alias("why"), "paths", X.symbols("text", "paths").alias("symbols"), null("map<string,bigint>").alias("path_mtime"), F.lit("active").alias("status"), null("string").alias("supersedes"), F.lit("remember").alias("source"), "claim_hash", ref.alias("transcript_ref"), F.lit(base).alias("seq"))
        made = full.first()
        if made is None:
            raise ValueError("the text holds a secret")
        one = self.spark.createDataFrame([made], full.schema)
        said = one.select("project_key", "session_id", F.lit("cli").alias("harness"), F.lit("remember").alias("source"), F.lit(0).cast("long").alias("offset"), F.lit("user").alias("role"), "text", F.lit(False).alias("error"), F.lit(False).alias("skip"))
        windows = extract.excerpts(said, F.date_format(at, "yyyy-MM")).withColumn("seq", F.lit(base))
        action = one.select("project_key", "session_id", F.lit("remember").alias("kind"), F.col("id").alias("claim_id"), "paths", X.tokens("text").alias("tokens"), F.col("created_at").alias("at"))
        self._commit({"excerpts": windows, **self._claim_parts(one, base), "actions": self._actions(action, base)})
        return made.id

    def _actions(self, actions: DataFrame, base: int) -> DataFrame:
        return self._numbered(store.clean_actions(actions), base)

    def _log(self, actions: DataFrame) -> None:
        with self.ledger.lock:
            self._commit({"actions": self._actions(actions, self._base())})

    # -- reading ----------------------------------------------------------------------
    def index(self, projects: list[str] | None = None) -> I.Index:
        """What retrieval reads, for some projects: their claims, and statistics of all (A18) from narrow columns."""
        narrow = A.cut(store.active_ids(self._rows("claims").select("id", "project_key", "claim_hash", "status", "seq", "doc_len")))
        n, mean = narrow.agg(F.count(F.lit(1)), F.avg("doc_len")).first()
        terms = self.read("terms").join(narrow.select(F.col("id").alias("record_id"), "seq"), ["record_id", "seq"], "left_semi").drop("seq")
        return I.Index.of(self.read("claims", projects), terms, int(n), float(mean or 1.0))

    def _projects(self, requests: DataFrame) -> list[str] | None:
        found = [r[0] for r in A.normalise(requests).select("project_key").distinct().limit(_LISTED + 1).collect()]
        return found if len(found) <= _LISTED else None

    def tail(self, projects: list[str] | None = None) -> DataFrame:
        """The last messages of each project's newest tape, for thin requests."""
        raw = self._rows("tape", projects)
        newest = raw.groupBy("project_key").agg(F.max_by("session_id", "seq").alias("session_id"))
        w = Window.partitionBy("project_key").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
        last = raw.join(newest, ["project_key", "session_id"]).withColumn("_s", F.sum(F.octet_length("line")).over(w)).where(F.col("_s") <= S.TAPE_TAIL_BYTES)
        chunk = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "line"))), lambda x: F.concat(F.rtrim(x["line"]), F.lit("\n"))), "")
        chunks = last.groupBy("project_key", "session_id").agg(chunk.alias("chunk"))
        return A.tails(parse_sessions(chunks.select("project_key", "session_id", F.lit("other").alias("harness"), F.lit("turn").alias("source"), F.lit(0).cast("long").alias("base"), "chunk")))

    def _more(self, requests: DataFrame, projects: list[str] | None, more: dict) -> tuple[DataFrame, dict]:
        more = {"tail": A.cut(self.tail(projects)), "actions": self.read("actions", projects), **more}
        if self.embedder is not None and "query_vec" not in requests.columns:
            requests, more = embed.with_query_vectors(requests, self.embedder), {"vectors": self.read("vectors", projects), **more}
        return requests, more

    def ask(self, requests: DataFrame, log: bool = True, **more) -> DataFrame:
        """Hits of a batch of requests; the asks go to the action log (R1, D25). ``files`` brings file times for staleness."""
        projects = self._projects(requests)
        ix, (asked, more) = self.index(projects), self._more(requests, projects, more)
        hits = A.cut(A.ask(asked, ix, excerpts=self.read("excerpts", projects), **more))
        if log:
            self._log_asks(requests, hits)
        return hits

    def _log_asks(self, requests: DataFrame, hits: DataFrame) -> None:
        q = A.normalise(requests).select("request_id", "project_key", "session_id", F.col("path_keys").alias("seed_paths"), X.uniq("tokens").alias("tokens"), F.date_format("now", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))
        self._log(store.ask_records(q, hits))

    def explain(self, requests: DataFrame, log: bool = True, **more) -> DataFrame:
        """Every candidate of a batch with its fate; an explained ask is an ask, so it is logged too."""
        projects = self._projects(requests)
        ix, (asked, more) = self.index(projects), self._more(requests, projects, more)
        out = A.cut(A.explain(asked, ix, **more))
        if log:
            self._log_asks(requests, out.where("rank is not null").select("request_id", "id", "warning"))
        return out

    def refresh_active(self, project: str, name: str = "active.md", now=None) -> str:
        """After a compaction: the pack of an empty request as a file in the store, whole or not at all."""
        at = F.current_timestamp() if now is None else now
        row = self.spark.createDataFrame([("compact", project, [])], "request_id string, project string, paths array<string>")
        null = {c: F.lit(None).cast("string") for c in ("question", "goal", "workspace_root", "session_id")}
        req = row.withColumns({**null, "limit_tokens": F.lit(None).cast("int"), "now": at})
        hits = self.ask(req, log=False).orderBy("rank").collect()
        when = self.spark.range(1).select(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()[0]
        body = active_pack(project, list(dict.fromkeys(h.warning for h in hits if h.warning)), hits, when)
        self.ledger.write_text(body, "packs", project.replace("/", "__"), name)
        return body

    def get_record(self, ident: str, session: str = "", now=None) -> dict | None:
        """A claim with its covering excerpt; the reading is logged as dwell."""
        claims = self.read("claims").where(F.col("id") == ident)
        row = claims.join(extract.covering_excerpt(claims, self.read("excerpts")).select("id", "excerpt"), "id", "left").first()
        if row is None:
            return None
        if not session:
            newest = store.newest_session(self.read("actions", [row.project_key]), self.read("sessions", [row.project_key])).where(F.col("project_key") == row.project_key).first()
            session = newest.session_id if newest else "default"
        at = F.current_timestamp() if now is None else now
        self._log(claims.select("project_key", F.lit(session).alias("session_id"), F.lit("get").alias("kind"), F.col("id").alias("claim_id"), "paths", X.strings(()).alias("tokens"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at")))
        return row.asDict(recursive=True)

    def stats(self) -> DataFrame:
        return store.project_stats(self.read("claims"), self.read("sessions"))

    def prune(self, project: str = "") -> None:
        with self.ledger.lock:
            at = self.ledger.head()
            raw = {n: self.ledger.rows(n, RELATIONS[n] + _EXTRA.get(n, ""), at) for n in ("claims", "sessions")}
            lengths = raw["claims"].groupBy("id").agg(F.max_by("doc_len", "seq").alias("doc_len"))
            claims, sessions = store.prune(A.cut(store.resolve_claims(raw["claims"].drop("doc_len"))), A.cut(store.latest(raw["sessions"], "jsonl")), project)
            self.ledger.replace("claims", claims.join(lengths, "id").select(*raw["claims"].columns), at)
            self.ledger.replace("sessions", sessions, at)

    def delete(self, name: str, keys: DataFrame, on: str = "id") -> None:
        """Rows of a relation by key, with what is derived of claims."""
        with self.ledger.lock:
            also = {"terms": "record_id", "vectors": "record_id"} if name == "claims" and on == "id" else {}
            gone = A.cut(keys.select(on).distinct())
            for n, c in {name: on, **also}.items():
                at = self.ledger.head()
                raw = self.ledger.rows(n, RELATIONS[n] + _EXTRA.get(n, ""), at)
                self.ledger.replace(n, raw.join(gone.select(F.col(on).alias(c)), c, "left_anti").select(*raw.columns), at)

    def delete_project(self, project: str) -> None:
        """Everything of a project."""
        key = self.spark.createDataFrame([(project,)], "p string").select(P.project_key("p").alias("project_key"))
        for name in ("claims", "terms", "vectors", "excerpts", "tape", "actions", "sessions"):
            self.delete(name, key, "project_key")

    def locate(self, home: str, session: str, harness: str | None = None) -> DataFrame:
        """A session's file in a home folder (H9)."""
        return L.locate(L.sessions_at(self.spark, home), session, harness)

    def catch_up_session(self, path: str, session: str, project: str, harness: str = "other", now=None) -> bool:
        """A located session file from its cursor on; was there anything new (R45, R46, H7, H8)?"""
        with self.ledger.lock:
            raw = self.spark.read.format("binaryFile").load(path).where(allowed("path", "length"))
            text = F.regexp_extract(F.make_valid_utf8(F.col("content").cast("string")), r"(?s)\A(.*\n)?", 0)
            chunk = raw.select(F.lit(project).alias("project_key"), F.lit(session).alias("session_id"), F.lit(harness).alias("harness"), F.lit("turn").alias("source"), F.lit(0).cast("long").alias("base"), F.octet_length(text).cast("long").alias("end"), text.alias("chunk"), F.lit(path).alias("path"))
            fresh = A.cut(self._unread(chunk))
            if fresh.isEmpty():
                return False
            self.ingest(fresh, now)
            return True

    def vector_count(self) -> int:
        """A7."""
        return self.read("vectors").count()

    def health(self) -> dict:
        return {"ok": True, "active": self.read("claims").where("status = 'active'").count()}


def _fields(schema: str) -> list[str]:
    """Top-level "name type" fields of a schema string."""
    out, depth, held = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(held.strip())
            held = ""
        else:
            held += c
    return [*out, held.strip()]


def active_pack(project: str, warnings: list[str], context: list, when: str = "") -> str:
    """A pack as a text file for a session that was just compacted."""
    out = ["# active context", "", f"project: {project}", *([f"when: {when}"] if when else []), "", "Warnings are blocking unless the user overrides them."]
    out += ["", "## warnings", *[f"- {w}" for w in warnings]] if warnings else []
    out += ["", "## context", *[line for h in context for line in ("", f"### {h['type']}", f"> {h['text']}")]] if context else []
    return "\n".join(out) + "\n"
