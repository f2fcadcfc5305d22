"""Relations and their changes: merge, supersede, retention, lookups, counts, deletes (D*, F*, A*, W*, K*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklode import schemas as S
from worklode.functions import gates, rules
from worklode.functions import paths as P
from worklode.functions import sentences as C
from worklode.functions import text as X
from worklode.functions.hashes import claim_hash


def is_fixture(session: str | Column) -> Column:
    """F17."""
    return X.trim(session).isin(*rules.FIXTURE_SESSIONS)


def top(df: DataFrame, keys: list, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key; the group limit runs before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


# -- claims ---------------------------------------------------------------------
def prepare(claims: DataFrame) -> DataFrame:
    """Defaults of a claim before it is written: key, status, symbols, hash."""
    key = P.project_key("project_key")
    kept = claims.withColumn("project_key", key).withColumn("status", F.coalesce(F.nullif("status", F.lit("")), F.lit("active")))
    kept = kept.withColumn("symbols", F.when(F.coalesce(F.size("symbols"), F.lit(0)) > 0, F.col("symbols")).otherwise(X.symbols("text", "paths")))
    return kept.withColumn("claim_hash", F.coalesce(F.nullif("claim_hash", F.lit("")), claim_hash("project_key", "type", "text"))).where(X.is_safe_id("id"))


#: Columns that a later write of the same id replaces; the others keep their first value.
MUTABLE = ("status", "supersedes", "text", "paths", "symbols", "path_mtime", "transcript_ref")


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by id: first write decides fixed columns, the latest one the mutable (D3). ``new`` has later ``seq``."""
    return one_row_an_id(stored.unionByName(new, allowMissingColumns=True)).select(*stored.columns)


def one_row_an_id(rows: DataFrame) -> DataFrame:
    """All writes of an id as one row."""
    first = [c for c in rows.columns if c not in (*MUTABLE, "id", "seq")]
    last = [c for c in rows.columns if c in MUTABLE or c == "seq"]
    pairs = rows.groupBy("id").agg(F.min_by(F.struct(*first), "seq").alias("_f"), F.max_by(F.struct(*last), "seq").alias("_l"))
    return pairs.select("id", "_f.*", "_l.*").select(*rows.columns)


def supersede(claims: DataFrame) -> DataFrame:
    """One active claim for each hash: the latest arrival; it names the one before."""
    w = Window.partitionBy("claim_hash", F.col("status") == "active").orderBy("seq", "id")  # one row back and one on: nothing is gathered
    active = F.col("status") == "active"
    out = claims.withColumn("_before", F.when(active, F.lag("id").over(w))).withColumn("_after", F.when(active, F.lead("id").over(w)))
    out = out.withColumn("supersedes", F.coalesce("_before", "supersedes"))
    return out.withColumn("status", F.when(F.col("_after").isNotNull(), "superseded").otherwise(F.col("status"))).drop("_before", "_after")


def resolve_claims(rows: DataFrame) -> DataFrame:
    """Claims as they are after all writes."""
    return supersede(one_row_an_id(rows))


def active_ids(rows: DataFrame) -> DataFrame:
    """(id, project, seq, doc_len) of active claims, from narrow columns of all writes."""
    one = one_row_an_id(rows)
    newest = Window.partitionBy("claim_hash").orderBy(F.desc("seq"), F.desc("id"))
    live = one.where("status = 'active'").withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    return live.select("id", "project_key", "seq", "doc_len")


def write_claims(stored: DataFrame, new: DataFrame) -> DataFrame:
    return supersede(upsert(stored, prepare(new)))


def collapse_duplicates(claims: DataFrame) -> DataFrame:
    """Repair: of several active ones of a hash the newest by (created_at, id) stays."""
    w = Window.partitionBy("claim_hash", "status").orderBy(F.desc("created_at"), F.desc("id"))
    n = F.row_number().over(w)
    return claims.withColumn("_n", n).withColumn("status", F.when((F.col("status") == "active") & (F.col("_n") > 1), "superseded").otherwise(F.col("status"))).drop("_n")


def set_status(claims: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """D5, D6."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return claims.join(hit, "id", "left").withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).drop("_hit")


def delete(table: DataFrame, keys: DataFrame, on: str = "id") -> DataFrame:
    """D7, D8, D18."""
    return table.join(keys.select(on).distinct(), on, "left_anti")


def active(claims: DataFrame, project: str | None = None) -> DataFrame:
    """F3."""
    out = claims.where("status = 'active'")
    return out if project is None else out.where(F.col("project_key") == project)


def all_active(claims: DataFrame) -> DataFrame:
    """F4."""
    return active(claims).orderBy(F.desc("created_at"), F.desc("id"))


def recent_active(claims: DataFrame, n: int) -> DataFrame:
    """The newest of each project."""
    return top(active(claims), ["project_key"], [F.desc("created_at"), F.desc("id")], n)


def by_type(claims: DataFrame, kind: str, n: int, since: str = "") -> DataFrame:
    """The newest of a type in each project; ties by later arrival."""
    hit = active(claims).where((F.col("type") == kind) & (F.col("created_at") >= since))
    return top(hit, ["project_key"], [F.desc("created_at"), F.desc("seq")], n)


def head_priority(claims: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """(project, id, pos): newest faileds, then decisions, then constraints (K4)."""
    caps = caps or S.HEAD_CAPS
    order = F.create_map(*[x for i, t in enumerate(caps) for x in (F.lit(t), F.lit(i))])
    limit = F.create_map(*[x for t, n in caps.items() for x in (F.lit(t), F.lit(n))])
    w = Window.partitionBy("project_key", "type").orderBy(F.desc("created_at"), F.desc("seq"))
    hit = active(claims).where(F.col("type").isin(*caps)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.try_element_at(limit, F.col("type")))
    return hit.select("project_key", "id", (F.try_element_at(order, F.col("type")) * 1000 + F.col("_n")).cast("int").alias("pos"))


def cold_priority(claims: DataFrame, n: int) -> DataFrame:
    """Faileds, then decisions, then constraints, newest first, up to ``n`` (K5)."""
    rank = F.when(F.col("type") == "failed", 0).when(F.col("type") == "decision", 1).otherwise(2)
    hit = active(claims).where(F.col("type").isin("failed", "decision", "constraint")).withColumn("_r", rank)
    return top(hit, ["project_key"], ["_r", F.desc("created_at"), F.desc("seq")], n).drop("_r")


def recent_paths(claims: DataFrame, n: int) -> DataFrame:
    """(project, path_key, pos): keys of the newest ``n`` claims, first seen first (K6)."""
    w = Window.partitionBy("project_key").orderBy(F.desc("created_at"), F.desc("seq"))
    newest = active(claims).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    keys = newest.select("project_key", "_n", F.posexplode(P.path_keys("paths")).alias("_p", "path_key"))
    first = keys.groupBy("project_key", "path_key").agg(F.min(F.struct("_n", "_p")).alias("_at"))
    return first.select("project_key", "path_key", F.row_number().over(Window.partitionBy("project_key").orderBy("_at")).alias("pos"))


def has_live_work(claims: DataFrame) -> DataFrame:
    """(project, live): is there an active claim outside fixtures (F16, A5)?"""
    return active(claims).groupBy("project_key").agg(F.max(~is_fixture("session_id")).alias("live"))


def noise_gates(said, paths="paths") -> dict[str, Column]:
    """The gate at reading time, by the type it is for; "any" is for all."""
    t = said.s if isinstance(said, gates.Said) else said
    return {
        "any": gates.skip_prose(said) | gates.list_chrome(t, F.lit(True)),
        "state": gates.next_i(t) | gates.process_state(t),
        "decision": gates.planning(t) | gates.quoted_attribution(t) | gates.narrative_decision(t),
        "constraint": gates.session_op(t) | gates.agent_prompt(t) | gates.constraint_fragment(t),
        "failed": gates.status_failed(t) | gates.failed_as_object(t) | ((F.size(paths) == 0) & failed_in_ticks(gates.raw(t))) | ~C.grounded_failed(t, paths),
    }


def of_type(by: dict, kind="type") -> Column:
    """Those of ``noise_gates`` that hold for a type."""
    return reduce(lambda a, b: a | b, [X.col(by["any"]), *[(F.col(kind) == k) & X.col(g) for k, g in by.items() if k != "any"]])


def is_noise(kind="type", text="text", paths="paths") -> Column:
    return of_type(noise_gates(X.trim(text), paths), kind)


def failed_in_ticks(x) -> Column:
    """The word stands only inside back-ticks (an open one reaches the end)."""
    word = r"(?i)(?<![0-9A-Za-z_])failed(?![0-9A-Za-z_])"
    return X.col(x).rlike(word) & ~F.regexp_replace(X.col(x), r"`[^`]*(?:`|\z)", "").rlike(word)


def to_markdown(claims: DataFrame) -> DataFrame:
    """(id, file, body): one document with front matter for each claim."""
    line = lambda k, c: F.concat(F.lit(f"{k}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
    lists = lambda k, c: F.concat(F.lit(f"{k}: "), F.to_json(F.coalesce(F.col(c), X.strings(()))))
    head = F.concat_ws("\n", F.lit("---"), line("id", "id"), line("type", "type"), line("project", "project_key"), line("status", "status"), line("created_at", "created_at"), line("session", "session_id"), lists("paths", "paths"), lists("symbols", "symbols"), F.lit("---"))
    body = F.concat(head, F.lit("\n\n"), F.col("text"), F.lit("\n"))
    return claims.select("id", F.concat(P.encode_key("project_key"), F.lit("/"), X.sanitise("id"), F.lit(".md")).alias("file"), body.alias("body"))


# -- actions ----------------------------------------------------------------------
def append_actions(stored: DataFrame, new: DataFrame, n: int = S.ACTION_CAP) -> DataFrame:
    """Append and keep the last ``n`` of each (project, session)."""
    return top(stored.unionByName(clean_actions(new)), ["project_key", "session_id"], [F.desc("at"), F.desc("seq")], n)


def clean_actions(new: DataFrame) -> DataFrame:
    new = new.withColumn("project_key", P.project_key("project_key")).withColumn("session_id", F.coalesce(F.nullif("session_id", F.lit("")), F.lit("default")))
    return new.where("project_key <> '' and kind <> '' and at <> ''")


def recent_actions(actions: DataFrame, n: int, by_session: bool = True) -> DataFrame:
    """F10."""
    return top(actions, ["project_key", *(["session_id"] if by_session else [])], [F.desc("at"), F.desc("seq")], n)


def last_ask(actions: DataFrame) -> DataFrame:
    """(project, at) of the latest ask."""
    return actions.where("kind = 'ask'").groupBy("project_key").agg(F.max(F.struct("at", "seq")).getField("at").alias("at"))


def newest_session(actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """(project, session): of the latest action, else the latest registered."""
    a = actions.groupBy("project_key").agg(F.max_by("session_id", F.struct("at", "seq")).alias("a"))
    s = sessions.groupBy("project_key").agg(F.max_by("session_id", "seq").alias("s"))
    return a.join(s, "project_key", "full").select("project_key", F.coalesce(F.nullif("a", F.lit("")), "s").alias("session_id"))


def last_ask_group(actions: DataFrame) -> DataFrame:
    """All ask rows of the newest ask time of each (project, session)."""
    w = Window.partitionBy("project_key", "session_id").orderBy(F.desc("at"))
    return actions.where("kind = 'ask'").withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def ask_packs(actions: DataFrame, claims: DataFrame, n: int = 3) -> DataFrame:
    """The newest ``n`` asks of each project with their hits."""
    asks = actions.where("kind = 'ask'")
    groups = asks.groupBy("project_key", "at", "session_id").agg(F.max("seq").alias("last"), F.max_by("tokens", "seq").alias("tokens"))
    groups = top(groups, ["project_key"], [F.desc("at"), F.desc("last")], n)
    hits = asks.where("claim_id <> ''").join(claims.select(F.col("id").alias("claim_id"), "type", "text"), "claim_id", "left")
    hit = F.struct(F.col("seq"), F.col("claim_id").alias("id"), F.col("type"), F.col("text"))
    listed = hits.groupBy("project_key", "at", "session_id").agg(F.sort_array(F.collect_list(hit), False).alias("hits"))
    return groups.join(listed, ["project_key", "at", "session_id"], "left").drop("last")


def ask_records(request: DataFrame, hits: DataFrame) -> DataFrame:
    """Action rows of an ask: one for each hit, or one without a claim, and one for each warning."""
    r = request.select("request_id", "project_key", "session_id", "seed_paths", "tokens", "at")
    asks = r.join(hits.select("request_id", F.col("id").alias("claim_id")), "request_id", "left").withColumn("kind", F.lit("ask"))
    warned = F.regexp_extract("warning", r"\(see ([^)]*)\)", 1)
    warns = r.join(hits.where("warning is not null").select("request_id", warned.alias("claim_id")), "request_id").withColumn("kind", F.lit("warn"))
    return asks.unionByName(warns).select("project_key", F.coalesce(F.nullif("session_id", F.lit("")), F.lit("default")).alias("session_id"), "kind", F.coalesce("claim_id", F.lit("")).alias("claim_id"), F.col("seed_paths").alias("paths"), "tokens", "at")


# -- sessions, cursors, vectors, excerpts ------------------------------------------
def refuse_test_ingest(root="root", workspace="workspace", jsonl="jsonl", session="session_id") -> Column:
    """Test sessions do not enter a store that is no test's."""
    test = lambda c: F.coalesce(F.col(c), F.lit("")).rlike(rules.TEST_PATH)
    return ~test(root) & (is_fixture(session) | test(workspace) | test(jsonl))


def of_path(sessions: DataFrame, path: str) -> DataFrame:
    """Sessions of a folder or of one below it."""
    p = path.rstrip("/")
    return sessions.where((F.col("workspace") == p) | F.col("workspace").startswith(p + "/") | (F.col("jsonl") == p))


def latest(table: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Last write of each key."""
    rest = [c for c in table.columns if c != key]
    return table.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*").select(*table.columns)


def write_excerpts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by id inside a month."""
    return stored.join(new.select("id", "month"), ["id", "month"], "left_anti").unionByName(new.dropDuplicates(["id", "month"]))


def cursor_status(cursors: DataFrame, files: DataFrame) -> DataFrame:
    """(path, cursor, size, status) against a file listing."""
    j = cursors.join(files.select("path", "size"), "path", "left")
    status = F.when(F.col("size").isNull(), "missing").when(F.col("cursor") > F.col("size"), "past-eof").when(F.col("cursor") < F.col("size"), "behind").otherwise("ok")
    return j.select("path", "cursor", "size", status.alias("status"))


def cursor_notes(sessions: DataFrame, status: DataFrame) -> DataFrame:
    """(project, note) tallies of cursor states."""
    j = sessions.where("project_key <> ''").select("project_key", F.col("jsonl").alias("path")).join(status, "path")
    n = j.groupBy("project_key").agg(*[F.count_if(F.col("status") == s).alias(a) for s, a in (("ok", "ok"), ("behind", "behind"), ("past-eof", "past"), ("missing", "miss"))])
    part = lambda c, label: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {label}")))
    bad = F.concat_ws(" ", part("behind", "behind"), part("past", "past-eof"), part("miss", "missing"), part("ok", "ok"))
    return n.select("project_key", F.when(F.col("behind") + F.col("past") + F.col("miss") == 0, F.concat(F.col("ok").cast("string"), F.lit(" ok"))).otherwise(bad).alias("note"))


def stale_vectors(claims: DataFrame, vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """Active claims without a vector of this model and dimension."""
    have = vectors.where((F.col("model") == model) & (F.col("dim") == dim)).select(F.col("record_id").alias("id"))
    return active(claims).join(have, "id", "left_anti")


# -- reports -------------------------------------------------------------------------
def project_stats(claims: DataFrame, sessions: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Counts of each project by type, its sessions and its tape's size."""
    counts = active(claims).groupBy("project_key").agg(F.count(F.lit(1)).alias("active"), *[F.count_if(F.col("type") == t).alias(t) for t in ("failed", "decision", "constraint", "state", "thread")])
    known = sessions.groupBy(F.coalesce("project_key", F.lit("")).alias("project_key")).agg(F.count(F.lit(1)).alias("sessions"))
    out = counts.join(known, "project_key", "full")
    if files is not None:
        out = out.join(files.groupBy("project_key").agg(F.sum("size").alias("raw_bytes"), F.count(F.lit(1)).alias("raw_files")), "project_key", "left")
    return out.na.fill(0)


def health_notes(stats: DataFrame, status: DataFrame) -> DataFrame:
    """Notes on tiny projects, lagging cursors and tapes that give few claims."""
    tiny = F.col("project_key").startswith("path-") & (F.col("active") <= 1) & (F.col("raw_bytes") < 100 << 10)
    a = stats.agg(F.count_if(tiny).alias("n")).where("n > 0").select(F.format_string("%d path-hash projects with almost no claims (folders without git origin)", "n").alias("note"))
    b = status.agg(F.count_if(F.col("status") == "past-eof").alias("p"), F.count_if(F.col("status") == "behind").alias("b")).where("p + b > 0").select(F.format_string("cursors: %d past-eof  %d behind  (catch-up not even with the tape)", "p", "b").alias("note"))
    heavy = ~F.col("project_key").startswith("path-") & (F.col("active") > 0) & (F.col("raw_bytes") >= 10 << 20) & (F.floor(F.col("raw_bytes") / F.col("active")) >= 500 << 10)
    c = stats.where(heavy).select(F.concat(F.col("project_key"), F.lit(": "), X.byte_size("raw_bytes"), F.lit(" tape / "), F.col("active").cast("string"), F.lit(" claims")).alias("note"))
    return a.union(b).union(c)


def prune(claims: DataFrame, sessions: DataFrame, project: str = "") -> tuple[DataFrame, DataFrame]:
    """Claims and sessions without test sessions, projects that had nothing else, fixture claims; noise superseded."""
    test_path = lambda c: F.coalesce(F.col(c), F.lit("")).rlike(rules.TEST_PATH)
    scope = F.lit(True) if not project else F.col("project_key") == project
    test = scope & (is_fixture("session_id") | test_path("workspace") | test_path("jsonl"))
    marked = sessions.withColumn("_test", test)
    orphans = marked.where("project_key <> ''").groupBy("project_key").agg(F.min("_test").alias("_all")).where("_all").select("project_key")
    gone = marked.where("_test").select("session_id", "project_key").distinct()
    kept = claims.join(gone, ["session_id", "project_key"], "left_anti").join(orphans, "project_key", "left_anti")
    kept = kept.where(~(scope & is_fixture("session_id")))
    status = F.when(scope & (F.col("status") == "active") & is_noise(), "superseded").otherwise(F.col("status"))
    return kept.withColumn("status", status).select(*claims.columns), marked.where("not _test").drop("_test")


def score_asks(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """(case, ask, hit, needed, recall) of needles found in packed texts."""
    texts = hits.groupBy("request_id").agg(F.collect_list(F.lower("text")).alias("texts"))
    e = expected.select("case_id", "request_id", F.explode_outer("needles").alias("needle")).join(texts, "request_id", "left")
    found = F.exists(F.coalesce("texts", X.strings(())), lambda t: F.contains(t, F.lower("needle")))
    s = e.groupBy("case_id", "request_id").agg(F.count("needle").alias("needed"), F.count_if(found & F.col("needle").isNotNull()).alias("hit"))
    return s.withColumn("recall", F.when(F.col("needed") == 0, 1.0).otherwise(F.col("hit") / F.col("needed")))
