"""Where sessions lie: roots of five tools, a session's file, and what its first lines say."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklode.sources.files import MAX_BYTES, listing

#: tool -> (folder of its sessions below the user's home, pattern of their files); fixed values.
ROOTS = {
    "grok": (".grok/sessions", "chat_history.jsonl"),
    "claude": (".claude/projects", "*.jsonl"),
    "codex": (".codex/sessions", "rollout-*.jsonl"),
    "pi": (".pi/agent/sessions", "*.jsonl"),
}
OPENCODE_DB = ".local/share/opencode/opencode.db"
STATE_DBS = ("state_5.sqlite", "state_4.sqlite", "state.sqlite")
#: Inspection reads a whole file up to this size, else its last bytes.
INSPECT_WHOLE, INSPECT_TAIL = 8 << 20, 4 << 20


def session_of(path="path", harness="harness") -> Column:
    """The session id that a file's place tells: the folder for one tool, the last part of the name for others."""
    p = F.col(path)
    name = F.regexp_extract(p, r"([^/]+)\.jsonl\z", 1)
    return F.when(F.col(harness) == "grok", F.regexp_extract(p, r"([^/]+)/[^/]+\z", 1)).when(F.col(harness).isin("codex", "pi"), F.coalesce(F.nullif(F.regexp_extract(name, r"([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})\z", 1), F.lit("")), name)).otherwise(name)


def sessions_at(spark: SparkSession, home: str) -> DataFrame:
    """(path, size, mtime_ms, harness, session_id) of every tool's session files below a home folder."""
    out = None
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for harness, (folder, pattern) in ROOTS.items():
        root = f"{home.rstrip('/')}/{folder}"
        where = fs_path(root)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            found = listing(spark, root, pattern).where(F.col("size") <= MAX_BYTES).withColumn("harness", F.lit(harness))
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "path string, size bigint, mtime_ms bigint, harness string, session_id string")
    return out.withColumn("session_id", session_of())


def discover_home(known: DataFrame, found: DataFrame) -> DataFrame:
    """(jsonl, harness, session_id): registered sessions first, then files not registered, each path once."""
    seen = known.select("jsonl", "harness", "session_id")
    plain = found.select(F.regexp_replace("path", r"\Afile:/*", "/").alias("jsonl"), "harness", "session_id")
    return seen.dropDuplicates(["jsonl"]).unionByName(plain.join(seen, "jsonl", "left_anti").dropDuplicates(["jsonl"]))


def locate(found: DataFrame, session_id: str, harness: str | None = None) -> DataFrame:
    """The newest file of a session, of one tool or of any."""
    hit = found.where(F.col("session_id") == session_id)
    hit = hit if harness is None else hit.where(F.col("harness") == harness)
    return hit.groupBy("harness").agg(F.max_by("path", "mtime_ms").alias("path"), F.max("mtime_ms").alias("mtime_ms"))


def peek(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, session_id, cwd) that the first line with a working folder says."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("n")).where(F.contains("value", F.lit('"cwd"')))
    at = lambda *names: F.coalesce(*[F.nullif(F.get_json_object("value", f"$.{k}"), F.lit("")) for k in names])
    said = lines.select("path", "n", at("cwd", "payload.cwd", "item.payload.cwd").alias("cwd"), at("payload.id", "item.payload.id", "sessionId", "id").alias("session_id")).where("cwd is not null")
    return said.groupBy("path").agg(F.min_by(F.struct("session_id", "cwd"), "n").alias("r")).select("path", "r.*")


def latest_by_cwd(found: DataFrame, peeked: DataFrame, cwd: str) -> DataFrame:
    """The newest file whose session ran in a folder."""
    return found.join(peeked.where(F.col("cwd") == cwd).select("path"), "path").agg(F.max_by("path", "mtime_ms").alias("path"))


def claude_slug(cwd: str) -> str:
    """The project folder of a working folder; it cannot be turned back, hence ``peek``."""
    return "".join(c if c.isalnum() and c.isascii() else "-" for c in cwd)


def grok_folder(cwd: str) -> str:
    return quote(cwd, safe="")


def inspection(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, chunk, note): whole files, or the last bytes of large ones from their next line on."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    large = F.col("length") > INSPECT_WHOLE
    tail = F.substring(F.col("content"), -INSPECT_TAIL, INSPECT_TAIL)
    text = F.when(large, F.regexp_replace(F.make_valid_utf8(tail.cast("string")), r"\A[^\n]*\n", "")).otherwise(F.make_valid_utf8(F.col("content").cast("string")))
    return raw.select("path", text.alias("chunk"), F.when(large, F.lit("tail only")).otherwise(F.lit("")).alias("note"))
