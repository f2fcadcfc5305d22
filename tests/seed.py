"""A small claim store and helpers for tests; texts are our own."""

from pyspark.sql import functions as F

from worklode import schemas as S
from worklode.functions.hashes import claim_hash
from worklode.functions.text import symbols

SEED = [
    ("S1", "failed", "Redis limiter failed in staging, pool exhausted.", ["src/mw/auth.ts"], "2026-08-01T18:12:00Z"),
    ("S2", "decision", "Use library jose, not jsonwebtoken, on the edge runtime.", ["src/mw/auth.ts"], "2026-07-20T11:00:00Z"),
    ("S3", "decision", "The rate limiter lives in src/mw/auth.ts in process.", ["src/mw/auth.ts"], "2026-07-22T09:00:00Z"),
    ("S4", "constraint", "Never log Authorization headers.", ["src/mw/auth.ts"], "2026-06-01T00:00:00Z"),
    ("S5", "state", "Working on the invoice export.", ["src/billing/export.ts"], "2026-08-10T00:00:00Z"),
]
NOW = "2026-08-14T12:00:00Z"


def claims(spark, rows=SEED, project="acme/api", session="s1"):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id string, type string, text string, paths array<string>, created_at string, seq bigint")
    null = lambda t: F.lit(None).cast(t)
    return df.select(
        "id", "type", F.lit(project).alias("project_key"), null("string").alias("workspace_root"), F.lit("cli").alias("harness"), F.lit(session).alias("session_id"), "created_at", "text",
        null("string").alias("why"), "paths", symbols("text", "paths").alias("symbols"), null("map<string,bigint>").alias("path_mtime"), F.lit("active").alias("status"),
        null("string").alias("supersedes"), F.lit("import").alias("source"), claim_hash(F.lit(project), "type", "text").alias("claim_hash"), null(S.REF).alias("transcript_ref"), "seq",
    )


def requests(spark, *rows):
    """Dicts of request fields."""
    full = [(r.get("id", f"r{i}"), r.get("question"), r.get("goal"), r.get("project", "acme/api"), r.get("workspace"), r.get("paths", []), r.get("session"), r.get("limit")) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, "request_id string, question string, goal string, project string, workspace_root string, paths array<string>, session_id string, limit_tokens int")
    return df.withColumn("now", F.to_timestamp(F.lit(NOW)))
