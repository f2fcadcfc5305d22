"""Tape files: listing, discovery, sealed reads and writes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest tape file that is ingested.
MAX_BYTES = 64 << 20


def listing(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, size, mtime_ms) of files below ``root``, without reading them."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return f.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"))


def discover(known: DataFrame, *roots: tuple[SparkSession, str, str]) -> DataFrame:
    """(jsonl, harness): registered sessions first, then files of each (session, root, harness), each path once."""
    out = known.select("jsonl", "harness", F.lit(0).alias("rank"))
    for i, (spark, root, harness) in enumerate(roots):
        out = out.union(listing(spark, root).select(F.col("path").alias("jsonl"), F.lit(harness), F.lit(i + 1)))
    w = Window.partitionBy("jsonl").orderBy("rank")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("jsonl", "harness")


def newest(files: DataFrame) -> DataFrame:
    """The newest tape."""
    return files.agg(F.max_by("path", "mtime_ms").alias("path"))


def allowed(path="path", size="size"):
    """Only tape files of ingestible size (S3)."""
    return F.col(path).endswith(".jsonl") & (F.col(size) <= MAX_BYTES)


def read_sealed(spark: SparkSession, root: str) -> DataFrame:
    """(path, chunk) of plain and zstd-sealed tapes; files are spread over tasks and opened by Spark."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl*").load(root).select("path", "content")

    def run(batches):
        import zstandard

        for pdf in batches:
            text = [zstandard.ZstdDecompressor().decompressobj().decompress(c) if p.endswith(".zst") else c for p, c in zip(pdf.path, pdf.content, strict=True)]
            yield pd.DataFrame({"path": pdf.path, "chunk": [bytes(t).decode("utf-8", "replace") for t in text]})

    return raw.mapInPandas(run, "path string, chunk string")


def idle(files: DataFrame, now_ms: int, hours: float = 24) -> DataFrame:
    """Tapes that nothing has been written to for a day, and that are not sealed yet (ST6, H28)."""
    return files.where(F.col("path").endswith(".jsonl") & (F.col("mtime_ms") <= now_ms - int(hours * 3_600_000)))


def seal_tapes(files: DataFrame) -> DataFrame:
    """Each tape of (path) becomes ``path``.zst beside it, written whole before the plain one goes; sealed ones stay.

    Gives (path, sealed); a repeated run does nothing more. Tapes lie where the
    executors can write.
    """

    def run(batches):
        import os

        import zstandard

        for pdf in batches:
            done = []
            for p in pdf.path:
                p = p.removeprefix("file:") if p.startswith("file:") else p
                if os.path.isfile(p) and not os.path.islink(p):
                    draft = f"{p}.zst.tmp"
                    with open(p, "rb") as src, open(draft, "wb") as out:
                        zstandard.ZstdCompressor().copy_stream(src, out)
                    os.replace(draft, f"{p}.zst")
                    os.remove(p)
                done.append(os.path.exists(f"{p}.zst"))
            yield pd.DataFrame({"path": pdf.path, "sealed": done})

    return files.select("path").mapInPandas(run, "path string, sealed boolean")


def confined(root: str, *parts: str) -> str:
    """A path below ``root``, or an error: no absolute, empty or upward parts, no links on the way (P20)."""
    import os

    if any(not x or x in (".", "..") or "/" in x or "\\" in x or "\x00" in x for x in parts):
        raise ValueError(f"not a name: {parts}")
    at = root
    for x in parts:
        at = os.path.join(at, x)
        if os.path.islink(at):
            raise ValueError(f"{at} is a link")
    return at


def seal(lines: DataFrame, path: str) -> None:
    """Write tape lines as zstd-compressed Parquet, a folder for each project and month."""
    lines.write.mode("overwrite").option("compression", "zstd").partitionBy("project_key", "month").parquet(path)
