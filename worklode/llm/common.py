"""Shared helpers of the training-data operators.

* ``materialize`` cuts lineage by a Parquet table in the folder that the
  session names in ``spark.checkpoint.dir``, below one folder for each
  application; ``discard`` removes a table that nothing reads any more, ``purge``
  all of an application's.
* ``bounded`` limits the rows and bytes of Arrow batches by the session's
  settings, which are read when a plan is made and so stay changed.
* ``text_slices`` views Arrow text columns as NumPy bytes without copying, in
  slices of bounded size, so a worker never holds more than one slice's arrays.
* ``pack_u64`` / ``unpack_u64`` move integer vectors through shuffles as one
  compressed binary value instead of a row each.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text whose NumPy intermediates a worker holds at once.
SLICE_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch between the JVM and a worker; whole texts make the stock ones too large for small executors.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="worklode-checkpoint-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only where that is unset and all tasks run on this machine."""
    return f"{_application_dir(spark)}/{uuid.uuid4().hex}"


def _application_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_dir()
    return f"{base.rstrip('/')}/worklode-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete the table behind ``materialize``'s result; nothing may read it afterwards."""
    if path := getattr(df, "worklode_path", None):
        _delete(df.sparkSession, path)


def purge(spark: SparkSession) -> None:
    """Delete all tables that this application has materialised, once its results are written."""
    _delete(spark, _application_dir(spark))


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: recovery after a lost executor rereads files."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.worklode_path = path
    return out


def bounded(df: DataFrame) -> DataFrame:
    """``df`` itself, once the session's Arrow batches hold BATCH_ROWS rows and BATCH_BYTES bytes (or one row) at most."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(conf.get(name).removesuffix("b")) <= most:
            conf.set(name, str(most))
    return df


def free_name(name: str, taken) -> str:
    """``name``, with as many underscores as it takes to clash with no column."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def partitions_for(total_bytes: int, target: int, least: int = 1) -> int:
    return max(least, -(-int(total_bytes or 0) // target))


def text_slices(batches: Iterator[pa.RecordBatch], col: str, limit: int = SLICE_BYTES):
    """Yield (batch slice, uint8 bytes, int64 offsets) with at most ``limit`` text bytes, or one row.

    Null texts count as empty.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        arr = batch.column(batch.schema.get_field_index(col))
        if arr.null_count:
            arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
        if pa.types.is_large_binary(arr.type) or pa.types.is_large_string(arr.type):
            offs = np.frombuffer(arr.buffers()[1], np.int64, n + 1, arr.offset * 8)
        else:
            offs = np.frombuffer(arr.buffers()[1], np.int32, n + 1, arr.offset * 4).astype(np.int64)
        buf = arr.buffers()[2]
        data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
            hi = min(n, max(hi, lo + 1))
            yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lo = hi


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-xorshift rounds)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def pack_u64(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values as byte planes under zlib: constant planes cost next to nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zlib.compress(planes.tobytes(), 1)


def unpack_u64(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending values, delta coded."""
    return pack_u64(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_u64(blob), dtype=np.uint64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + n) for each pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)
