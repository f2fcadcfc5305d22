"""Hashes, ids, vectors and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from worklode.functions.text import col, normalise

_NUL = "\x00"


def claim_hash(project, kind, text) -> Column:
    """M1."""
    return F.sha2(F.concat(col(project), F.lit(_NUL), col(kind), F.lit(_NUL), normalise(text)), 256)


def excerpt_id(session, start, end) -> Column:
    """M2."""
    return F.sha2(F.concat(col(session), F.lit(_NUL), col(start).cast("string"), F.lit(_NUL), col(end).cast("string")), 256)


def new_id(ts, *parts) -> Column:
    """UTC second and 16 hex digits; the digits hash the record, so a repeated run gives the same id (M3)."""
    return F.concat(F.date_format(col(ts), "yyyyMMddHHmmss"), F.substring(F.sha2(F.concat_ws(_NUL, *[col(p).cast("string") for p in parts]), 256), 1, 16))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine in [0, 1] as float32; 0 for unequal dimensions or zero vectors (M4)."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when((F.size(col(a)) == F.size(col(b))) & (norm > 0), dot(a, b) / norm).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).cast("float")


def l2_normalise(v) -> Column:
    """M5."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(col(v), lambda x: (x.cast("float") * (1 / n).cast("float")).cast("float"))).otherwise(col(v))


def age_days(created_at, now) -> Column:
    """Days since an RFC 3339 string, not below 0; unreadable counts as now."""
    ts = F.try_to_timestamp(col(created_at))
    return F.coalesce(F.greatest(F.lit(0.0), (F.unix_micros(col(now)) - F.unix_micros(ts)) / 8.64e10), F.lit(0.0))


def months_back(ts, n: int = 13) -> Column:
    """Month keys from a time's month backwards."""
    first = F.trunc(col(ts), "month")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.date_format(F.add_months(first, -i), "yyyy-MM"))
