"""Sharding into byte-balanced shards by histogram sort, on DataFrame functions alone.

Documents are ordered by (hash of the text, hash of doc_id and text): equal texts are
neighbours, so a group of copies is cut only where balance needs it. The order
is a string of digits. Each round counts the exact bytes below every candidate
boundary at one more digit, for the few prefixes that still hold a shard's
target, and the probes narrow until every splitter is within tolerance. Then
one exchange moves each document to its shard (``exchange``; ``assign`` tells the
places without moving the texts).

The counting rounds read a narrow table (key digits and sizes), written once to
the shared folder; the driver receives at most ``shards * 2**DIGIT`` counts a
round. Slots are gapless numbers in each shard: row numbers inside small cells
of the key plus the counts of the cells before, so that no shard has to fit in
one task.

Defined results: a null text has size 1 and the crc of no bytes; a null doc_id is
one value among others; repeated rows are told apart by nothing, so each gets a
slot of its own, in any order; an empty table gives no rows; with fewer documents
than shards some shards are empty; ``exchange`` keeps extra columns, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklode.llm.common import free_name, materialize

#: Bits of a digit; digits of the text's hash and of the document's hash.
DIGIT, DIGITS = 11, 12
#: Cells of a slot numbering: bits of the text hash and of the document hash.
_CELL, _SALT = 10, 6


def _digit(i: int) -> Column:
    """The i-th digit of the 128-bit key (k1, k2), most significant first; six digits for each half."""
    key, at = ("k1", i) if i < DIGITS // 2 else ("k2", i - DIGITS // 2)
    left = 64 - DIGIT * (at + 1)
    if left >= 0:
        return F.shiftrightunsigned(key, left).bitwiseAND(F.lit((1 << DIGIT) - 1).cast("long"))
    return F.col(key).bitwiseAND(F.lit((1 << (DIGIT + left)) - 1).cast("long"))


def _cell() -> Column:
    """Text-hash prefix and document-hash prefix, so a hot text is spread over 2 ** _SALT cells."""
    return (F.shiftrightunsigned("k1", 64 - _CELL) * (1 << _SALT) + F.shiftrightunsigned("k2", 64 - _SALT)).cast("int")


def _key_columns(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    text = F.coalesce(docs[text_col], F.lit(""))
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(2), docs[id_col].cast("string"), text).alias("k2")


def keys(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *_key_columns(docs, id_col, text_col),
    )


def splitters(keyed: DataFrame, shards: int, tolerance: float = 0.001) -> list[tuple[int, ...]]:
    """``shards - 1`` boundaries, each a string of digits: a row is below it if its digits sort before."""
    total = keyed.agg(F.sum("size")).first()[0] or 0
    targets = [total * (s + 1) / shards for s in range(shards - 1)]
    slack = tolerance * total / shards
    state = [((), 0) for _ in targets]  # (prefix that holds the target, bytes below that prefix)
    found: list = [None] * len(targets)
    for depth in range(DIGITS):
        prefixes = {p for (p, _), f in zip(state, found, strict=True) if f is None}
        if not prefixes:
            break
        inside, name = F.lit(False), F.lit(None).cast("int")
        order = sorted(prefixes)
        for n, p in enumerate(order):
            same = F.lit(True)
            for i, d in enumerate(p):
                same = same & (_digit(i) == d)
            inside, name = inside | same, F.when(same, n).otherwise(name)
        rows = keyed.where(inside).groupBy(name.alias("p"), _digit(depth).alias("d")).agg(F.sum("size").alias("b")).collect()
        counts = {p: sorted((r.d, r.b) for r in rows if r.p == n) for n, p in enumerate(order)}
        for k, target in enumerate(targets):
            if found[k] is not None:
                continue
            prefix, below = state[k]
            for d, b in counts[prefix]:
                if below + b >= target or (d, b) == counts[prefix][-1]:
                    ends = [(abs(below - target), (*prefix, d)), (abs(below + b - target), (*prefix, d + 1))]
                    near = min(ends)
                    state[k] = ((*prefix, d), below)
                    if near[0] <= slack or depth == DIGITS - 1:
                        found[k] = near[1]
                    break
                below += b
            else:
                found[k] = (*prefix, 0)
    return found


def below(boundary: tuple[int, ...]) -> Column:
    """Does a row's key sort before the boundary?"""
    out = F.lit(False)
    for i in reversed(range(len(boundary))):
        out = (_digit(i) < boundary[i]) | ((_digit(i) == boundary[i]) & out)
    return out


def shard_of(bounds: list[tuple[int, ...]]) -> Column:
    shard = F.lit(0)
    for b in bounds:
        shard = shard + F.when(below(b), 0).otherwise(1)
    return shard.cast("int")


def assign(docs: DataFrame, shards: int = 8, id_col="doc_id", text_col="text", tolerance: float = 0.001) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard."""
    keyed = materialize(keys(docs, id_col, text_col))
    placed = keyed.withColumn("shard", shard_of(splitters(keyed, shards, tolerance)))
    placed = placed.withColumn("cell", _cell())
    sums = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = sums.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("start"))
    number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("k1", "k2"))
    return (
        placed.withColumn("number", number)
        .join(before, ["shard", "cell"])
        .select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def exchange(docs: DataFrame, shards: int = 8, id_col="doc_id", text_col="text", tolerance: float = 0.001) -> DataFrame:
    """The documents themselves with their shard (as ``shard`` or the next free name), moved once: ranges of (shard, slot order)."""
    bounds = splitters(materialize(keys(docs, id_col, text_col)), shards, tolerance)
    name = free_name("shard", docs.columns)
    k1, k2 = _key_columns(docs, id_col, text_col)
    held = docs.select(F.struct("*").alias("d"), k1, k2).withColumn("s", shard_of(bounds)).withColumn("cell", _cell())
    moved = held.repartitionByRange("s", "cell", "k1", "k2").sortWithinPartitions("s", "cell", "k1", "k2")
    return moved.select("d.*", F.col("s").alias(name))
