"""Embedders behind one interface, applied batch-wise by an iterator pandas UDF.

An embedder has ``name``, ``dim`` and ``embed(texts) -> vectors``. Failing ones
degrade: the rows get no vector and retrieval goes on without them.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklode.functions.text import trim


def unit(v) -> list[float]:
    """A vector of length one, in float32; the zero vector stays."""
    x = np.asarray(v, np.float32)
    n = float(np.sqrt((x.astype(float) ** 2).sum()))
    return (x * np.float32(1 / n)).tolist() if n else x.tolist()


@dataclass
class TokenEmbedder:
    """Deterministic, for tests: hashed tokens, and an axis for each group of synonyms."""

    groups: list[list[str]] = field(default_factory=list)
    dim: int = 32
    name: str = "token-test"

    @staticmethod
    def _hash(token: str) -> int:
        """FNV-1a, 32 bits."""
        h = 0x811C9DC5
        for b in token.encode():
            h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
        return h

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            low, v = text.lower(), np.zeros(self.dim, np.float32)
            for t in filter(None, re.split(r"[ \n\t,.;:]+", low)):
                v[self._hash(t) % self.dim] += 1
            for i, g in enumerate(self.groups):
                if any(k and k.lower() in low for k in g):
                    v[i % self.dim] += 8
            out.append(unit(v))
        return out


@dataclass
class CommandEmbedder:
    """A local command: {"texts": [...]} in, {"vectors": [[...]], "model", "dim"} out."""

    command: str
    name: str = "command"
    dim: int = 384
    timeout: float = 15.0

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        done = subprocess.run(["sh", "-c", self.command], input=json.dumps({"texts": texts}).encode(), capture_output=True, timeout=self.timeout, check=True)
        vectors = json.loads(done.stdout)["vectors"]
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
        return [unit(v) for v in vectors]


def open_embedder(env: Mapping[str, str] = os.environ) -> CommandEmbedder | None:
    """The command that the environment names, or none: retrieval goes on without vectors."""
    command = env.get("WORKLODE_EMBED_CMD", "").strip()
    return CommandEmbedder(command, dim=int(env.get("WORKLODE_EMBED_DIM", "384"))) if command else None


def pack_vector(v) -> bytes:
    """Little-endian float32 (M6)."""
    return np.asarray(v, "<f4").tobytes()


def unpack_vector(b: bytes) -> list[float]:
    return np.frombuffer(b, "<f4").tolist()


def embedding(embedder, text: Column) -> Column:
    """The vector of a text, null where the embedder fails."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            try:
                yield pd.Series(embedder.embed(s.fillna("").tolist()), dtype=object)
            except Exception:  # an embedder is optional: without it the other generators answer
                yield pd.Series([None] * len(s), dtype=object)

    return run(text)


def document(text="text", symbols="symbols") -> Column:
    """What is embedded of a claim (M7)."""
    return F.concat_ws(" ", trim(text), F.array_join(F.filter(F.transform(symbols, trim), lambda s: s != ""), " "))


def vectors_for(claims: DataFrame, embedder) -> DataFrame:
    """Vector rows of claims."""
    v = claims.select(F.col("id").alias("record_id"), "project_key", F.lit(embedder.name).alias("model"), F.lit(embedder.dim).alias("dim"), embedding(embedder, document()).alias("vec"))
    return v.where("vec is not null")


def with_query_vectors(requests: DataFrame, embedder) -> DataFrame:
    """``model`` and ``query_vec`` of requests' question and goal tokens."""
    from worklode.functions.text import tokens

    said = F.array_join(F.concat(tokens(F.coalesce("question", F.lit(""))), tokens(F.coalesce("goal", F.lit("")))), " ")
    return requests.withColumn("model", F.lit(embedder.name)).withColumn("query_vec", F.when(said != "", embedding(embedder, said)))
