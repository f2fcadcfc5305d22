"""Greedy packing of one request's candidates (R33-R39): plain Python on at most 400 rows."""

from __future__ import annotations

import json
import re

from worklode import schemas as S
from worklode.functions import rules

_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> frozenset:
    return frozenset(t for t in (m.lower() for m in _TOKEN.findall(text)) if len(t) > 1)


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def hit_size(c: dict) -> int:
    """Estimated tokens of a hit's JSON: a quarter of its bytes, with the three signs that JSON for the web escapes."""
    hit = {"id": c["id"], "type": c["type"], "text": c["text"], "when": c["created_at"], "paths": list(c["paths"]), "harness": c["harness"], "status": c["status"]}
    if c["source"]:
        hit["source"] = c["source"]
    hit["has_excerpt"] = bool(c["has_ref"])
    raw = json.dumps(hit, ensure_ascii=False, separators=(",", ":"))
    return max(1, (len(raw.encode()) + 5 * len(re.findall("[<>&]", raw)) + 3) // 4)


def order(c: dict):
    return (c["score"], c["created_at"], c["id"])


class Packer:
    def __init__(self, rows: list[dict], limit: int, head: bool):
        self.rows = sorted(rows, key=order, reverse=True)
        for c in self.rows:
            c["_tokens"], c["_cluster"] = tokens(c["text"]), frozenset(c["cluster"])
        self.limit, self.head = limit, head

    def cover(self, a: dict, b: dict) -> float:
        if a["type"] == b["type"] and (self.head or a["_cluster"] & b["_cluster"]):
            return 1.0
        return jaccard(a["_tokens"], b["_tokens"])

    @staticmethod
    def repeats(c: dict, packed: list[dict]) -> bool:
        return any((p["claim_hash"] and p["claim_hash"] == c["claim_hash"]) or jaccard(c["_tokens"], p["_tokens"]) >= S.DIVERSITY for p in packed)

    @staticmethod
    def count(packed, kind) -> int:
        return sum(p["type"] == kind for p in packed)

    def capped(self, c, remaining, packed) -> bool:
        """Is the type full while another type is or could be packed?"""
        if self.count(packed, c["type"]) < S.PACK_TYPE_CAP:
            return False
        return any(p["type"] != c["type"] for p in packed) or any(r["type"] != c["type"] and self.count(packed, r["type"]) < S.PACK_TYPE_CAP for r in remaining)

    def pool(self) -> list[dict]:
        out = list(self.rows)
        if not self.head:
            for drop in (lambda c: c["type"] == "state" and c["off_path"], lambda c: c["type"] == "failed" and not (c["failed_overlap"] or c["path"] or c["symbol"] or c["hop"])):
                out = [c for c in out if not drop(c)] or out
        return out

    def pack(self) -> list[dict]:
        remaining, packed, spent = self.pool(), [], 0

        def take(c) -> None:
            nonlocal spent
            remaining.remove(c)
            size = hit_size(c)
            if self.repeats(c, packed) or (packed and spent + size > self.limit):
                return
            packed.append(c)
            spent += size

        urgent = [c for c in remaining if c["type"] == "failed" and c["failed_overlap"]]
        if urgent:
            take(max(urgent, key=lambda c: c["score"]))
        while len(packed) < S.PACK_CAP and remaining:
            best = None
            for c in remaining:
                if (packed and c["score"] <= 0) or self.repeats(c, packed) or self.capped(c, remaining, packed):
                    continue
                sim = max((self.cover(c, p) for p in packed), default=0.0)
                value = (c["score"] - S.W_COVERAGE * sim, -sim)
                if best is None or value > best[0]:
                    best = (value, c)
            if best is None:
                break
            take(best[1])
        return packed

    def evict(self, packed: list[dict]) -> list[dict]:
        """Make room for strong faileds on the same file or symbol; the token limit does not count here."""
        packed = list(packed)
        inside = {c["id"] for c in packed}
        missing = [c for c in self.rows if c["failed_overlap"] and c["id"] not in inside and (c["path"] or c["symbol"])]
        for m in sorted(missing, key=lambda c: -c["score"]):
            if self.count(packed, "failed") >= S.PACK_TYPE_CAP:
                break
            if len(packed) < S.PACK_CAP:
                packed.append(m)
                continue
            loose = [i for i, p in enumerate(packed) if not (p["type"] == "failed" and p["failed_overlap"])]
            if not loose:
                break
            packed[min(loose, key=lambda i: packed[i]["score"])] = m
        return sorted(packed, key=order, reverse=True)[: S.PACK_CAP] if missing else packed

    def reason(self, c: dict, packed: list[dict]) -> str:
        """Why a candidate is not packed."""
        if self.repeats(c, packed):
            return "diversity"
        if self.count(packed, c["type"]) >= S.PACK_TYPE_CAP:
            return "type-cap"
        if c["score"] <= 0:
            return "score<=0"
        return "pack-cap" if len(packed) >= S.PACK_CAP else "outranked"


def run(rows: list[dict], limit: int, head: bool) -> tuple[list[dict], list[tuple[dict, str]]]:
    """(packed in order, [(left-out candidate, reason)])."""
    p = Packer(rows, limit, head)
    first = p.pack()
    packed = p.evict(first)
    inside = {c["id"] for c in packed}
    evicted = {c["id"] for c in first} - inside
    return packed, [(c, "evicted-for-failed" if c["id"] in evicted else p.reason(c, packed)) for c in p.rows if c["id"] not in inside]


def warning(c: dict) -> str | None:
    strong = c["failed_overlap"] if c["type"] == "failed" else c["shipped_overlap"]
    return rules.WARNINGS[c["type"]].format(c["id"]) if strong and c["type"] in rules.WARNINGS else None
