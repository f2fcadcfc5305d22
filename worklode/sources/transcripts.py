"""Session transcripts: JSON lines of five dialects to messages.

A line's meaning depends on the lines before it in the same batch (calls of the
engine's own tools hide their results), so a batch of a session is parsed by one
grouped function; batches are spread by session.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame

from worklode.schemas import MESSAGES

#: Prefixes under which this engine's own tools are called, and their names.
OWN_PREFIXES = ("mcp__worklode__", "mcp_worklode_", "worklode__", "worklode_")
OWN_TOOLS = frozenset({"ask", "remember", "catch_up", "catchup", "get_record", "getrecord"})
# -- fixed values: line types without claim prose ------------------------------
SILENT_TYPES = frozenset(
    "session model_change thinking_level_change compaction branch_summary custom label session_info custom_message last-prompt mode "
    "permission-mode attachment ai-title file-history-snapshot file-history-delta system reasoning backend_tool_call".split()
)
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "model": "assistant", "tool": "tool", "tool_result": "tool", "toolresult": "tool", "bashexecution": "tool"}
CHROME_TAGS = ("system-reminder", "user_info", "agent-reminder", "claude-user-context")
CLAIM_TYPES = frozenset({"failed", "decision", "constraint", "state", "thread"})

_TAGS = [re.compile(rf"<{t}>.*?(?:</{t}>|\Z)", re.S | re.I) for t in CHROME_TAGS]
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_HEAD = re.compile(r"^[^\S\n]*<<<<<<<[^\n]*\n?(?:.*?)(?=^[^\S\n]*(?:=======|>>>>>>>)|\Z)", re.S | re.M)
_FENCE = re.compile(r"^[^\S\n]*(?:=======|>>>>>>>)[^\n]*(?:\n|\Z)", re.M)


def clip(text: str, at=2000, head=400, tail=400) -> str:
    raw = text.encode()
    if len(raw) <= at:
        return text
    return raw[:head].decode("utf-8", "replace") + "\n…\n" + raw[-tail:].decode("utf-8", "replace")


def is_own_tool(name) -> bool:
    n = str(name or "").strip().lower().replace("-", "_") if isinstance(name, str) else ""
    for p in OWN_PREFIXES:
        n = n.removeprefix(p)
    return n in OWN_TOOLS


def _object(text: str):
    try:
        o = json.loads(text)
    except ValueError:
        return None
    return o if isinstance(o, dict) else None


def is_own_payload(text: str) -> bool:
    """A response of this engine, told by its keys."""
    o = _object(text.strip())
    if o is None:
        return False
    if o.keys() >= {"warnings", "context"} or ("extracted" in o and ("copied" in o or "ids" in o)):
        return True
    return isinstance(o.get("type"), str) and o["type"] in CLAIM_TYPES and o.keys() >= {"text", "id"}


_TOKEN = re.compile(r'["\\{}]')


def object_spans(s: str) -> list[tuple[int, int]]:
    """Balanced outermost brace spans, strings respected."""
    spans, depth, start, quoted, pos = [], 0, -1, False, 0
    while m := _TOKEN.search(s, pos):
        c, pos = m[0], m.end()
        if c == "\\":
            pos += quoted
        elif c == '"':
            quoted = not quoted
        elif quoted:
            continue
        elif c == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                spans.append((start, pos))
    return spans


def holds_own_payload(text: str) -> bool:
    return is_own_payload(text) or any(is_own_payload(text[a:b]) for a, b in object_spans(text))


def without_own_payload(text: str) -> str:
    for a, b in reversed(object_spans(text)):
        if is_own_payload(text[a:b]):
            text = f"{text[:a]} {text[b:]}".strip()
    return text.strip()


def without_chrome(text: str) -> str:
    """Without tagged reminders, comments, and the head side of merge conflicts."""
    for tag in _TAGS:
        text = tag.sub("", text)
    text = _COMMENT.sub("", text)
    if "<<<<<<<" in text:
        text = _FENCE.sub("", _HEAD.sub("", text))
    return text.strip()


def flatten(v) -> str:
    """Any content as text."""
    if isinstance(v, str):
        return v
    if isinstance(v, list):
        return "".join((p if isinstance(p, str) else flatten_map(p) if isinstance(p, dict) else "") + "\n" for p in v)
    return flatten_map(v) if isinstance(v, dict) else ""


def flatten_map(m: dict) -> str:
    for k in ("text", "content", "output_text", "input_text"):
        if isinstance(m.get(k), str) and m[k].strip():
            return m[k]
    return next((flatten(m[k]) for k in ("parts", "content") if isinstance(m.get(k), list)), "")


class LineParser:
    """Parses the lines of one batch in order."""

    def __init__(self):
        self.own: set[str] = set()

    def _note(self, m) -> None:
        if isinstance(m, dict) and is_own_tool(m.get("name")):
            ident = next((m[k] for k in ("id", "tool_use_id", "call_id") if isinstance(m.get(k), str) and m[k]), None)
            if ident:
                self.own.add(ident)

    def _note_all(self, o: dict) -> None:
        message, payload, item = o.get("message"), o.get("payload"), o.get("item")
        lists = [o.get("tool_calls"), o.get("content"), message.get("content") if isinstance(message, dict) else None]
        for parts in lists:
            for p in parts if isinstance(parts, list) else ():
                self._note(p)
        self._note(payload)
        self._note(item)
        if isinstance(item, dict):
            self._note(item.get("payload"))

    def prose(self, v) -> str:
        """Content without thinking, tool calls and tool results."""
        if not isinstance(v, list):
            return flatten(v)
        out = []
        for p in v:
            if isinstance(p, str):
                out.append(p + "\n")
            elif isinstance(p, dict):
                if p.get("type") in ("tool_use", "toolCall"):
                    self._note({"name": p.get("name"), "id": p.get("id")})
                elif p.get("type") not in ("thinking", "tool_result") and isinstance(p.get("text"), str):
                    out.append(p["text"] + "\n")
        return "".join(out)

    def parse(self, line: str):
        """(role, text, error, skip) of a line, or None if it gives no message."""
        trimmed = line.strip().removeprefix("﻿")
        o = _object(trimmed) if trimmed else None
        if o is None or "_redacted" in o:
            return None
        self._note_all(o)
        item = o.get("item")
        if isinstance(item, dict) and o.get("payload") is None and (not isinstance(o.get("type"), str) or o["type"] == "item"):
            o = {"type": "", **item}
        kind = o.get("type") if isinstance(o.get("type"), str) else ""
        envelope = self._envelope(kind, o)
        if envelope is not None:
            return self._finish(*envelope)
        return self._plain(kind, o)

    def _plain(self, kind: str, o: dict):
        silent = ("", "", False, True)
        if kind in SILENT_TYPES or "synthetic_reason" in o:
            return silent
        if kind == "tool_result":
            body = flatten(o.get("content")) or flatten(o.get("text"))
            if o.get("tool_call_id") in self.own or holds_own_payload(body):
                return ("tool", "", False, True)
        error, message = o.get("error") is True, o.get("message")
        if isinstance(o.get("role"), str):
            role = o["role"]
            text = self.prose(o.get("content")) or flatten(o.get("text")) or flatten(o.get("output"))
        elif isinstance(message, dict):
            role = message.get("role") if isinstance(message.get("role"), str) else ""
            text = self.prose(message.get("content")) or flatten(message.get("output")) or flatten(message.get("summary"))
            error = error or message.get("isError") is True
        else:
            role, text = kind, self.prose(o.get("content")) or flatten(o.get("text"))
        if not text:
            return silent if self._only_own(o) else None
        return self._finish("tool" if kind == "tool_result" else self.role(role), text, error, False)

    def _only_own(self, o: dict) -> bool:
        calls = o.get("tool_calls")
        if isinstance(calls, list) and calls:
            return all(is_own_tool(c.get("name") if isinstance(c, dict) else None) for c in calls) and not flatten(o.get("content")) and not flatten(o.get("text"))
        message = o.get("message")
        parts = message.get("content") if isinstance(message, dict) else o.get("content")
        if not isinstance(parts, list) or not all(isinstance(p, dict) for p in parts):
            return False
        saw = False
        for p in parts:
            if p.get("type") in ("tool_use", "tool_result"):
                if not is_own_tool(p.get("name")) and not (p["type"] == "tool_result" and holds_own_payload(flatten(p.get("content")))):
                    return False
                saw = True
            elif p.get("type") != "thinking" and isinstance(p.get("text"), str) and p["text"].strip():
                return False
        return saw

    def _envelope(self, kind: str, o: dict):
        """Lines that wrap a payload: (role, text, error, skip), or None for other lines."""
        silent = ("", "", False, True)
        if kind in ("session_meta", "SessionMeta", "turn_context", "TurnContext"):
            return silent
        if kind not in ("event_msg", "EventMsg", "response_item", "ResponseItem"):
            return None
        p = o["payload"] if isinstance(o.get("payload"), dict) else o
        what = p.get("type")
        if kind in ("event_msg", "EventMsg"):
            role = {"user_message": "user", "agent_message": "assistant"}.get(what)
            return (role, clip(self.payload_text(p)), False, False) if role else silent
        if what in ("function_call_output", "FunctionCallOutput"):
            ident = next((p[k] for k in ("call_id", "id") if isinstance(p.get(k), str) and p[k]), "")
            body = self.payload_text(p) or flatten(p.get("output"))
            if ident in self.own or holds_own_payload(body):
                return ("tool", "", False, True)
            return ("tool", clip(body), False, False) if body.strip() else silent
        if what == "message":
            text = self.prose(p.get("content")) or self.payload_text(p)
            role = p.get("role") if isinstance(p.get("role"), str) else ""
            return (self.role(role), clip(text), False, False) if text.strip() else silent
        return silent

    @staticmethod
    def payload_text(p: dict) -> str:
        for k in ("message", "text", "output", "content"):
            s = flatten(p.get(k))
            if s.strip():
                return s
        return ""

    @staticmethod
    def role(role: str) -> str:
        return ROLES.get(role.strip().lower(), role.lower() or "other")

    @staticmethod
    def _finish(role, text, error, skip):
        if skip:
            return role, text, error, True
        text = "" if role in ("system", "developer") else without_own_payload(without_chrome(text))
        if not text.strip() or holds_own_payload(text):
            return role, "", error, True
        return role, clip(text), error, False


def parse_batch(lines: list[str], base: int = 0):
    """Messages (offset, role, text, error, skip) of complete lines; offsets count bytes and line breaks."""
    parser, offset = LineParser(), base
    for line in lines:
        m = parser.parse(line)
        if m is not None:
            yield (offset, *m)
        offset += len(line.encode()) + 1


def complete_lines(chunk: str) -> tuple[list[str], int]:
    """Lines that end in a line break, and the bytes they take; a last partial line waits."""
    end = chunk.rfind("\n") + 1
    return (chunk[: end - 1].split("\n") if end else []), len(chunk[:end].encode())


def parse_sessions(chunks: DataFrame) -> DataFrame:
    """Messages of (project_key, session_id, harness, source, base, chunk) rows; a row is one batch of a session."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                lines, _ = complete_lines(r.chunk or "")
                rows += [(r.project_key, r.session_id, r.harness, r.source, *m) for m in parse_batch(lines, int(r.base or 0))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MESSAGES.split(", ")])

    return chunks.select("project_key", "session_id", "harness", "source", "base", "chunk").mapInPandas(run, MESSAGES)
