"""SQLite session stores as batch data sources.

``format("worklode_sqlite").option("path", db)`` gives (session_id, directory,
updated, chunk): a session's messages as JSON lines, a partition for each
session, read-only. ``option("table", "threads")`` lists a thread table.
"""

from __future__ import annotations

import json
import os
import sqlite3

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from worklode.sources.transcripts import flatten

SCHEMAS = {"sessions": "session_id string, directory string, updated bigint, chunk string", "threads": "id string, cwd string, rollout string, first_user string, updated bigint"}
_LIMIT = 5000


def connect(path: str) -> sqlite3.Connection:
    if os.path.islink(path):
        raise OSError(f"{path} is a link")
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def part_texts(raws) -> list[dict]:
    """Text parts of a message: text, tool output, other text; no reasoning and steps."""
    out = []
    for raw in raws:
        try:
            p = json.loads(raw)
        except ValueError:
            continue
        kind = p.get("type") if isinstance(p, dict) else None
        if not isinstance(p, dict) or kind in ("reasoning", "step-start", "step-finish"):
            continue
        text = flatten(p.get("output")) if kind in ("tool", "tool-result", "tool_result") else ""
        text = text or (p["text"] if isinstance(p.get("text"), str) else "")
        if text:
            out.append({"type": "text", "text": text})
    return out


class _Session(InputPartition):
    def __init__(self, session_id: str, directory: str, updated: int):
        super().__init__(session_id)
        self.row = (session_id, directory, updated)


class SessionReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        with connect(self.path) as db:
            try:
                rows = db.execute(f"SELECT id, COALESCE(directory, ''), COALESCE(time_updated, 0) FROM session ORDER BY time_updated DESC LIMIT {_LIMIT}").fetchall()
            except sqlite3.OperationalError:
                rows = db.execute(f"SELECT id, COALESCE(directory, ''), 0 FROM session LIMIT {_LIMIT}").fetchall()
        return [_Session(*r) for r in rows if r[0]]

    def read(self, partition):
        lines = []
        with connect(self.path) as db:
            for ident, data in db.execute("SELECT id, data FROM message WHERE session_id = ? ORDER BY time_created, id", (partition.row[0],)).fetchall():
                try:
                    m = json.loads(data)
                except ValueError:
                    m = {}
                m = m if isinstance(m, dict) else {}
                content = part_texts(r[0] for r in db.execute("SELECT data FROM part WHERE message_id = ? ORDER BY time_created, id", (ident,)))
                if not content and isinstance(m.get("content"), str) and m["content"]:
                    content = [{"type": "text", "text": m["content"]}]
                lines.append(json.dumps({"type": "message", "role": m.get("role") or "other", "content": content}))
        yield (*partition.row, "".join(line + "\n" for line in lines))


class ThreadReader(DataSourceReader):
    """Threads of up to three state files; the first file with an id wins."""

    def __init__(self, path: str):
        self.paths = [p for p in path.split(",") if os.path.exists(p)]

    def read(self, partition):
        seen = set()
        for path in self.paths:
            with connect(path) as db:
                for r in db.execute("SELECT id, COALESCE(cwd, ''), COALESCE(rollout_path, ''), COALESCE(first_user_message, ''), COALESCE(updated_at, 0) FROM threads"):
                    if r[0] and r[0] not in seen:
                        seen.add(r[0])
                        yield (r[0], r[1], r[2] if r[2] and os.path.exists(r[2]) else "", r[3], int(r[4]))


class SqliteSource(DataSource):
    @classmethod
    def name(cls):
        return "worklode_sqlite"

    def schema(self):
        return SCHEMAS[self.options.get("table", "sessions")]

    def reader(self, schema):
        path = self.options["path"]
        return ThreadReader(path) if self.options.get("table") == "threads" else SessionReader(path)
