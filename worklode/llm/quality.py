"""Quality rules with suffix-array repetition.

Each text's words get a suffix array (prefix doubling over whole slices of
documents, the document being the first key) and its longest-common-prefix
array. A suffix lies in nested LCP intervals, each a maximal repeated substring;
the deepest of them has the larger LCP of its two neighbours. The union of the
spans of those with at least ``min_words`` words is the covered share, the
largest LCP the longest repeat. The same array gives the exact words inside
5-word windows found twice.

The limits bite where the base rule (5-word windows over more than a fifth of
the words) does not: repeats of ten words and more over a tenth of the words
(the published limit for duplicate 10-grams), or one repeat of fifty words and
more, here a section said again, that is over a fiftieth of the words.

Defined results: null or empty texts have no words, fail the base rule and are
not kept; a text of one word repeated is all repetition; rows are judged one by
one, so repeated rows, null ids and ties need no rule; an empty table gives no
rows; other columns are ignored. A long text's words are numbered a chunk at a
time, so a worker holds the integer arrays of one text, not its words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklode.llm.common import bounded, column, text_slices

#: Shortest repeat (words) that counts for coverage; largest covered share of the words; longest single repeat as a share of the words, if also that many words.
MIN_WORDS, MAX_COVERED, MAX_LONGEST, LONG_WORDS = 10, 0.10, 0.02, 50
_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1
#: The white space of the word rule: space and tab to carriage return.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LINE_WORD, _LINE_BLANK = re.compile(rb"[^\x20\x09-\x0d]"), re.compile(rb"[\x20\x09-\x0d]")


def suffix_array(doc: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of each document's words, and LCP with the suffix before (0 across documents).

    Prefix doubling on ranks that are refined only where suffixes still tie.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    base = np.int64(int(ids.max()) + 1)
    key = doc.astype(np.int64) * base + ids
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n + 1, np.int64)

    def group_starts(k):
        first = np.r_[True, k[1:] != k[:-1]]
        return np.maximum.accumulate(np.where(first, np.arange(n), 0)), first

    start, _ = group_starts(key[order])
    rank[order] = start + 1
    end = np.searchsorted(doc, doc, "right")
    step = 1
    while True:
        size = np.bincount(rank[order] - 1, minlength=n)
        open_ = np.flatnonzero(size[rank[order] - 1] > 1)
        if not len(open_):
            break
        s = order[open_]
        nxt = s + step
        second = np.where(nxt < end[s], rank[np.minimum(nxt, n)], 0)
        first = rank[s]
        o = np.lexsort((second, first))
        s, first, second = s[o], first[o], second[o]
        order[open_] = s
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        at = open_[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
        rank[s] = at + 1
        step *= 2
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    live = np.flatnonzero(doc[a] == doc[b])
    l = 0
    while len(live):
        x, y = a[live] + l, b[live] + l
        ok = (x < end[a[live]]) & (y < end[b[live]])
        ok[ok] = ids[x[ok]] == ids[y[ok]]
        live = live[ok]
        lcp[live + 1] += 1
        l += 1
        if l >= 64 and len(live):
            _finish_lcp(order, lcp, doc, ids, end, rank[:n] - 1)
            break
    return order, lcp


def _finish_lcp(order, lcp, doc, ids, end, pos) -> None:
    """Kasai's scan for the documents with a repeat of 64 words or more, linear in their length."""
    for d in np.unique(doc[order[np.flatnonzero(lcp >= 64)]]).tolist():
        lo = int(np.searchsorted(doc, d))
        hi = int(end[lo])
        words, p, prev = ids[lo:hi].tolist(), pos[lo:hi].tolist(), order
        h, n = 0, hi - lo
        for i in range(n):
            r = p[i]
            if r > lo:
                j = int(prev[r - 1]) - lo
                while i + h < n and j + h < n and words[i + h] == words[j + h]:
                    h += 1
                lcp[r] = h
                h = max(0, h - 1)
            else:
                lcp[r] = 0
                h = 0


def repeats(doc: np.ndarray, order: np.ndarray, lcp: np.ndarray, n_docs: int, least: int) -> np.ndarray:
    """For each document, the words covered by the union of repeats of at least ``least`` words."""
    n = len(doc)
    if not n:
        return np.zeros(n_docs, np.int64)
    depth = np.maximum(lcp, np.r_[lcp[1:], 0])  # of the deepest interval that holds the suffix
    hit = np.flatnonzero(depth >= least)
    reach = np.zeros(n, np.int64)
    reach[order[hit]] = order[hit] + depth[hit]
    return np.bincount(doc[np.maximum.accumulate(reach) > np.arange(n)], minlength=n_docs)


def windows(doc, order, lcp, n_docs, k=5) -> np.ndarray:
    """For each document, the words inside k-word windows that are found twice or more."""
    n = len(doc)
    mark = np.zeros(n + k + 1, np.int64)
    hit = np.flatnonzero(lcp >= k)
    at = np.unique(np.concatenate([order[hit], order[hit - 1]])) if len(hit) else hit
    np.add.at(mark, at, 1)
    np.add.at(mark, at + k, -1)
    return np.bincount(doc[np.cumsum(mark)[:n] > 0], minlength=n_docs)


def _duplicate_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif _LINE_WORD.search(line):
            seen.add(line)
    return n


def _chunks(text: bytes, size: int = 1 << 20):
    """``text`` in pieces of about ``size`` bytes that end at white space."""
    lo = 0
    while lo < len(text):
        m = _LINE_BLANK.search(text, lo + size)
        hi = m.end() if m else len(text)
        yield text[lo:hi]
        lo = hi


def number_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and the words' numbers by first sight."""
    book: dict[bytes, int] = {}
    sizes, parts = [], []
    for t in texts:
        n = 0
        for piece in _chunks(t):
            words = piece.split()
            parts.append(np.fromiter((book.setdefault(w, len(book)) for w in words), np.int64, len(words)))
            n += len(words)
        sizes.append(n)
    return np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.int64)


def verdict(m: dict[str, np.ndarray], max_covered=MAX_COVERED, max_longest=MAX_LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) of figures."""
    n = m["n_words"]
    failed = (n < 10) | (100 * m["n_repeat_words"] > 20 * n)
    bad = (m["n_covered_words"] > max_covered * n) | ((m["longest_repeat"] >= LONG_WORDS) & (m["longest_repeat"] > max_longest * n))
    return failed, ~failed & ~bad


def measure(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """All figures of a slice of documents."""
    n = len(offs) - 1
    raw = data.tobytes()
    texts = [raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    n_words, ids = number_words(texts)
    doc = np.repeat(np.arange(n), n_words)
    order, lcp = suffix_array(doc, ids)

    def total(per_byte):
        s = np.r_[0, np.cumsum(per_byte, dtype=np.int64)]
        return s[offs[1:]] - s[offs[:-1]]

    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc[order], lcp)
    return {
        "n_words": n_words,
        "word_chars": total(((data & 0xC0) != 0x80) & ~_BLANK[data]),
        "n_symbols": total(_SYMBOLS[data]),
        "n_dup_lines": np.fromiter(map(_duplicate_lines, texts), np.int64, n),
        "n_repeat_words": windows(doc, order, lcp, n),
        "n_covered_words": repeats(doc, order, lcp, n, MIN_WORDS),
        "longest_repeat": longest,
    }


def assess(df: DataFrame, id_col="doc_id", text_col="text", max_covered=MAX_COVERED, max_longest=MAX_LONGEST) -> DataFrame:
    """One row per document with its figures, ``base_failed`` and ``kept``."""
    schema = df.select(F.col(id_col)).schema
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]
    for c in names:
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean")

    def run(batches):
        for b, data, offs in text_slices(batches, text_col, 1 << 20):
            m = measure(data, offs)
            failed, kept = verdict(m, max_covered, max_longest)
            yield pa.RecordBatch.from_arrays([column(b, id_col), *(pa.array(m[c], pa.int64()) for c in names), pa.array(failed), pa.array(kept)], [id_col, *names, "base_failed", "kept"])

    return bounded(df.select(id_col, text_col)).mapInArrow(run, schema)
