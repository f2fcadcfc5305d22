"""Benchmark decontamination with a generalised suffix automaton of test items.

The automaton holds every substring of every item's normalised words. Document
words stream through it; at each word it knows the longest suffix that occurs
in an item, so a window (``window`` words of an item, or a shorter item whole)
ends wherever that length reaches the window's. Words that no item has, and
pairs of words that no item has, split the stream beforehand: a window cannot
cross them.

The items are test data of bounded size: each automaton takes at most
``max_item_bytes`` of item text; more items make more automata, one pass each,
so nothing larger than the bound is broadcast.

Defined results: null and empty texts have no words and no hits; null or empty
items have no windows; an item without an id marks words but is not listed;
repeated items count once by id; repeated documents each get their own row; no
items at all means no hits; extra columns are kept by ``decontaminate``.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklode.llm.common import bounded, column, free_name, materialize, text_slices

#: Words are runs of ASCII letters and digits and of any non-ASCII character; A-Z is lower-cased.
_FOLD = bytes(
    (b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 32 for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Item text of one automaton. Measured on short words: 57 bytes of driver memory while it is built and 19 of broadcast for each byte.
MAX_ITEM_BYTES = 4 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class ItemAutomaton:
    """Generalised suffix automaton over word numbers, with the windows that end in each state.

    A state is four 32-bit integers: its link, its length and its first
    transition. Most states have no other; the rest are one sorted array of
    (state, word) keys with their targets.
    """

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = 10):
        self.window = window
        self.book: dict[bytes, int] = {}
        self.names: list[str | None] = []
        seqs = []
        for name, ws in items:
            if ws:
                self.names.append(name)
                seqs.append(array("i", [self.book.setdefault(w, len(self.book)) for w in ws]))
        self.base = max(1, len(self.book))
        self.link, self.length, self.word, self.goto = (array("i", [x]) for x in (-1, 0, -1, -1))
        more: dict[int, int] = {}
        others: dict[int, list[int]] = {}
        for seq in seqs:
            last = 0
            for w in seq:
                last = self._extend(last, w, more, others)
        keys = np.fromiter(more, np.int64, len(more))
        order = np.argsort(keys)
        self.keys = array("q", keys[order].tobytes())
        self.targets = array("i", np.fromiter(more.values(), np.int32, len(more))[order].tobytes())
        del more, others
        link, length = np.frombuffer(self.link, np.int32), np.frombuffer(self.length, np.int32)
        # the state that holds the suffix of exactly `window` words
        self.top = self._climb((length >= window) & (length[link] >= window) & (np.arange(len(link)) > 0), link)
        marks, self.least = [], window
        self.short: dict[int, list] = {}
        for k, seq in enumerate(seqs):
            n, v = len(seq), 0
            here = array("i")
            for i, w in enumerate(seq):
                v = self.step(v, w)
                while self.length[self.link[v]] >= i + 1:
                    v = self.link[v]
                if i + 1 >= window:
                    here.append(self.top[v])
            marks.append(np.unique(np.frombuffer(here, np.int32)).astype(np.int64) << 32 | k)
            if n < window:
                self.short.setdefault(v, []).append((n, self.names[k]))
                self.least = min(self.least, n)
        marks = np.sort(np.concatenate(marks)) if marks else np.zeros(0, np.int64)
        self.listed, self.item = array("i", (marks >> 32).astype(np.int32).tobytes()), array("i", (marks & 0xFFFFFFFF).astype(np.int32).tobytes())
        # the nearest state with a short item; the root, which has none, stands for no such state
        up = np.ones(len(link), bool)
        up[[0, *self.short]] = False
        self.near = self._climb(up, link)
        self.bits = max(16, int(8 * sum(map(len, seqs)) + 1).bit_length())
        self.pairs = np.zeros(1 << self.bits, bool)
        for seq in seqs:
            x = np.frombuffer(seq, np.int32).astype(np.uint64)
            self.pairs[self._slot(x[:-1], x[1:])] = True

    @staticmethod
    def _climb(up: np.ndarray, link: np.ndarray) -> array:
        """For each state the first one along its links that is not ``up``, by pointer jumping."""
        to = np.where(up, link, np.arange(len(link), dtype=np.int32)).astype(np.int32)
        while True:
            far = to[to]
            if (far == to).all():
                return array("i", to.tobytes())
            to = far

    def _slot(self, a, b):
        return ((a * np.uint64(self.base) + b) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def _extend(self, last: int, w: int, more: dict[int, int], others: dict[int, list[int]]) -> int:
        link, length, word, goto, base = self.link, self.length, self.word, self.goto, self.base

        def get(p):
            return goto[p] if word[p] == w else more.get(p * base + w)

        def split(p, q):
            clone = len(link)
            link.append(link[q])
            length.append(length[p] + 1)
            word.append(word[q])
            goto.append(goto[q])
            if q in others:
                others[clone] = list(others[q])
                for c in others[q]:
                    more[clone * base + c] = more[q * base + c]
            link[q] = clone
            while p >= 0 and get(p) == q:
                if word[p] == w:
                    goto[p] = clone
                else:
                    more[p * base + w] = clone
                p = link[p]
            return clone

        q = get(last)
        if q is not None:
            return q if length[q] == length[last] + 1 else split(last, q)
        cur = len(link)
        link.append(0)
        length.append(length[last] + 1)
        word.append(-1)
        goto.append(-1)
        p = last
        while p >= 0 and get(p) is None:
            if word[p] < 0:
                word[p], goto[p] = w, cur
            else:
                more[p * base + w] = cur
                others.setdefault(p, []).append(w)
            p = link[p]
        if p >= 0:
            q = get(p)
            link[cur] = q if length[q] == length[p] + 1 else split(p, q)
        return cur

    def step(self, v: int, w: int) -> int:
        """The state after word ``w``, or -1."""
        if self.word[v] == w:
            return self.goto[v]
        key = v * self.base + w
        at = bisect_left(self.keys, key)
        return self.targets[at] if at < len(self.keys) and self.keys[at] == key else -1

    def found(self, v: int) -> list[str | None]:
        """Names of the items with the window that ends in state ``v``."""
        t = self.top[v]
        return [self.names[k] for k in self.item[bisect_left(self.listed, t) : bisect_right(self.listed, t)]]

    def segments(self, ids: np.ndarray, doc: np.ndarray):
        """(start, end) of the stretches in which a window may lie."""
        n = len(ids)
        known = ids >= 0
        if self.least == 1:
            edge = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
            return edge[::2], edge[1::2]
        ok = known[:-1] & known[1:] & (doc[:-1] == doc[1:]) if n > 1 else np.zeros(0, bool)
        at = np.flatnonzero(ok)
        ok[at] = self.pairs[self._slot(ids[at].astype(np.uint64), ids[at + 1].astype(np.uint64))]
        edge = np.flatnonzero(np.diff(np.r_[False, ok, False].astype(np.int8)))
        lo, hi = edge[::2], edge[1::2] + 1
        keep = hi - lo >= self.least
        return lo[keep], hi[keep]

    def stream(self, ids: list[int]):
        """Yield (end, window length, item names) for each window that ends at a word of ``ids``."""
        link, length, near, window, step = self.link, self.length, self.near, self.window, self.step
        v = size = 0
        for i, w in enumerate(ids):
            t = step(v, w)
            while t < 0 and v:
                v = link[v]
                size = length[v]
                t = step(v, w)
            if t < 0:
                continue
            v = t
            size += 1
            if size >= window:
                yield i + 1, window, self.found(v)
            u = near[v]
            while u > 0:
                for n, name in self.short[u]:
                    if n <= size:
                        yield i + 1, n, (name,)
                u = near[link[u]]

    def scan(self, texts: list[bytes]):
        """Per text: number of words, hit mask (or None), names of items."""
        words = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        book = self.book.get
        ids = np.fromiter((book(w, -1) for ws in words for w in ws), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(texts)), sizes)
        first = np.cumsum(sizes) - sizes
        masks: list = [None] * len(texts)
        names: list = [set() for _ in texts]
        # a stretch never leaves its document: pairs across documents are no pairs, and single words are cut here
        lo, hi = self.segments(ids, doc)
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            while a < b:
                d = int(doc[a])
                stop = min(b, int(first[d] + sizes[d]))
                for end, n, found in self.stream(ids[a:stop].tolist()):
                    if masks[d] is None:
                        masks[d] = np.zeros(int(sizes[d]), bool)
                    e = a + end - int(first[d])
                    masks[d][e - n : e] = True
                    names[d].update(found)
                a = stop
        return sizes, masks, names


def item_batches(items: DataFrame, id_col="item_id", text_col="text", max_item_bytes=MAX_ITEM_BYTES):
    """Lists of (id, words) with at most ``max_item_bytes`` of text, one at a time on the driver."""
    batch, size = [], 0
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).distinct()
    for r in rows.toLocalIterator():
        text = bytes(r.t or b"")
        if batch and size + len(text) > max_item_bytes:
            yield batch
            batch, size = [], 0
        batch.append((r.i, words_of(text)))
        size += len(text)
    yield batch


def automata(items: DataFrame, id_col="item_id", text_col="text", window=10, max_item_bytes=MAX_ITEM_BYTES) -> list[ItemAutomaton]:
    """All automata of a small item set."""
    return list(build(items, id_col, text_col, window, max_item_bytes))


def build(items: DataFrame, id_col="item_id", text_col="text", window=10, max_item_bytes=MAX_ITEM_BYTES) -> Iterator[ItemAutomaton]:
    """One automaton for each ``max_item_bytes`` of item text, made when it is asked for."""
    return (ItemAutomaton(batch, window) for batch in item_batches(items, id_col, text_col, max_item_bytes))


def mark_names(columns) -> tuple[str, str, str]:
    """Names of what ``mark`` adds: number of words, hit runs, items; other names where a table has these."""
    return free_name("n_words", columns), free_name("_windows", columns), free_name("_items", columns)


def mark(docs: DataFrame, models: Iterable[ItemAutomaton], text_col="text", then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """``docs`` with the number of words, the hit runs of words (start, end) and the item ids found; one model at a time.

    ``then`` makes batches with the columns of ``docs`` of the last model's, in the same worker: a second Python step after
    it would keep a second worker for each core of an executor, with its memory, for the rest of the application.
    """
    spark, kept = docs.sparkSession, docs.schema.fields
    count, spans_col, items_col = mark_names(docs.columns)
    schema = T.StructType([*kept, T.StructField(count, T.LongType()), T.StructField(spans_col, T.ArrayType(T.IntegerType())), T.StructField(items_col, T.ArrayType(T.StringType()))])
    out = docs.select(*[f"`{f.name}`" for f in kept])
    models, k = iter(models), 0
    model = next(models, None)
    while model is not None:
        if k:
            out = materialize(out)
        shared = spark.sparkContext.broadcast(model)  # of at most max_item_bytes of items
        del model
        model = next(models, None)
        last = then if model is None else None

        def run(batches, shared=shared, k=k, last=last):
            m = shared.value
            for b, data, offs in text_slices(batches, text_col):
                raw, o = data.tobytes(), offs.tolist()
                sizes, masks, names = m.scan([raw[x:y] for x, y in zip(o[:-1], o[1:], strict=True)])
                old = column(b, spans_col).to_pylist() if k else [None] * len(masks)
                had = column(b, items_col).to_pylist() if k else [None] * len(masks)
                spans, found = [], []
                for i, mask in enumerate(masks):
                    if old[i]:
                        mask = np.zeros(int(sizes[i]), bool) if mask is None else mask
                        for x, y in zip(old[i][::2], old[i][1::2], strict=True):
                            mask[x:y] = True
                    spans.append([] if mask is None else np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8))).tolist())
                    found.append(sorted({*(x for x in names[i] if x is not None), *(had[i] or ())}))
                cols = [column(b, f.name) for f in kept]
                marked = pa.RecordBatch.from_arrays([*cols, pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))], schema.names)
                yield last(marked) if last else marked

        out = bounded(out).mapInArrow(run, docs.schema if last else schema)
        k += 1
    return out


def digest(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", window=10) -> DataFrame:
    """Counts per document: words, hit words, items."""
    docs = docs.select(id_col, text_col)
    count, spans_col, items_col = mark_names(docs.columns)
    m = mark(docs, build(items, item_id, item_text, window), text_col)
    ends = F.expr(f"aggregate({spans_col}, 0L, (a, x) -> x - a)")  # end - (start - earlier sum): alternating sum
    return m.select(
        id_col,
        F.col(count).alias("n_words"),
        ends.alias("n_hit"),
        F.size(items_col).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_col, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(spans_col) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, text_col="text", item_id="item_id", item_text="text", window=10, max_coverage=0.5, max_item_bytes=MAX_ITEM_BYTES) -> DataFrame:
    """Documents without the hit spans of words (every hit run is ``window`` words or a whole short item, the length
    limit); those with more than ``max_coverage`` of their words hit go. Columns as in ``docs``."""
    schema = docs.schema
    count, spans_col, _ = mark_names(docs.columns)

    def clean(b):
        spans, n = column(b, spans_col).to_pylist(), column(b, count).to_pylist()
        texts, keep = column(b, text_col).to_pylist(), []
        for i, s in enumerate(spans):
            hit = sum(y - x for x, y in zip(s[::2], s[1::2], strict=True))
            keep.append(hit <= max_coverage * n[i])
            if s and keep[-1]:
                texts[i] = cut(texts[i].encode(), s).decode()
        cols = [pa.array(texts, pa.string()) if f.name == text_col else column(b, f.name) for f in schema.fields]
        return pa.RecordBatch.from_arrays(cols, schema.names).filter(pa.array(keep, pa.bool_()))

    return mark(docs, build(items, item_id, item_text, window, max_item_bytes), text_col, clean)


def cut(text: bytes, spans: list[int]) -> bytes:
    """``text`` without the characters from the first to the last word of each span."""
    at = [x.span() for x in _WORD.finditer(text)]
    out, done = [], 0
    for x, y in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[done : at[x][0]])
        done = at[y - 1][1]
    return b"".join([*out, text[done:]])
