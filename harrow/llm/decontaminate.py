"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words become numbers; one automaton holds every substring of every item. A document is a
stream of words: the automaton's state after each word gives the longest item substring that ends
there, and so each window of the items that does. Runs of words whose neighbours never meet in any
item cannot hold a window and are skipped without stepping through the automaton.

Items are dealt to blocks of bounded size. One block is one pass over the documents. With more, the driver
holds one block at a time, each pass writes the hits that it finds, by a digest of the text, to the shared folder
before the next block is read, and a last pass joins all hits of a text to its documents. So no worker ever has
more than one automaton, and driver and workers need the same memory whatever the size of the benchmark.

* null or empty text, of a document or an item: no words, nothing hit;
* null doc_id: its row is reported like any other; items with a null id count as item ``null``;
* repeated documents: a row each; repeated items: each id counts once, and equal rows of items are read once;
* very long text: one at a time in a worker, whole; a longer item than a block is a block of its own;
* an item shorter than the window is one window; empty benchmark: no hits; empty table: no rows;
* further columns, whatever their names, pass through ``decontaminate`` unread, but for n_chars.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, ddl, drop_written, fresh, id_text, map_rows, ship, written

WINDOW = 10
#: Bytes of item text in one automaton (some 20 times that in a worker's memory).
BLOCK_BYTES = 4_000_000
#: Bytes of hits that may be broadcast; with more the join shuffles.
MOST_BROADCAST = 32 << 20
#: A document of which more than this part of the words is hit is dropped by ``decontaminate``.
MOST_COVERAGE = 0.5

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of ints, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []
        for _, words in items:
            last, path = 0, []
            for w in words:
                last = self._extend(last, w)
                path.append(last)
            ends.append(path)
        self._name(items, ends)

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of the strings of p followed by w, cut from a longer class if need be."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def _name(self, items: list[tuple[str, list[int]]], ends: list[list[int]]) -> None:
        """For states: which full windows (self.full) and whole short items (self.short) end in their strings."""
        full: dict[int, set[str]] = {}
        own: dict[int, list[tuple[int, str]]] = {}
        for (name, words), path in zip(items, ends, strict=True):
            if 0 < len(words) < self.window:
                own.setdefault(path[-1], []).append((len(words), name))
                continue
            for i in range(self.window - 1, len(words)):
                full.setdefault(self.window_state(path[i]), set()).add(name)
        self.full = {s: tuple(sorted(x)) for s, x in full.items()}
        self.short: list[tuple[tuple[int, str], ...]] = [()] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.short[s] = (*own.get(s, ()), *self.short[self.link[s]])

    def window_state(self, s: int) -> int:
        """The state of the last ``window`` words of a longer string's state."""
        while self.length[self.link[s]] >= self.window:
            s = self.link[s]
        return s

    def hits(self, words: list[int]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(start, end, items) of each window or short item that occurs, by end."""
        s = matched = 0
        for i, w in enumerate(words):
            while s and w not in self.next[s]:
                s = self.link[s]
                matched = self.length[s]
            if w in self.next[s]:
                s = self.next[s][w]
                matched += 1
            if matched >= self.window:
                yield i + 1 - self.window, i + 1, self.full.get(self.window_state(s), ())
            for m, name in self.short[s]:
                if m <= matched:
                    yield i + 1 - m, i + 1, (name,)


class Scanner:
    """Finds the item windows in documents."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.ids: dict[bytes, int] = {}
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in _words(text)]) for name, text in items]
        coded = [x for x in coded if x[1]]
        self.automaton = SuffixAutomaton(coded, window)
        self.shortest = min((min(window, len(x)) for _, x in coded), default=0)
        n = len(self.ids)
        self.pairs = np.unique(np.array([a * n + b for _, x in coded for a, b in zip(x, x[1:], strict=False)], dtype=np.int64))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The maximal hit runs of the words, as (start, end), and the items that occur."""
        if not self.shortest or len(words) < self.shortest:
            return [], set()
        get = self.ids.get
        coded = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = coded >= 0
        joined = known[:-1] & known[1:]
        at = np.flatnonzero(joined)
        if len(at) and len(self.pairs):
            keys = coded[at] * len(self.ids) + coded[at + 1]
            found = np.searchsorted(self.pairs, keys)
            joined[at] = self.pairs[np.minimum(found, len(self.pairs) - 1)] == keys
        else:
            joined[:] = False
        # Runs of known words in which each pair of neighbours occurs in an item.
        starts = np.flatnonzero(known & ~np.r_[False, joined])
        stops = np.flatnonzero(known & ~np.r_[joined, False]) + 1
        spans, names = [], set()
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            if b - a >= self.shortest:
                for i, j, items in self.automaton.hits(coded[a:b].tolist()):
                    names.update(items)
                    spans.append((a + i, a + j))
        return merged(spans), names


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans, as sorted maximal ones."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _words(text: str) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def _dealt(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> tuple[DataFrame, int]:
    """block, item and text of the items, and how many blocks of about ``block_bytes`` there are."""
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).filter(F.length("text") > 0).distinct()
    items = written(items)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    return items.select(F.pmod(F.xxhash64("item", "text"), F.lit(n)).alias("block"), "item", "text"), n


def _hits(texts: DataFrame, dealt: DataFrame, n: int, window: int) -> DataFrame:
    """h1, h2, spans (starts and ends in turn) and items of each text with a hit; ``texts`` has columns h1, h2 and text."""
    spark, found = texts.sparkSession, []
    for k in range(n):
        shared = spark.sparkContext.broadcast([(r.item, r.text) for r in dealt.filter(F.col("block") == k).collect()])

        def scan(rows, shared=shared):
            scanner = Scanner(shared.value, window)
            for h1, h2, text in rows:
                spans, names = scanner.scan(_words(text))
                if spans:
                    yield h1, h2, [x for s in spans for x in s], sorted(names)

        passed = map_rows(texts, scan, "h1 long, h2 long, spans array<long>, items array<string>")
        found.append(written(passed.dropDuplicates(["h1", "h2"])))
        shared.unpersist()
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    # A text has a row for each block that hits it, and no more spans than words in each.
    hits = every.groupBy("h1", "h2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    hits = written(hits)
    drop_written(*found)
    return hits


def _scanned(frame: DataFrame, text: str, benchmark: DataFrame, finish, schema: str, item_id: str, item_text: str, window: int, block_bytes: int) -> DataFrame:
    """``finish(row, words, spans, items)`` of each row, without the rows for which it gives None."""
    spark = frame.sparkSession
    ship(spark)
    width, at = len(frame.columns), frame.columns.index(text)
    dealt, n = _dealt(benchmark, item_id, item_text, block_bytes)
    if n == 1:
        shared = spark.sparkContext.broadcast([(r.item, r.text) for r in dealt.collect()])

        def scan(rows):
            scanner = Scanner(shared.value, window)
            for row in rows:
                words = _words(row[at])
                if (done := finish(row, words, *scanner.scan(words))) is not None:
                    yield done

        return map_rows(frame, scan, schema)
    whole = F.coalesce(F.col(text), F.lit(""))
    keys = [F.xxhash64(whole), F.xxhash64(whole, F.lit(1))]
    hits = _hits(frame.select(keys[0].alias("h1"), keys[1].alias("h2"), whole.alias("text")), dealt, n, window)
    names = fresh(frame, "h1", "h2", "spans", "items")
    hits = hits.toDF(*names)
    size = hits.agg(F.sum(40 + 8 * F.size(names[2]) + 32 * F.size(names[3]))).first()[0] or 0
    hits = F.broadcast(hits) if size <= MOST_BROADCAST else hits
    joined = frame.join(hits, (keys[0] == F.col(names[0])) & (keys[1] == F.col(names[1])), "left").drop(*names[:2])

    def end(rows):
        for row in rows:
            spans = row[width] or []
            spans = merged(list(zip(spans[::2], spans[1::2], strict=True)))
            if (done := finish(row[:width], _words(row[at]), spans, set(row[width + 1] or ()))) is not None:
                yield done

    return map_rows(joined, end, schema)


def report(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document, and its hit spans in words."""

    def finish(row, words, spans, names):
        n_hit = sum(b - a for a, b in spans)
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        return row[0], len(words), n_hit, len(names), digest, n_hit > 0, ",".join(f"{a}:{b}" for a, b in spans)

    return _scanned(
        docs.select(*id_text(doc_id, text)), "text", benchmark, finish,
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string",
        item_id, item_text, window, block_bytes,
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES, most_coverage: float = MOST_COVERAGE, least_words: int = 1,
) -> DataFrame:
    """The documents without their hit spans of ``least_words`` words or more.

    A document of which more than ``most_coverage`` of the words is hit is dropped; all others keep
    every column, and their text outside the spans byte for byte. A changed text's n_chars, if there
    is such a column, becomes its new length.
    """
    names = docs.columns
    at = names.index(text)

    def finish(row, words, spans, _):
        spans = [s for s in spans if s[1] - s[0] >= least_words]
        if not spans:
            return row
        if sum(b - a for a, b in spans) > most_coverage * len(words):
            return None
        row = list(row)
        row[at] = without(row[at], spans)
        if "n_chars" in names:
            row[names.index("n_chars")] = len(row[at])
        return tuple(row)

    return _scanned(docs, text, benchmark, finish, ddl(docs), item_id, item_text, window, block_bytes)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of each span and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw.translate(WORD_BYTES))]
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")
