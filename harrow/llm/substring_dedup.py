"""Removal of repeated byte strings by prefix-free parsing, distributed.

Parsing. A rolling hash runs over each text. Of every ``SPAN`` neighbouring places the one with the
least hash is a trigger. A phrase is all that sees one trigger first, up to the trigger and the bytes
that surely follow it in any string of the shortest length: its trigger string. Which trigger a string
sees first depends on its own bytes alone, so no suffix of a phrase that reaches into its trigger
string is a proper prefix of another one (prefix-free), and each string is a suffix of one phrase
followed by the start of the rest of the parse.

Dictionary. Equal phrases with equal continuations (copies, common passages) become one entry with a
count: repeats of repeats are counted, not listed. Suffixes of phrases can only be equal if they end in
the same trigger string, so the dictionary is dealt by it. Phrases alone with their trigger string,
almost all in ordinary text, need no more work.

Order. In a block (``Block``) the phrases are put in the order of their suffixes, read back from the
trigger, with common lengths of neighbours: the suffix array of the dictionary. The continuations are
sequences of phrases; distinct phrases get ranks, and the sequences of ranks are sorted: the suffix
array of the parse. Both together give the corpus order, and with it for any two entries the longest
common string around the trigger, and thereby which offsets a repeat. Blocks of more than
``MOST_CONTEXTS`` entries are dealt again by narrower ranges of offsets, whose strings share more
bytes; in the end a range is one offset, a block one string, and a count decides. No block of a hot
phrase goes to one task whole.

Several lengths are found by one parse. ``report`` removes strings of ``LENGTH`` bytes, and also tells how
many bytes shorter repeats, of ``SHORT`` bytes, would cover: a passage of 50 words can have under LENGTH bytes.

* null or empty text, or one under the shortest length: nothing removed;
* null doc_id: kept as null, its text counts; rows that repeat: each a copy of the others;
* a string that repeats within one text, overlapping itself included, is removed throughout;
* very long text: one at a time in a worker; empty table: no rows; further columns are not read;
* ``dedup`` keeps all columns, whatever their names, and replaces bytes of a code point that was cut by U+FFFD.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ddl, drop_written, fresh, map_rows, ship, written

LENGTH, SHORT = 400, 256
#: Bytes of the rolling hash, and places of which one is a trigger; SPAN a power of two, both fit in the shortest length.
HASHED, SPAN = 16, 128
#: Entries of a block that one task sorts; larger blocks are dealt again by these ranges of offsets.
MOST_CONTEXTS = 256
#: Entries of a block up to which pairs are listed one by one; beyond that in arrays.
FEW = 12
WIDTHS = (32, 4, 1)
#: Rows (some 50 bytes) that may be broadcast; with more the join shuffles.
MOST_BROADCAST_ROWS = 300_000

#: Rows of a batch of phrases.
MOST_ROWS = 20_000
_HALF = 1 << 63
#: More than any length and than any number of starts in a row.
_WIDTH = 1 << 16
_hash = xxhash.xxh3_64_intdigest
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.uint64(0xD6E8FEB86659FD93)


def rolling(raw: bytes) -> np.ndarray:
    """A hash of the HASHED bytes from each place, by doubling."""
    h = (np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * _FIRST
    size = 1
    while size < HASHED:
        h = h[:-size] * _BASE + h[size:]
        h ^= h >> np.uint64(29)
        size *= 2
    return h


def triggers(raw: bytes, length: int = LENGTH, span: int = SPAN) -> Iterator[tuple[int, int, int]]:
    """(place, low, high) of each trigger; strings that start low to high bytes before it see it first.

    The least hash of a span wins, of equal ones the leftmost.
    """
    if len(raw) < length:
        return
    h = rolling(raw)
    # Places are numbered from 0 in blocks, so that hash and place fit one word in texts of any length.
    step = 1 << 22
    for at in range(0, len(raw) - length + 1, step):
        part = h[at : at + step + span - 1]
        key = (part >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while size < span:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        first = (key & np.uint64(0xFFFFFF)).astype(np.int64)[: min(step, len(raw) - length + 1 - at)]
        starts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        ends = np.r_[starts[1:], len(first)] - 1
        for p, a, b in zip(first[starts].tolist(), starts.tolist(), ends.tolist(), strict=True):
            yield at + p, p - b, p - a


def _parse(docs: DataFrame, lengths: tuple[int, ...], span: int) -> DataFrame:
    """A row for each phrase: bucket (digest of its trigger string), u (digest of phrase and continuation), its
    document's keys, the trigger's place p, the offsets low to high of its starts, and room, the bytes from p on that count."""
    shortest, longest = min(lengths), max(lengths)
    sure = shortest - span + 1

    names = ["bucket", "u", "k1", "k2", "p", "low", "high", "room"]
    schema = pa.schema([(c, pa.int64() if k < 4 else pa.int32()) for k, c in enumerate(names)])

    def run(batches):
        columns: list[list[int]] = [[] for _ in names]
        buckets, us, k1s, k2s, ps, lows, highs, rooms = columns

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            for c in columns:
                c.clear()
            return out

        for given in batches:
            for at in range(0, given.num_rows, 64):
                part = given.slice(at, 64)
                for k1, text, k2 in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    raw, before = text.encode("utf-8", "surrogatepass"), len(ps)
                    for p, low, high in triggers(raw, shortest, span):
                        buckets.append(_hash(raw[p : p + sure]) - _HALF)
                        us.append(_hash(raw[p - high : p - low + longest], low << 16 | high) - _HALF)
                        ps.append(p)
                        lows.append(low)
                        highs.append(high)
                        rooms.append(min(len(raw) - p, longest - low))
                        if len(ps) >= MOST_ROWS:
                            k1s += [k1] * (len(ps) - before)
                            k2s += [k2] * (len(ps) - before)
                            yield batch()
                            before = 0
                    k1s += [k1] * (len(ps) - before)
                    k2s += [k2] * (len(ps) - before)
        if ps:
            yield batch()

    return docs.mapInArrow(run, "bucket long, u long, k1 long, k2 long, p int, low int, high int, room int")


def _following(cells: list[tuple[int, int, int]], k: int, end: int, span: int) -> list[int]:
    """Of the phrases behind cell k: start and end, from its trigger on, of those that lie before ``end`` with their lookahead.

    A cut counts if the bytes between the trigger and ``end`` suffice to find it, so equal continuations have equal
    cuts; ``cells`` are those of all windows of the text.
    """
    p, out = cells[k][0], []
    start = 0
    for place, low, high in cells[k + 1 :]:
        seen = max(place - high, p)
        if seen + span + HASHED - 1 > end:
            break
        if seen > place - low:
            continue
        out += [start, seen + span + HASHED - 1 - p]
        start = place - p
    return [*out, start]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _least_between(order: list[int], near: list[int], n: int) -> np.ndarray:
    """Common lengths of all pairs, from a sorted order and the common lengths of neighbours in it."""
    out = np.full((n, n), 1 << 30, np.int32)
    for i in range(n - 1):
        reach = np.minimum.accumulate(near[i:])
        out[order[i], order[i + 1 :]] = reach
        out[order[i + 1 :], order[i]] = reach
    return out


class Block:
    """Entries (phrase before the trigger, continuation, cuts of the continuation) that share a trigger string.

    ``by_suffix`` is the suffix array of the dictionary: entries in the order of their phrases, read back from the
    trigger; ``by_parse`` the suffix array of the parse: entries in the order of their continuations, as sequences of
    ranks of phrases. Each comes with the common lengths of neighbours; the least of those between two entries is theirs.
    """

    def __init__(self, entries: list[tuple[bytes, bytes, list[int]]]) -> None:
        self.n = len(entries)
        phrases = [e[0][::-1] for e in entries]
        self.by_suffix = sorted(range(self.n), key=phrases.__getitem__)
        self.suffix_near = [_common(phrases[a], phrases[b]) for a, b in zip(self.by_suffix, self.by_suffix[1:], strict=False)]

        parse = [self._phrases(after, cuts) for _, after, cuts in entries]
        rank = {x: i for i, x in enumerate(sorted({x for p in parse for x in p}))}
        ranks = [[rank[x] for x in p] for p in parse]
        self.by_parse = sorted(range(self.n), key=ranks.__getitem__)
        self.parse_near = [
            self._common_parse(entries[a], ranks[a], entries[b], ranks[b]) for a, b in zip(self.by_parse, self.by_parse[1:], strict=False)
        ]

    @staticmethod
    def _phrases(after: bytes, cuts: list[int]) -> list[bytes]:
        """The phrases of a continuation, each with the lookahead that fixes its end; the last is what is left."""
        return [*(after[a:b] for a, b in zip(cuts[:-1:2], cuts[1::2], strict=True)), after[cuts[-1] :]]

    @staticmethod
    def _common_parse(one: tuple, ranks_one: list[int], two: tuple, ranks_two: list[int]) -> int:
        """Whole phrases by rank, then bytes of the first phrase that differs."""
        same = 0
        for x, y in zip(ranks_one, ranks_two, strict=False):
            if x != y:
                break
            same += 1
        if same == len(ranks_one) or same == len(ranks_two):
            return min(len(one[1]), len(two[1]))
        at = one[2][2 * same]
        return at + _common(one[1][at:], two[1][at:])

    def pairs(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(i, j), i < j: the longest common suffix of the phrases and the longest common prefix of the continuations."""
        found: list[dict[tuple[int, int], int]] = []
        for order, near in ((self.by_suffix, self.suffix_near), (self.by_parse, self.parse_near)):
            common = {}
            for x, i in enumerate(order):
                least = 1 << 30
                for j, length in zip(order[x + 1 :], near[x:], strict=True):
                    least = min(least, length)
                    common[(i, j) if i < j else (j, i)] = least
            found.append(common)
        return {k: (v, found[1][k]) for k, v in found[0].items()}

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """The same for all pairs as matrices."""
        return _least_between(self.by_suffix, self.suffix_near, self.n), _least_between(self.by_parse, self.parse_near, self.n)


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of ranges of whole numbers, both ends included."""
    found: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if found and a <= found[-1][1] + 1:
            found[-1] = (found[-1][0], max(b, found[-1][1]))
        else:
            found.append((a, b))
    return found


def repeats(group: list[tuple[int, int, int, bytes, bytes, list[int]]], lengths: tuple[int, ...]) -> list[list[tuple[int, int, int]]]:
    """Of each entry (count, low, high, before, after, cuts) of a block: (length, offsets, as a range) that repeat.

    Entries differ from one another; one with a count over 1 repeats as a whole and needs no answer.
    """
    block = Block([g[3:] for g in group])
    answers: list[list[tuple[int, int, int]]] = [[] for _ in group]
    few = len(group) <= FEW
    if few:
        pairs = block.pairs()
    else:
        suffixes, prefixes = block.arrays()
        lows, highs = (np.array([g[k] for g in group])[:, None] for k in (1, 2))
        high = np.minimum(suffixes, highs)
    for length in lengths:
        found: dict[int, list[tuple[int, int]]] = {}
        if few:
            for pair, (suffix, prefix) in pairs.items():
                for i in pair:
                    a, b = max(length - prefix, group[i][1]), min(suffix, group[i][2])
                    if a <= b and group[i][0] == 1:
                        found.setdefault(i, []).append((a, b))
        else:
            low = np.maximum(length - prefixes, lows)
            shared = low <= high
            np.fill_diagonal(shared, False)
            for i in np.flatnonzero(shared.any(axis=1)).tolist():
                if group[i][0] == 1:
                    at = np.flatnonzero(shared[i])
                    found[i] = list(zip(low[i, at].tolist(), high[i, at].tolist(), strict=True))
        for i, ranges in found.items():
            answers[i] += [(length, a, b) for a, b in _joined(ranges)]
    return answers


_FOUND = "k1 long, k2 long, length int, first int, last int"


def _sorted_out(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """k1, k2, length, first, last: the starts that repeat, of the unique entries of whole blocks."""

    def run(rows):
        held: list[tuple] = []

        def flush():
            answers = repeats([(r[1], r[2], r[3], *r[7:]) for r in held], lengths)
            for r, found in zip(held, answers, strict=True):
                for length, a, b in found:
                    yield r[4], r[5], length, r[6] - b, r[6] - a

        for row in rows:
            if held and row[0] != held[0][0]:
                yield from flush()
                held = []
            held.append(row)
        if held:
            yield from flush()

    keyed = rows.select("bucket", "t", "low", "high", "k1", "k2", "p", "before", "after", "cuts")
    keyed = keyed.repartition("bucket").sortWithinPartitions("bucket", "k1", "k2", "p")
    return map_rows(keyed, run, _FOUND, per_batch=10_000)


def _narrower(rows: DataFrame, width: int, length: int) -> DataFrame:
    """The entries cut into ranges of ``width`` offsets, in blocks by the bytes that such ranges share."""

    def run(rows):
        for t, low, high, k1, k2, p, before, after, cuts in rows:
            low = max(low, length - len(after))
            for s in range(low // width, high // width + 1):
                a, b = max(low, s * width), min(high, s * width + width - 1)
                left, right = before[len(before) - b :], after[: length - a]
                sure = left[len(left) - s * width :] + b"|" + right[: length - s * width - width + 1]
                bucket = _hash(sure, s) - _HALF
                u = _hash(left + b"|" + right, a << 16 | b) - _HALF
                n = sum(e <= len(right) for e in cuts[1::2])
                yield bucket, u, t, a, b, k1, k2, p, left, right, cuts[: 2 * n + 1]

    return map_rows(
        rows.select("t", "low", "high", "k1", "k2", "p", "before", "after", "cuts"), run,
        "bucket long, u long, t long, low int, high int, k1 long, k2 long, p int, before binary, after binary, cuts array<int>",
        per_batch=500,
    )


def _bounded(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(MOST_BROADCAST_ROWS + 1).count() <= MOST_BROADCAST_ROWS else rows


def _keyed(docs: DataFrame, doc_id: str, text: str, *more: str | Column) -> DataFrame:
    """k1, text, k2: rows that agree in both keys are copies, with equal results."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("k1"), whole.alias("text"),
        F.xxhash64(whole).alias("k2"), *more,
    )


def _starts(rows: DataFrame, lengths: tuple[int, ...], room: Column) -> DataFrame:
    """k1, k2, length, first, last: all starts of the entries, each with the greatest length that the text has room for."""
    cases, above = [], F.col("high") + 1
    for length in sorted(lengths, reverse=True):
        least = F.greatest(F.col("low"), F.lit(length) - room)
        cases.append(F.struct(F.lit(length).alias("length"), least.alias("a"), (above - 1).alias("b")))
        above = F.least(above, least)
    wide = rows.select("k1", "k2", "p", F.explode(F.filter(F.array(*cases), lambda x: x["a"] <= x["b"])).alias("x"))
    return wide.select("k1", "k2", "x.length", (F.col("p") - F.col("x.b")).alias("first"), (F.col("p") - F.col("x.a")).alias("last"))


def repeated_ranges(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lengths: tuple[int, ...] = (LENGTH,), span: int = SPAN,
) -> DataFrame:
    """k1, k2, ranges: per document the places at which repeated strings start, as codes (see ``decoded``).

    A place is listed with the greatest length at least; it repeats with any shorter length too.
    """
    shortest, longest = min(lengths), max(lengths)
    if span & (span - 1) or span + HASHED > shortest or longest >= _WIDTH:
        raise ValueError("the span must be a power of two and fit in the lengths with the hashed bytes")
    ship(docs.sparkSession)
    keyed = _keyed(docs, doc_id, text)
    # Texts that are too short for a string need no look.
    parse = written(_parse(keyed.filter(F.octet_length("text") >= shortest), lengths, span))
    shared = written(parse.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"))
    rows = written(parse.join(shared, "bucket"))
    drop_written(parse, shared)
    same = ["bucket", "u"]
    # The dictionary: entries with counts, each with one of its places.
    place = F.min(F.struct("k1", "k2", "p"))
    entries = written(rows.groupBy(*same).agg(
        F.count("*").alias("t"), place.alias("at"), F.max("low").alias("low"), F.max("high").alias("high"), F.max("room").alias("room")
    ))
    copies = rows.join(entries.filter("t > 1").select(*same), same)
    ranges = [written(_starts(copies, lengths, F.col("room")))]
    open_ = entries.groupBy("bucket").agg(F.count("*").alias("d"), F.sum((F.col("t") == 1).cast("int")).alias("ones"))
    open_ = written(open_.filter("d > 1 and ones > 0").select("bucket", "d"))
    wanted = written(entries.join(open_, "bucket").select("bucket", "t", "d", "at.*", "low", "high", "room"))
    drop_written(rows, entries, open_)

    def cut(rows):
        for k1, text, k2, places in rows:
            raw = text.encode("utf-8", "surrogatepass")
            cells = list(triggers(raw, span + HASHED - 1, span))
            number = {c[0]: k for k, c in enumerate(cells)}
            for x in places:
                p, low, high = x["p"], x["low"], x["high"]
                end = p + x["room"]
                yield x["bucket"], x["t"], x["d"], low, high, k1, k2, p, raw[p - high : p], raw[p:end], _following(cells, number[p], end, span)

    # A list for each document: no longer than the document.
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("bucket", "t", "d", "p", "low", "high", "room")).alias("places"))
    texts = keyed.join(_bounded(wanted.select("k1", "k2").distinct()), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    content = written(map_rows(
        texts.join(lists, ["k1", "k2"]).select("k1", "text", "k2", "places"), cut,
        "bucket long, t long, d long, low int, high int, k1 long, k2 long, p int, before binary, after binary, cuts array<int>",
        per_batch=500,
    ))
    drop_written(wanted)
    ranges.append(written(_sorted_out(content.filter(F.col("d") <= MOST_CONTEXTS), lengths)))
    hot_blocks = content.filter(F.col("d") > MOST_CONTEXTS)
    for length in () if hot_blocks.isEmpty() else lengths:
        hot = hot_blocks
        for width in WIDTHS:
            if hot.isEmpty():
                break
            cuts = written(_narrower(hot, width, length))
            totals = written(cuts.groupBy(*same).agg(F.sum("t").alias("total"), F.min(F.struct("k1", "k2", "p", "low")).alias("at")))
            alone = cuts.filter("t = 1").join(totals.filter("total > 1").select(*same), same)
            ranges.append(written(_starts(alone, (length,), F.lit(length))))
            sizes = totals.groupBy("bucket").agg(F.count("*").alias("d"), F.sum((F.col("total") == 1).cast("int")).alias("ones"))
            sizes = written(sizes.filter("d > 1 and ones > 0").select("bucket", "d"))
            # One of the places of each entry of an open block; places are spread evenly, blocks are not.
            named = written(totals.join(sizes, "bucket").select("bucket", "u", "total", "d", "at.*"))
            key = ["bucket", "u", "k1", "k2", "p", "low"]
            left = cuts.drop("t").join(named.withColumnRenamed("total", "t"), key).dropDuplicates(key)
            hot = written(left)
            ranges.append(written(_sorted_out(hot.filter(F.col("d") <= MOST_CONTEXTS), (length,))))
            hot = hot.filter(F.col("d") > MOST_CONTEXTS)
            drop_written(cuts, totals, sizes, named)
    drop_written(content)
    found = ranges[0]
    for r in ranges[1:]:
        found = found.unionByName(r)
    code = (F.col("first").cast("long") * _WIDTH + F.col("last") - F.col("first")) * _WIDTH + F.col("length")
    return found.groupBy("k1", "k2").agg(F.collect_list(code).alias("ranges"))


def decoded(codes: list[int] | None) -> list[tuple[int, int, int]]:
    """(length, first, last) of the codes."""
    return [(c % _WIDTH, c // _WIDTH**2, c // _WIDTH**2 + c // _WIDTH % _WIDTH) for c in codes or ()]


def covered(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """The maximal byte runs (start, end) that strings starting in the ranges cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + length))
        else:
            out.append((a, b + length))
    return out


def kept_bytes(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _runs(codes: list[int] | None, *lengths: int) -> list[tuple[int, int]]:
    """The maximal byte runs that repeated strings of any of the lengths cover."""
    if not codes:
        return []
    found = decoded(codes)
    runs = [r for n in lengths for r in covered([(a, b) for x, a, b in found if x == n], n)]
    return covered(runs, 0)


def report(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, short: int = SHORT, span: int = SPAN,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_short (bytes that repeated strings of ``short`` bytes cover)."""
    ranges = repeated_ranges(docs, doc_id, text, (length, short), span)
    rows = _keyed(docs, doc_id, text, F.col(doc_id).cast("long").alias("id")).join(ranges, ["k1", "k2"], "left")

    def run(rows):
        for i, t, found in rows:
            raw = t.encode("utf-8", "surrogatepass")
            runs = _runs(found, length)
            kept = kept_bytes(raw, runs)
            covers = sum(b - a for a, b in _runs(found, length, short))
            yield i, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), covers

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_short long"
    return map_rows(rows.select("id", "text", "ranges"), run, schema)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, span: int = SPAN) -> DataFrame:
    """The documents without their repeated strings; null texts stay null, and all columns are kept."""
    k1, k2, found = fresh(docs, "k1", "k2", "ranges")
    ranges = repeated_ranges(docs, doc_id, text, (length,), span).toDF(k1, k2, found)
    whole = F.coalesce(F.col(text), F.lit(""))
    own = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    rows = docs.join(ranges, (own == F.col(k1)) & (F.xxhash64(whole) == F.col(k2)), "left").drop(k1, k2)
    at = docs.columns.index(text)

    def cut(rows):
        for *row, places in rows:
            if row[at] is not None and places is not None:
                row[at] = kept_bytes(row[at].encode("utf-8", "surrogatepass"), _runs(places, length)).decode("utf-8", "replace")
            yield tuple(row)

    return map_rows(rows, cut, ddl(docs))
