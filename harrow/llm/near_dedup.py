"""Near-duplicate detection with b-bit MinHash, banding, and links confirmed on full shingle sets.

1. Each text becomes its set of 5-word shingles, 512 minima of it, the low two bits of each minimum
   packed into 128 bytes, and 32 band keys of four whole minima each. Texts with equal sets are one
   node from here on, however many copies there are.
2. Nodes that share a band key form a bucket. A bucket is cut into blocks of about ``BLOCK`` nodes, and each
   node is compared within its own block: as many rows as nodes, however large the bucket.
3. In a block the similarity of all pairs is estimated at once from counts of equal bit pairs,
   corrected for chance collisions. What leaves the block is a spanning forest of the best pairs.
4. Pairs are confirmed on full sets, and linked nodes become components.
5. Buckets in which more than one component is left are compared in full: components of more than a block
   are cut into blocks of their own, all others share blocks, and blocks meet in pairs, but never two
   of one component. Every pair of different components that could be a link is confirmed, in the block, on the
   full sets, which come in slices of the range of hashes. So all links count, but pairs are never
   listed: what leaves a block are its nodes, and links that join components.

The fifth step costs what it must: pairs of nodes that share a bucket but no component.

Chances of missing a link at similarity 0.75: no shared band, 5 in a million; an estimate under the
limit (4.5 standard deviations), 4 in a million; both fall fast as similarity rises.

* null or empty text, or one without words: n_shingles 0, a component of its own;
* fewer words than a shingle has: the whole sequence is the one shingle;
* null doc_id: linked like any other, never the smallest unless no row of the component has an id;
* rows that repeat a doc_id: a row each, kept alike; ``dedup`` returns one row of each component;
* very long text: the sets of two texts in a worker's memory, of more only slices; empty table: no rows;
* further columns, whatever their names, pass through ``dedup`` unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, fresh, id_text, map_rows, ship, space_words, written
from .components import components

SHINGLE_WORDS = 5
#: A link: 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
MINIMA, BITS, BANDS, ROWS = 512, 2, 32, 4
#: Nodes of a bucket that one task compares with as many others.
BLOCK = 256
#: Hashes of a set that a unit's worker holds at a time.
SLICE_HASHES = 8192
#: Standard deviations below the threshold at which an estimate still counts.
MARGIN = 4.5
#: Ids with hashes that may be broadcast (16 bytes each); with more the join shuffles.
MOST_BROADCAST_IDS = 500_000

_random = np.random.default_rng(20)
_FACTORS = _random.integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _random.integers(0, 2**32, MINIMA, dtype=np.uint32)
_MIX = _random.integers(0, 2**63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_MIX = _random.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLICE = 256


def shingles(text: str) -> np.ndarray:
    """The set of shingles as sorted 64-bit hashes."""
    words = space_words(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE_WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - SHINGLE_WORDS + 1
    s = np.zeros(n, np.uint64)
    for k in range(SHINGLE_WORDS):
        s = (s ^ (s >> np.uint64(29))) * _MIX[0] + h[k : k + n] * _MIX[k]
    s ^= s >> np.uint64(32)
    s *= _MIX[1]
    return np.unique(s ^ (s >> np.uint64(29)))


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of each of MINIMA hash functions over the set."""
    low = np.full(MINIMA, 2**32 - 1, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    held = np.empty((_SLICE, MINIMA), np.uint32)
    for at in range(0, len(x), _SLICE):
        part = x[at : at + _SLICE, None]
        values = np.multiply(part, _FACTORS, out=held[: len(part)])
        values += _OFFSETS
        np.minimum(low, values.min(axis=0), out=low)
    return low


def packed(low: np.ndarray) -> bytes:
    """The low bits of the minima, four pairs to a byte."""
    pairs = (low & np.uint32(3)).astype(np.uint8).reshape(-1, 4)
    return (pairs[:, 0] | pairs[:, 1] << 2 | pairs[:, 2] << 4 | pairs[:, 3] << 6).astype(np.uint8).tobytes()


def band_keys(low: np.ndarray) -> list[int]:
    rows = low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _BAND_MIX[0]
    for k in range(ROWS):
        key = (key ^ (key >> np.uint64(31)) ^ rows[:, k]) * _BAND_MIX[k]
    return (key ^ (key >> np.uint64(29))).astype(np.int64).tolist()


def least_equal(similarity: float = SIMILARITY / 100, margin: float = MARGIN) -> int:
    """Equal bit pairs from which a pair may be a link: a chance collision happens once in 2**BITS."""
    chance = 0.5**BITS
    p = similarity + (1 - similarity) * chance
    return int(MINIMA * p - margin * (MINIMA * p * (1 - p)) ** 0.5)


def estimate(equal: float) -> float:
    """Similarity from the number of equal bit pairs, corrected for chance collisions."""
    chance = 0.5**BITS
    return (equal / MINIMA - chance) / (1 - chance)


def equal_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal bit pairs of one packed signature (row of uint64) with each of several."""
    x = a ^ b
    return MINIMA - np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int64)


def is_link(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SIMILARITY * (len(a) + len(b) - both)


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, node (digest of the set; null without words), n_shingles, bands, sig and keys (the bands, short)."""

    def run(rows):
        for i, t, h in rows:
            s = shingles(t)
            if not len(s):
                yield i, h, None, 0, None, None, None
                continue
            low = minima(s)
            bands = band_keys(low)
            keys = np.array(bands, np.int64).astype(np.uint32).tobytes()
            yield i, h, xxhash.xxh3_128_digest(s.tobytes()), len(s), bands, packed(low), keys

    plain = docs.select(*id_text(doc_id, text)).withColumn("text_hash", F.xxhash64("text"))
    return map_rows(plain, run, "doc_id long, text_hash long, node binary, n_shingles long, bands array<long>, sig binary, keys binary")


def members(nodes: DataFrame) -> DataFrame:
    """band, at, node, size: the nodes of each bucket of two or more; the band has number ``at``."""
    placed = nodes.select("node", F.posexplode("bands").alias("at", "band"))
    full = written(placed.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"))
    out = written(placed.join(full, "band").select("band", "at", "node", "size"))
    drop_written(full)
    return out


_FACTS = ["unit", "at", "node", "n", "sig", "keys"]


def _with_facts(dealt: DataFrame, nodes: DataFrame) -> DataFrame:
    return dealt.join(nodes.select("node", F.col("n_shingles").alias("n"), "sig", "keys"), "node")


def own_units(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The blocks that are compared within themselves: each node once for each of its buckets."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    unit = F.xxhash64("band", F.pmod(F.xxhash64("node"), blocks))
    return _with_facts(placed.select("node", "at", unit.alias("unit")), nodes).select(*_FACTS)


def cross_units(placed: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs of blocks of buckets with more than one component; none of two blocks of one component."""
    rooted = placed.join(roots, "node", "left").select("band", "at", "node", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted)
    sizes = written(rooted.groupBy("band", "root").agg(F.count("*").alias("m")))
    several = sizes.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.when(F.col("m") <= BLOCK, F.col("m")).otherwise(0)).alias("small"))
    several = written(several.filter("n > 1").withColumn("mixed", F.ceil(F.col("small") / BLOCK).cast("int")))
    groups = sizes.join(several, "band")
    large = groups.filter(F.col("m") > BLOCK).withColumn("slices", F.ceil(F.col("m") / BLOCK).cast("int"))
    of_large = large.select("band", "root", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    of_large = of_large.select("band", "root", F.xxhash64("root", "slice").alias("block"))
    of_mixed = several.filter("mixed > 0").select("band", F.lit(None).cast("binary").alias("root"), F.explode(F.sequence(F.lit(0), F.col("mixed") - 1)).alias("block"))
    blocks = of_large.unionByName(of_mixed.withColumn("block", F.col("block").cast("long")))
    lists = blocks.groupBy("band").agg(F.collect_list(F.struct("block", "root")).alias("blocks"))
    # For each component of more than a block, and for the others of a bucket together, the blocks that they meet.
    kinds = large.select("band", "root").unionByName(several.filter("mixed > 0").select("band", F.lit(None).cast("binary").alias("root")))
    meet = kinds.withColumnRenamed("root", "kind").join(lists, "band").select(
        "band", F.coalesce("kind", F.lit(b"")).alias("kind"),
        F.transform(F.filter("blocks", lambda x: F.col("kind").isNull() | ~x["root"].eqNullSafe(F.col("kind"))), lambda x: x["block"]).alias("others"),
    )
    meet = written(meet)
    sized = written(groups.select("band", "root", "m", "mixed"))
    slice_ = F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / BLOCK).cast("int")).cast("int")  # the type counts in the hash
    own = F.when(F.col("m") > BLOCK, F.xxhash64("root", slice_)).otherwise(F.pmod(F.xxhash64("root"), F.col("mixed")))
    named = rooted.join(sized, ["band", "root"]).select(
        "band", "at", "node", "root", own.cast("long").alias("own"), F.when(F.col("m") > BLOCK, F.col("root")).otherwise(F.lit(b"")).alias("kind")
    )
    dealt = named.join(meet, ["band", "kind"]).select("band", "at", "node", "root", "own", F.explode("others").alias("other"))
    unit = F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other"))
    out = written(_with_facts(dealt.select("node", "at", "root", unit.alias("unit")), nodes).select(*_FACTS, "root"))
    drop_written(rooted, sizes, several, meet, sized)
    return out


def _groups(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for row in rows:
        if held and row[0] != held[0][0]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _possible(k: int, sigs: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """Equal counts of row k with all rows; -1 where no link is possible."""
    equal = equal_counts(sigs[k], sigs)
    fits = 100 * np.minimum(sizes, sizes[k]) >= SIMILARITY * np.maximum(sizes, sizes[k])
    return np.where(fits & (equal >= least), equal, -1)


def best_pairs(unit_rows: DataFrame) -> DataFrame:
    """a, b: of each unit, a spanning forest of the pairs with the highest estimates (Prim's algorithm)."""
    least = least_equal()

    def run(rows):
        for group in _groups(rows):
            if len(group) < 2:
                continue
            sigs = np.frombuffer(b"".join(r[3] for r in group), np.uint64).reshape(len(group), -1)
            sizes = np.array([r[2] for r in group])
            best, by, out = np.full(len(group), -1), np.zeros(len(group), int), np.ones(len(group), bool)
            k = 0
            for _ in range(len(group) - 1):
                out[k] = False
                equal = _possible(k, sigs, sizes, least)
                better = out & (equal > best)
                best[better], by[better] = equal[better], k
                k = int(np.argmax(np.where(out, best, -2)))
                if best[k] >= 0:
                    yield sorted((group[k][1], group[by[k]][1]))

    keyed = unit_rows.select("unit", "node", "n", "sig").repartition("unit").sortWithinPartitions("unit", "node")
    return map_rows(keyed, run, "a binary, b binary").distinct()


def _cross(group: list[tuple], least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, js): rows k < js of a unit that may be a link between components, in their first common band.

    Rows are (unit, at, node, n, sig, keys, root, ...).
    """
    numbers: dict[bytes, int] = {}
    root = np.array([numbers.setdefault(r[6], len(numbers)) for r in group])
    if len(numbers) < 2:
        return
    sigs = np.frombuffer(b"".join(r[4] for r in group), np.uint64).reshape(len(group), -1)
    keys = np.frombuffer(b"".join(r[5] for r in group), np.uint32).reshape(len(group), BANDS)
    sizes = np.array([r[3] for r in group])
    at = group[0][1]
    for k in range(len(group) - 1):
        js = np.flatnonzero((_possible(k, sigs, sizes, least) >= 0) & (root != root[k]))
        js = js[js > k]
        if len(js):
            js = js[(keys[js, :at] != keys[k, :at]).all(axis=1)]
        if len(js):
            yield k, js


def _shared_sizes(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs: products of the incidence matrix, a slice of shingles at a time."""
    every, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(every), 4096):
        a, b = np.searchsorted(column, (at, at + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out


class _Joined:
    """Which components a unit's links have joined."""

    def __init__(self, group: list[tuple]) -> None:
        self.group, self.of = group, {r[6]: r[6] for r in group}

    def _find(self, x: bytes) -> bytes:
        while self.of[x] != x:
            self.of[x] = x = self.of[self.of[x]]
        return x

    def apart(self, k: int, j: int) -> bool:
        return self._find(self.group[k][6]) != self._find(self.group[j][6])

    def link(self, k: int, j: int) -> list[bytes]:
        self.of[self._find(self.group[k][6])] = self._find(self.group[j][6])
        return sorted((self.group[k][2], self.group[j][2]))


class _Counter:
    """Sizes of the intersections of a unit's candidate pairs, from one slice of the sets after another."""

    def __init__(self, group: list[tuple], pairs: list[tuple[int, np.ndarray]]) -> None:
        self.n, self.pairs = len(group), pairs
        self.dense = sum(len(js) for _, js in pairs) > 2 * len(group)
        self.both = np.zeros((self.n, self.n), np.float32) if self.dense else [np.zeros(len(js), np.int64) for _, js in pairs]

    def add(self, parts: list[np.ndarray]) -> None:
        # A comparison of two sets costs some 100 ns an element, a product far less.
        if self.dense:
            self.both += _shared_sizes(parts)
            return
        for (k, js), both in zip(self.pairs, self.both, strict=True):
            for x, j in enumerate(js.tolist()):
                both[x] += len(np.intersect1d(parts[k], parts[j], assume_unique=True))

    def of_pair(self, at: int) -> np.ndarray:
        k, js = self.pairs[at]
        return self.both[k, js] if self.dense else self.both[at]


def cross_links(unit_rows: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links between different components that no forest of best pairs had, confirmed on full sets.

    The first pass names the nodes of each unit that such a link could touch; the second gets their sets, a
    slice of the range of hashes at a time, counts what pairs share, and lets a spanning part of the links out.
    """
    least = least_equal()

    def concerned(rows):
        for group in _groups(rows):
            touched: set[int] = set()
            for k, js in _cross(group, least):
                touched.add(k)
                touched.update(js.tolist())
            most = max((group[k][3] for k in touched), default=0)
            bits = max(0, (most - 1) // SLICE_HASHES).bit_length()
            for k in sorted(touched):
                yield *group[k], bits

    def sliced(rows):
        for *row, bits, hashes in rows:
            yield *row, -1, None
            whole = np.frombuffer(hashes, np.uint64)
            ends = np.searchsorted(whole, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
            for k, part in enumerate(np.split(whole, ends)):
                yield row[0], None, row[2], None, None, None, None, k, part.tobytes()

    def links(rows):
        state = None

        def finish():
            group, counter = state[0], state[1]
            if counter is None:
                return
            joined, sizes = _Joined(group), [r[3] for r in group]
            for at, (k, js) in enumerate(counter.pairs):
                for j, both in zip(js.tolist(), counter.of_pair(at).tolist(), strict=True):
                    if 100 * both >= SIMILARITY * (sizes[k] + sizes[j] - both) and joined.apart(k, j):
                        yield joined.link(k, j)

        for unit, slice_, part in _slices(rows):
            if slice_ < 0:
                if state is not None:
                    yield from finish()
                pairs = list(_cross(part, least))
                state = part, _Counter(part, pairs) if pairs else None, {r[2]: k for k, r in enumerate(part)}
            elif state[1] is not None:
                sets_ = [np.empty(0, np.uint64)] * len(state[0])
                for r in part:
                    sets_[state[2][bytes(r[2])]] = np.frombuffer(r[8], np.uint64)
                state[1].add(sets_)
        if state is not None:
            yield from finish()

    head = "unit long, at int, node binary, n long, sig binary, keys binary, root binary"
    few = map_rows(unit_rows.repartition("unit").sortWithinPartitions("unit", "node"), concerned, head + ", bits int")
    few = written(few)
    full = few.join(sets, "node").select(*_FACTS, "root", "bits", "hashes")
    parts = map_rows(full, sliced, head + ", slice int, hashes binary")
    out = map_rows(parts.repartition("unit").sortWithinPartitions("unit", "slice", "node"), links, "a binary, b binary")
    out = written(out.distinct())
    drop_written(few)
    return out


def _slices(rows: Iterator[tuple]) -> Iterator[tuple[int, int, list[tuple]]]:
    """unit, slice and rows of each run of rows with both alike."""
    held: list[tuple] = []
    for row in rows:
        if held and (row[0], row[7]) != (held[0][0], held[0][7]):
            yield held[0][0], held[0][7], held
            held = []
        held.append(row)
    if held:
        yield held[0][0], held[0][7], held


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. ``sets`` has the sorted hashes of each node."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b")), "b").select("a", "set_a", "b", "set_b")

    def run(rows):
        for a, set_a, b, set_b in rows:
            if is_link(np.frombuffer(set_a, np.uint64), np.frombuffer(set_b, np.uint64)):
                yield a, b

    return map_rows(two, run, "a binary, b binary")


def _bounded(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(MOST_BROADCAST_IDS + 1).count() <= MOST_BROADCAST_IDS else ids


def _sets(docs: DataFrame, doc_id: str, text: str, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, hashes (sorted, 8 bytes each) of the given nodes; only documents with the smallest id of such a node are read again."""
    ids = written(classes.join(nodes, "node", "left_semi").select("id").distinct())
    plain = docs.select(*id_text(doc_id, text))
    chosen = plain.join(_bounded(ids), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")

    def name(rows):
        for (t,) in rows:
            s = shingles(t)
            if len(s):
                yield xxhash.xxh3_128_digest(s.tobytes()), s.tobytes()

    found = written(map_rows(chosen, name, "node binary, hashes binary", per_batch=500))
    # Ids that repeat, or that no row has, can bring a node more than once.
    if found.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return found
    once = written(found.dropDuplicates(["node"]))
    drop_written(found)
    return once


def annotate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id, kept."""
    return _annotated(docs, doc_id, text).select("doc_id", "n_shingles", "component_id", "kept")


def _annotated(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``annotate`` with text_hash, and root: the same for all rows of a component of two rows or more, else null."""
    ship(docs.sparkSession)
    sketched = written(sketches(docs, doc_id, text))
    nodes = written(sketched.filter("node is not null").dropDuplicates(["node"]).select("node", "n_shingles", "bands", "sig", "keys"))
    placed = members(nodes)
    shared = written(placed.select("node").distinct())
    # Copies are counted before their rows move: a text that a third of all rows share is a row for each task.
    classes = sketched.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    classes = written(classes)
    sets = _sets(docs, doc_id, text, classes, shared)
    first = written(best_pairs(own_units(placed, nodes)))
    links = written(confirmed(first, sets))
    roots = written(components(links))
    unit_rows = cross_units(placed, nodes, roots)
    rest = cross_links(unit_rows, sets)
    if not rest.isEmpty():
        roots = written(components(links.unionByName(rest)))
    # Of each node with copies or links, the smallest id of all that it can reach.
    named = classes.join(roots, "node", "left").filter("copies > 1 or root is not null")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    special = written(named.join(least, "root").select("node", "root", "component_id"))
    out = sketched.select("doc_id", "text_hash", "n_shingles", "node").join(special, "node", "left")
    component = F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    out = written(out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), kept.alias("kept"), "root"))
    drop_written(sketched, nodes, placed, shared, classes, sets, first, links, roots, unit_rows, rest, special)
    return out


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns.

    Rows are named by id and text hash, so that rows which repeat an id, or have none, go separate ways.
    """
    grouped = _annotated(docs, doc_id, text).filter("root is not null")
    chosen = grouped.filter("kept").groupBy("root").agg(F.min("text_hash").alias("stay"))
    judged = grouped.join(chosen, "root").withColumn("stays", F.expr("kept and text_hash = stay"))
    own_id, own_hash = fresh(docs, "id", "hash")
    name = [F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)]
    gone = written(judged.filter("not stays").select(*name).distinct())
    again = written(judged.filter("stays").groupBy(*name).agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(own_id)) & (
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(own_hash)
    )
    kept = docs.join(_bounded(gone), same, "left_anti")
    if again.isEmpty():
        return kept
    # Rows that repeat id and text; few, and only they are dealt by them.
    once = kept.join(_bounded(again), same, "left_anti")
    repeated = kept.join(_bounded(again), same, "left_semi").dropDuplicates([doc_id, text])
    return once.unionByName(repeated)
