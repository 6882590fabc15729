"""Substring dedup, language model and near-duplicates against brute force."""

import hashlib
import math
import os
import pickle
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.llm import lm, near_dedup, queries, substring_dedup

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "b"), (None, "b"), (4, " \t\n"), (5, "é日本🙂 x")]


def texts(spark, sf=SF):
    return [(r.doc_id, r.text) for r in queries.documents(spark, sf).collect()]


def brute_kept(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(rows, raws, strict=True):
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        spans = int(np.count_nonzero(gone[:-1] & ~np.r_[False, gone[:-1]][: len(r)]))
        out.append((i, len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removed(frame):
    return sorted((tuple(r)[:5] for r in frame.collect()), key=repr)


def test_op1(spark):
    want = brute_kept(texts(spark), substring_dedup.LENGTH)
    got = queries.op1_substring_dedup(spark, SF)
    assert removed(got) == want and any(r[2] for r in want)
    covers = sorted(((r.doc_id, r.n_short) for r in got.collect()), key=repr)
    assert covers == [(r[0], r[2]) for r in brute_kept(texts(spark), substring_dedup.SHORT)]


def pieces(rng, alphabet):
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(30, 200))) for _ in range(4)]
    out = []
    for _ in range(40):
        text = ""
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, 60)
            text += rng.choice(base)[at : at + rng.randint(10, 120)] + "".join(rng.choice("wxyz") for _ in range(rng.randint(0, 30)))
        out.append(text)
    return [*out, "a" * 100, "ab" * 60, "é" * 90]


@pytest.mark.parametrize("most", [256, 1])
def test_op1_random(spark, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "FEW", 12 if most == 1 else 3)
    monkeypatch.setattr(substring_dedup, "MOST_ROWS", 50)
    monkeypatch.setattr(substring_dedup, "MOST_CONTEXTS", most)  # 1: every bucket is dealt by narrower ranges
    monkeypatch.setattr(substring_dedup, "MOST_BROADCAST_ROWS", 0 if most == 1 else 300_000)
    rng = random.Random(most)
    rows = [*((k, t) for k, t in enumerate(pieces(rng, "ab "))), *((100 + k, t) for k, t in enumerate(pieces(rng, "abcdefgh"))), *ODD]
    rows += [(7, "q" * 39), (None, rows[0][1]), (8, rows[50][1]), (8, rows[50][1])]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, k1 string")
    got = substring_dedup.report(docs, length=60, short=40, span=16)
    assert removed(got) == brute_kept(rows, 60)
    assert Counter((r.doc_id, r.n_bytes, r.n_short) for r in got.collect()) == Counter(r[:3] for r in brute_kept(rows, 40))


def test_op1_block():
    """The orders of dictionary and parse give the common strings of all pairs of entries."""
    rng = random.Random(5)
    raws = [p.encode() for p in pieces(rng, "ab ") if len(p) >= 60]
    span, room = 16, 50
    entries = []
    for raw in raws:
        cells = list(substring_dedup.triggers(raw, span + substring_dedup.HASHED - 1, span))
        for k, (p, _, high) in enumerate(cells):
            end = min(len(raw), p + room)
            entries.append((raw[p - high : p], raw[p:end], substring_dedup._following(cells, k, end, span)))
    entries = entries[:150]
    assert any(len(e[2]) > 1 for e in entries)
    block = substring_dedup.Block(entries)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    pairs, (suffixes, prefixes) = block.pairs(), block.arrays()
    for i, a in enumerate(entries):
        for j, b in enumerate(entries[:i]):
            want = common(a[0][::-1], b[0][::-1]), common(a[1], b[1])
            assert pairs[j, i] == (suffixes[i, j], prefixes[i, j]) == (suffixes[j, i], prefixes[j, i]) == want


def test_op1_dedup(spark):
    line = "".join(map(chr, range(0x4E00, 0x4E00 + 40)))
    docs = spark.createDataFrame([(1, f"x{line}y", "c"), (2, f"{line}", "d"), (3, None, "e"), (4, "short", "f")], "doc_id long, text string, ranges string")
    docs = docs.select("*", *(F.concat("ranges", F.lit(k)).alias(k) for k in ("k1", "K2", "__k1", "__ranges", "ranges_")))
    found = substring_dedup.dedup(docs, length=40, span=16)
    got = {r.doc_id: r for r in found.collect()}
    assert found.columns == docs.columns
    assert got[1].text == "xy" and got[2].text == "" and got[3].text is None and got[4].text == "short"
    assert tuple(got[1])[2:] == ("c", "ck1", "cK2", "c__k1", "c__ranges", "cranges_")
    assert substring_dedup.report(docs.limit(0)).count() == 0


def brute_base(rows):
    words = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    seen = Counter(w for (_, ws), h in zip(words, held, strict=True) if not h for w in ws)
    n = sum(seen.values())
    norm = n + 0.5 * (len(seen) + 1)
    return sorted(
        ((i, h, len(ws), sum(w in seen for w in ws), n, round(sum(math.log10((seen[w] + 0.5) / norm) for w in ws), 6))
         for (i, ws), h in zip(words, held, strict=True)), key=repr,
    )


def based(frame):
    return sorted(((*tuple(r)[:5], round(r.base_score, 6)) for r in frame.collect()), key=repr)


def test_op4(spark):
    rows = texts(spark)
    got = queries.op4_lm(spark, SF).collect()
    assert sorted(((*tuple(r)[:5], round(r.base_score, 6)) for r in got), key=repr) == brute_base(rows)
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op4_rare_words_by_join(spark):
    rows = [*texts(spark)[:60], *ODD]
    docs = spark.createDataFrame([(*r, "c", "c") for r in rows], "doc_id long, text string, word string, held_out string")
    few, many = (lm.score(docs, most_common=m) for m in (40, 10**6))
    assert based(few) == based(many) == brute_base(rows)
    assert lm.score(docs.limit(0)).count() == 0


def small_model(spark, n=60):
    docs = spark.createDataFrame(texts(spark)[:n], "doc_id long, text string")
    corpus = lm.corpus_of(lm.count_words(docs))
    return docs, corpus, lm.train(lm.encode(docs, corpus), corpus)


def read(corpus, texts):
    """words, codes, classes, members and feature rows of the texts."""
    words, starts, codes = lm.Reader(corpus).read(texts)
    return words, codes, *lm.Coding(corpus).features(codes, starts)


def test_lm_is_a_distribution(spark):
    """The probabilities of all words and of an unknown one add up to one after any history."""
    docs, corpus, model = small_model(spark)
    scorer, head = lm.Scorer(model), corpus.shape.head
    *_, rows = read(corpus, [texts(spark)[3][1]])
    rows = rows[:, :5]
    total = np.zeros(5)
    for c in range(head):
        for m in range(corpus.shape.members):
            total += np.exp(scorer.log_probs(np.full(5, c), np.full(5, m), rows))
    for c in range(head, corpus.shape.classes):  # tail classes share all of their mass out
        total += np.exp(scorer.log_probs(np.full(5, c), np.full(5, -1), rows))
    assert np.allclose(total, 1, atol=1e-3)
    counts = Counter(x for i, t in texts(spark)[:60] if zlib.crc32(str(i).encode()) % 5 != 1 for x in (t.encode().lower().split() + [b""]))
    mass = defaultdict(float)
    for word, c in counts.items():
        if word not in corpus.common[: corpus.n_head]:
            mass[lm.tail_class_of(word)] += c + 0.5
    assert all(abs(mass[k] - corpus.tail_mass[k]) < 1e-6 for k in range(lm.TAIL))


def test_lm_counts_and_score_by_brute_force(spark):
    """Counts of rows over all training documents, and the score of a text, one token and one outcome at a time."""
    docs, corpus, model = small_model(spark)
    shape = corpus.shape
    want = [defaultdict(int), defaultdict(int)]
    for i, t in texts(spark)[:60]:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            _, _, classes, members, rows = read(corpus, [t])
            for n, (c, m) in enumerate(zip(classes.tolist(), members.tolist(), strict=True)):
                for k in range(lm.KINDS):
                    want[0][k, int(rows[k, n]), c] += 1
                    if m >= 0:
                        want[1][k, c * shape.inner + int(rows[k, n]) % shape.inner, m] += 1
    for factor, counts in zip((model.outer, model.inner), want, strict=True):
        seen = np.zeros(factor.seen.shape)
        for (k, r, _), n in counts.items():
            seen[k, r] += n
        assert np.array_equal(seen, factor.seen)
        for (k, r, o), n in list(counts.items())[:2000]:
            share = math.exp(factor.bias[r // factor.rows, o])
            assert abs(math.log1p(n / (lm.SMOOTH * share)) - lm.UNIT * float(factor.weights[k, r, o])) <= lm.UNIT / 2 + 1e-3
        assert np.count_nonzero(factor.weights) == len(counts)

    def log_softmax(factor, group, rows, outcome):
        scores = factor.bias[group].astype(float)
        for k, r in enumerate(rows):
            scores = scores + factor.steps[k][min(lm.SEEN - 1, int(factor.seen[k, r]).bit_length())] * lm.UNIT * factor.weights[k, r].astype(float)
        return scores[outcome] - math.log(np.exp(scores).sum())

    got = {r.doc_id: r for r in lm.score(docs).collect()}
    for i, t in texts(spark)[:6]:
        words, place, classes, members, rows = read(corpus, [t])
        total = 0.0
        for n, (c, m) in enumerate(zip(classes.tolist(), members.tolist(), strict=True)):
            total += log_softmax(model.outer, 0, rows[:, n], c)
            if m >= 0:
                total += log_softmax(model.inner, c, rows[:, n] % shape.inner + c * shape.inner, m)
            else:
                count = corpus.counts[place[n]] if place[n] >= 0 else 0
                total += math.log((count + 0.5) / (corpus.tail_mass[c - shape.head] + 0.5))
        assert abs(total / math.log(10) - got[i].score) < 0.02 + 1e-3 * len(words)


def test_lm_slope_is_that_of_the_likelihood(spark):
    _, corpus, model = small_model(spark)
    _, _, classes, members, rows = read(corpus, [t for _, t in texts(spark)[:4]])
    factor = lm.Factor(model.outer.bias, model.outer.rows)
    factor.weights, factor.seen = model.outer.weights, model.outer.seen
    group = np.zeros(len(classes), np.int64)

    def likelihood(steps):
        """Each token taken out of the counts of its rows, by their definition."""
        total = 0.0
        for n, c in enumerate(classes.tolist()):
            scores = factor.bias[0].astype(float)
            for k in range(lm.KINDS):
                w, seen = lm.UNIT * factor.weights[k, rows[k, n]].astype(float), float(factor.seen[k, rows[k, n]])
                prior = lm.SMOOTH * math.exp(factor.bias[0, c])
                held = round(math.expm1(w[c]) * prior)
                w[c] = math.log1p(max(held - 1, 0) / prior)
                scores = scores + steps[k, min(lm.SEEN - 1, int(max(seen - 1, 0)).bit_length())] * w
            total += scores[c] - math.log(np.exp(scores).sum())
        return total

    slope, curve = factor.curvature(group, rows, classes)
    size = lm.KINDS * lm.SEEN
    for at in ((0, 3), (1, 1), (2, 4)):
        up, down = factor.steps.copy(), factor.steps.copy()
        up[at] += 1e-3
        down[at] -= 1e-3
        values = [likelihood(x) for x in (up, factor.steps, down)]
        i = at[0] * lm.SEEN + at[1]
        assert abs((values[0] - values[2]) / 2e-3 - slope[i]) < 0.05 + 0.01 * abs(slope[i])
        assert abs((2 * values[1] - values[0] - values[2]) / 1e-6 - curve[i * size + i]) < 1 + 0.05 * abs(curve[i * size + i])


def test_lm_does_not_depend_on_partitions(spark, monkeypatch):
    docs = queries.documents(spark, "/root/testdata/sf0.01")
    one, four, many = ({r.doc_id: r for r in lm.score(docs.repartition(n)).collect()} for n in (1, 4, 64))
    for other in (four, many):
        assert all(abs(one[i].score - other[i].score) < 1e-6 * one[i].n_tokens for i in one)
    held = [r for r in one.values() if r.held_out]
    assert sum(r.score - r.base_score for r in held) > 0.1 * sum(r.n_tokens for r in held)
    monkeypatch.setattr(lm, "TOKENS_A_SUM", 10_000)  # partial sums before the sums of blocks
    again = {r.doc_id: r for r in lm.score(docs.repartition(64)).collect()}
    assert all(abs(one[i].score - again[i].score) < 1e-6 * one[i].n_tokens for i in one)


def test_lm_counts_beyond_sixteen_bits():
    shape = lm.Shape(1024, 1, 2)
    counts, n = lm.Counts(shape), 150_000
    one = np.zeros(lm.BATCH, np.int64)
    for at in range(0, n, lm.BATCH):
        size = min(lm.BATCH, n - at)
        counts.add(one[:size], one[:size], np.full((lm.KINDS, size), 7, np.int32))
    blocks = {(f, k, first): np.frombuffer(x, np.uint32) for f, k, first, x in counts.blocks()}
    assert len(blocks) == 2 * lm.KINDS and all(x.sum() == x.max() == n for x in blocks.values())


def test_lm_places_of_the_largest_model():
    shape = lm.shape_of(10**12, 10**9)
    classes = np.array([0, shape.head - 1, shape.head], np.int16)
    _, (group, rows, _) = shape.places(classes, np.array([0, 1, -1], np.int16), np.full((lm.KINDS, 3), shape.rows - 1, np.int32))
    assert group.tolist() == [0, shape.head - 1] and rows[0].tolist() == [shape.inner - 1, shape.rows - 1]


def test_lm_grows_with_the_corpus():
    small, large, huge = lm.shape_of(20_000, 5_000), lm.shape_of(4_000_000, 200_000), lm.shape_of(10**12, 10**9)
    assert small.rows < large.rows < huge.rows == lm.MOST_ROWS
    assert small.head * small.members < large.head * large.members <= huge.head * huge.members == lm.MOST_HEAD


def test_lm_broadcasts_are_small_and_deleted(spark):
    docs, corpus, model = small_model(spark)
    again = pickle.loads(pickle.dumps(model))
    for a, b in ((model.outer, again.outer), (model.inner, again.inner)):
        assert np.array_equal(a.weights, b.weights) and np.array_equal(a.seen, b.seen) and np.array_equal(a.bins, b.bins)
    for x in (model, lm.Scorer(model)):
        assert len(pickle.dumps(x)) < sum(f.weights.nbytes for f in (model.outer, model.inner)) / 4
    args = read(corpus, [texts(spark)[3][1]])[2:]
    assert np.array_equal(lm.Scorer(model).log_probs(*args), pickle.loads(pickle.dumps(lm.Scorer(model))).log_probs(*args))
    before = set(os.listdir(spark.sparkContext._temp_dir))
    assert lm.score(docs).count() == docs.count()
    assert set(os.listdir(spark.sparkContext._temp_dir)) <= before


def test_lm_at_its_bounds_drops_nothing(spark, monkeypatch):
    """with few rows and head words every token still counts in a row of each kind, and every word has its share."""
    monkeypatch.setattr(lm, "LEAST_ROWS", 64)
    monkeypatch.setattr(lm, "MOST_ROWS", 64)
    monkeypatch.setattr(lm, "LEAST_HEAD", 4)
    monkeypatch.setattr(lm, "MOST_HEAD", 4)
    docs, corpus, model = small_model(spark)
    assert corpus.shape == lm.Shape(64, 2, 2) and corpus.n_head == 4
    assert model.outer.seen.sum(axis=1).tolist() == [corpus.tokens] * lm.KINDS
    assert model.inner.seen.sum(axis=1).tolist() == [corpus.counts[:4].sum()] * lm.KINDS
    assert abs(corpus.tail_mass.sum() + corpus.counts[:4].sum() - corpus.tokens - 0.5 * (corpus.types - 4)) < 1e-6
    rows = texts(spark)[:60]
    got = lm.score(docs).collect()
    assert sorted(((*tuple(r)[:5], round(r.base_score, 6)) for r in got), key=repr) == brute_base(rows)
    scorer, head, total = lm.Scorer(model), corpus.shape.head, np.zeros(5)
    features = read(corpus, [rows[3][1]])[-1][:, :5]
    for c in range(corpus.shape.classes):
        for m in range(corpus.shape.members) if c < head else [-1]:
            total += np.exp(scorer.log_probs(np.full(5, c), np.full(5, m), features))
    assert np.allclose(total, 1, atol=1e-3)


def test_skip_feature_tells_words_apart():
    """Of two words in one class the word before the last decides, whatever the last one."""
    rng = np.random.default_rng(3)

    def draw(n):
        rows = rng.integers(0, 1024, (lm.KINDS, n)).astype(np.int32)
        members = rng.integers(0, 2, n)
        rows[2] = 10 + members
        return np.zeros(n, np.int64), members, rows

    shape = lm.Shape(1024, 1, 2)
    counts, batches = lm.Counts(shape), [draw(500) for _ in range(10)]
    for b in batches:
        counts.add(*b)
    factor = lm.Factor(np.log(np.full((1, 2), 0.5)), 1024)
    for k in range(lm.KINDS):
        factor.weights[k], factor.seen[k] = lm.scaling_step(np.full((1024, 2), 0.5), counts.tables[1][k].astype(float))
    size = lm.KINDS * lm.SEEN
    sums = [np.zeros(size), np.zeros(size * size)]
    for b in batches:
        for x, more in zip(sums, factor.curvature(*shape.places(*b)[1]), strict=True):
            x += more
    factor.move(*sums)
    _, members, rows = draw(200)
    scores = sum(w[r] * x[r][:, None] for w, x, r in zip(factor.weights, factor.scales(), rows, strict=True)) + factor.bias[0]
    p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    assert p[np.arange(200), members].mean() > 0.8


def test_reader_keeps_texts_apart():
    corpus = lm.Corpus(3, 2, [b"a", b"b"], np.array([2.0, 1.0]), np.zeros(lm.TAIL), lm.shape_of(3, 2))
    together = read(corpus, ["a b c a", "", "b", "x y z"])
    apart = [read(corpus, [t]) for t in ("a b c a", "", "b", "x y z")]
    assert together[0] == [w for x in apart for w in x[0]]
    for k in (1, 2, 3, 4):
        assert np.array_equal(together[k], np.concatenate([x[k] for x in apart], axis=-1))


def brute_components(rows):
    sets, ids = [], [i for i, _ in rows]
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k)), i == least.get(find(k))) for k, i in enumerate(ids)), key=repr)


def test_op10(spark):
    got = sorted(map(tuple, queries.op10_minhash(spark, SF).collect()), key=repr)
    assert got == brute_components(texts(spark)) and any(not r[3] for r in got)


def family(rng, n, words, edits):
    base = [f"w{rng.randint(0, 9999)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = f"e{rng.randint(0, 9999)}"
        out.append(" ".join(w))
    return out


def test_op10_blocks(spark, monkeypatch):
    """Large groups, of whose members only some are linked, cut into small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "MOST_BROADCAST_IDS", 0)
    rng = random.Random(6)
    data = [t for n, words, edits in ((60, 120, 9), (40, 60, 6), (30, 200, 3), (20, 3, 1)) for t in family(rng, n, words, edits)]
    rng.shuffle(data)
    rows = [*enumerate(data, 100), *ODD, (None, data[0]), (99, data[1].upper()), (98, data[1].replace(" ", "\t"))]
    docs = spark.createDataFrame([(*r, "c", "c") for r in rows], "doc_id long, text string, node string, n_shingles string")
    want = brute_components(rows)
    assert sorted(map(tuple, near_dedup.annotate(docs).collect()), key=repr) == want
    monkeypatch.setattr(near_dedup, "SLICE_HASHES", 16)  # sets come in several slices
    assert sorted(map(tuple, near_dedup.annotate(docs).collect()), key=repr) == want
    kept = near_dedup.dedup(docs)
    assert kept.columns == docs.columns
    stay = Counter(i for i, n, _, k in want if k)
    stay[3] = stay[None] = 1  # rows that repeat id and text
    assert Counter(r.doc_id for r in kept.collect()) == stay
    assert near_dedup.annotate(docs.limit(0)).count() == near_dedup.dedup(docs.limit(0)).count() == 0
    clashing = ["id", "HASH", "id_", "__id", "__hash", "root", "n", "stay", "component_id"]
    wide = docs.select("*", *(F.concat_ws("-", "doc_id", F.lit(c)).alias(c) for c in clashing))
    again = near_dedup.dedup(wide)
    assert again.columns == wide.columns
    assert Counter(map(tuple, again.select(*clashing).collect())) == Counter(
        tuple("-".join([*([] if r.doc_id is None else [str(r.doc_id)]), c]) for c in clashing) for r in kept.collect()
    )


def test_estimate():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.75, 0.95):
        errors = []
        for _ in range(30):
            n = 400
            both = int(n * 2 * share / (1 + share))
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            b = np.r_[a[:both], rng.integers(0, 2**63, n - both, dtype=np.uint64)]
            x, y = (np.frombuffer(near_dedup.packed(near_dedup.minima(s)), np.uint64) for s in (a, b))
            errors.append(near_dedup.estimate(near_dedup.equal_counts(x, y[None, :])[0]) - both / (2 * n - both))
        assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.04
