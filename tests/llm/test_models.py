"""Toxicity and licenses."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from harrow.llm import licenses, queries, toxicity
from tests.oracle import assert_same, canonical, connect

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "a idiot"), (3, "a idiot"), (None, "b"), (None, "b"), (4, "x " * 100_000)]


def test_cumulative_link_recovers_weights():
    rng = np.random.default_rng(1)
    true, cuts = np.array([2.0, -1.0, 0.0]), np.array([0.0, 2.0])
    x = rng.integers(0, 3, size=(4000, 3))
    noise = rng.logistic(size=4000)
    grade = ((x @ true + noise)[:, None] > cuts).sum(axis=1)
    rows = [(int(g), {j: float(v) for j, v in enumerate(r) if v}) for g, r in zip(grade, x, strict=True)]
    w, t = toxicity.fit(rows, 3, 3, ridge=0.0)
    assert np.allclose(w, true, atol=0.25) and np.allclose(t, cuts, atol=0.3) and t[0] < t[1]


def test_slopes_are_those_of_the_loss():
    rows = [(0, {0: 1.0}), (1, {0: 2.0, 1: 1.0}), (2, {1: 3.0}), (1, {})]
    w, t = toxicity.fit(rows, 2, 3, rounds=2000, ridge=0.05)

    def loss(w, t):
        model = toxicity.CumulativeLink({}, tuple(t))
        logs = [math.log(model.grades(sum(w[c] * v for c, v in x.items()))[g]) for g, x in rows]
        return -sum(logs) / len(rows) + 0.05 * float(np.sum(w**2)) / 4

    best = loss(w, t)
    for k in range(2):
        for step in (-0.05, 0.05):
            moved = np.array(w)
            moved[k] += step
            assert loss(moved, t) >= best - 1e-6
            moved = np.array(t)
            moved[k] += step
            if moved[0] < moved[1]:
                assert loss(w, moved) >= best - 1e-6


def test_fit_needs_little_memory_beside_its_arrays(monkeypatch):
    """The same by blocks as at once, and a round needs less than another copy of the values."""
    rng = np.random.default_rng(5)
    n, each = 4000, 250
    col = np.concatenate([rng.choice(2000, each, replace=False) for _ in range(n)]).astype(np.int32)
    val, grade = rng.random(n * each), rng.integers(0, 2, n)
    ends = np.arange(n + 1) * each
    tracemalloc.start()
    blocks = toxicity.fit_arrays(grade, ends, col, val, 2000, 2, rounds=3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < val.nbytes
    monkeypatch.setattr(toxicity, "BLOCK", 10**9)
    once = toxicity.fit_arrays(grade, ends, col, val, 2000, 2, rounds=3)
    rows = [(int(g), dict(zip(col[a : a + each].tolist(), val[a : a + each].tolist(), strict=True))) for g, a in zip(grade, ends[:-1], strict=True)]
    dicts = toxicity.fit(rows, 2000, 2, rounds=3)
    for other in (once, dicts):
        assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(blocks, other, strict=True))


def test_labelled_rows_reach_the_driver_as_arrays():
    col, val = toxicity.values([1, 7], [2, 1], 30)
    assert col.tolist() == [2, 3, 14, 15] and val.tolist() == [1.0, toxicity.rate(2, 30), 1.0, toxicity.rate(1, 30)]
    assert [x.tolist() for x in toxicity.values([], [], 0)] == [[], []]


def test_op2_held_out(spark):
    """Some labels are noise: texts marked toxic without a marked word, and a few the other way round."""
    sf = "/root/testdata/sf0.1"
    docs, labels = queries.documents(spark, sf), queries.table(spark, sf, "labels")
    model = toxicity.train(docs, labels.filter("doc_id % 3 <> 0"))
    held = labels.filter("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("label"))
    rows = toxicity.score(docs, model).join(held, "doc_id").collect()
    toxic = [r.toxic for r in rows if r.label]
    clean = [r.toxic for r in rows if not r.label]
    assert len(toxic) > 100 and sum(toxic) >= 0.9 * len(toxic)
    assert len(clean) > 1000 and sum(clean) <= 0.005 * len(clean)
    assert toxicity.reject(docs, model).columns == docs.columns


def test_op2_odd(spark):
    docs = spark.createDataFrame([(*r, "c") for r in ODD], "doc_id long, text string, grade string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert toxicity.score(docs, model).filter("toxic").count() == 0 and toxicity.reject(docs, model).count() == len(ODD)
    words = "ab cd ef gh ij kl mn".split()
    rng = random.Random(2)
    text = lambda bad: " ".join(rng.choices(words, k=20) + ["idiot"] * bad)
    data = [(100 + i, text(i % 3)) for i in range(90)]
    docs = docs.unionByName(spark.createDataFrame([(*r, "c") for r in data], docs.schema))
    marks = [(100 + i, i % 3) for i in range(90)] + [(100, None), (None, 1), (101, 0), (9999, 2)]
    model = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert len(model.thresholds) == 2
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert got[3].toxic and not got[1].toxic and not got[4].toxic
    severity = [got[100 + i].expected_severity for i in range(3)]
    assert severity == sorted(severity)
    assert toxicity.reject(docs.limit(0), model).count() == 0


def brute_features(text):
    """Occurrence by feature, from the definition: every word, and under '^' each beginning of 4 to 9 bytes of a longer one."""
    words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    found = Counter(words)
    for w in words:
        for size in range(4, 10):
            if size < len(w):
                found[b"^" + w[:size]] += 1
    return found, len(words)


def test_op2_by_brute_force(spark):
    """Which features are kept, the grades that are learned from, and every score, from their definitions."""
    sf = "/root/testdata/sf0.01"
    docs, labels = queries.documents(spark, sf), queries.table(spark, sf, "labels")
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.toxic * (1 + (r.quality == 0)) for r in labels.collect() if r.doc_id in texts}
    seen = [Counter(), Counter()]
    for i, grade in marks.items():
        seen[grade > 0].update(brute_features(texts[i])[0].keys())
    n = [sum(g <= 0 for g in marks.values()), sum(g > 0 for g in marks.values())]
    chosen = {f: toxicity.chi2(seen[1][f], seen[0][f], n[1], n[0]) for f in seen[0].keys() | seen[1].keys()}
    limit = min(toxicity.LEAST_CHI2, sum(n) / 4)
    wanted = {f for f, x in chosen.items() if x >= limit and seen[0][f] + seen[1][f] >= min(toxicity.LEAST_DOCS, n[1])}
    assert 0 < len(wanted) <= toxicity.MOST_FEATURES and set(model.weights) == wanted
    assert len(model.thresholds) == len(set(marks.values())) - 1
    got = {r.doc_id: r for r in queries.op2_toxicity(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        found, words = brute_features(text)
        latent = sum(model.weights[f][0] + model.weights[f][1] * math.log1p(200 * k / (words + 50)) for f, k in found.items() if f in model.weights)
        at_most = [1 / (1 + math.exp(latent - t)) for t in model.thresholds] + [1.0]
        grades = [b - a for a, b in zip([0.0, *at_most], at_most, strict=False)]
        severity = sum(k * p for k, p in enumerate(grades))
        assert abs(severity - got[i].expected_severity) < 1e-6 and got[i].toxic == (got[i].expected_severity >= toxicity.CUT)
        assert abs(grades[got[i].grade] - max(grades)) < 1e-9


def test_op2_few_labels_and_repeated_ids(spark):
    rows = [(i, f"plain text number {i}" + " idiot" * (i % 2)) for i in range(12)]
    rows += [(1, "idiot again and again")] * 50 + [(2, "other words")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    assert b"idiot" in model.weights and len(model.thresholds) == 1
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(r.toxic == bool(r.doc_id % 2) for r in got)


def test_op8(spark):
    assert_same(queries.op8_licenses(spark, SF), licenses.oracle_sql(), connect(SF))


def test_op8_odd(spark, tmp_path):
    mit, apache = licenses.NOTICES[0][1], "Licensed under the Apache License, Version 2.0"
    # DuckDB copies a text's words for each of its words, so the very long text is scanned by itself below.
    texts = [
        *(r for r in ODD if r[0] != 4), (5, f"x {mit.upper()} y"), (6, f"the {apache} and MIT  license, mit-license; licenſe"), (7, "mit licenKse Kind"),
        (8, mit.replace("free of charge", "free of any charge")), (9, "general public license"), (10, "Général public license é"),
        (5, f"x {mit.upper()} y"), (11, " ".join(mit.split()[:6])), (12, "--mit license--"),
    ]
    docs = spark.createDataFrame([(*r, "c", "c") for r in texts], "doc_id long, text string, words string, score string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = licenses.scan(docs)
    assert_same(got, licenses.oracle_sql(), connect(tmp_path))
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[5].labels == rows[8].labels == "mit" and rows[5].score == 1 > rows[8].score >= licenses.LEAST_SCORE
    assert rows[6].base_labels == "apache,mit" and rows[6].n_base == 3 and rows[11].labels == "" and rows[12].first_word == 0
    long = licenses.scan(spark.createDataFrame([(4, "x " * 100_000 + mit)], "doc_id long, text string")).collect()
    assert long[0].n_words == 100_000 + len(licenses._plain_words(mit)) and long[0].labels == "mit"
    assert canonical(got.columns, got.limit(0).collect())[1] == [] and licenses.scan(docs.limit(0)).count() == 0


def brute_licenses(text, templates):
    """Label of the most similar template wherever a run of words fits one, by edit-free overlap of word triples of every window."""
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    doc = words(text)
    triples = [tuple(doc[i : i + 3]) for i in range(len(doc) - 2)]
    found = []
    for label, t in templates:
        w = words(t)
        own = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        for start in range(len(triples)):
            if triples[start] in own:
                for width in {len(w) - 2, len(w) - 2 + 3, len(w) - 2 - 3}:
                    held = len(own & set(triples[start : start + width]))
                    if width > 0 and held >= 0.6 * max(len(w) - 2, width):
                        found.append((held / max(len(w) - 2, width), held, start, start + width, label))
    winners = set()
    for s in found:
        if not any(o[:2] > s[:2] and o[4] != s[4] and o[2] < s[3] and s[2] < o[3] for o in found):
            winners.add(s[4])
    return winners


CASES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
     " (the \"Software\"), to deal in the Software without any restriction at all, including without limitation the rights to use, copy, modify,"
     " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to"
     " do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or"
     " substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING"
     " BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("cc-by-sa", "Text is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License unless it says so."),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-sa", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("gpl,lgpl", "It comes under the GNU Lesser General Public License as it is"),
    ("agpl,gpl", "is licensed under the GNU Affero General Public License, version 3 or later"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that"
     " the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND ISC DISCLAIMS ALL WARRANTIES"
     " WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL ISC BE LIABLE FOR ANY"
     " SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS"),
    ("", "You need a license to drive, and permission is needed to copy software without restriction"),
    ("", "licensed to sell under a roof of creative people, commons of attribution, 4 or 0 of them international"),
]


def bsd(clauses, who="THE REGENTS AND CONTRIBUTORS"):
    text = dict(licenses.NOTICES)[f"bsd-{clauses}-clause"]
    return text.replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", who).replace("the copyright holder nor", "the University nor")


def test_op8_labels(spark):
    """Texts with one word more or less, told apart from their likes, among other words; against a brute-force search too."""
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("some other words that stand here or there").strip() or "x" for _ in range(n))
    cases = [*CASES, ("bsd-2-clause", bsd(2)), ("bsd-3-clause", bsd(3)), ("apache,bsd-3-clause", bsd(3) + " " + say(9) + " Licensed under the Apache License, Version 2.0")]
    texts = [f"{say(7)} {t} {say(7)}" for _, t in cases]
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (want, text) in enumerate(cases):
        assert rows[i].labels == want, (text, rows[i])
        base = set(filter(None, rows[i].base_labels.split(",")))
        assert base | brute_licenses(texts[i], licenses.NOTICES) == set(filter(None, want.split(",")))


def test_op8_span_is_bounded(spark):
    """Words put between all words of a notice: every k-gram is gone, or the span is too wide."""
    notice = "Licensed under the Apache License, Version 2.0"
    words = notice.split()
    wide = " ".join(w + " filler" * (i % 3 == 2) * 6 for i, w in enumerate(words * 3))
    got = licenses.scan(spark.createDataFrame([(1, wide), (2, f"{notice} x"), (3, " ".join(words[:5]))], "doc_id long, text string"))
    assert {r.doc_id: r.score for r in got.collect()} == {1: 0, 2: 1, 3: 0}


def test_op8_long_text_in_slices(spark, monkeypatch):
    """A notice across the border of two slices, wherever it stands, and templates of one's own."""
    monkeypatch.setattr(licenses, "SLICE", 16)
    notice = "You may read this text on Sundays only and never aloud"
    docs = spark.createDataFrame([(k, "x " * k + notice + " y" * 40) for k in range(40)], "doc_id long, text string")
    got = licenses.scan(docs, templates=[("sunday", notice)]).collect()
    assert len(got) == 40 and all(r.labels == "sunday" and r.score == 1 for r in got)


def test_op8_is_native(spark):
    plan = queries.op8_licenses(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
