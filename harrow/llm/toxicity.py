"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(severity <= k) = sigmoid(t_k - w.x): the thresholds t_k are ordered and share one weight vector w. A
feature is a word or a longer word's first 4 to 9 bytes, with two values: that it occurs, and how often
among the words, on a log scale. (A marked word is telling by itself, a chance beginning by its rate.) Fitting takes a
sample of labelled rows, the ``MOST_LABELS`` smallest by a hash of the id; features are counted on the
executors, and those are kept whose documents' labels differ most (chi squared). The model has at
most ``MOST_FEATURES`` weights, so its broadcast is bounded; scoring is one pass without a shuffle.

Grades come from the labels alone: a label of any number of values is taken as it is, and where there is a
second label, of quality, a marked document that is also of no quality is one grade higher. Grades that no
labelled document has are left out.

* null or empty text: no features, severity of an empty document; null labels and labels of unknown
  documents: unused; repeated labels: the highest grade counts; repeated documents: scored a row each, and of
  rows that repeat an id one is learned from, that with the least hash of its text;
* no labels, or of one class only: nothing is toxic; few labels: the limits below shrink with them;
* empty table: no rows; null doc_id: kept as null; very long text: whole, one at a time in a worker;
* further columns, whatever their names, pass through ``reject`` unread.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, drop_written, forget_others, id_text, map_rows, ship, written

#: Bounds of the fit: labelled rows and weights.
MOST_LABELS = 20_000
MOST_FEATURES = 4096
#: Bytes of a word's beginning that make a feature.
PREFIXES = range(4, 10)
#: A feature needs this many documents and this chi squared (one degree of freedom); of fewer labels, whose chi squared
#: cannot exceed their number, a quarter of them, and as many documents as are toxic at most.
LEAST_DOCS = 4
LEAST_CHI2 = 25.0
#: Values of labelled rows that a round of the fit takes at once.
BLOCK = 1 << 17
#: Expected severity from which a document is rejected.
CUT = 0.5


def rate(n: int, n_words: int) -> float:
    """How often something occurs among the words, damped in short texts."""
    return math.log1p(200 * n / (n_words + 50))


def features(text: str) -> Counter:
    """Words, and under a leading '^' the beginnings of longer words, with their counts."""
    words = Counter(alnum_words(text or ""))
    out = Counter(words)
    for w, n in words.items():
        for size in PREFIXES:
            if len(w) <= size:
                break
            out[b"^" + w[:size]] += n
    return out


@dataclass(frozen=True)
class CumulativeLink:
    """Weights by feature, for its occurrence and for its rate, and ordered thresholds."""

    weights: dict[bytes, tuple[float, float]]
    thresholds: tuple[float, ...]
    begins: frozenset[bytes] = frozenset()

    def __post_init__(self) -> None:
        # Most words are settled by one look at their first bytes.
        short = {f[1 : 1 + PREFIXES[0]] for f in self.weights if f[:1] == b"^"}
        object.__setattr__(self, "begins", frozenset(short))

    def latent(self, text: str) -> float:
        known, first = self.weights, PREFIXES[0]
        if not known:
            return 0.0
        words = Counter(alnum_words(text or ""))
        total = sum(words.values())
        found = {w: words[w] for w in known.keys() & words.keys()}
        for w, n in words.items():
            if w[:first] in self.begins:
                for size in PREFIXES:
                    if len(w) <= size:
                        break
                    if (p := b"^" + w[:size]) in known:
                        found[p] = found.get(p, 0) + n
        return sum(known[f][0] + known[f][1] * rate(n, total) for f, n in sorted(found.items()))

    def grades(self, latent: float) -> list[float]:
        """The probability of each grade."""
        at_most = [1 / (1 + math.exp(min(700.0, latent - t))) for t in self.thresholds] + [1.0]
        return [b - a for a, b in zip([0.0, *at_most], at_most, strict=False)]

    def severity(self, text: str) -> float:
        return sum(k * p for k, p in enumerate(self.grades(self.latent(text))))


def fit(rows: list[tuple[int, dict[int, float]]], n_features: int, n_grades: int, rounds: int = 600, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from (grade, {feature: value}) rows, by full-batch Adam on the mean log loss."""
    sizes = [len(x) for _, x in rows]
    col = np.fromiter((c for _, x in rows for c in x), np.int32, sum(sizes))
    val = np.fromiter((v for _, x in rows for v in x.values()), np.float64, sum(sizes))
    return fit_arrays(np.array([g for g, _ in rows]), np.r_[0, np.cumsum(sizes, dtype=np.int64)], col, val, n_features, n_grades, rounds, ridge)


def fit_arrays(
    grade: np.ndarray, ends: np.ndarray, col: np.ndarray, val: np.ndarray, n_features: int, n_grades: int,
    rounds: int = 600, ridge: float = 1e-3,
) -> tuple[np.ndarray, np.ndarray]:
    """``fit`` on arrays: row k has the features ``col[ends[k]:ends[k + 1]]`` with these values.

    Each round takes some ``BLOCK`` values after another, so that it needs little memory beside the arrays.
    """
    n = len(grade)
    cuts_at = np.searchsorted(ends, np.arange(BLOCK, len(col), BLOCK))
    edges = sorted({0, *cuts_at.tolist(), n})
    blocks = [(slice(a, b), slice(ends[a], ends[b]), np.diff(ends[a : b + 1])) for a, b in zip(edges, edges[1:], strict=False)]
    # Thresholds are the first one and the logs of the gaps, so they stay in order.
    share = np.array([np.mean(grade <= k) for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    params = np.r_[np.zeros(n_features), start[0], np.log(np.maximum(np.diff(start), 1e-2))]
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        w, gaps = params[:n_features], np.exp(params[n_features + 1 :])
        cuts = np.r_[-np.inf, params[n_features] + np.r_[0, np.cumsum(gaps)], np.inf]
        latent = np.zeros(n)
        for own, at, sizes in blocks:
            latent[own] = np.bincount(np.repeat(np.arange(len(sizes)), sizes), val[at] * w[col[at]], len(sizes))
        upper = 1 / (1 + np.exp(np.clip(latent - cuts[grade + 1], -500, 500)))
        lower = 1 / (1 + np.exp(np.clip(latent - cuts[grade], -500, 500)))
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p  # of log p by its upper and its lower cut
        slope = np.zeros_like(params)
        for own, at, sizes in blocks:
            slope[:n_features] += np.bincount(col[at], val[at] * np.repeat((du - dl)[own], sizes), n_features)
        slope[:n_features] = slope[:n_features] / n + ridge * w / 2
        by_cut = np.array([dl[grade == k + 1].sum() - du[grade == k].sum() for k in range(n_grades - 1)]) / n
        slope[n_features] = by_cut.sum()
        slope[n_features + 1 :] = np.cumsum(by_cut[::-1])[::-1][1:] * gaps
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:n_features], params[n_features] + np.r_[0, np.cumsum(np.exp(params[n_features + 1 :]))]


def values(columns: list[int], counts: list[int], n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a document's two values for each of its kept features, and the values."""
    col, val = np.empty((len(columns), 2), np.int32), np.ones((len(columns), 2))
    col[:] = 2 * np.array(columns, np.int32)[:, None] + np.arange(2, dtype=np.int32)
    val[:, 1] = [rate(n, n_words) for n in counts]
    return col.reshape(-1), val.reshape(-1)


def chi2(a: int, b: int, n_a: int, n_b: int) -> float:
    """Of a feature in a of n_a and b of n_b documents."""
    n, hit = n_a + n_b, a + b
    low = hit * (n - hit) * n_a * n_b
    return n * (a * (n_b - b) - b * (n_a - a)) ** 2 / low if low else 0.0


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    label_id: str = "doc_id", most_labels: int = MOST_LABELS, quality: str = "quality",
) -> CumulativeLink:
    """The model for the labelled documents; ``quality`` is used where the labels have such a column."""
    spark = docs.sparkSession
    ship(spark)
    grade = F.greatest(F.col(label).cast("int"), F.lit(0))
    if quality in labels.columns:
        grade = grade + F.when((grade > 0) & (F.col(quality) == 0), 1).otherwise(0)
    grade = F.when(F.col(label).isNotNull(), grade)
    known = labels.select(F.col(label_id).cast("long").alias("doc_id"), grade.alias("grade"))
    known = known.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    # At most ``most_labels`` rows of two numbers; then as many documents, one for each id.
    sample = docs.select(*id_text(doc_id, text)).join(F.broadcast(known), "doc_id").groupBy("doc_id", "grade")
    sample = written(sample.agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text")).select("doc_id", "text", "grade"))

    def count(rows):
        seen: Counter = Counter()
        for _, text, grade in rows:
            toxic = int(grade > 0)
            seen.update((f, toxic) for f in features(text))
            seen[b"", toxic] += 1
            if len(seen) > 200_000:
                yield from ((f, n * (1 - t), n * t) for (f, t), n in seen.items())
                seen.clear()
        yield from ((f, n * (1 - t), n * t) for (f, t), n in seen.items())

    counts = map_rows(sample, count, "feature binary, clean long, toxic long").groupBy("feature")
    counts = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = counts.filter(F.length("feature") == 0).first()
    if totals is None or not totals.clean or not totals.toxic:
        return CumulativeLink({}, (math.inf,))
    n_a, n_b = totals.toxic, totals.clean
    cells = [F.col(c).cast("double") for c in ("toxic", "clean")]
    hit = cells[0] + cells[1]
    low = hit * (n_a + n_b - hit) * F.lit(float(n_a) * n_b)
    cross = cells[0] * (n_b - cells[1]) - cells[1] * (n_a - cells[0])
    score = F.when(low > 0, (n_a + n_b) * cross * cross / low).otherwise(0.0)
    kept = counts.filter((F.length("feature") > 0) & (hit >= min(LEAST_DOCS, n_a))).withColumn("chi2", score)
    kept = kept.filter(F.col("chi2") >= min(LEAST_CHI2, (n_a + n_b) / 4)).orderBy(F.desc("chi2"), "feature").limit(MOST_FEATURES).collect()
    if not kept:
        return CumulativeLink({}, (math.inf,))
    names = [bytes(r.feature) for r in kept]
    column = {f: i for i, f in enumerate(names)}

    def sparse(rows):
        for doc_id, text, grade in rows:
            found = features(text)
            hits = sorted((column[f], n) for f, n in found.items() if f in column)
            col, val = values([c for c, _ in hits], [n for _, n in hits], len(alnum_words(text)))
            yield doc_id, grade, col.tobytes(), val.tobytes()

    # At most ``most_labels`` rows of at most 2 * MOST_FEATURES values of 12 bytes, few in practice; as arrays, not as objects.
    rows = map_rows(sample, sparse, "doc_id long, grade int, cols binary, vals binary", per_batch=500).collect()
    rows.sort(key=lambda r: r.doc_id)
    drop_written(sample)
    grades = [r.grade for r in rows]
    ends = np.r_[0, np.cumsum([len(r.cols) // 4 for r in rows], dtype=np.int64)]
    col, val = (np.frombuffer(b"".join(r[k] for r in rows), kind) for k, kind in ((2, np.int32), (3, np.float64)))
    del rows
    levels = {g: k for k, g in enumerate(sorted(set(grades)))}
    weights, cuts = fit_arrays(np.array([levels[g] for g in grades]), ends, col, val, 2 * len(names), len(levels))
    pairs = weights.reshape(-1, 2).tolist()
    return CumulativeLink({f: (a, b) for f, (a, b) in zip(names, pairs, strict=True)}, tuple(cuts.tolist()))


def score(docs: DataFrame, model: CumulativeLink, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, grade (the most probable), expected_severity and toxic (rejected) of every document."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(rows):
        own = shared.value
        for doc_id, text in rows:
            p = own.grades(own.latent(text))
            severity = sum(k * x for k, x in enumerate(p))
            yield doc_id, p.index(max(p)), severity, severity >= CUT

    return map_rows(docs.select(*id_text(doc_id, text)), run, "doc_id long, grade int, expected_severity double, toxic boolean")


def reject(docs: DataFrame, model: CumulativeLink, text: str = "text") -> DataFrame:
    """The documents whose expected severity is below the cut, with all their columns."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def below(texts: pd.Series) -> pd.Series:
        forget_others(__name__)
        return pd.Series([shared.value.severity(t) < CUT for t in texts], dtype=bool)

    stays = F.pandas_udf(below, "boolean")

    return docs.filter(stays(F.coalesce(F.col(text), F.lit(""))))
