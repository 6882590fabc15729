"""License scan by diagonal voting, in DataFrame functions only.

All rolling k-grams of a document's words are joined, by hash, with the k-grams of license texts and notices
(``notices``, or templates of one's own). A hit at word p of the document and word q of a template votes for
diagonal p - q: the place where the template would start. Votes are counted for each diagonal; each is merged
with its neighbours up to ``GAP`` away (inserted or lost words) to a span of bounded width. A span is verified by its
score: the distinct k-grams of the template that it holds, over those of the template or the words that it spans,
whichever are more, so inserted words count as well. Verified spans that overlap compete: of each run of
overlapping ones the best (score, then k-grams held) wins, and others stay only if they do not touch it.
Documents are never shuffled: only hits and one short row for each document.

* null or empty text: no words, no labels, score 0; null doc_id: kept as null;
* rows that repeat doc_id and text get a row each, with equal results (hits are counted once);
* very long text: its words are cut into slices of ``SLICE`` before k-grams are made of them;
* empty table: no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .notices import NOTICES

K = 3
#: Diagonals of one template this close together belong to one span.
GAP = 8
#: The least score of a verified span.
LEAST_SCORE = 0.6
#: Words of a slice.
SLICE = 4096

# Base phrases by label.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered.

    ``lower`` also changes letters beyond ASCII, which only matters where it gives an ASCII letter: the
    Kelvin sign, taken out here. Words with other such letters stay words and equal no phrase or notice.
    """
    parts = F.split(F.lower(F.replace(text, F.lit("K"), F.lit("ĸ"))), _BETWEEN)
    first = F.when(F.element_at(parts, 1) == "", 2).otherwise(1)
    last = F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.slice(parts, first, F.greatest(last - first + 1, F.lit(0)))


def _plain_words(text: str) -> list[str]:
    out = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text)
    return out.split()


Templates = list[tuple[str, str]]


def template_grams(spark: SparkSession, templates: Templates, k: int = K) -> DataFrame:
    """label, notice, q, h (hash of the k-gram at q), size (k-grams of the template): as many rows as the templates have words."""
    rows = []
    for i, (label, text) in enumerate(templates):
        words = _plain_words(text)
        grams = [words[q : q + k] for q in range(len(words) - k + 1)]
        rows += [(label, i, q, g, len(grams)) for q, g in enumerate(grams)]
    frame = spark.createDataFrame(rows, "label string, notice int, q int, gram array<string>, size int")
    return frame.select("label", "notice", "q", F.xxhash64("gram").alias("h"), "size")


def _places(words: Column, phrase: str) -> Column:
    """Indexes, from 0, at which the words of the phrase stand consecutively."""
    want = phrase.split()
    starts = F.sequence(F.lit(1), F.size(words) - len(want) + 1)
    here = F.filter(starts, lambda i: reduce(lambda a, b: a & b, (F.get(words, i - 1 + j) == w for j, w in enumerate(want))))
    return F.when(F.size(words) >= len(want), F.transform(here, lambda i: i - 1)).otherwise(F.array().cast("array<int>"))


def _rolled(docs: DataFrame, k: int) -> DataFrame:
    """id, text_hash, p and h: the hash of the k-gram at each word."""
    n = F.size("words")
    starts = F.sequence(F.lit(0), n - k, F.lit(SLICE))
    slices = F.when(n >= k, F.transform(starts, lambda at: F.struct(at.alias("at"), F.slice("words", at + 1, F.lit(SLICE + k - 1)).alias("part"))))
    parts = docs.select("id", "text_hash", F.explode(slices).alias("x")).select("id", "text_hash", "x.at", "x.part")
    hashes = F.transform(F.sequence(F.lit(1), F.size("part") - k + 1), lambda i: F.xxhash64(F.slice("part", i, k)))
    rolled = parts.select("id", "text_hash", "at", F.posexplode(hashes).alias("i", "h"))
    return rolled.select("id", "text_hash", (F.col("at") + F.col("i")).alias("p"), "h")


def verdicts(docs: DataFrame, templates: Templates = NOTICES, k: int = K) -> DataFrame:
    """id, text_hash, found (labels of the winning spans) and score of documents with a verified span.

    ``docs`` has columns id, text_hash and words.
    """
    # As many rows as the templates have words.
    hits = _rolled(docs, k).join(F.broadcast(template_grams(docs.sparkSession, templates, k)), "h")
    # A repeated document has the same hits; counted by place, they count once.
    votes = hits.groupBy("id", "text_hash", "label", "notice", "size", (F.col("p") - F.col("q")).alias("diagonal")).agg(F.collect_set("q").alias("qs"))
    each = Window.partitionBy("id", "text_hash", "notice").orderBy("diagonal").rangeBetween(-GAP, GAP)
    ends = F.array_max(F.collect_list(F.col("diagonal") + F.array_max("qs")).over(each)), F.array_min(F.collect_list(F.col("diagonal") + F.array_min("qs")).over(each))
    spans = votes.select(
        "id", "text_hash", "label", "notice", "size",
        F.size(F.array_distinct(F.flatten(F.collect_list("qs").over(each)))).alias("held"),
        ends[1].alias("first"), ends[0].alias("last"),
    )
    spans = spans.groupBy("id", "text_hash", "label", "notice", "size", "first", "last").agg(F.max("held").alias("held"))
    spans = spans.withColumn("score", F.col("held") / F.greatest(F.col("size"), F.col("last") - F.col("first") + 1))
    spans = spans.filter(F.col("score") >= LEAST_SCORE)
    # Runs of spans that overlap, and the best span of each.
    place = Window.partitionBy("id", "text_hash").orderBy("first", "last", "notice")
    reach = F.max("last").over(place.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.coalesce((F.col("first") >= reach + k).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(place))
    rank = F.struct("score", "held", (-F.col("notice")).alias("order"), (-F.col("first")).alias("place"), "last", "label")
    best = F.max(rank).over(Window.partitionBy("id", "text_hash", "run")).alias("best")
    judged = runs.select("id", "text_hash", "label", "score", "first", "last", best)
    apart = (F.col("last") + k <= -F.col("best.place")) | (F.col("first") >= F.col("best.last") + k)
    stay = judged.filter((F.col("label") == F.col("best.label")) | apart)
    return stay.groupBy("id", "text_hash").agg(F.collect_set("label").alias("found"), F.max("score").alias("score"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Templates = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(whole).alias("text_hash"), words_of(whole).alias("words"))
    found = verdicts(rows, templates).withColumnsRenamed({"id": "id2", "text_hash": "hash2"})
    base = rows.select(
        "id",
        "text_hash",
        F.size("words").cast("long").alias("n_words"),
        # The places are searched only in texts that have a phrase's last word.
        *(
            F.when(F.array_contains("words", phrase.split()[0]) & F.array_contains("words", "license"), _places(F.col("words"), phrase))
            .otherwise(F.array().cast("array<int>"))
            .alias(f"at_{label}")
            for label, phrase in PHRASES.items()
        ),
    )
    every = F.concat(*(F.col(f"at_{label}") for label in PHRASES))
    labels = F.array_compact(F.array(*(F.when(F.size(f"at_{label}") > 0, F.lit(label)) for label in PHRASES)))
    base = base.select(
        "id", "text_hash", "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        labels.alias("base"),
    )
    out = base.join(found, F.col("id").eqNullSafe(F.col("id2")) & (F.col("text_hash") == F.col("hash2")), "left")
    both = F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(both), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle_sql(k: int = K, templates: Templates = NOTICES) -> str:
    """The same in DuckDB's SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    split = lambda x: (
        f"list_filter(regexp_split_to_array(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
        r" '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    )
    notices = ", ".join(f"({quoted(label)}, {i}, {quoted(text)})" for i, (label, text) in enumerate(templates))
    phrases = ", ".join(f"({quoted(label)}, {quoted(p)}, {len(p.split())})" for label, p in PHRASES.items())
    return f"""
with notices as (
  select label, notice, {split("body")} as words from (values {notices}) t(label, notice, body)
), ngrams as (
  select label, notice, i - 1 as q, array_to_string(words[i : i + {k - 1}], ' ') as gram, len(words) - {k - 1} as size
  from (select *, unnest(range(1, len(words) - {k - 2})) as i from notices)
), phrases as (select * from (values {phrases}) t(label, phrase, n)
), d as (
  select row_number() over () as r, doc_id, {split("coalesce(text, '')")} as words from documents
), rolled as (
  select r, i - 1 as p, array_to_string(words[i : i + {k - 1}], ' ') as gram
  from (select r, words, unnest(range(1, len(words) - {k - 2})) as i from d)
), votes as (
  select r, label, notice, size, p - q as diagonal, min(p) as low, max(p) as high, list(distinct q) as qs
  from rolled join ngrams using (gram) group by all
), spans as (
  select r, label, notice, size, first, last, max(held) as held from (
    select a.r, a.label, a.notice, a.size, min(b.low) as first, max(b.high) as last,
      len(list_distinct(flatten(list(b.qs)))) as held
    from votes a join votes b on a.r = b.r and a.notice = b.notice and b.diagonal between a.diagonal - {GAP} and a.diagonal + {GAP}
    group by a.r, a.label, a.notice, a.size, a.diagonal)
  group by all
), verified as (
  select *, held / greatest(size, last - first + 1) as score from spans where held / greatest(size, last - first + 1) >= {LEAST_SCORE}
), runs as (
  select *, sum(new) over (partition by r order by first, last, notice) as run from (
    select *, case when first < max(last) over (partition by r order by first, last, notice rows between unbounded preceding and 1 preceding) + {k}
      then 0 else 1 end as new from verified)
), judged as (
  select *, first_value(label) over w as best_label, first_value(first) over w as best_first, first_value(last) over w as best_last
  from runs window w as (partition by r, run order by score desc, held desc, notice, first, last desc)
), cover as (
  select r, label, score as cover from judged where label = best_label or last + {k} <= best_first or first >= best_last + {k}
), verdict as (select r, max(cover) as score from cover group by r
), places as (
  select r, label, i - 1 as p from (
    select r, words, label, phrase, n, unnest(range(1, len(words) - n + 2)) as i from d, phrases)
  where array_to_string(words[i : i + n - 1], ' ') = phrase
), base as (
  select r, count(*) as n_base, min(p) as first_word, max(p) as last_word, string_agg(distinct label, ',' order by label) as base_labels
  from places group by r
), labels as (
  select r, string_agg(distinct label, ',' order by label) as labels
  from (select r, label from cover union select r, label from places) group by r
)
select d.doc_id, cast(len(d.words) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score
from d left join base using (r) left join labels using (r) left join verdict using (r)
"""
