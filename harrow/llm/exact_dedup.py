"""Exact dedup by progressive refinement: length, then prefix hash, then full hash of what is left.

Texts are compared after each run of ASCII white space has become one space; null counts as empty.
All steps are DataFrame functions; counts are aggregated before they are shuffled, so a text that a
third of all rows share costs one row for each task.

* null text: equal to the empty text, and a text like any other; very long text: whole, a row at a time;
* null doc_id: stays only if no row of the group has an id; equal rows with null ids are one document;
* rows that repeat doc_id and text: one document. ``annotate`` marks each as kept, ``dedup`` returns one;
* empty table: empty result; further columns, whatever their names, pass through ``dedup`` unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, drop_written, fresh, quoted, written

PREFIX_CHARS = 64
#: Bytes of a table that may be broadcast; beyond that the join shuffles. A row of a hash table with a length and a
#: prefix hash takes up to 64 bytes there, one with a digest and three numbers up to 160.
MOST_BROADCAST = 32 << 20
KEY_BYTES, GROUP_BYTES = 64, 160
# Runs that one space should replace; single spaces need no replacement.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _RUNS, " ")


def _size(text: str) -> Column:
    return F.octet_length(normalised(text))


def _prefix(text: str) -> Column:
    return F.xxhash64(F.substring(normalised(text), 1, PREFIX_CHARS))


def _digest(text: str) -> Column:
    """32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def survivors(docs: DataFrame, text: str = "text") -> DataFrame:
    """size, prefix: the pairs that more than one text has.

    One pass reads each text for its length and prefix hash and counts rows by both. Lengths that occur once
    are out; of the rest, prefixes that occur once are out.
    """
    counted = written(docs.select(_size(text).alias("size"), _prefix(text).alias("prefix")).groupBy("size", "prefix").agg(F.count("*").alias("n")))
    lengths = counted.groupBy("size").agg(F.sum("n").alias("m")).filter("m > 1").select("size")
    out = written(counted.filter("n > 1").join(lengths, "size", "left_semi").select("size", "prefix"))
    drop_written(counted)
    return out


def copies(docs: DataFrame, left: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of two rows or more with equal texts: sha (32 bytes), keep_id, group_size, n_keep (rows with keep_id).

    Only texts whose length and prefix are among the survivors, ``left``, are read in full and hashed.
    """
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), _size(text).alias("size"), _prefix(text).alias("prefix"))
    full = keyed.join(bounded(left, KEY_BYTES, MOST_BROADCAST), ["size", "prefix"], "left_semi").select("doc_id", _digest("text").alias("sha"))
    # Rows of one id are counted first, so the smallest id and its repeats come from one small group.
    each = full.groupBy("sha", "doc_id").agg(F.count("*").alias("n"))
    groups = each.groupBy("sha").agg(
        F.min("doc_id").alias("keep_id"),
        F.sum("n").alias("group_size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "n")).getField("n").alias("n_keep"),
    )
    return written(groups.filter("group_size > 1"))


def annotate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256. Shows every digest, so it hashes every text."""
    left = survivors(docs, text)
    groups = copies(docs, left, doc_id, text)
    drop_written(left)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _digest(text).alias("sha"))
    rows = rows.join(bounded(groups, GROUP_BYTES, MOST_BROADCAST), "sha", "left")
    keep = F.when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id"))
    return rows.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the one with the smallest id.

    A text that shares its length and prefix hash with no other stays without being hashed.
    """
    left = survivors(docs, text)
    size, prefix, shared, sha, keep, n = fresh(docs, "size", "prefix", "shared", "sha", "keep", "n")
    groups = copies(docs, left, doc_id, text).select(F.col("sha").alias(sha), F.col("keep_id").alias(keep), F.col("n_keep").alias(n))
    named = left.select(F.col("size").alias(size), F.col("prefix").alias(prefix), F.lit(True).alias(shared))
    rows = docs.withColumns({size: _size(text), prefix: _prefix(text)}).join(bounded(named, KEY_BYTES, MOST_BROADCAST), [size, prefix], "left")
    # Other texts get a key that is no digest; one for each length and prefix, so that no task gets them all.
    other = F.unhex(F.hex(F.col(prefix)))
    rows = rows.withColumn(sha, F.when(F.col(shared), _digest(text)).otherwise(other)).join(bounded(groups, GROUP_BYTES, MOST_BROADCAST), sha, "left")
    rows = rows.filter(F.col(n).isNull() | F.col(doc_id).cast("long").eqNullSafe(F.col(keep)))
    names = [quoted(c) for c in docs.columns]
    if groups.filter(F.col(n) > 1).isEmpty():
        return rows.select(*names)
    once = rows.filter(F.col(n).isNull() | (F.col(n) == 1))
    repeated = rows.filter(F.col(n) > 1).dropDuplicates([sha])
    return once.unionByName(repeated).select(*names)
