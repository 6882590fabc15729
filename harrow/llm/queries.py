"""One query for each corpus operator over its whole table, and SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, exact_dedup, licenses, lm, near_dedup, pii, secrets, substring_dedup, toxicity

VOCABULARY = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def vocabulary() -> tuple[str, str]:
    """Path of the vocabulary file and the pattern that splits text before the merges."""
    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), *vocabulary())


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(documents(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir), *vocabulary())


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("spans")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.annotate(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_substring_dedup, op2_toxicity, op3_bpe, op4_lm, op5_exact_dedup, op6_secrets, op7_pii, op8_licenses, op9_decontamination,
        op10_minhash,
    ]
    return {f.__name__: f for f in found}


OP5_SQL = r"""
with d as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
), g as (
  select norm, min(doc_id) as keep_id, count(*) as group_size from d group by norm
)
select d.doc_id, g.keep_id, g.group_size, d.doc_id is not distinct from g.keep_id as kept, sha256(d.norm) as text_sha256
from d join g using (norm)
"""

OP9_SQL = r"""
with w as (
  select item_id, cast(item_id as varchar) as item,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words
  from benchmark
), windows as (
  select distinct item, array_to_string(words[i : i + least(10, len(words)) - 1], ' ') as win, least(10, len(words)) as size
  from (select item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as i from w where len(words) > 0)
), sizes as (select distinct size from windows
), d as (
  select doc_id, row_number() over () as r,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words
  from documents
), grams as (
  select r, i, size, array_to_string(words[i : i + size - 1], ' ') as win
  from (select r, words, size, unnest(range(1, len(words) - size + 2)) as i from d, sizes)
), found as (
  select g.r, g.i, g.size, x.item from grams g join windows x on g.win = x.win and g.size = x.size
), hit as (
  select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + size)) as p from found) group by r
), items as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct r, item from found) group by r
)
select d.doc_id, cast(len(d.words) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(x.n_items, 0) as n_items,
  sha256(coalesce(x.names, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from d left join hit h using (r) left join items x using (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op8_licenses": licenses.oracle_sql(), "op9_decontamination": OP9_SQL}
