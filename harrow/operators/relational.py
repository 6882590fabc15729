"""The operators of the plan API, each from DataFrames to a lazy DataFrame.

All compile to built-in Spark operators; the strategies of a join or a sort differ in the hint that
Catalyst gets, never in the result. Output fields are the left fields, then the right ones; of two
fields with one name the left stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import Aggregate
from ..functions.equality import field_type, literal, predicate, type_class
from ..plans.ast import Predicate

#: What each join strategy asks of Catalyst; ``auto`` leaves the choice to it and to AQE.
JOIN_HINTS = {"auto": None, "merge": "merge", "hash": "shuffle_hash"}
SORT_STRATEGIES = ("auto", "natural_runs", "one_buffer", "multi_buffer")


def _names(frame: DataFrame) -> dict[str, str]:
    return {c.lower(): c for c in frame.columns}


def _without(right: DataFrame, left: DataFrame, but: str = "") -> DataFrame:
    """``right`` without the fields that ``left`` has too."""
    taken = _names(left)
    return right.drop(*(c for c in right.columns if c.lower() in taken and c.lower() != but.lower()))


def select(frame: DataFrame, where: Predicate) -> DataFrame:
    """The rows for which the predicate holds; simple terms reach the Parquet scan as pushed filters."""
    return frame.filter(predicate(frame, where)) if where.terms else frame


def project(frame: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The named fields in this order, under these names; the scan reads no others."""
    for name in fields:
        field_type(frame, name)
    return frame.select(*(F.col(name).alias(name) for name in fields))


def product(left: DataFrame, right: DataFrame, strategy: str = "auto") -> DataFrame:
    """All pairs of rows. ``block`` makes Spark pair partitions instead of broadcasting a side."""
    if strategy not in ("auto", "block"):
        raise ValueError(f"unknown product strategy {strategy}")
    right = _without(right, left)
    return left.crossJoin(right.hint("shuffle_replicate_nl") if strategy == "block" else right)


def join(left: DataFrame, right: DataFrame, left_field: str, right_field: str, strategy: str = "auto") -> DataFrame:
    """Inner equi-join on one field pair; no rows if the two fields are of different type classes."""
    if strategy not in JOIN_HINTS:
        raise ValueError(f"unknown join strategy {strategy}")
    kinds = type_class(field_type(left, left_field)), type_class(field_type(right, right_field))
    keep = _without(right, left, right_field)
    key = "__right_key"
    keep = keep.withColumn(key, F.col(right_field))
    if right_field.lower() in _names(left):
        keep = keep.drop(right_field)
    hint = JOIN_HINTS[strategy]
    keep = keep.hint(hint) if hint else keep
    on = F.col(left_field) == F.col(key) if kinds[0] == kinds[1] else F.lit(False)
    return left.join(keep, on, "inner").drop(key)


def merge_join(left: DataFrame, right: DataFrame, left_field: str, right_field: str) -> DataFrame:
    return join(left, right, left_field, right_field, "merge")


def hash_join(left: DataFrame, right: DataFrame, left_field: str, right_field: str) -> DataFrame:
    return join(left, right, left_field, right_field, "hash")


def index_join(left: DataFrame, right: DataFrame, left_field: str, indexed_field: str) -> DataFrame:
    """Join with a table that has an index on ``indexed_field``.

    An index is an access path without a counterpart in Spark, so the right side is left to the
    planner: it is broadcast only if its size estimate, checked at run time by AQE, is under
    ``spark.sql.autoBroadcastJoinThreshold``; beyond that the join shuffles.
    """
    return join(left, right, left_field, indexed_field)


def index_select(frame: DataFrame, field: str, value: int | str) -> DataFrame:
    """Rows whose field equals the value: a pushed filter that skips files and row groups by their statistics.

    It skips most of them in a table whose rows were loaded, compacted or clustered in the order of the field.
    """
    if type_class(field_type(frame, field)) != ("string" if isinstance(value, str) else "number"):
        return frame.filter(F.lit(False))
    return frame.filter(F.col(field) == literal(value))


def sort(frame: DataFrame, fields: Sequence[str], strategy: str = "auto") -> DataFrame:
    """Rows in ascending order of the fields. Every strategy is Spark's range-partitioned external sort."""
    if strategy not in SORT_STRATEGIES:
        raise ValueError(f"unknown sort strategy {strategy}")
    for name in fields:
        field_type(frame, name)
    return frame.orderBy(*fields) if fields else frame


def sort_runs(frame: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows sorted within each partition: the runs of a sort before they are merged; no shuffle."""
    return frame.sortWithinPartitions(*fields)


def group_by(frame: DataFrame, keys: Sequence[str], aggregates: Sequence[Aggregate]) -> DataFrame:
    """A row for each group: its keys, then the aggregates. Without keys, one row even for no input."""
    for name in [*keys, *(a.field for a in aggregates)]:
        field_type(frame, name)
    if not aggregates:
        return frame.select(*keys).distinct()
    return frame.groupBy(*keys).agg(*(a.column() for a in aggregates))


def materialize(frame: DataFrame) -> DataFrame:
    """Keep the rows of a plan that several others read, until ``unpersist``; lost blocks are computed again."""
    return frame.persist(StorageLevel.MEMORY_AND_DISK)

