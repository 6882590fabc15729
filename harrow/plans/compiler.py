"""From a SELECT tree to a lazy DataFrame: tables and views, products, one filter, one projection.

The tree is not optimised here. Catalyst turns products with equalities into joins, pushes filters
into the scans, prunes columns and merges views into the queries that use them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from ..errors import CyclicView
from ..operators.relational import product, project, select
from .ast import Query

TableReader = Callable[[str], DataFrame]


def compile_query(query: Query, views: dict[str, Query], read: TableReader, within: tuple[str, ...] = ()) -> DataFrame:
    """``read`` opens a table by name. A name is looked up among the views first."""

    def source(name: str) -> DataFrame:
        if name in within:
            raise CyclicView(" -> ".join([*within, name]))
        if name in views:
            return compile_query(views[name], views, read, (*within, name))
        return read(name)

    joined = reduce(product, map(source, query.tables))
    return project(select(joined, query.where), query.fields)
