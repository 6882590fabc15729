"""Operators of the plan API."""

from .relational import (
    group_by,
    hash_join,
    index_join,
    index_select,
    join,
    materialize,
    merge_join,
    product,
    project,
    select,
    sort,
    sort_runs,
)

__all__ = [
    "group_by", "hash_join", "index_join", "index_select", "join", "materialize",
    "merge_join", "product", "project", "select", "sort", "sort_runs",
]
