"""Plan operators over streams.

The operators that keep no state (project, select, join with a static table) take a streaming
DataFrame as it is. ``query_stream`` runs a SELECT with one of its tables bound to a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..database import Database
from ..plans.compiler import compile_query
from ..plans.parser import parse_query


def query_stream(db: Database, text: str, streams: dict[str, DataFrame]) -> DataFrame:
    """The SELECT ``text`` with the named tables read from streams and all others from ``db``."""
    tx = db.begin()
    bound = {k.lower(): v for k, v in streams.items()}
    return compile_query(
        parse_query(text), tx.catalog.views, lambda name: bound[name] if name in bound else tx.table(name)
    )
