"""Registry of aggregate functions. A new one is a function from a column to an aggregate column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Builder = Callable[[Column], Column]
_REGISTRY: dict[str, Builder] = {"count": F.count, "max": F.max}


@dataclass(frozen=True)
class Aggregate:
    """An aggregate function over a field; the result is named ``<function>of<field>``."""

    function: str
    field: str

    @property
    def output(self) -> str:
        return f"{self.function}of{self.field}"

    def column(self) -> Column:
        return _REGISTRY[self.function](F.col(self.field)).alias(self.output)


def register(name: str, build: Builder) -> None:
    """Make ``name`` an aggregate function. ``build`` may use any Spark aggregate or a grouped pandas UDF."""
    _REGISTRY[name] = build


def count(field: str) -> Aggregate:
    return Aggregate("count", field)


def maximum(field: str) -> Aggregate:
    return Aggregate("max", field)
