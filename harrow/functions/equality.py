"""Equality of the dialect: values of different type classes are unequal, never an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnknownField
from ..plans.ast import Expression, FieldRef, Literal, Predicate, Term


def field_type(frame: DataFrame, name: str) -> T.DataType:
    """The type of a field; names are compared without regard to case."""
    for f in frame.schema.fields:
        if f.name.lower() == name.lower():
            return f.dataType
    raise UnknownField(name)


def type_class(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    return "string" if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)) else kind.simpleString()


def expression_class(frame: DataFrame, e: Expression) -> str:
    if isinstance(e, Literal):
        return "string" if isinstance(e.value, str) else "number"
    return type_class(field_type(frame, e.name))


def literal(value: int | str) -> Column:
    return F.lit(value).cast("string" if isinstance(value, str) else "int")


def expression(e: Expression) -> Column:
    return F.col(e.name) if isinstance(e, FieldRef) else literal(e.value)


def term(frame: DataFrame, t: Term) -> Column:
    """A column that tells whether the term holds; false, not null, where a type class differs."""
    if expression_class(frame, t.left) != expression_class(frame, t.right):
        return F.lit(False)
    return expression(t.left) == expression(t.right)


def predicate(frame: DataFrame, p: Predicate) -> Column:
    """The conjunction of the terms, in a form from which Catalyst takes joins and pushed filters."""
    return reduce(lambda a, b: a & b, (term(frame, t) for t in p.terms), F.lit(True)) if p.terms else F.lit(True)
