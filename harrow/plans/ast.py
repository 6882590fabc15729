"""Syntax trees of the SQL dialect. ``str()`` of a tree is SQL text that parses to the same tree."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class FieldRef:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Literal:
    """An int32 or a string constant."""

    value: int | str

    def __str__(self) -> str:
        return f"'{self.value}'" if isinstance(self.value, str) else str(self.value)


Expression = FieldRef | Literal


@dataclass(frozen=True)
class Term:
    """``left = right``, the only comparison of the dialect."""

    left: Expression
    right: Expression

    def __str__(self) -> str:
        return f"{self.left} = {self.right}"

    def fields(self) -> list[str]:
        return [x.name for x in (self.left, self.right) if isinstance(x, FieldRef)]


@dataclass(frozen=True)
class Predicate:
    """A conjunction of terms; without terms it is true."""

    terms: tuple[Term, ...] = ()

    def __str__(self) -> str:
        return " and ".join(map(str, self.terms))

    def applies_to(self, fields: Iterable[str]) -> bool:
        """Can the predicate be evaluated on rows with these fields?"""
        known = {f.lower() for f in fields}
        return all(f in known for t in self.terms for f in t.fields())

    def conjoin(self, other: Predicate) -> Predicate:
        return Predicate(self.terms + other.terms)

    def constant_for(self, name: str) -> Literal | None:
        """The constant c of the first term ``name = c``, whichever side it stands on."""
        for t in self.terms:
            for a, b in ((t.left, t.right), (t.right, t.left)):
                if a == FieldRef(name) and isinstance(b, Literal):
                    return b
        return None

    def field_for(self, name: str) -> str | None:
        """The other field g of the first term ``name = g``."""
        for t in self.terms:
            for a, b in ((t.left, t.right), (t.right, t.left)):
                if a == FieldRef(name) and isinstance(b, FieldRef):
                    return b.name
        return None


@dataclass(frozen=True)
class Query:
    fields: tuple[str, ...]
    tables: tuple[str, ...]
    where: Predicate = field(default_factory=Predicate)

    def __str__(self) -> str:
        tail = f" where {self.where}" if self.where.terms else ""
        return f"select {', '.join(self.fields)} from {', '.join(self.tables)}{tail}"


@dataclass(frozen=True)
class Insert:
    table: str
    fields: tuple[str, ...]
    values: tuple[Literal, ...]

    def __str__(self) -> str:
        return f"insert into {self.table}({', '.join(self.fields)}) values ({', '.join(map(str, self.values))})"


@dataclass(frozen=True)
class Delete:
    table: str
    where: Predicate = field(default_factory=Predicate)

    def __str__(self) -> str:
        return f"delete from {self.table}" + (f" where {self.where}" if self.where.terms else "")


@dataclass(frozen=True)
class Update:
    table: str
    field: str
    value: Expression
    where: Predicate = Predicate()

    def __str__(self) -> str:
        tail = f" where {self.where}" if self.where.terms else ""
        return f"update {self.table} set {self.field} = {self.value}{tail}"


@dataclass(frozen=True)
class FieldDef:
    """A field of a table; ``length`` is None for int and the most UTF-16 code units for varchar."""

    name: str
    length: int | None = None

    def __str__(self) -> str:
        return f"{self.name} int" if self.length is None else f"{self.name} varchar({self.length})"


@dataclass(frozen=True)
class CreateTable:
    table: str
    fields: tuple[FieldDef, ...]

    def __str__(self) -> str:
        return f"create table {self.table}({', '.join(map(str, self.fields))})"


@dataclass(frozen=True)
class CreateView:
    view: str
    query: Query

    def __str__(self) -> str:
        return f"create view {self.view} as {self.query}"


@dataclass(frozen=True)
class CreateIndex:
    index: str
    table: str
    field: str

    def __str__(self) -> str:
        return f"create index {self.index} on {self.table}({self.field})"


Command = Insert | Delete | Update | CreateTable | CreateView | CreateIndex
