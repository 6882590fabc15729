"""Transactions: snapshot reads, staged copy-on-write changes, and a serialisability check at commit.

A delete or an update rewrites only the files that hold a row it hits; a file of which every row is
deleted is only forgotten. An insert reads nothing, so inserts of several transactions into one table do not conflict.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import Conflict, EngineError, TransactionClosed, TypeMismatch, UnknownField, UnknownIndex, UnknownTable
from .functions.equality import expression, expression_class, literal, predicate
from .plans import ast
from .plans.catalog import Catalog
from .plans.compiler import compile_query
from .plans.layout import SYSTEM_TABLES, check_value, default_of, spark_schema
from .plans.parser import parse_command, parse_query

if TYPE_CHECKING:
    from .database import Database

#: Files with fewer rows are small: ``compact`` writes them together.
SMALL_ROWS = 10_000


class Transaction:
    """Sees the catalog as it was at the start, and its own changes. Use as a context manager or by calls."""

    def __init__(self, db: Database) -> None:
        self._db = db
        self._number, self._base = db.committed()
        self._now = self._base
        self._used: set[str] = set()
        self._staged: list[str] = []
        self._added: dict[str, list[tuple[str, int]]] = {}  # files of tables that so far were only inserted into
        self._open = True

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self._open:
            self.rollback() if kind else self.commit()

    @property
    def catalog(self) -> Catalog:
        return self._now

    @property
    def added(self) -> list[str]:
        """The tables that were only inserted into."""
        return list(self._added)

    def _check_open(self) -> None:
        if not self._open:
            raise TransactionClosed("the transaction has ended")

    def table(self, name: str) -> DataFrame:
        """A table, a catalog table or a registered read-only table as a DataFrame."""
        self._check_open()
        name = name.lower()
        self._used.add(name)
        if name in self._now.tables:
            entry = self._now.tables[name]
            return self._db.storage.read_files([f for f, _ in entry.files], spark_schema(entry.fields))
        if name in SYSTEM_TABLES:
            # A commit of any name changes what a catalog table shows.
            self._used.update(SYSTEM_TABLES)
            return self._db.spark.createDataFrame(self._now.system_rows(name), spark_schema(SYSTEM_TABLES[name]))
        if name in self._db.registered:
            found = self._db.registered[name]
            if not isinstance(found, DataFrame):
                found = self._db.registered[name] = found()
            return found
        raise UnknownTable(name)

    def query(self, text: str) -> DataFrame:
        """The lazy result of a SELECT statement."""
        self._check_open()
        query = parse_query(text)
        self._used.update(self._now.views)
        return self._db.planner(query, self._now.views, self.table)

    def execute(self, text: str) -> int:
        """Run a command; the number of rows that it inserted, deleted or matched, 0 for a definition."""
        self._check_open()
        command = parse_command(text)
        if type(command) in self._db.commands:
            return self._db.commands[type(command)](self, command)
        return self.run(command)

    def run(self, command: ast.Command) -> int:
        """The engine's own way to run a parsed command."""
        return getattr(self, f"_{type(command).__name__.lower()}")(command)

    def _own(self, name: str):
        if name not in self._now.tables:
            if name in SYSTEM_TABLES or name in self._db.registered or name in self._now.views:
                raise EngineError(f"{name} is read-only")
            raise UnknownTable(name)
        return self._now.tables[name]

    def _stage(self, name: str, frame: DataFrame) -> list[tuple[str, int]]:
        files = self._db.storage.write_rows(name, frame)
        self._staged += [f for f, _ in files]
        return files

    def _add(self, name: str, frame: DataFrame) -> None:
        files = self._stage(name, frame)
        self._added.setdefault(name, []).extend(files)
        self._now = self._now.with_files(name, (*self._now.tables[name].files, *files))

    def _clustered(self, name: str, frame: DataFrame) -> DataFrame:
        """Rows in the order of the table's first indexed field, so that a look-up skips most files and row groups."""
        fields = list(self._now.indexes_of(name))
        return frame.repartitionByRange(F.col(fields[0])).sortWithinPartitions(fields[0]) if fields else frame

    def _replace(self, name: str, hits: dict[str, int], kept: Callable[[DataFrame], DataFrame], whole: bool) -> int:
        """Put ``kept`` of the rows of files with a hit in their place; if ``whole``, files of nothing but hits are only dropped."""
        entry = self._now.tables[name]
        again = [f for f, n in entry.files if f in hits and not (whole and hits[f] == n)]
        files = [x for x in entry.files if x[0] not in hits]
        if again:
            files += self._stage(name, kept(self._db.storage.read_files(again, spark_schema(entry.fields))))
        self._now = self._now.with_files(name, tuple(files))
        self._added.pop(name, None)
        return sum(hits.values())

    def _insert(self, c: ast.Insert) -> int:
        entry = self._own(c.table)
        if len(c.fields) != len(c.values) or len(set(c.fields)) < len(c.fields):
            raise TypeMismatch("the fields and the values of an insert must pair up")
        given = dict(zip(c.fields, c.values, strict=True))
        if unknown := given.keys() - {f.name for f in entry.fields}:
            raise UnknownField(", ".join(sorted(unknown)))
        for f in entry.fields:
            if f.name in given:
                check_value(f, given[f.name])
        row = tuple(given[f.name].value if f.name in given else default_of(f) for f in entry.fields)
        self._add(c.table, self._db.spark.createDataFrame([row], spark_schema(entry.fields)).coalesce(1))
        return 1

    def load(self, name: str, frame: DataFrame) -> None:
        """Add the rows of a DataFrame to a table; its columns must be the table's fields."""
        self._check_open()
        entry = self._own(name.lower())
        schema = spark_schema(entry.fields)
        if missing := set(schema.names) - set(frame.columns):
            raise UnknownField(", ".join(sorted(missing)))
        units = {f.name: F.max(F.length(F.encode(F.col(f.name), "UTF-16BE")) / 2) for f in entry.fields if f.length is not None}
        nulls = [F.max(F.col(f.name).isNull()) for f in entry.fields]
        found = frame.agg(*nulls, *units.values()).first()
        if any(found[: len(nulls)]):
            raise TypeMismatch("the engine has no null")
        limits = [f.length for f in entry.fields if f.length is not None]
        if any(most is not None and most > n for most, n in zip(found[len(nulls) :], limits, strict=True)):
            raise TypeMismatch("a value is longer than its field allows")
        self._add(name.lower(), self._clustered(name.lower(), frame.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields))))

    def compact(self, name: str, small_rows: int = SMALL_ROWS) -> int:
        """Write the rows of files with under ``small_rows`` rows into fewer files; how many files there were."""
        self._check_open()
        entry, rows = self._own(name.lower()), self.table(name)
        small = {f: n for f, n in entry.files if n < small_rows}
        if len(small) < 2:
            return 0
        few = max(1, sum(small.values()) // (100 * small_rows))
        self._replace(name.lower(), small, lambda x: self._clustered(name.lower(), x.select(*rows.columns)).coalesce(few), whole=False)
        return len(small)

    def cluster(self, index: str) -> int:
        """Write the indexed table anew in the order of the indexed field, so that a look-up skips most files; its files before."""
        self._check_open()
        if index.lower() not in self._now.indexes:
            raise UnknownIndex(index)
        x = self._now.indexes[index.lower()]
        self.table(x.table)
        files = dict(self._own(x.table).files)
        by_field = lambda frame: frame.repartitionByRange(F.col(x.field)).sortWithinPartitions(x.field)
        return len(files) if self._replace(x.table, files, by_field, whole=False) else 0

    def _hits(self, name: str, rows: DataFrame, hit: Column) -> dict[str, int]:
        """Of each file with a hit, how many there are: one pass with the predicate pushed down, a row for each file."""
        if not self._now.tables[name].files:
            return {}
        found = rows.filter(hit).groupBy(self._db.storage.file_name().alias("file")).agg(F.count("*").alias("n"))
        return {r.file: r.n for r in found.collect()}

    def _delete(self, c: ast.Delete) -> int:
        self._own(c.table)
        rows = self.table(c.table)
        hit = F.coalesce(predicate(rows, c.where), F.lit(False))
        if hits := self._hits(c.table, rows, hit):
            return self._replace(c.table, hits, lambda x: x.filter(~hit), whole=True)
        return 0

    def _update(self, c: ast.Update) -> int:
        entry = self._own(c.table)
        rows = self.table(c.table)
        target = next((f for f in entry.fields if f.name == c.field), None)
        if target is None:
            raise UnknownField(c.field)
        if isinstance(c.value, ast.Literal):
            check_value(target, c.value)
        elif (expression_class(rows, c.value) == "string") != (target.length is not None):
            raise TypeMismatch(f"{c.value} does not fit {target}")
        hit = F.coalesce(predicate(rows, c.where), F.lit(False))
        hits = self._hits(c.table, rows, hit)
        if not hits:
            return 0
        if isinstance(c.value, ast.FieldRef) and target.length is not None:
            # UTF-16 code units, the unit of varchar lengths.
            units = F.length(F.encode(F.col(c.value.name), "UTF-16BE")) / 2
            if not rows.filter(hit & (units > target.length)).isEmpty():
                raise TypeMismatch(f"a value of {c.value} is longer than {target} allows")
        new = literal(c.value.value) if isinstance(c.value, ast.Literal) else expression(c.value)
        return self._replace(c.table, hits, lambda x: x.withColumn(c.field, F.when(hit, new).otherwise(F.col(c.field))), whole=False)

    def _createtable(self, c: ast.CreateTable) -> int:
        self._used.add(c.table)
        if c.table in self._db.registered:
            raise EngineError(f"{c.table} is a registered table")
        self._now = self._now.with_new_table(c.table, c.fields)
        return 0

    def _createview(self, c: ast.CreateView) -> int:
        self._used.add(c.view)
        candidate = self._now.with_view(c.view, c.query)
        compile_query(c.query, candidate.views, self.table, (c.view,))  # names resolve, and there is no cycle
        self._now = candidate
        return 0

    def _createindex(self, c: ast.CreateIndex) -> int:
        entry = self._own(c.table)
        if c.field not in {f.name for f in entry.fields}:
            raise UnknownField(c.field)
        self._now = self._now.with_index(c)
        return 0

    def commit(self) -> None:
        """Publish the changes; Conflict, and a rollback, if a used table or view has changed since the start."""
        self._check_open()
        while self._now != self._base:
            number, head = self._db.committed()
            used = {n for n in self._used if n not in SYSTEM_TABLES}
            if any(head.stamp(n) != self._base.stamp(n) for n in used) or (
                self._used & SYSTEM_TABLES.keys() and head != self._base
            ):
                self.rollback()
                raise Conflict("a table or view that the transaction used was changed by another one")
            tables = {k: v for k, v in self._now.tables.items() if v != self._base.tables.get(k)}
            for name, files in self._added.items():
                if name in head.tables and name in self._base.tables and name not in used:
                    old = head.tables[name]
                    tables[name] = replace(old, files=(*old.files, *files), version=old.version + 1)
            merged = replace(
                head,
                tables=head.tables | tables,
                views=head.views | {k: v for k, v in self._now.views.items() if k not in self._base.views},
                indexes=head.indexes | {k: v for k, v in self._now.indexes.items() if k not in self._base.indexes},
            )
            if self._db.storage.append(number + 1, merged.to_json()):
                break
        self._open = False

    def rollback(self) -> None:
        """Drop the staged files; the committed catalog never named them."""
        self._check_open()
        self._open = False
        for file in self._staged:
            self._db.storage.drop_file(file)
