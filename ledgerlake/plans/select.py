"""Single-table selections over a catalog, as values that build DataFrames.

NULL is a value: it equals NULL, and is less than every other value. Predicates are written so that
Catalyst can push them down; arms for NULL appear only where a column may hold one.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.errors import ColumnNotFound, ParameterNotFound, TableNotFound, TypeMismatch, UnsupportedFeature

OPERATORS = ("=", "<", "<=", ">", ">=", "in", "between", "has")


@dataclass(frozen=True)
class Param:
    """The n-th bound value, from 1."""

    number: int


@dataclass(frozen=True)
class TableDef:
    """A table: how to read it, its key, and the columns that never hold NULL."""

    name: str
    rows: DataFrame
    key: tuple[str, ...] = ()
    required: frozenset[str] = frozenset()

    def field(self, name: str) -> T.StructField:
        for f in self.rows.schema.fields:
            if f.name == name:
                return f
        raise ColumnNotFound(self.name, name)

    def nullable(self, name: str) -> bool:
        return self.field(name).nullable and name not in self.required and name not in self.key


@dataclass
class Catalog:
    tables: dict[str, TableDef] = field(default_factory=dict)

    def add(self, table: TableDef) -> Catalog:
        for name in table.key:
            table.field(name)
        self.tables[table.name] = table
        return self

    def drop(self, name: str) -> Catalog:
        self.get(name)
        del self.tables[name]
        return self

    def get(self, name: str) -> TableDef:
        if name not in self.tables:
            raise TableNotFound(name)
        return self.tables[name]


def _family(value) -> str:
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "text" if isinstance(value, str) else "bytes" if isinstance(value, (bytes, bytearray)) else "time"


def _check_test(field: T.StructField, op: str, value) -> None:
    """Refuse a test whose values are of another kind than the column; nothing is converted."""
    kind = field.dataType
    if op == "has":
        if not isinstance(kind, T.ArrayType):
            raise TypeMismatch(kind.simpleString(), "array")
        kind = kind.elementType
    for v in value if op in ("in", "between") else (value,):
        _check(kind, v)


def _check(kind: T.DataType, value) -> None:
    families = {"boolean": T.BooleanType, "number": T.NumericType, "text": T.StringType, "bytes": T.BinaryType, "time": (T.TimestampType, T.TimestampNTZType, T.DateType)}
    if value is not None and not isinstance(kind, families[_family(value)]):
        raise TypeMismatch(kind.simpleString(), type(value).__name__)


def predicate(column: Column, op: str, value, nullable: bool = True) -> Column:
    """column op value, with NULL as the least value."""
    null = column.isNull() if nullable else F.lit(False)
    if op == "between":
        return predicate(column, ">=", value[0], nullable) & predicate(column, "<=", value[1], nullable)
    if op == "has":  # value = ANY(column)
        return F.coalesce(F.array_contains(column, value), F.lit(False)) if value is not None else F.coalesce(F.exists(column, lambda x: x.isNull()), F.lit(False))
    if op == "in":
        known = [v for v in value if v is not None]
        arms = ([column.isin(known)] if known else []) + ([null] if len(known) < len(value) else [])
        return reduce(lambda a, b: a | b, arms, F.lit(False)) if len(arms) != 1 else arms[0]
    if value is None:
        return {"=": null, "<": F.lit(False), "<=": null, ">": ~null, ">=": F.lit(True)}[op]
    if op == "=":
        return column == F.lit(value)
    test = {"<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}[op]
    return (test | null) if nullable and op in ("<", "<=") else test


@dataclass(frozen=True)
class Select:
    """A selection: immutable, so that parts can be shared and bound again."""

    table: str
    columns: tuple[tuple[str, str], ...] | None = None
    tests: tuple[tuple[str, str, object], ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    most: int | None = None

    def pick(self, *names: str, **renamed: str) -> Select:
        """Columns to return; pick(new="old") renames."""
        return replace(self, columns=(*[(n, n) for n in names], *[(old, new) for new, old in renamed.items()]))

    def where(self, column: str, op: str, value) -> Select:
        """One more condition. The column may be qualified by the table's own name."""
        if op not in OPERATORS:
            raise UnsupportedFeature(f"operator {op}")
        return replace(self, tests=(*self.tests, (self._own(column), op, value)))

    def where_any(self, *tests: tuple[str, str, object]) -> Select:
        """One more condition: any of the tests (column, operator, value)."""
        for _, op, _ in tests:
            if op not in OPERATORS:
                raise UnsupportedFeature(f"operator {op}")
        return replace(self, tests=(*self.tests, ("", "any", tuple((self._own(c), op, v) for c, op, v in tests))))

    def _own(self, column: str) -> str:
        table, dot, name = column.rpartition(".")
        if dot and table != self.table:
            raise ColumnNotFound(table, name)
        return name

    def used(self) -> set[str]:
        """The columns that conditions and the order read."""
        tests = [t for c, op, v in self.tests for t in (v if op == "any" else ((c, op, v),))]
        return {c for c, _, _ in tests} | {c for c, _ in self.order}

    def order_by(self, *names: str) -> Select:
        """Names to sort by; a leading minus sorts downwards."""
        return replace(self, order=tuple((n.lstrip("-"), n.startswith("-")) for n in names))

    def limit(self, n: int) -> Select:
        if n < 0:
            raise UnsupportedFeature("a negative limit")
        return replace(self, most=n)

    def bind(self, *values) -> Select:
        """The selection with its parameters replaced."""

        def one(v):
            if isinstance(v, Param):
                if not 1 <= v.number <= len(values):
                    raise ParameterNotFound(v.number)
                return values[v.number - 1]
            return [one(x) for x in v] if isinstance(v, (list, tuple)) else v

        def test(c, op, v):
            return (c, op, tuple(test(*t) for t in v) if op == "any" else one(v))

        return replace(self, tests=tuple(test(*t) for t in self.tests))

    def path(self, catalog: Catalog) -> str:
        """How the key is bound: "point", "range" or "scan". Only for reports."""
        key = catalog.get(self.table).key
        equal = {c for c, op, _ in self.tests if op == "="}
        if key and set(key) <= equal:
            return "point"
        return "range" if len(key) == 1 and any(c == key[0] and op in OPERATORS[:5] for c, op, _ in self.tests) else "scan"

    def at(self, catalog: Catalog, ops: DataFrame, position: int, decode) -> DataFrame:
        """The selection as of a log position: ops are read there (refused if it isn't applied yet) and decode
        turns (key, created_at, value) into the table's columns."""
        from ledgerlake.operators.versions import read_at

        return self.build(catalog, decode(read_at(ops, position)))

    def build(self, catalog: Catalog, rows: DataFrame | None = None) -> DataFrame:
        """The DataFrame; rows stands in for the table's rows, for instance as of a position."""
        table = catalog.get(self.table)
        df = table.rows if rows is None else rows
        for test in self.bind().tests:
            arms = test[2] if test[1] == "any" else (test,)
            for name, op, value in arms:
                _check_test(table.field(name), op, value)
            df = df.where(reduce(lambda a, b: a | b, [predicate(F.col(n), op, v, table.nullable(n)) for n, op, v in arms], F.lit(False)) if len(arms) != 1 else predicate(F.col(arms[0][0]), arms[0][1], arms[0][2], table.nullable(arms[0][0])))
        for name, _ in (*self.order, *(self.columns or ())):
            table.field(name)
        if self.order:
            df = df.orderBy(*[F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_first() for n, down in self.order])
        if self.most is not None:
            df = df.limit(self.most)
        return df if self.columns is None else df.select(*[F.col(old).alias(new) for old, new in self.columns])
