"""SELECT as a DataFrame: scan, expiry, newest rows, join, filter, order, projection.  Catalyst does the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import DialectError
from quillon.functions.render import column_text
from quillon.operators.predicates import REAL, WHOLE, predicate
from quillon.plans.ast import Join, Name, Select, Where
from quillon.sources.catalog import Catalog, Table

LEFT, RIGHT = "__l", "__r"


@dataclass
class Side:
    """A table in a query, with a prefix for its columns."""

    table: Table
    prefix: str = ""

    def column(self, name: str) -> Column | None:
        return F.col(f"`{self.prefix}{name}`") if self.table.field(name) else None

    def kind(self, name: str) -> T.DataType:
        return self.table.field(name).dataType

    def prefixed(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{f.name}`").alias(self.prefix + f.name) for f in self.table.schema.fields])


class Planner:
    def __init__(self, catalog: Catalog, compat: bool, now: Column):
        self.catalog, self.compat, self.now = catalog, compat, now

    def select(self, stmt: Select) -> DataFrame:
        if any(n.column == "*" for n in stmt.columns[1:]):
            raise DialectError("Unknown column: *")
        left = Side(self.catalog.find(stmt.table))
        return self.joined(stmt, left) if stmt.join else self.single(stmt, left)

    # One table

    def key_lookup(self, table: Table, where: Where | None) -> bool:
        """Whether the predicate asks for a key, and so sees only the newest row of it."""
        if where is None or where.op != "=":
            return False
        return where.column.column == (table.implicit_key() if self.compat else table.key)

    def single(self, stmt: Select, side: Side) -> DataFrame:
        table, where = side.table, stmt.where
        if where is not None and where.column.table not in (None, table.name):
            if not self.compat:
                raise DialectError(f"Unknown column: {where.column}")
            where = None
        if where is not None and not table.field(where.column.column):
            if not self.compat:
                raise DialectError(f"Unknown column: {where.column}")
            where = None  # compat: an unknown column is no condition
        if self.key_lookup(table, where):
            df = self.looked_up(table, where)
        else:
            df = table.rows(self.now)
            if where is not None:
                name = where.column.column
                df = df.where(predicate(side.column(name), side.kind(name), where.op, where.literal))
        df = self.ordered(df, stmt, [side])
        if stmt.columns[0].column == "*":
            return df.select(*[F.col(f"`{f.name}`") for f in table.schema.fields])
        out = []
        for name in stmt.columns:
            found = side.column(name.column)
            if found is None or (name.table not in (None, table.name) and not self.compat):
                raise DialectError(f"Unknown column: {name if found is not None else name.column}")
            out.append(found.alias(name.column))
        return df.select(*out)

    def looked_up(self, table: Table, where: Where) -> DataFrame:
        """The newest row of a key.  The key's predicate passes below the window; real keys compare exactly, or, in
        compat, by their whole part."""
        key = where.column.column
        kind = table.field(key).dataType
        if self.compat and isinstance(kind, REAL):
            df = table.read().withColumn("__key", F.col(f"`{key}`").cast("bigint"))
            cut = Table(table.name, table.schema, lambda: df, None, table.newest, table.expiry)
            return cut.newest_rows("__key", self.now).where(predicate(F.col("__key"), T.LongType(), "=", where.literal.split(".")[0])).drop("__key")
        return table.newest_rows(f"`{key}`", self.now).where(predicate(F.col(f"`{key}`"), kind, "=", where.literal, exact=True))

    # Two tables

    def joined(self, stmt: Select, left: Side) -> DataFrame:
        join = stmt.join
        left, right = Side(left.table, LEFT), Side(self.catalog.find(join.table), RIGHT)
        on_left, on_right = self.join_columns(join, left, right)
        right_key = right.table.implicit_key() if self.compat else right.table.key
        right_rows = right.table.newest_rows(f"`{on_right}`", self.now) if on_right == right_key else right.table.rows(self.now)
        condition = self.equal(left.column(on_left), left.kind(on_left), right.column(on_right), right.kind(on_right))
        df = left.prefixed(left.table.rows(self.now)).join(right.prefixed(right_rows), condition)
        if stmt.where is not None:
            df = df.where(self.on_sides(stmt.where, [left, right]))
        df = self.ordered(df, stmt, [left, right])
        if stmt.columns[0].column == "*":
            return df.select(*[s.column(f.name).alias(f"{s.table.name}.{f.name}") for s in (left, right) for f in s.table.schema.fields])
        out = []
        for name in stmt.columns:
            found = self.resolve(name, [left, right])
            if found is None:
                if not self.compat:
                    raise DialectError(f"Unknown column: {name}")
                found = F.lit("NULL"), T.StringType()
            out.append(found[0].alias(str(name)))
        return df.select(*out)

    def join_columns(self, join: Join, left: Side, right: Side) -> tuple[str, str]:
        """Columns of ON by table; its sides may be either way round."""
        a, b = join.left, join.right
        if a.table is not None and a.table != left.table.name:
            a, b = b, a
        if not right.table.field(b.column) or (b.table not in (None, right.table.name) and not self.compat):
            raise DialectError(f"JOIN column not found: {b.column}")
        if not left.table.field(a.column):
            raise DialectError(f"JOIN column not found: {a.column}")
        return a.column, b.column

    @staticmethod
    def equal(a: Column, a_kind: T.DataType, b: Column, b_kind: T.DataType) -> Column:
        """Keys of equal types as they are, other numbers as doubles, anything with text as text."""
        numbers = WHOLE + REAL
        if a_kind == b_kind or (isinstance(a_kind, WHOLE) and isinstance(b_kind, WHOLE)):
            return a == b
        if isinstance(a_kind, numbers) and isinstance(b_kind, numbers):
            return a.cast("double") == b.cast("double")
        return column_text(a, a_kind) == column_text(b, b_kind)

    @staticmethod
    def resolve(name: Name, sides: list[Side]) -> tuple[Column, T.DataType] | None:
        """A column by its table's name, or else on the first side that has it."""
        for side in sides:
            if name.table in (None, side.table.name) and (found := side.column(name.column)) is not None:
                return found, side.kind(name.column)
        return None

    def on_sides(self, where: Where, sides: list[Side]) -> Column:
        """A qualified column on its table; another one on every side that has it."""
        name, tests = where.column, []
        for side in sides:
            if name.table in (None, side.table.name) and (found := side.column(name.column)) is not None:
                tests.append(predicate(found, side.kind(name.column), where.op, where.literal))
                if name.table is not None:
                    break
        if not tests:
            if not self.compat:
                raise DialectError(f"Unknown column: {name}")
            return F.lit(True)
        return tests[0] if len(tests) == 1 else tests[0] & tests[1]

    def ordered(self, df: DataFrame, stmt: Select, sides: list[Side]) -> DataFrame:
        if stmt.order is None:
            return df
        found = self.resolve(stmt.order.column, sides)
        if found is None:
            raise DialectError(f"Unknown column: {stmt.order.column}")
        column, kind = found
        keys = [column]
        if self.compat and isinstance(kind, T.StringType):
            keys = [column.try_cast("double"), column]  # texts that are numbers sort as such, before others
        if stmt.order.descending:
            return df.orderBy(*[k.desc_nulls_first() for k in keys])
        return df.orderBy(*[k.asc_nulls_last() for k in keys])
