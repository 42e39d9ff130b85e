"""What a statement says, before any table is looked at.  Names are in upper case."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property


@dataclass(frozen=True)
class Name:
    """A column, perhaps qualified; column "*" stands for all."""

    column: str
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.{self.column}" if self.table else self.column


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str  # INT, DECIMAL, DATETIME or VARCHAR
    length: int | None = None
    key: bool = False
    not_null: bool = False


@dataclass(frozen=True)
class Create:
    table: str
    columns: tuple[ColumnSpec, ...]


@dataclass(frozen=True)
class Insert:
    """body: the text after VALUES, which may be long; its rows are read when they are asked for."""

    table: str
    columns: tuple[str, ...] | None
    body: str = field(repr=False)
    compat: bool = False

    @cached_property
    def rows(self) -> list[list[str]]:
        from quillon.plans.parser import value_rows

        return value_rows(self.body, self.compat)


@dataclass(frozen=True)
class Where:
    column: Name
    op: str
    literal: str


@dataclass(frozen=True)
class Join:
    table: str
    left: Name
    right: Name


@dataclass(frozen=True)
class OrderBy:
    column: Name
    descending: bool = False


@dataclass(frozen=True)
class Select:
    columns: tuple[Name, ...]
    table: str
    join: Join | None = None
    where: Where | None = None
    order: OrderBy | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Where | None = None


Statement = Create | Insert | Select | Delete
