"""INSERT, bulk load and DELETE."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.errors import DialectError
from quillon.functions.coerce import DEFAULTS, as_kind, int_column, to_int, to_value
from quillon.operators.predicates import predicate
from quillon.plans.ast import Delete, Insert
from quillon.plans.parser import value_rows
from quillon.plans.values import text_columns
from quillon.sources.catalog import EXPIRY, NEVER, POSITION, Catalog, Table

#: Characters of statements beyond which tasks read them, and the driver doesn't; the rows are the same.
LONG = 64 << 20
ARROW = {"INT": pa.int64(), "DATETIME": pa.int64(), "DECIMAL": pa.float64(), "VARCHAR": pa.string()}


def kinds(table: Table) -> list[str]:
    return [f.metadata["decl"] for f in table.schema.fields]


def places(table: Table, stmt: Insert, compat: bool) -> list[int] | None:
    """Where the values of a row go; None for the table's own order.  Compat passes over a list of columns."""
    if stmt.columns is None or compat:
        return None
    names = table.schema.fieldNames()
    for c in stmt.columns:
        if c not in names:
            raise DialectError(f"Unknown column: {c}")
    return [names.index(c) for c in stmt.columns]


def columns_of(rows: list[list[str]], types: list[str], order: list[int] | None) -> tuple[list[list], list[int]]:
    """Values by column, and expiry, of rows of literals.  Missing values take the default of their type, the first value
    too many is the row's expiry, further ones are passed over."""
    size = len(types) if order is None else len(order)
    expiry = [to_int(row[size], NEVER) if len(row) > size else NEVER for row in rows]
    columns = []
    for i, kind in enumerate(types):
        at = i if order is None else order.index(i) if i in order else None
        default = DEFAULTS[kind]
        if at is None:
            columns.append([default] * len(rows))
        elif kind == "VARCHAR":
            columns.append([row[at] if len(row) > at else default for row in rows])
        else:
            columns.append([to_value(row[at], kind) if len(row) > at else default for row in rows])
    return columns, expiry


#: Literals whose values the cast to a number gives as to_value() does.
PLAIN = {"INT": r"^-?[0-9]{1,18}$", "DATETIME": r"^-?[0-9]{1,18}$", "DECIMAL": r"^-?[0-9]{1,15}(\.[0-9]{1,15})?$"}


def values_of(texts: pa.ChunkedArray, kind: str, default=None) -> pa.Array:
    """A column of literals as values; default where an INT has no number."""
    if kind == "VARCHAR":
        return texts.combine_chunks()
    if pc.all(pc.match_substring_regex(texts, PLAIN[kind])).as_py():
        return texts.cast(ARROW[kind]).combine_chunks()
    if default is not None:
        return pa.array([to_int(t, default) for t in texts.to_pylist()], pa.int64())
    return pa.array([to_value(t, kind) for t in texts.to_pylist()], ARROW[kind])


def batch_of(body: str, compat: bool, types: list[str], order: list[int] | None, number: int) -> list[pa.Array]:
    """The physical columns of a statement's rows but the batch number; they follow those of smaller numbers."""
    found = text_columns(body)
    if found is None:
        columns, expiry = columns_of(value_rows(body, compat), types, order)
        n, arrays, expiry = len(expiry), [pa.array(c, ARROW[k]) for c, k in zip(columns, types)], pa.array(expiry, pa.int64())
    else:
        n, size, arrays = found.num_rows, len(types) if order is None else len(order), []
        for i, kind in enumerate(types):
            at = i if order is None else order.index(i) if i in order else found.num_columns
            arrays.append(values_of(found.column(at), kind) if at < found.num_columns else pa.repeat(pa.scalar(DEFAULTS[kind], ARROW[kind]), n))
        expiry = values_of(found.column(size), "INT", NEVER) if size < found.num_columns else pa.repeat(pa.scalar(NEVER, pa.int64()), n)
    first = number << 32
    return [*arrays, expiry, pa.array(np.arange(first, first + n))]


def insert(catalog: Catalog, table: Table, stmts: list[Insert], compat: bool) -> None:
    """Append the rows of some INSERT statements as one batch; very long ones are read and coerced by tasks."""
    table.managed()
    types = kinds(table)
    orders = [places(table, s, compat) for s in stmts]
    names = [*table.schema.fieldNames(), EXPIRY, POSITION]
    if sum(len(s.body) for s in stmts) <= LONG:

        def part(i: int) -> pa.Table:
            return pa.table(batch_of(stmts[i].body, compat, types, orders[i], i), names=names)

        if len(stmts) == 1:
            catalog.append(table, part(0))
        else:
            with ThreadPoolExecutor(4) as pool:  # Arrow's part of the work runs side by side
                catalog.append(table, pa.concat_tables(pool.map(part, range(len(stmts)))))
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays(batch_of(body, compat, types, orders[number], number), names=names)

    # Rows are dealt over all cores as they come; their order is in their numbers.
    texts = catalog.spark.createDataFrame(pa.table({"number": pa.array(range(len(stmts)), pa.int64()), "body": [s.body for s in stmts]}))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields) + f", {EXPIRY} long, {POSITION} long"
    catalog.append(table, texts.mapInArrow(run, schema))


def load(catalog: Catalog, table: Table, df: DataFrame, stream: tuple[str, int] | None = None) -> None:
    """Append a DataFrame by position under the rules of INSERT, as column expressions; rows keep df's order to the newest-row rule."""
    table.managed()
    source, out = df.schema.fields, []
    for i, (f, kind) in enumerate(zip(table.schema.fields, kinds(table))):
        if i < len(source):
            column = as_kind(F.col(f"`{source[i].name}`"), source[i].dataType, kind)
        else:
            column = F.lit(DEFAULTS[kind]).cast(f.dataType)
        out.append(column.alias(f.name))
    n = len(out)
    expiry: Column = F.lit(NEVER)
    if len(source) > n:
        expiry = F.coalesce(int_column(F.col(f"`{source[n].name}`").cast("string"), NEVER), F.lit(NEVER))
    df = df.select(*out, expiry.cast("long").alias(EXPIRY), F.monotonically_increasing_id().alias(POSITION))
    catalog.append(table, df, stream)


def delete(catalog: Catalog, table: Table, stmt: Delete, compat: bool) -> None:
    """Take away the rows that match, or all; compat takes away all whatever the condition.  Expired rows stay as they are:
    the newest of a key hides the others even so."""
    if stmt.where is None or compat:
        catalog.truncate(table)
        return
    name = stmt.where.column
    found = table.field(name.column) if name.table in (None, table.name) else None
    if found is None:
        raise DialectError(f"Unknown column: {name}")
    catalog.remove(table, predicate(F.col(f"`{found.name}`"), found.dataType, stmt.where.op, stmt.where.literal))
