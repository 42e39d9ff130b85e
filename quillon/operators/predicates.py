"""One comparison of a column with a literal, as a Column that Parquet can push down."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import DialectError
from quillon.functions.coerce import literal_double

TOLERANCE = 1e-9
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
REAL = (T.FloatType, T.DoubleType, T.DecimalType)


def compare(column: Column, op: str, value) -> Column:
    if op == "=":
        return column == value
    if op == "<":
        return column < value
    if op == ">":
        return column > value
    if op == "<=":
        return column <= value
    if op == ">=":
        return column >= value
    return F.lit(False)  # parsed in compat only


def whole_number(column: Column, op: str, value: float) -> Column:
    """An integer column against any number, by an integer literal, so that the column is not cast."""
    if math.isnan(value):
        return F.lit(False)
    if math.isinf(value):
        return F.lit({"<": value > 0, "<=": value > 0, ">": value < 0, ">=": value < 0}.get(op, False)) & column.isNotNull()
    nearest = round(value)
    if op == "=":
        return column == F.lit(nearest).cast("bigint") if abs(nearest - value) < TOLERANCE and abs(nearest) < 2**63 else F.lit(False)
    if value == nearest:
        bound = nearest
    elif op in ("<", "<="):
        op, bound = "<=", math.floor(value)
    elif op in (">", ">="):
        op, bound = ">=", math.ceil(value)
    else:
        return F.lit(False)
    if bound >= 2**63 or bound < -(2**63):
        return F.lit((bound > 0) == (op in ("<", "<="))) & column.isNotNull()
    return compare(column, op, F.lit(bound).cast("bigint"))


def predicate(column: Column, kind: T.DataType, op: str, literal: str, exact: bool = False) -> Column:
    """column op literal.  Equality of real numbers has a tolerance unless exact; its bounds are inclusive and reach the
    scan, the difference decides."""
    if isinstance(kind, T.StringType):
        return compare(column, op, F.lit(literal))
    if isinstance(kind, WHOLE):
        return whole_number(column, op, literal_double(literal))
    if isinstance(kind, REAL):
        value = literal_double(literal)
        if op == "=" and not exact:
            return (column >= value - TOLERANCE) & (column <= value + TOLERANCE) & (F.abs(column - F.lit(value)) < TOLERANCE)
        return compare(column, op, F.lit(value))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.BooleanType)):
        return compare(column, op, F.lit(literal).cast(kind))
    raise DialectError(f"No comparison for {kind.simpleString()}")
