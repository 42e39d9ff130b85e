"""Literals to values by numeric prefix, never an error: as Python for rows in a statement, as Column for bulk loads."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import DialectError

INTEGER = r"^-?[0-9]+"
REAL = r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_INTEGER, _REAL = re.compile(INTEGER), re.compile(REAL)
_SPECIAL = re.compile(r"^-?(inf|nan)", re.IGNORECASE)
_LEADING = re.compile(r"\s*[+]?")
LEAST, MOST = -(2**63), 2**63 - 1

SPARK_TYPES = {"INT": T.LongType(), "DATETIME": T.LongType(), "DECIMAL": T.DoubleType(), "VARCHAR": T.StringType()}
DEFAULTS = {"INT": 0, "DATETIME": 0, "DECIMAL": 0.0, "VARCHAR": ""}


def to_int(text: str, default: int = 0) -> int:
    """The integer that text begins with; default where there is none or it has more than 64 bits."""
    m = _INTEGER.match(text)
    if not m:
        return default
    value = int(m[0])
    return value if LEAST <= value <= MOST else default


def to_double(text: str) -> float:
    """The number that text begins with; 0 where there is none or it is too large."""
    m = _REAL.match(text)
    if m:
        value = float(m[0])
        return 0.0 if math.isinf(value) else value
    m = _SPECIAL.match(text)
    return float(m[0]) if m else 0.0


def to_value(text: str, kind: str):
    if kind == "VARCHAR":
        return text
    return to_double(text) if kind == "DECIMAL" else to_int(text)


def literal_double(text: str) -> float:
    """A literal compared with a number: the number it begins with, an error where there is none."""
    text = text[_LEADING.match(text).end() :]
    m = _REAL.match(text) or _SPECIAL.match(text)
    if not m:
        raise DialectError(f"Not a number: {text}")
    return float(m[0])


def int_column(text: Column, default: int = 0) -> Column:
    return F.coalesce(F.regexp_extract(text, INTEGER, 0).try_cast("bigint"), F.lit(default).cast("bigint"))


def double_column(text: Column) -> Column:
    value = F.regexp_extract(text, REAL, 0).try_cast("double")
    special = F.regexp_extract(F.lower(text), "^-?(inf|nan)", 0)
    named = F.when(special == "inf", float("inf")).when(special == "-inf", float("-inf")).when(special != "", float("nan"))
    finite = F.when(F.abs(value) == float("inf"), 0.0).otherwise(value)
    return F.coalesce(finite, named, F.lit(0.0))


def as_kind(column: Column, source: T.DataType, kind: str) -> Column:
    """A column of another table as a value of kind; null becomes the default of the kind."""
    if kind == "VARCHAR":
        out = column.cast("string")
    elif isinstance(source, T.StringType):
        return double_column(column) if kind == "DECIMAL" else int_column(column)
    elif kind == "DECIMAL":
        out = column.cast("double")
    elif isinstance(source, T.TimestampNTZType):
        out = F.unix_seconds(column.cast("timestamp"))
    elif isinstance(source, (T.TimestampType,)):
        out = F.unix_seconds(column)
    elif isinstance(source, T.DateType):
        out = F.unix_seconds(column.cast("timestamp"))
    elif isinstance(source, (T.DoubleType, T.FloatType, T.DecimalType)):
        out = column.try_cast("bigint")
    else:
        out = column.cast("bigint")
    return F.coalesce(out, F.lit(DEFAULTS[kind]).cast(SPARK_TYPES[kind]))
