"""Values as text.  A number is written in the fewest digits that give it back, fixed or scientific with at least two
digits of exponent, whichever is shorter, fixed where both are as long."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def double_text(value: float) -> str:
    if value != value:
        return "nan"
    if value in (float("inf"), float("-inf")):
        return "inf" if value > 0 else "-inf"
    sign, digits, exponent = Decimal(repr(float(value))).as_tuple()
    lead = "-" if sign else ""
    text = "".join(map(str, digits)).lstrip("0")
    exponent += len(text) - len(text.rstrip("0"))
    text = text.rstrip("0")
    if not text:
        return f"{lead}0"
    point = len(text) + exponent  # digits before the decimal point
    if point >= len(text):
        fixed = text + "0" * (point - len(text))
    elif point > 0:
        fixed = f"{text[:point]}.{text[point:]}"
    else:
        fixed = "0." + "0" * -point + text
    scientific = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{'-' if point < 1 else '+'}{abs(point - 1):02d}"
    return lead + (fixed if len(fixed) <= len(scientific) else scientific)


def value_text(value) -> str:
    if isinstance(value, float):
        return double_text(value)
    return "NULL" if value is None else str(value)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once, however often body has it."""
    return F.transform(F.array(value), body)[0]


def shorter_form(value: Column) -> Column:
    """double_text() of any column: Java's digits, put in the shorter form."""

    def parts(java: Column) -> Column:
        mantissa, power = F.substring_index(java, "E", 1), F.coalesce(F.split_part(java, F.lit("E"), F.lit(2)).try_cast("int"), F.lit(0))
        whole, part = F.split_part(mantissa, F.lit("."), F.lit(1)), F.split_part(mantissa, F.lit("."), F.lit(2))
        led = F.ltrim(F.concat(whole, part), F.lit("0"))
        point = F.length(whole) + power - (F.length(whole) + F.length(part) - F.length(led))
        return F.struct(F.rtrim(led, F.lit("0")).alias("digits"), point.alias("point"))

    def forms(of: Column) -> Column:
        digits, point = of["digits"], of["point"]
        n, size = F.length(digits), F.abs(point - 1).cast("string")
        fixed = (
            F.when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n)))
            .when(point > 0, F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
            .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        )
        scientific = F.concat(
            F.substr(digits, F.lit(1), F.lit(1)),
            F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""),
            F.when(point < 1, "e-").otherwise("e+"),
            F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size),
        )
        return F.struct(fixed.alias("fixed"), scientific.alias("scientific"))

    def shorter(of: Column) -> Column:
        return F.when(F.length(of["fixed"]) <= F.length(of["scientific"]), of["fixed"]).otherwise(of["scientific"])

    text = bound(bound(bound(F.abs(value).cast("string"), parts), forms), shorter)
    sign = F.when((value < 0) | (value.cast("string") == "-0.0"), "-").otherwise("")
    return (
        F.when(F.isnan(value), "nan")
        .when(F.abs(value) == float("inf"), F.concat(sign, F.lit("inf")))
        .when(value == 0, F.concat(sign, F.lit("0")))
        .otherwise(F.concat(sign, text))
    )


def double_column_text(value: Column) -> Column:
    """double_text() of a column.  A number with fewer than five zeros at its end is never longer in fixed form; between
    0.001 and 10^7 that is Java's, and a whole number's is the integer's.  Others go by their digits."""
    size = F.abs(value)
    fixed = (size < 1e5) | (size % 1e5 != 0)
    whole = (value == F.rint(value)) & (value != 0) & (size < float(2**53))
    return (
        F.when(whole & fixed, value.try_cast("bigint").cast("string"))
        .when((value == 0) | ((size >= 1e-3) & (size < 1e7) & fixed), F.rtrim(F.rtrim(value.cast("string"), F.lit("0")), F.lit(".")))
        .otherwise(shorter_form(value))
    )


def column_text(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return double_column_text(value.cast("double"))
    return value.cast("string")
