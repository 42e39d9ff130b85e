"""Lexer, parser, coercion and text of values: no session but for the Column twins."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.errors import DialectError
from quillon.functions.coerce import double_column, int_column, literal_double, to_double, to_int
from quillon.functions.render import double_column_text, double_text
from quillon.plans.ast import Name, Select
from quillon.plans.lexer import statements, tokens
from quillon.plans.parser import parse

LITERALS = ["12abc", "abc", "+5", "3.7", "-8x", "9" * 20, "2024-01-01", "", "-", "1e400", "1e3", ".5", "-.5e2x", "inf", "-NaN", "9223372036854775807", "9223372036854775808", "1.", "1.e2"]


def test_tokens():
    assert [t.text for t in tokens("select a.b,'x; y' from t where c>=.5;")] == ["select", "a.b", ",", "x; y", "from", "t", "where", "c", ">=", ".5", ";"]
    assert [t.kind for t in tokens("')' )")] == ["text", "mark"]


def test_statements():
    assert statements("A 1; B 2;\nC\n3;\n\nD") == ["A 1;", "B 2;", "C\n3;", "D"]
    assert statements("A 'x;y' 1;") == ["A 'x;y' 1;"]
    assert statements("A 1; B 2;\nC", compat=True) == ["A 1; B 2;", "C"]
    assert statements("") == [] and statements(";\n ;") == []


def test_select_parts():
    s = parse("select t.a, b from t inner join u on t.a = u.b where u.c >= 'x' order by b desc;")
    assert isinstance(s, Select)
    assert s.columns == (Name("A", "T"), Name("B")) and s.join.table == "U"
    assert (s.where.column, s.where.op, s.where.literal) == (Name("C", "U"), ">=", "x") and s.order.descending


def test_create_parts():
    s = parse("CREATE TABLE IF NOT EXISTS T (A INT NOT NULL, B DECIMAL(10,2), C VARCHAR(9), D BLOB, PRIMARY KEY (B))")
    assert [(c.name, c.kind, c.length, c.key, c.not_null) for c in s.columns] == [
        ("A", "INT", None, False, True), ("B", "DECIMAL", None, True, False), ("C", "VARCHAR", 9, False, False), ("D", "VARCHAR", 255, False, False),
    ]


@pytest.mark.parametrize(
    "sql,message",
    [
        ("", "Empty statement"), ("UPDATE T", "Unknown statement: UPDATE"), ("SELECT A FROM T x", "trailing characters: x"), ("CREATE T", "Expected TABLE"),
        ("SELECT A FROM T LEFT JOIN U", "trailing characters: LEFT"), ("SELECT A FROM T WHERE A", "Expected operator"), ("SELECT A FROM T WHERE A =", "Expected value"),
        ("SELECT FROM T", "Expected column"), ("SELECT A FROM T ORDER A", "Expected BY after ORDER"), ("SELECT A FROM T WHERE A == 1", "Expected operator"),
        ("INSERT INTO T (1)", "Expected VALUES"), ("INSERT INTO T VALUES (1 2)", "Expected )"), ("INSERT INTO T VALUES (1", "Expected )"), ("DELETE T", "Expected FROM"),
        ("SELECT A FROM T WHERE A <> 1", "Expected value"), ("CREATE TABLE T (A INT, A INT)", "Duplicate"), ("SELECT 'x", "without a closing quote"),
    ],
)
def test_errors(sql, message):
    with pytest.raises(DialectError, match=message.replace("(", r"\(").replace(")", r"\)")):
        parse(sql)


def test_rows_of_values():
    assert parse("insert into t (a, b) values ('x, (y);', -1.5),( 2 ,''),()  ;").rows == [["x, (y);", "-1.5"], ["2", ""], []]
    for bad in ("(1),", "(1) (2)", "1", "(1,,2)", "((1))", "(1); (2)", "(1 = 2)", "('x)", ""):
        with pytest.raises(DialectError):
            parse(f"INSERT INTO T VALUES {bad}")


def test_compat_parses_more():
    assert parse("INSERT INTO T VALUES (1 2)", compat=True).rows == [["1", "2"]]
    assert parse("SELECT A FROM T WHERE A == 1", compat=True).where.op == "=="


def test_coercion():
    assert [to_int(x) for x in LITERALS[:8]] == [12, 0, 0, 3, -8, 0, 2024, 0]
    assert [to_double(x) for x in ("12abc", "abc", "+5", "3.7x", "1e3", "1e400", ".5")] == [12, 0, 0, 3.7, 1000, 0, 0.5]
    assert to_int("", -1) == -1 and literal_double(" +2.5x") == 2.5
    with pytest.raises(DialectError):
        literal_double("abc")


def test_coercion_columns(spark):
    rows = spark.createDataFrame([(x,) for x in LITERALS], "x string").select("x", int_column(F.col("x")).alias("i"), double_column(F.col("x")).alias("d")).collect()
    for r in rows:
        assert r["i"] == to_int(r["x"]), r
        assert r["d"] == to_double(r["x"]) or (math.isnan(r["d"]) and math.isnan(to_double(r["x"]))), r


@pytest.mark.parametrize("value,text", [(1200.0, "1200"), (100000.0, "1e+05"), (0.0001, "1e-04"), (1893456000.0, "1893456000"), (0.05, "0.05"), (-2.5, "-2.5"), (0.0, "0"), (1e100, "1e+100"), (123456.0, "123456")])
def test_double_text(value, text):
    assert double_text(value) == text


@settings(max_examples=300)
@given(st.floats(allow_nan=False))
def test_double_text_is_exact(x):
    assert float(double_text(x)) == x


def test_double_text_column(spark):
    values = [1200.0, 1e5, 1e-4, 1893456000.0, 0.05, -2.5, 0.0, -0.0, 1e100, 123456.0, 1.5e-9, 12345678.9, 0.001, 1e7, 9999999.0, float("inf"), float("-inf"), float("nan"), 3.0e-5, 1 / 3]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", double_column_text(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in rows] == [double_text(v) for v in values]


def test_double_text_column_compiles(spark):
    """Text of many rows by compiled code, at the limits of each form."""
    limits = [1e-3, 9.99e-4, 99999.0, 1e5, 100000.5, 1.1e6, 1e6, 9999999.99, 1e7, 1.5e7, 2.0**53, 2.0**53 - 1, 1e15, -0.0, float("nan"), float("-inf"), None]
    signed = F.array(*[F.lit(v).cast("double") for v in limits])
    values = spark.range(4000).select(F.when(F.col("id") < len(limits), F.try_element_at(signed, (F.col("id") + 1).cast("int"))).otherwise((F.col("id") - 2000) / 100).alias("v"))
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        rows = values.select("v", double_column_text(F.col("v")).alias("t")).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert len(rows) == 4000 and rows[len(limits) - 1]["t"] is None
    assert all(r["t"] == double_text(r["v"]) for r in rows if r["v"] is not None)
