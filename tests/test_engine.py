"""Statements end to end, on hand-made tables."""

import io
import shutil
from concurrent.futures import ThreadPoolExecutor

import pytest

from quillon.engine import Engine
from quillon.errors import DialectError
from quillon.operators import dml

USERS = """
CREATE TABLE TEST_USERS (ID DECIMAL, NAME VARCHAR(64), BALANCE DECIMAL, EXPIRES_AT DECIMAL);
INSERT INTO TEST_USERS VALUES (1, 'Alice', 1200, 1893456000), (2, 'Bob', 450, 1893456000);
INSERT INTO TEST_USERS VALUES (3, 'Carol', 2200, 1893456000), (4, 'Dave', 800, 1893456000);
CREATE TABLE TEST_ORDERS (ORDER_ID DECIMAL, USER_ID DECIMAL, AMOUNT DECIMAL, EXPIRES_AT DECIMAL);
INSERT INTO TEST_ORDERS VALUES (101, 1, 50, 1893456000), (102, 1, 150, 1893456000), (103, 3, 500, 1893456000);
"""
JOIN = "FROM TEST_USERS INNER JOIN TEST_ORDERS ON TEST_USERS.ID = TEST_ORDERS.USER_ID"


def made(spark, tmp_path, script="", **how):
    e = Engine(spark, str(tmp_path / "db"), **how)
    for r in e.execute(script) if script else []:
        assert r.ok, r.error
    return e


def got(e, sql):
    (r,) = e.execute(sql)
    assert r.ok, r.error
    return [" ".join(row) for row in r.texts()]


@pytest.fixture(scope="module")
def users(spark, tmp_path_factory):
    return made(spark, tmp_path_factory.mktemp("users"), USERS)


@pytest.mark.parametrize(
    "sql,rows",
    [
        ("SELECT NAME, BALANCE FROM TEST_USERS WHERE ID = 2;", ["Bob 450"]),
        ("SELECT NAME FROM TEST_USERS WHERE BALANCE > 1000 ORDER BY NAME;", ["Alice", "Carol"]),
        ("SELECT NAME FROM TEST_USERS ORDER BY BALANCE DESC;", ["Carol", "Alice", "Dave", "Bob"]),
        ("SELECT ID FROM TEST_USERS WHERE BALANCE > 5000;", []),
        (f"SELECT TEST_USERS.NAME, TEST_ORDERS.AMOUNT {JOIN} WHERE TEST_ORDERS.AMOUNT >= 100 ORDER BY TEST_ORDERS.ORDER_ID;", ["Alice 150", "Carol 500"]),
        ("SELECT ORDER_ID FROM TEST_ORDERS WHERE USER_ID = 1 ORDER BY ORDER_ID;", ["101", "102"]),
        (f"SELECT TEST_USERS.NAME, TEST_ORDERS.AMOUNT {JOIN} WHERE TEST_ORDERS.AMOUNT > 900;", []),
        (f"SELECT TEST_USERS.NAME {JOIN} ORDER BY TEST_ORDERS.ORDER_ID DESC;", ["Carol", "Alice", "Alice"]),
    ],
)
def test_golden(users, sql, rows):
    assert got(users, sql) == rows


def test_golden_errors(users):
    a, b = users.execute("SELECT UNKNOWN_COLUMN FROM TEST_USERS;\nSELECT * FROM MISSING_TABLE;")
    assert a.error == "Unknown column: UNKNOWN_COLUMN" and b.error == "No such table: MISSING_TABLE"


@pytest.mark.parametrize("sql", ["SELECT A, * FROM TEST_USERS", f"SELECT TEST_USERS.NOPE {JOIN}", "SELECT NAME FROM TEST_USERS WHERE NOPE = 1", "SELECT NAME FROM TEST_USERS ORDER BY NOPE",
                                 "SELECT TEST_ORDERS.ID FROM TEST_USERS", "SELECT NAME FROM TEST_USERS WHERE BALANCE = abc", "SELECT NAME FROM TEST_USERS INNER JOIN TEST_ORDERS ON ID = NOPE"])
def test_strict_errors(users, sql):
    with pytest.raises(DialectError):
        users.query(sql)


def test_headers(users):
    assert users.query("SELECT * FROM TEST_USERS").columns == ["ID", "NAME", "BALANCE", "EXPIRES_AT"]
    assert users.query("SELECT TEST_USERS.* FROM TEST_USERS").columns == ["ID", "NAME", "BALANCE", "EXPIRES_AT"]
    assert users.query("SELECT TEST_USERS.NAME, NAME FROM TEST_USERS").columns == ["NAME", "NAME"]
    assert users.query(f"SELECT * {JOIN}").columns[:5] == ["TEST_USERS.ID", "TEST_USERS.NAME", "TEST_USERS.BALANCE", "TEST_USERS.EXPIRES_AT", "TEST_ORDERS.ORDER_ID"]


def test_newest_row_of_a_key(spark, tmp_path):
    e = made(spark, tmp_path, "CREATE TABLE T (ID INT PRIMARY KEY, V VARCHAR);\nINSERT INTO T VALUES (1, 'a'), (1, 'b'), (2, 'c');\nSELECT * FROM T;\nINSERT INTO T VALUES (2, 'd');")
    assert got(e, "SELECT V FROM T WHERE ID = 1") == ["b"] and got(e, "SELECT V FROM T WHERE ID = 2") == ["d"]
    assert sorted(got(e, "SELECT V FROM T")) == ["a", "b", "c", "d"]
    e.execute("CREATE TABLE U (K INT);\nINSERT INTO U VALUES (1), (2), (3);")
    assert sorted(got(e, "SELECT U.K, T.V FROM U INNER JOIN T ON U.K = T.ID")) == ["1 b", "2 d"]


def test_undeclared_key(spark, tmp_path):
    script = "CREATE TABLE T (ID INT, V VARCHAR);\nINSERT INTO T VALUES (1, 'a'), (1, 'b');"
    assert sorted(got(made(spark, tmp_path / "s", script), "SELECT V FROM T WHERE ID = 1")) == ["a", "b"]
    assert got(made(spark, tmp_path / "c", script, compat=True), "SELECT V FROM T WHERE ID = 1") == ["b"]


def test_expiry(spark, tmp_path):
    script = "CREATE TABLE T (ID INT PRIMARY KEY, V VARCHAR);\nINSERT INTO T VALUES (1, 'past', 99), (2, 'now', 100), (3, 'future', 101), (4, 'zero', 0), (5, 'never'), (6, 'odd', x), (7, 'old'), (7, 'hides', 99, 5);"
    e = made(spark, tmp_path, script, now=100)
    assert sorted(got(e, "SELECT V FROM T")) == ["future", "never", "now", "odd", "old", "zero"]
    assert got(e, "SELECT V FROM T WHERE ID = 7") == [] and got(e, "SELECT V FROM T WHERE ID = 2") == ["now"]


def test_coercion_on_insert(spark, tmp_path):
    e = made(spark, tmp_path, "CREATE TABLE T (A INT, B DECIMAL, C DATETIME, D VARCHAR(2));\nINSERT INTO T VALUES (12abc, 3.7x, '2024-01-01', NULL), (abc), ('', '', '', 'longer than two');")
    assert sorted(got(e, "SELECT * FROM T")) == ["0 0 0 ", "0 0 0 longer than two", "12 3.7 2024 NULL"]


def test_column_list(spark, tmp_path):
    script = "CREATE TABLE T (A INT, B VARCHAR, C DECIMAL);\nINSERT INTO T (B, A) VALUES (5, 6);"
    assert got(made(spark, tmp_path / "s", script), "SELECT * FROM T") == ["6 5 0"]
    assert got(made(spark, tmp_path / "c", script, compat=True), "SELECT * FROM T") == ["5 6 0"]
    assert not made(spark, tmp_path / "s").execute("INSERT INTO T (NOPE) VALUES (1);")[0].ok


def test_join_across_types(spark, tmp_path):
    e = made(spark, tmp_path, "CREATE TABLE I (X VARCHAR, K INT);\nCREATE TABLE D (X VARCHAR, K DECIMAL);\nCREATE TABLE V (X VARCHAR, K VARCHAR);\nINSERT INTO I VALUES (i, 100000), (j, 5);\nINSERT INTO D VALUES (d, 100000), (e, 5);\nINSERT INTO V VALUES (v, '100000'), (w, '5'), (x, abc);")
    assert sorted(got(e, "SELECT I.X, D.X FROM I INNER JOIN D ON I.K = D.K")) == ["i d", "j e"]
    assert sorted(got(e, "SELECT I.X, V.X FROM I INNER JOIN V ON I.K = V.K")) == ["i v", "j w"]
    assert got(e, "SELECT D.X, V.X FROM D INNER JOIN V ON D.K = V.K") == ["e w"]  # 100000 reads 1e+05


def test_tolerance(spark, tmp_path):
    e = made(spark, tmp_path, "CREATE TABLE T (N VARCHAR, B DECIMAL, I INT);\nINSERT INTO T VALUES (a, 0.05, 7), (b, 0.0500000005, 8), (c, 0.050000002, 9), (d, 1893456000, 1);")
    assert sorted(got(e, "SELECT N FROM T WHERE B = 0.05")) == ["a", "b"] and got(e, "SELECT N FROM T WHERE B = 1893456000") == ["d"]
    assert got(e, "SELECT N FROM T WHERE I = 7.5") == [] and sorted(got(e, "SELECT N FROM T WHERE I > 7.5")) == ["b", "c"]
    assert sorted(got(e, "SELECT N FROM T WHERE I <= 7.5")) == ["a", "d"] and got(e, "SELECT N FROM T WHERE I = 7.0000000001") == ["a"]


def test_pushdown(spark, tmp_path):
    e = made(spark, tmp_path, "CREATE TABLE T (N VARCHAR, B DECIMAL);\nINSERT INTO T VALUES (a, 0.05);")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = e.query("SELECT B FROM T WHERE B = 0.05")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(B" in plan and "LessThanOrEqual(B" in plan and "ReadSchema: struct<B:double,__expiry:bigint>" in plan


def test_order_of_text(spark, tmp_path):
    script = "CREATE TABLE T (V VARCHAR);\nINSERT INTO T VALUES ('9'), ('10'), (abc);"
    assert got(made(spark, tmp_path / "s", script), "SELECT V FROM T ORDER BY V") == ["10", "9", "abc"]
    assert got(made(spark, tmp_path / "c", script, compat=True), "SELECT V FROM T ORDER BY V") == ["9", "10", "abc"]


def test_delete(spark, tmp_path):
    script = "CREATE TABLE T (A INT, B VARCHAR);\nINSERT INTO T VALUES (1, x), (2, y), (3, z);"
    e = made(spark, tmp_path / "s", script)
    before = e.query("SELECT A FROM T")
    assert e.execute("DELETE FROM T WHERE A >= 2;")[0].ok and got(e, "SELECT * FROM T") == ["1 x"]
    assert before.count() == 3  # a DataFrame keeps the version that it listed
    assert not e.execute("DELETE FROM T WHERE NOPE = 1;")[0].ok and not e.execute("DELETE FROM NOPE;")[0].ok
    e.execute("DELETE FROM T;\nINSERT INTO T VALUES (9, q);")
    assert got(e, "SELECT * FROM T") == ["9 q"]
    e.close(older_s=0)
    assert got(e, "SELECT * FROM T") == ["9 q"] and len(list((tmp_path / "s/db/T/data").glob("*"))) == 1
    c = made(spark, tmp_path / "c", script, compat=True)
    c.execute("DELETE FROM T WHERE A = 1;")
    assert got(c, "SELECT * FROM T") == []


def test_compat_unknowns(spark, tmp_path):
    e = made(spark, tmp_path, "CREATE TABLE T (A INT, B INT);\nINSERT INTO T VALUES (1, 1), (2, 2);", compat=True)
    assert len(got(e, "SELECT A FROM T WHERE NOPE = 1")) == 2 and len(got(e, "SELECT A FROM T WHERE U.A = 1")) == 2 and got(e, "SELECT A FROM T WHERE B == 1") == []
    e.execute("CREATE TABLE U (A INT, C INT);\nINSERT INTO U VALUES (1, 7), (2, 8);")
    assert sorted(got(e, "SELECT NOPE, T.A FROM T INNER JOIN U ON T.A = U.A")) == ["NULL 1", "NULL 2"]
    assert sorted(got(e, "SELECT C FROM T INNER JOIN U ON T.A = U.A WHERE A = 2")) == ["8"]


def test_restart(spark, tmp_path):
    script = "CREATE TABLE T (A INT, B DECIMAL PRIMARY KEY, C DATETIME);\nINSERT INTO T VALUES (1, 2, 3);\nCREATE TABLE EMPTY (X VARCHAR(7) NOT NULL);"
    made(spark, tmp_path, script)
    (tmp_path / "db/T/data/0").mkdir()  # a statement that was never committed
    shutil.copy(next((tmp_path / "db/T/data").glob("*/*.parquet")), tmp_path / "db/T/data/0/part-0.parquet")
    e = made(spark, tmp_path, "INSERT INTO T VALUES (5, 2, 6);")
    assert e.catalog.find("T").key == "B" and got(e, "SELECT A FROM T WHERE B = 2") == ["5"] and got(e, "SELECT * FROM EMPTY") == []
    assert e.catalog.find("EMPTY").schema["X"].metadata["length"] == 7
    e.catalog.compact(e.catalog.find("T"))
    assert sorted(got(e, "SELECT A FROM T")) == ["1", "5"] and len(e.catalog.find("T").log.newest().files) == 1
    e.close(older_s=0)
    assert sorted(got(made(spark, tmp_path), "SELECT A FROM T")) == ["1", "5"] and len(list((tmp_path / "db/T/data").glob("*/*.parquet"))) == 1


def test_create_twice(spark, tmp_path):
    e = made(spark, tmp_path, "CREATE TABLE T (A INT);\nINSERT INTO T VALUES (1);\nCREATE TABLE T (B VARCHAR, C INT);")
    assert e.query("SELECT * FROM T").columns == ["A"] and got(e, "SELECT A FROM T") == ["1"]


def test_batch(spark, tmp_path):
    e = made(spark, tmp_path)
    script = "CREATE TABLE A (X INT); CREATE TABLE B (X INT);\nINSERT INTO A VALUES (1);\nINSERT INTO A VALUES (2);\nINSERT INTO B VALUES (3);\nINSERT INTO NOPE VALUES (1);\nBAD;\nINSERT INTO A VALUES (4);\nSELECT X FROM A ORDER BY X;"
    results = e.execute(script)
    assert [r.ok for r in results] == [True] * 5 + [False, False, True, True]
    assert results[5].error == "No such table: NOPE" and results[-1].render() == "COL\tX\nROW\t1\nROW\t2\nROW\t4\nDONE\n"
    assert results[6].render() == "ERR\tUnknown statement: BAD\n" and results[0].render() == "DONE\n"
    assert e.catalog.find("A").log.newest().version == 3  # created; the first two INSERTs were one append


@pytest.mark.parametrize("long", [1 << 20, 64 << 20])
def test_long_statements(spark, tmp_path, monkeypatch, long):
    """Enough text for tasks to read it, or for the driver; one statement is wrong."""
    monkeypatch.setattr(dml, "LONG", long)
    e = made(spark, tmp_path, "CREATE TABLE T (K INT PRIMARY KEY, V VARCHAR, D DECIMAL);")
    pad = "x" * 60
    rows = [", ".join(f"({k}, '{pad}{s}', {k}.5)" for k in range(4000)) for s in range(6)]
    script = "\n".join(f"INSERT INTO T VALUES {r}{' (1)' if s == 3 else ''};" for s, r in enumerate(rows))
    results = e.execute(script)
    assert [r.ok for r in results] == [True, True, True, False, True, True] and "trailing" in results[3].error
    assert e.query("SELECT K FROM T").count() == 20000
    assert got(e, "SELECT V, D FROM T WHERE K = 3999") == [pad + "5 3999.5"]  # the last statement's


@pytest.mark.parametrize("body", [
    "(1, 'a', 2)", " ( 1 ,'a b, (c); d' , 2.5 ) , (3,'',x) ;", "(1, 'a', 2), (3, 'b', 4), (-5, 'c', 1e3)", "(1,2,3),\n(4,5,6)", "(1\n2)", "(1 2)", "(1, , 2)", "(1, 'a'x)", "('a''b')", "()", "(1), (1, 2)",
    "(1, 'a\nb')", "(1, 'ж \"x\" \\\\')", "(0x1f, inf, +3)", "(1, 2", "1, 2)", "(1)(2)", "(1),", "(1);(2)", "(1, 'a)", "(a=b)", "(NULL, NaN, '')", "('x', 'y'), ('z', 'w')", "(9223372036854775808, 99999999999999999999.5, 0.1234567890123456789)",
    "(1, '\0')", "(\ufeff1)", "(1,2,3,4,5), (1,2,3,4,6)", "((1))", "(1, 2)x", "x(1)", "(1,(2))", "(1, 2) (3, 4)", "(\t1\t,\t'\t')", "(12abc, .5, -)",
])
def test_rows_by_column_are_the_parsers(body):
    """Where the quick way reads a text, it reads what the parser does."""
    from quillon.operators.dml import batch_of, columns_of
    from quillon.plans.parser import value_rows
    from quillon.plans.values import text_columns

    found = text_columns(body)
    if found is None:
        return
    rows = value_rows(body, False)
    assert [list(r) for r in zip(*found.to_pydict().values())] == rows
    for order in (None, [1, 0]):
        for types in (["INT", "VARCHAR", "DECIMAL"], ["VARCHAR", "DECIMAL", "DATETIME", "INT"]):
            columns, expiry = columns_of(rows, types, order)
            assert repr([c.to_pylist() for c in batch_of(body, False, types, order, 0)[:-1]]) == repr([*columns, expiry])


def test_quick_rows_are_read_quickly():
    from quillon.plans.values import text_columns

    assert text_columns("(1, 'a', 2), (3, 'b, (c); =', 4);").num_rows == 2 and text_columns("( 1 ,'a' ),\n (2,b)").num_rows == 2


def test_engines_that_share_a_root(spark, tmp_path):
    a = made(spark, tmp_path, "CREATE TABLE T (K INT, V VARCHAR);\nINSERT INTO T VALUES (1, a), (2, b);")
    b = made(spark, tmp_path)
    assert sorted(got(b, "SELECT K FROM T")) == ["1", "2"]
    a.execute("DELETE FROM T WHERE K = 1;")
    assert b.execute("INSERT INTO T VALUES (3, c);\nCREATE TABLE U (X INT);")[0].ok
    for e in (a, b, made(spark, tmp_path)):
        assert sorted(got(e, "SELECT K FROM T")) == ["2", "3"] and got(e, "SELECT X FROM U") == []
    b.execute("DELETE FROM T;")
    a.execute("INSERT INTO T VALUES (4, d);")
    assert got(b, "SELECT * FROM T") == ["4 d"]


def test_many_writers(spark, tmp_path):
    """Eight engines insert, delete and compact at one time; what they wrote is there once."""
    made(spark, tmp_path, "CREATE TABLE T (K INT, V INT);")

    def work(i):
        e = made(spark, tmp_path)
        for j in range(6):
            assert all(r.ok for r in e.execute(f"INSERT INTO T VALUES ({i * 100 + j}, {j}), ({i * 100 + j + 50}, {j});"))
            if i == 3 and j % 2:
                assert e.execute("DELETE FROM T WHERE K = 999999;")[0].ok
        assert e.execute(f"DELETE FROM T WHERE K = {i * 100};")[0].ok
        if i == 5:
            e.catalog.compact(e.catalog.find("T"))

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(work, range(8)))
    expected = sorted(i * 100 + j + d for i in range(8) for j in range(6) for d in (0, 50) if j or d)
    e = made(spark, tmp_path)
    assert sorted(int(k) for k in got(e, "SELECT K FROM T")) == expected
    log = e.catalog.find("T").log
    assert log.versions()[-1] >= 57 and log.newest().version == log.versions()[-1]
    e.close(older_s=0)
    assert sorted(int(k) for k in got(made(spark, tmp_path), "SELECT K FROM T")) == expected and log.versions()[0] > 17


def test_a_commit_in_between(spark, tmp_path, monkeypatch):
    """A DELETE that is overtaken searches what came, and starts over where its files went; an append follows suit."""
    from quillon.sources.log import Log

    a, b = made(spark, tmp_path, "CREATE TABLE T (K INT);\nINSERT INTO T VALUES (1), (2);"), made(spark, tmp_path)
    commit, between = Log.commit, ["INSERT INTO T VALUES (1), (3);", "DELETE FROM T WHERE K = 2;", "INSERT INTO T VALUES (1), (4);"]

    def overtaken(self, *args, **more):
        if between and self is a.catalog.find("T").log:
            b.execute(between.pop())
        return commit(self, *args, **more)

    monkeypatch.setattr(Log, "commit", overtaken)
    assert a.execute("DELETE FROM T WHERE K = 1;")[0].ok and not between
    assert sorted(got(a, "SELECT K FROM T")) == sorted(got(made(spark, tmp_path), "SELECT K FROM T")) == ["3", "4"]
    between.append("INSERT INTO T VALUES (5);")
    a.execute("INSERT INTO T VALUES (6);")
    assert sorted(got(b, "SELECT K FROM T")) == ["3", "4", "5", "6"]


def test_commits_by_rename(tmp_path, spark):
    """On file systems other than the local one a rename decides; viewfs has one for the test."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.logtest.link./in", f"file://{tmp_path}")
    try:
        e = Engine(spark, "viewfs://logtest/in/db")
        f = Engine(spark, "viewfs://logtest/in/db")
        assert e.execute("CREATE TABLE T (K INT);\nINSERT INTO T VALUES (1);")[1].ok and f.execute("INSERT INTO T VALUES (2);")[0].ok
        assert sorted(got(e, "SELECT K FROM T")) == ["1", "2"]
    finally:
        spark._jsc.hadoopConfiguration().unset("fs.viewfs.mounttable.logtest.link./in")


def test_a_delete_writes_only_files_with_matches(spark, tmp_path):
    e = made(spark, tmp_path, "CREATE TABLE T (K INT);\nINSERT INTO T VALUES (1), (2);\nDELETE FROM T WHERE K = 7;\nINSERT INTO T VALUES (3);")
    log = e.catalog.find("T").log
    before = log.newest()
    e.execute("DELETE FROM T WHERE K = 3;")
    assert len(before.files) == 2 and len(before.files & log.newest().files) == 1 and sorted(got(e, "SELECT K FROM T")) == ["1", "2"]


def test_callback(users):
    seen = []
    users.execute("SELECT NAME FROM TEST_USERS ORDER BY NAME", on_row=lambda names, row: seen.append((names, row)) or len(seen) == 2)
    assert seen == [(["NAME"], ["Alice"]), (["NAME"], ["Bob"])]


def test_attached_tables_are_read_only(spark, tmp_path):
    e = made(spark, tmp_path)
    e.attach("X", spark.range(3))
    assert not e.execute("INSERT INTO X VALUES (1);")[0].ok and not e.execute("DELETE FROM X;")[0].ok
    assert got(e, "SELECT ID FROM X WHERE ID >= 2") == ["2"]


def test_stream(spark, tmp_path):
    from quillon.streaming.ingest import stream_into

    spark.range(5).selectExpr("cast(id as string) || 'x' as k", "id / 2 as v").write.json(str(tmp_path / "in"))
    e = made(spark, tmp_path, "CREATE TABLE S (K INT, V DECIMAL);")
    rows = spark.readStream.schema("k string, v double").json(str(tmp_path / "in"))
    for _ in range(2):
        stream_into(e, "s", rows, str(tmp_path / "state")).awaitTermination(60)
    e.load("s", spark.createDataFrame([("9", 9.0)], "k string, v double"), (str(tmp_path / "state"), 0))  # as a repeated micro-batch
    assert sorted(got(e, "SELECT K, V FROM S")) == ["0 0", "1 0.5", "2 1", "3 1.5", "4 2"]


def test_shell(spark, tmp_path, monkeypatch):
    from quillon.__main__ import main

    out = io.StringIO()
    main([str(tmp_path / "db")], lines=["CREATE TABLE T (A INT);\n", "INSERT INTO T\n", "VALUES (1);\n", "SELECT A FROM T;\n", ".exit\n", "BAD;\n"], out=out)
    assert out.getvalue() == "DONE\nDONE\nCOL\tA\nROW\t1\nDONE\n"
