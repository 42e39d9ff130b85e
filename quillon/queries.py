"""Registered queries of the engine, a statement or two each, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.engine import Engine
from quillon.functions.render import column_text

KEYS = {"CUSTOMER": "c_custkey", "ORDERS": "o_orderkey", "PART": "p_partkey", "SUPPLIER": "s_suppkey", "NATION": "n_nationkey", "REGION": "r_regionkey"}
TABLES = ("REGION", "NATION", "CUSTOMER", "SUPPLIER", "PART", "ORDERS", "LINEITEM", "EVENTS")
NOW = 1704672000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name.lower()}.parquet")


def engine(spark: SparkSession, sf_dir: str, compat: bool = False, now: int | None = None) -> Engine:
    """An engine of its own folder, with the tables attached; their files are opened when a statement names them."""
    out = Engine(spark, f"{spark.conf.get('spark.sql.warehouse.dir')}/quillon-{uuid.uuid4().hex}", compat, now)
    for name in TABLES:
        facts = {"key": "user_id", "newest": ("event_id",)} if name == "EVENTS" else {"key": KEYS.get(name)}
        out.attach(name, partial(table, spark, sf_dir, name), **facts)
    return out


def asked(sql: str, compat: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir, compat).query(sql)


def done(e: Engine, script: str) -> None:
    for result in e.execute(script):
        if not result.ok:
            raise RuntimeError(result.error)
    e.catalog.files().deleteOnExit(e.catalog.path())  # the folder is this query's alone


def join_text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.attach("TEXTS", table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), "c_name"))
    return e.query("SELECT ORDERS.O_ORDERKEY, TEXTS.C_NAME FROM ORDERS INNER JOIN TEXTS ON ORDERS.O_CUSTKEY = TEXTS.K")


def join_where_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.attach("OTHER", table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"))
    return e.query(
        "SELECT CUSTOMER.C_NAME, OTHER.C_CUSTKEY FROM CUSTOMER INNER JOIN OTHER ON CUSTOMER.C_CUSTKEY = OTHER.C_CUSTKEY WHERE C_ACCTBAL > 5000"
    )


def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).newest("EVENTS").select("USER_ID", "EVENT_ID", "EVENT_TYPE", "VALUE")


def insert_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    done(e, "CREATE TABLE T (K INT PRIMARY KEY, P INT, D DECIMAL(10,2), W DATETIME, V VARCHAR(8), M INT);")
    texts = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("k"),
        "o_orderpriority",
        F.concat(F.col("o_orderkey").cast("string"), F.lit(".5x")).alias("d"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("w"),
        "o_orderstatus",
    )
    e.load("T", texts)
    return e.query("SELECT * FROM T")


def insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as a statement's text: 25 in any scale of the tables."""
    e = engine(spark, sf_dir)
    rows = ", ".join(f"({r[0]}, '{r[1]}', {r[2]})" for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").limit(25).collect())
    done(e, f"CREATE TABLE N (K INT, NAME VARCHAR(25), R DECIMAL);\nINSERT INTO N VALUES {rows};\nINSERT INTO N (R, NAME) VALUES (12abc, '12abc'), (abc);")
    return e.query("SELECT K, NAME, R FROM N")


def insert_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    done(e, "CREATE TABLE C (K INT, NAME VARCHAR, N INT, BALANCE DECIMAL, SEGMENT VARCHAR);")
    e.load("C", table(spark, sf_dir, "customer"))
    e.load("C", table(spark, sf_dir, "customer").where("c_nationkey = 7"))
    return e.query("SELECT * FROM C")


def delete_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    done(e, "CREATE TABLE N (K INT, NAME VARCHAR, R INT);")
    e.load("N", table(spark, sf_dir, "nation"))
    done(e, "DELETE FROM N;")
    return e.query("SELECT * FROM N")


def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    done(e, "CREATE TABLE C (K INT, NAME VARCHAR, N INT, BALANCE DECIMAL, SEGMENT VARCHAR);")
    e.load("C", table(spark, sf_dir, "customer"))
    done(e, "DELETE FROM C WHERE BALANCE < 1000;")
    return e.query("SELECT K, BALANCE FROM C")


def ttl_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that expire some seconds before and after now, at it, or never."""
    e = engine(spark, sf_dir, now=NOW)
    done(e, "CREATE TABLE E (K INT, V DECIMAL);")
    expiry = F.when(F.col("event_id") % 5 == 0, -1).otherwise(NOW + F.col("event_id") % 21 - 10)
    e.load("E", table(spark, sf_dir, "events").select("event_id", "value", expiry.alias("expiry")))
    return e.query("SELECT K, V FROM E")


def ttl_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each key, unless it has expired: older ones don't come back."""
    e = engine(spark, sf_dir, now=NOW)
    done(e, "CREATE TABLE E (K INT PRIMARY KEY, N INT, V DECIMAL);")
    expiry = F.when(F.col("event_id") % 5 == 0, -1).otherwise(NOW + F.col("event_id") % 21 - 10)
    e.load("E", table(spark, sf_dir, "events").orderBy("event_id").select("user_id", "event_id", "value", expiry.alias("expiry")))
    return e.newest("E")


def join_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).query("SELECT NATION.N_NATIONKEY, N_NAME FROM NATION INNER JOIN NATION ON NATION.N_REGIONKEY = NATION.N_NATIONKEY")


def join_numeric_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INT with DECIMAL."""
    e = engine(spark, sf_dir)
    e.attach("REALS", table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("double").alias("k"), "c_name"))
    return e.query("SELECT ORDERS.O_ORDERKEY, REALS.C_NAME FROM ORDERS INNER JOIN REALS ON ORDERS.O_CUSTKEY = REALS.K")


def join_real_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DECIMAL with VARCHAR: the number's text decides.  Numbers and texts are both of the balance to two decimals, which
    has no -0 (a double has, and "-0" is its text)."""
    e = engine(spark, sf_dir)
    customers, balance = table(spark, sf_dir, "customer"), F.col("c_acctbal").cast("decimal(12,2)")
    e.attach("CUSTOMER", customers.withColumn("c_acctbal", balance.cast("double")), key=KEYS["CUSTOMER"])
    e.attach("TEXTS", customers.select("c_custkey", F.regexp_replace(balance.cast("string"), r"\.?0+$", "").alias("k")))
    return e.query("SELECT CUSTOMER.C_CUSTKEY, TEXTS.C_CUSTKEY, TEXTS.K FROM CUSTOMER INNER JOIN TEXTS ON CUSTOMER.C_ACCTBAL = TEXTS.K")


def values_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as the text protocol writes them."""
    found = engine(spark, sf_dir).query("SELECT L_ORDERKEY, L_LINENUMBER, L_QUANTITY, L_DISCOUNT FROM LINEITEM")
    return found.select(*[column_text(F.col(f.name), f.dataType).alias(f.name) for f in found.schema.fields])


def positions(df: DataFrame, column: str) -> DataFrame:
    """The places of a sorted result's rows, and the column it is sorted by."""
    place = F.row_number().over(Window.orderBy("at")).cast("long").alias("PLACE")
    return df.select(F.col(f"`{column}`").alias("SORTED"), F.monotonically_increasing_id().alias("at")).select(place, "SORTED")


def placed(sql: str, column: str, compat: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: positions(engine(spark, sf_dir, compat).query(sql), column)


def order_text_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, compat=True)
    e.attach("TEXTS", table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("k")))
    return positions(e.query("SELECT K FROM TEXTS ORDER BY K"), "K")


def reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second engine on the root finds the tables, their keys and their rows."""
    e = engine(spark, sf_dir)
    done(e, "CREATE TABLE C (K INT PRIMARY KEY, NAME VARCHAR, N INT, BALANCE DECIMAL, SEGMENT VARCHAR);")
    e.load("C", table(spark, sf_dir, "customer"))
    e.load("C", table(spark, sf_dir, "customer").where("c_nationkey = 7").withColumn("c_name", F.lit("again")))
    return Engine(spark, e.catalog.root).newest("C")


def two_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engines that share a root take turns, and then append at one time: no statement is lost, and none counts twice."""
    a = engine(spark, sf_dir)
    done(a, "CREATE TABLE C (K INT, NAME VARCHAR, N INT, BALANCE DECIMAL, SEGMENT VARCHAR);")
    b, customers = Engine(spark, a.catalog.root), table(spark, sf_dir, "customer")
    a.load("C", customers)
    b.load("C", customers.where("c_nationkey = 3"))
    done(a, "DELETE FROM C WHERE N = 7;")
    done(b, "INSERT INTO C VALUES (-1, 'b', 7, 1.5, x);\nDELETE FROM C WHERE BALANCE < 0;")
    done(a, "INSERT INTO C VALUES (-2, 'a', 7, 2.5, y);")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: Engine(spark, a.catalog.root).load("C", customers.where(f"c_nationkey = {i}")), range(10, 14)))
    return a.query("SELECT * FROM C")


ON_CUSTOMER = "INNER JOIN CUSTOMER ON ORDERS.O_CUSTKEY = CUSTOMER.C_CUSTKEY"
JOINED = "from orders join customer on o_custkey = c_custkey"
OPS = {"eq": "=", "lt": "<", "gt": ">", "le": "<=", "ge": ">="}
STAR = {
    "ORDERS": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "CUSTOMER": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flagship": asked("SELECT C_NAME, C_ACCTBAL FROM CUSTOMER WHERE C_ACCTBAL > 5000 ORDER BY C_ACCTBAL DESC"),
    "scan_star": asked("SELECT * FROM REGION"),
    "project_columns": asked("SELECT N_NAME, N_REGIONKEY FROM NATION"),
    **{f"filter_num_{k}": asked(f"SELECT C_CUSTKEY FROM CUSTOMER WHERE C_NATIONKEY {op} 7") for k, op in OPS.items()},
    **{f"filter_str_{k}": asked(f"SELECT C_CUSTKEY FROM CUSTOMER WHERE C_MKTSEGMENT {op} 'BUILDING'") for k, op in OPS.items()},
    "filter_tolerance_eq": asked("SELECT L_ORDERKEY, L_LINENUMBER FROM LINEITEM WHERE L_DISCOUNT = 0.05"),
    "filter_datetime": asked("SELECT O_ORDERKEY FROM ORDERS WHERE O_ORDERDATE >= '1996-01-01'"),
    "filter_unknown_compat": asked("SELECT C_CUSTKEY FROM CUSTOMER WHERE NOPE = 1", compat=True),
    "pk_lookup": asked("SELECT * FROM CUSTOMER WHERE C_CUSTKEY = 42"),
    "pk_newest": asked("SELECT EVENT_ID, USER_ID, VALUE FROM EVENTS WHERE USER_ID = 7"),
    "inner_join_project": asked(f"SELECT ORDERS.O_ORDERKEY, CUSTOMER.C_NAME FROM ORDERS {ON_CUSTOMER} WHERE ORDERS.O_TOTALPRICE >= 100000"),
    "inner_join_star": asked(f"SELECT * FROM ORDERS {ON_CUSTOMER}"),
    "join_on_swapped": asked("SELECT ORDERS.O_ORDERKEY, C_NAME FROM ORDERS INNER JOIN CUSTOMER ON CUSTOMER.C_CUSTKEY = ORDERS.O_CUSTKEY"),
    "join_many": asked("SELECT CUSTOMER.C_CUSTKEY, SUPPLIER.S_SUPPKEY FROM CUSTOMER INNER JOIN SUPPLIER ON CUSTOMER.C_NATIONKEY = SUPPLIER.S_NATIONKEY WHERE SUPPLIER.S_ACCTBAL > 9000"),
    "join_where_right": asked(f"SELECT ORDERS.O_ORDERKEY, CUSTOMER.C_ACCTBAL FROM ORDERS {ON_CUSTOMER} WHERE CUSTOMER.C_ACCTBAL > 5000"),
    "join_where_both": join_where_both,
    "join_text_keys": join_text_keys,
    "join_unknown_col_compat": asked(f"SELECT ORDERS.O_ORDERKEY, NOPE FROM ORDERS {ON_CUSTOMER}", compat=True),
    "join_pk_last_match": asked("SELECT CUSTOMER.C_CUSTKEY, EVENTS.EVENT_ID, EVENTS.VALUE FROM CUSTOMER INNER JOIN EVENTS ON CUSTOMER.C_CUSTKEY = EVENTS.USER_ID"),
    "last_write_wins": last_write_wins,
    "insert_coerce": insert_coerce,
    "insert_values": insert_values,
    "insert_append": insert_append,
    "delete_all": delete_all,
    "delete_where": delete_where,
    "ttl_visible": ttl_visible,
    "ttl_newest": ttl_newest,
    "table_star": asked("SELECT NATION.* FROM NATION"),
    "filter_literal_prefix": asked("SELECT C_CUSTKEY, C_ACCTBAL FROM CUSTOMER WHERE C_ACCTBAL > '+5000.5abc'"),
    "filter_int_real": asked("SELECT C_CUSTKEY FROM CUSTOMER WHERE C_NATIONKEY > 7.5"),
    "pk_lookup_prefix": asked("SELECT C_CUSTKEY, C_NAME FROM CUSTOMER WHERE C_CUSTKEY = '42abc'"),
    "join_self": join_self,
    "join_numeric_keys": join_numeric_keys,
    "join_real_texts": join_real_texts,
    "values_as_text": values_as_text,
    "reopened": reopened,
    "two_engines": two_engines,
    "order_places_asc": placed("SELECT C_CUSTKEY, C_ACCTBAL FROM CUSTOMER ORDER BY C_ACCTBAL", "C_ACCTBAL"),
    "order_places_desc": placed("SELECT C_CUSTKEY, C_ACCTBAL FROM CUSTOMER ORDER BY C_ACCTBAL DESC", "C_ACCTBAL"),
    "order_places_join": placed(f"SELECT ORDERS.O_ORDERKEY, CUSTOMER.C_NAME FROM ORDERS {ON_CUSTOMER} ORDER BY ORDERS.O_ORDERKEY DESC", "ORDERS.O_ORDERKEY"),
    "order_text_compat": order_text_compat,
    "order_by_asc": asked("SELECT C_CUSTKEY, C_ACCTBAL FROM CUSTOMER ORDER BY C_ACCTBAL"),
    "order_by_desc": asked("SELECT C_CUSTKEY, C_ACCTBAL FROM CUSTOMER ORDER BY C_ACCTBAL DESC"),
    "order_by_hidden": asked("SELECT C_CUSTKEY FROM CUSTOMER ORDER BY C_ACCTBAL"),
    "order_after_join": asked(f"SELECT ORDERS.O_ORDERKEY, CUSTOMER.C_NAME FROM ORDERS {ON_CUSTOMER} WHERE ORDERS.O_TOTALPRICE >= 100000 ORDER BY ORDERS.O_ORDERKEY"),
}

CUSTOMER_ROWS = 'c_custkey::bigint as "K", c_name as "NAME", c_nationkey::bigint as "N", c_acctbal as "BALANCE", c_mktsegment as "SEGMENT"'

ORACLE_SQL: dict[str, str] = {
    "flagship": 'select c_name as "C_NAME", c_acctbal as "C_ACCTBAL" from customer where c_acctbal > 5000',
    "scan_star": 'select r_regionkey as "R_REGIONKEY", r_name as "R_NAME" from region',
    "project_columns": 'select n_name as "N_NAME", n_regionkey as "N_REGIONKEY" from nation',
    **{f"filter_num_{k}": f'select c_custkey as "C_CUSTKEY" from customer where c_nationkey {op} 7' for k, op in OPS.items()},
    **{f"filter_str_{k}": f"select c_custkey as \"C_CUSTKEY\" from customer where c_mktsegment {op} 'BUILDING'" for k, op in OPS.items()},
    "filter_tolerance_eq": 'select l_orderkey as "L_ORDERKEY", l_linenumber as "L_LINENUMBER" from lineitem where abs(l_discount - 0.05) < 1e-9',
    "filter_datetime": "select o_orderkey as \"O_ORDERKEY\" from orders where o_orderdate >= timestamp '1996-01-01'",
    "filter_unknown_compat": 'select c_custkey as "C_CUSTKEY" from customer',
    "pk_lookup": 'select c_custkey as "C_CUSTKEY", c_name as "C_NAME", c_nationkey as "C_NATIONKEY", c_acctbal as "C_ACCTBAL", c_mktsegment as "C_MKTSEGMENT" from customer where c_custkey = 42',
    "pk_newest": 'select event_id as "EVENT_ID", user_id as "USER_ID", value as "VALUE" from events where user_id = 7 order by event_id desc limit 1',
    "inner_join_project": f'select o_orderkey as "O_ORDERKEY", c_name as "C_NAME" {JOINED} where o_totalprice >= 100000'.replace('"O_ORDERKEY"', '"ORDERS.O_ORDERKEY"').replace('"C_NAME"', '"CUSTOMER.C_NAME"'),
    "inner_join_star": "select " + ", ".join(f'{c} as "{t}.{c.upper()}"' for t, columns in STAR.items() for c in columns) + f" {JOINED}",
    "join_on_swapped": f'select o_orderkey as "ORDERS.O_ORDERKEY", c_name as "C_NAME" {JOINED}',
    "join_many": 'select c_custkey as "CUSTOMER.C_CUSTKEY", s_suppkey as "SUPPLIER.S_SUPPKEY" from customer join supplier on c_nationkey = s_nationkey where s_acctbal > 9000',
    "join_where_right": f'select o_orderkey as "ORDERS.O_ORDERKEY", c_acctbal as "CUSTOMER.C_ACCTBAL" {JOINED} where c_acctbal > 5000',
    "join_where_both": 'select a.c_name as "CUSTOMER.C_NAME", b.c_custkey as "OTHER.C_CUSTKEY" from customer a join customer b on a.c_custkey = b.c_custkey where a.c_acctbal > 5000 and b.c_acctbal > 5000',
    "join_text_keys": 'select o_orderkey as "ORDERS.O_ORDERKEY", c_name as "TEXTS.C_NAME" from orders join customer on o_custkey::varchar = c_custkey::varchar',
    "join_unknown_col_compat": f"select o_orderkey as \"ORDERS.O_ORDERKEY\", 'NULL' as \"NOPE\" {JOINED}",
    "join_pk_last_match": 'select c_custkey as "CUSTOMER.C_CUSTKEY", event_id as "EVENTS.EVENT_ID", value as "EVENTS.VALUE" from customer join (select * from events qualify row_number() over (partition by user_id order by event_id desc) = 1) on c_custkey = user_id',
    "last_write_wins": 'select user_id as "USER_ID", event_id as "EVENT_ID", event_type as "EVENT_TYPE", value as "VALUE" from events qualify row_number() over (partition by user_id order by event_id desc) = 1',
    "insert_coerce": """select o_orderkey::bigint as "K", coalesce(try_cast(regexp_extract(o_orderpriority, '^-?[0-9]+') as bigint), 0) as "P",
        o_orderkey + 0.5::double as "D", year(o_orderdate)::bigint as "W", o_orderstatus as "V", 0::bigint as "M" from orders""",
    "insert_values": """select n_nationkey::bigint as "K", n_name as "NAME", n_regionkey::double as "R" from nation
        union all select 0::bigint, '12abc', 12::double union all select 0::bigint, '', 0::double""",
    "insert_append": f"select {CUSTOMER_ROWS} from customer union all select {CUSTOMER_ROWS} from customer where c_nationkey = 7",
    "delete_all": 'select n_nationkey::bigint as "K", n_name as "NAME", n_regionkey::bigint as "R" from nation where false',
    "delete_where": 'select c_custkey::bigint as "K", c_acctbal as "BALANCE" from customer where not c_acctbal < 1000',
    "ttl_visible": f'select event_id::bigint as "K", value as "V" from events where event_id % 5 = 0 or {NOW} + event_id % 21 - 10 >= {NOW}',
    "ttl_newest": f"""select user_id::bigint as "K", event_id::bigint as "N", value as "V" from (select * from events qualify row_number() over (partition by user_id order by event_id desc) = 1)
        where event_id % 5 = 0 or {NOW} + event_id % 21 - 10 >= {NOW}""",
    "table_star": 'select n_nationkey as "N_NATIONKEY", n_name as "N_NAME", n_regionkey as "N_REGIONKEY" from nation',
    "filter_literal_prefix": 'select c_custkey as "C_CUSTKEY", c_acctbal as "C_ACCTBAL" from customer where c_acctbal > 5000.5',
    "filter_int_real": 'select c_custkey as "C_CUSTKEY" from customer where c_nationkey > 7.5',
    "pk_lookup_prefix": 'select c_custkey as "C_CUSTKEY", c_name as "C_NAME" from customer where c_custkey = 42',
    "join_self": 'select a.n_nationkey as "NATION.N_NATIONKEY", a.n_name as "N_NAME" from nation a join nation b on a.n_regionkey = b.n_nationkey',
    "join_numeric_keys": 'select o_orderkey as "ORDERS.O_ORDERKEY", c_name as "REALS.C_NAME" from orders join customer on o_custkey = c_custkey',
    "join_real_texts": """select a.c_custkey as "CUSTOMER.C_CUSTKEY", b.c_custkey as "TEXTS.C_CUSTKEY", regexp_replace(b.c_acctbal::decimal(12,2)::varchar, '\\.?0+$', '') as "TEXTS.K"
        from customer a join customer b on a.c_acctbal::decimal(12,2) = b.c_acctbal::decimal(12,2)""",
    "values_as_text": """select l_orderkey::varchar as "L_ORDERKEY", l_linenumber::varchar as "L_LINENUMBER", regexp_replace(l_quantity::double::varchar, '\\.0$', '') as "L_QUANTITY",
        regexp_replace(l_discount::double::varchar, '\\.0$', '') as "L_DISCOUNT" from lineitem""",
    "reopened": f"select {CUSTOMER_ROWS} from (select * replace (case when c_nationkey = 7 then 'again' else c_name end as c_name) from customer)",
    "two_engines": f"""select {CUSTOMER_ROWS} from (select * from customer union all select * from customer where c_nationkey = 3) where c_nationkey <> 7 and c_acctbal >= 0
        union all select -1::bigint, 'b', 7::bigint, 1.5::double, 'x' union all select -2::bigint, 'a', 7::bigint, 2.5::double, 'y'
        union all select {CUSTOMER_ROWS} from customer where c_nationkey between 10 and 13""",
    "order_places_asc": 'select row_number() over (order by c_acctbal) as "PLACE", c_acctbal as "SORTED" from customer',
    "order_places_desc": 'select row_number() over (order by c_acctbal desc) as "PLACE", c_acctbal as "SORTED" from customer',
    "order_places_join": f'select row_number() over (order by o_orderkey desc) as "PLACE", o_orderkey as "SORTED" {JOINED}',
    "order_text_compat": 'select row_number() over (order by c_nationkey) as "PLACE", c_nationkey::varchar as "SORTED" from customer',
    "order_by_asc": 'select c_custkey as "C_CUSTKEY", c_acctbal as "C_ACCTBAL" from customer',
    "order_by_desc": 'select c_custkey as "C_CUSTKEY", c_acctbal as "C_ACCTBAL" from customer',
    "order_by_hidden": 'select c_custkey as "C_CUSTKEY" from customer',
    "order_after_join": f'select o_orderkey as "ORDERS.O_ORDERKEY", c_name as "CUSTOMER.C_NAME" {JOINED} where o_totalprice >= 100000',
}
