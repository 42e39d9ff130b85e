"""The engine: statements in, DataFrames out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import DialectError
from quillon.functions.render import value_text
from quillon.operators import dml
from quillon.operators.select import Planner
from quillon.plans.ast import Create, Delete, Insert, Select, Statement
from quillon.plans.lexer import statements
from quillon.plans.parser import parse
from quillon.sources.catalog import Catalog


@dataclass
class Result:
    """What a statement gave: rows for SELECT, none for others, or an error."""

    rows: DataFrame | None = None
    error: str | None = None

    @property
    def ok(self) -> bool:
        return self.error is None

    @property
    def columns(self) -> list[str]:
        return self.rows.columns if self.rows is not None else []

    def texts(self) -> list[list[str]]:
        """All rows as text; for results small enough for the driver."""
        return [] if self.rows is None else [[value_text(v) for v in row] for row in self.rows.collect()]

    def lines(self) -> Iterator[str]:
        """COL, ROW and DONE lines with tabs, or an ERR line; rows come by partition."""
        if not self.ok:
            yield f"ERR\t{self.error}\n"
            return
        if self.rows is not None:
            if self.columns:
                yield "\t".join(["COL", *self.columns]) + "\n"
            for row in self.rows.toLocalIterator():
                yield "\t".join(["ROW", *map(value_text, row)]) + "\n"
        yield "DONE\n"

    def render(self) -> str:
        """lines() as one text; for results small enough for the driver."""
        return "".join(self.lines())


class Engine:
    """Tables under root, a folder that Spark can write; by default one in the warehouse.

    Strict, the default, takes statements at their word.  compat reproduces what
    is well defined but surprising in the dialect: DELETE empties the table
    whatever its condition, a condition on an unknown column holds, an unknown
    column of a join reads NULL, the first column is a key where none is
    declared, numbers in text columns sort as numbers, and lists of columns in
    INSERT are passed over.  now: the clock in epoch seconds, for tests.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, compat: bool = False, now: int | None = None):
        self.spark, self.compat = spark, compat
        self.catalog = Catalog(spark, root or spark.conf.get("spark.sql.warehouse.dir") + "/quillon")
        self.now = F.unix_timestamp() if now is None else F.lit(now).cast("long")

    def attach(self, name: str, df: DataFrame | Callable[[], DataFrame], **facts) -> None:
        """df, or what the function gives when it is first asked for, as a read-only table; see Catalog.attach()."""
        self.catalog.attach(name, df, **facts)

    def load(self, name: str, df: DataFrame, stream: tuple[str, int] | None = None) -> None:
        """Append df to a table by position, under the rules of INSERT.  stream: see Catalog.append()."""
        dml.load(self.catalog, self.catalog.find(name.upper()), df, stream)

    def newest(self, name: str) -> DataFrame:
        """The newest row of every key of a table, where it hasn't expired."""
        table = self.catalog.find(name.upper())
        rows = table.newest_rows(f"`{table.implicit_key()}`", self.now)
        return rows.select(*[F.col(f"`{f.name}`") for f in table.schema.fields])

    def query(self, sql: str) -> DataFrame:
        """The rows of one SELECT; DialectError where it can't be run."""
        stmt = parse(sql, self.compat)
        if not isinstance(stmt, Select):
            raise DialectError("Expected SELECT")
        return Planner(self.catalog, self.compat, self.now).select(stmt)

    def execute(self, script: str, on_row: Callable[[list[str], list[str]], Any] | None = None) -> list[Result]:
        """Run a script, a result for each statement in order; one that fails doesn't stop the others.

        INSERT statements that follow one another into one table are one append.
        on_row gets the names and texts of every row, streamed by partition, and
        ends the rows of a statement by returning something true.
        """
        results: list[Result] = []
        waiting: list[tuple[int, Insert]] = []
        for sql in statements(script, self.compat) or [""]:
            try:
                stmt = parse(sql, self.compat)
            except DialectError as e:
                self.flush(waiting, results)
                results.append(Result(error=str(e)))
                continue
            if isinstance(stmt, Insert):
                if waiting and waiting[0][1].table != stmt.table:
                    self.flush(waiting, results)
                waiting.append((len(results), stmt))
                results.append(Result())
                continue
            self.flush(waiting, results)
            results.append(self.run(stmt, on_row))
        self.flush(waiting, results)
        return results

    def flush(self, waiting: list[tuple[int, Insert]], results: list[Result]) -> None:
        """Write the INSERT statements that wait, as one append.  Where it fails, those at fault are looked for and left
        out: each of them fails alone."""
        group, waiting[:] = list(waiting), []
        for last in (False, True):
            good = []
            for i, stmt in group:
                try:
                    dml.places(self.catalog.find(stmt.table), stmt, self.compat)
                    if last:
                        stmt.rows  # noqa: B018  raises what is wrong with them
                    good.append((i, stmt))
                except DialectError as e:
                    results[i] = Result(error=str(e))
            if not good:
                return
            table = self.catalog.find(good[0][1].table)
            outcome = self.guarded(lambda: dml.insert(self.catalog, table, [s for _, s in good], self.compat))
            for i, _ in good:
                results[i] = outcome
            if outcome.ok:
                return
            group = good

    def run(self, stmt: Statement, on_row: Callable | None = None) -> Result:
        if isinstance(stmt, Create):
            return self.guarded(lambda: self.catalog.create(stmt.table, stmt.columns))
        if isinstance(stmt, Delete):
            return self.guarded(lambda: dml.delete(self.catalog, self.catalog.find(stmt.table), stmt, self.compat))
        try:
            rows = Planner(self.catalog, self.compat, self.now).select(stmt)
            if on_row is not None:
                for row in rows.toLocalIterator():
                    if on_row(rows.columns, [value_text(v) for v in row]):
                        break
            return Result(rows)
        except (DialectError, PySparkException) as e:
            return Result(error=str(e))

    @staticmethod
    def guarded(work: Callable[[], Any]) -> Result:
        try:
            work()
            return Result()
        except (DialectError, PySparkException) as e:
            return Result(error=str(e))

    def close(self, older_s: int = 3600) -> None:
        """Remove what no table has referred to for so many seconds; DataFrames handed out before a DELETE end with it."""
        self.catalog.vacuum(older_s)
