"""python -m quillon [--compat] [ROOT]: statements from standard input, each up to a semicolon; .exit or \\q ends."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from quillon.engine import Engine


def main(args: list[str], lines=sys.stdin, out=sys.stdout) -> None:
    roots = [a for a in args if not a.startswith("--")]
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    engine = Engine(spark, roots[0] if roots else None, compat="--compat" in args)
    pending = ""
    for line in lines:
        if line.strip() in (".exit", "\\q"):
            break
        pending += line
        if ";" in line:
            for result in engine.execute(pending):
                out.writelines(result.lines())
            pending = ""
    if pending.strip():
        for result in engine.execute(pending):
            out.writelines(result.lines())
    engine.close()


if __name__ == "__main__":
    main(sys.argv[1:])
