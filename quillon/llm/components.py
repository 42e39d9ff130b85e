"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import staged

SALTS = 16


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """df joined with table, whose key is unique, on key; rows of df that share a key go to salts tasks.

    table's columns but its key are added; it is sent salts times over, so it
    should be the slimmer side.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts)))
    spread = table.withColumnRenamed(table_key, "__key").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    # Spark's estimate of the side's size doesn't see the salts.
    spread = spread.withColumnRenamed("__salt", "__other").hint("merge")
    return salted.join(spread, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__other")), how).drop("__salt", "__key", "__other")


def components(edges: DataFrame) -> DataFrame:
    """node, label for the nodes of edges (a, b), both long; nodes have equal labels where edges connect them.

    Each round, every node points to its smallest neighbour or itself, and to
    where that one points; edges between different targets go on.  Nodes should
    be hashes: in a random order a round leaves a fraction of the nodes, in a
    sorted path only half.  Every round is written to the shared folder.
    """
    edges = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while labels is None or edges.take(1):
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionAll(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        nearest = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to"))
        onward = nearest.select(F.col("node").alias("via"), F.col("to").alias("label"))
        step = staged(lookup(nearest, "to", onward, "via").select("node", "label"), "step")
        first = lookup(edges, "a", step.withColumnRenamed("label", "la"), "node")
        moved = lookup(first, "b", step.withColumnRenamed("label", "lb"), "node").where("la <> lb")
        edges = staged(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        if labels is None:
            labels = step
        else:
            met = lookup(labels, "label", step.withColumnRenamed("label", "next"), "node", "left")
            labels = met.select("node", F.coalesce("next", "label").alias("label"))
    return staged(labels, "labels")
