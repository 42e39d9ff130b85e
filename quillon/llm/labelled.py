"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def sample(docs: DataFrame, columns: list[str], labels: DataFrame, label: str, bound: int, where: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """__labelled (the id), __label (0 or 1) and columns of labelled documents, bound of them at most: those whose ids
    have the smallest hashes.

    One label an id, the smallest where there are several; none where it is
    null.  One row an id, the one whose columns have the smallest hash, however
    often docs repeats it.  So the sample has no more rows than bound, and its
    ids are sent to all tasks.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if where is not None:
        known = known.where(where)
    known = known.groupBy(F.col("doc_id").cast("long").alias("__labelled")).agg(F.min(F.col(label).cast("int")).alias("__label"))
    rank = F.shiftrightunsigned(F.xxhash64("__labelled"), 1)
    n = known.count()
    if n > bound:
        # About twice the bound pass; only these are sorted.
        known = known.where(rank <= F.lit(min((1 << 63) - 1, (1 << 64) * bound // n))).orderBy(rank).limit(bound)
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), row.alias("__row"))
    met = slim.join(F.broadcast(known), F.col("__id") == F.col("__labelled"))
    one = met.groupBy("__labelled", "__label").agg(F.min(F.struct(F.xxhash64("__row").alias("h"), F.col("__row").alias("r"))).alias("__one"))
    return one.select("__labelled", "__label", *[F.col("__one.r")[c].alias(c) for c in columns])
