"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as
Parquet and read again as the docs of the next one; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, jaccard, lines, mixing, quality_rules
from quillon.llm.common import documents, fresh, staged
from quillon.llm.filters import asks, tester

#: Near duplicates: documents whose sets of runs of so many words have at least this Jaccard similarity.  The contract of op7_jaccard has its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned quality rules and their base keep.  A null or short text fails the base; without
    labels there are no rules, and the base alone decides; an empty table stays empty."""
    rules = quality_rules.learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    verdict = fresh(docs, "__judged")
    return quality_rules.judged(docs, "text", rules, verdict).where(F.col(verdict)["kept"]).drop(verdict)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many of them hold; n_chars follows the text.  A null text becomes an empty one."""
    found = lines.dedup_lines(docs)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(*[f"`{c}`" for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: of its rows with the smallest id, the smallest of one set of shingles.

    Rows that share an id are judged by their texts, each in its own component.
    A text without words is in none and stays, once if its row repeats; rows
    without an id stay.
    """
    found = jaccard.jaccard_join(docs, words=NEAR_WORDS, percent=NEAR_PERCENT, sets=True)
    found = staged(found.select("doc_id", "component_id", "class", "first_class"), "components")
    gone = found.where("component_id < doc_id or class <> first_class").select("doc_id", "class").distinct()
    again = found.where("doc_id is not null").groupBy("doc_id", "class").count().where("count > 1").select("doc_id")
    test, known, hashed = tester(gone.select("doc_id").unionAll(again), "doc_id"), F.col("doc_id").isNotNull(), F.xxhash64("doc_id")
    # The caller's row travels as one column, so that none of its names can clash with ours.
    row = F.struct("text", *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    judged = docs.where(known).select("doc_id", row.alias("row"), jaccard.set_class(NEAR_WORDS, test)(hashed, F.col("text").cast("string")).alias("judged"))
    classed = judged.where("judged.asked").select("doc_id", "row", "judged.class")
    left = classed.join(gone.toDF("gone_id", "gone_class"), (F.col("doc_id") == F.col("gone_id")) & (F.col("class") == F.col("gone_class")), "left_anti")
    wordless = F.when(F.col("class").isNull(), F.col("row.text"))
    moved = left.groupBy("doc_id", "class", wordless.alias("wordless")).agg(F.min("row").alias("row"))
    return docs.where(~(known & asks(test)(hashed))).unionByName(moved.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it.  Rows that share an id, or have none, share the larger
    number; a null or wordless text has no size, is never taken and goes; an empty table stays empty."""
    found = mixing.mix_sources(docs).where("taken > 0")
    copies = found.groupBy(F.col("doc_id").alias("taken_id")).agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("copies"))
    rows = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    met = rows.join(copies, F.col("doc_id").eqNullSafe(F.col("taken_id")))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids with the digests of ids and decoded text, a row for each of docs.  A null text has no tokens."""
    return bpe.digests(docs, ids=True)


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", one_of_each),
    ("mixing sources", mix),
    ("BPE encoding", tokenize),
]

#: The first stage learns its rules, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{i}")
    return docs
