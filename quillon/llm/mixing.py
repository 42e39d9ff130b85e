"""Mixing sources to target weights by weighted fair queueing.

The documents of a source, shuffled, come one after the other and, once the
source is through, all over again up to a number of passes.  A copy's virtual
finish time is the words its source has emitted by then over the source's
target; the mix is the copies in the order of finish times, cut where the next
one would exceed the budget.

No source is ever in one task: its documents fall into ranges of the shuffle
order, sums by (source, range) give every range its offset, and only within a
range are sizes accumulated.  The cut is found by sums over ranges of finish
times, in two steps, then exactly within one fine range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import documents, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
PASSES = 2
#: Ranges of finish times in a step of the search, to the unit of time and then to the range; later times are one range.
STEPS = 4096
LATEST = 4


def sizes(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size (words), key: the shuffle order, a digest of the id."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ).withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def targets(sums: DataFrame, weights: tuple[float, ...], share: float, passes: int) -> DataFrame:
    """source, none, source_size, target for (source, none, source_size), one row a source.

    With excess reshared until no target is above passes times its source's
    size, the targets are min(cap, weight x level), where the level is what is
    left to the sources below their cap, by weight.  Sources in the order of
    cap / weight: the first whose cap exceeds its share at that level, and all
    after it, stay below.
    """
    order = Window.orderBy("none", "source")
    ranked = sums.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(passes)))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / (F.col("all_weight") - F.col("gone")))
        .withColumn("below", F.col("cap") > F.col("weight") * F.col("level"))
        .withColumn("final", F.min(F.when(F.col("below"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything))
    )
    reached = F.coalesce(F.col("final.level") * F.col("weight"), F.col("cap"))
    return ranked.select("source", "none", "source_size", F.least("cap", reached).alias("target"))


def virtual_times(slim: DataFrame, weights: tuple[float, ...], share: float, passes: int, digits: int) -> DataFrame:
    """doc_id, size, key, source_size, target and done, the words of its source up to and with the document."""
    slim = slim.select(
        "doc_id",
        "size",
        "key",
        F.col("source").isNull().alias("none"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.substring("key", 1, digits).alias("part"),
    )
    parts = slim.groupBy("none", "source", "part").agg(F.sum("size").alias("part_size"))
    sums = parts.groupBy("none", "source").agg(F.sum("part_size").alias("source_size"))
    earlier = Window.partitionBy("none", "source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("part_size").over(earlier), F.lit(0))).drop("part_size")
    offsets = offsets.join(targets(sums, weights, share, passes), ["none", "source"])
    within = Window.partitionBy("none", "source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    done = F.sum("size").over(within) + F.col("offset")
    return slim.join(offsets, ["none", "source", "part"]).select("doc_id", "size", "key", "source_size", "target", done.alias("done"))


def finish(p: int) -> Column:
    """Virtual finish time of a document's copy in pass p, from 0; null where the source has no words."""
    return (F.col("done") + F.lit(p) * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0))


def place(time: Column) -> Column:
    return F.least(F.floor(time * STEPS), F.lit(LATEST * STEPS)).cast("long")


def fine(time: Column) -> Column:
    return F.least(F.floor((time * STEPS - place(time)) * STEPS), F.lit(STEPS)).cast("long")


def copies(timed: DataFrame, passes: int) -> DataFrame:
    """One row for each copy of a document that has words, with its coarse and fine range of finish times."""
    each = [F.struct(finish(p).alias("time"), F.lit(p).alias("pass")) for p in range(passes)]
    found = timed.where("size > 0").select("doc_id", "size", "key", F.explode(F.array(*each)).alias("copy"))
    return found.select("doc_id", "size", "key", "copy.*", place(F.col("copy.time")).alias("place"), fine(F.col("copy.time")).alias("fine"))


def first_over(items: DataFrame, order: list[str], used: int, budget: float) -> tuple[list, int] | None:
    """The first value of order at which used and the sizes so far exceed budget, and the words before it."""
    so_far = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = items.groupBy(*order).agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(so_far) + F.lit(used))
    row = sums.where(F.col("upto") > F.lit(budget)).orderBy(*order).first()
    return row and ([row[c] for c in order], row["upto"] - row["n"])


def taken(timed: DataFrame, budget: float, passes: int) -> Column:
    """Words of a document in the mix: its copies that come before the first that exceeds the budget."""
    items = copies(timed, passes)
    coarse = first_over(items, ["place"], 0, budget)
    if coarse is None:
        return F.col("size") * F.lit(passes)
    (at,), used = coarse
    items = items.where(F.col("place") == at)
    (nearer,), used = first_over(items, ["fine"], used, budget)
    items = items.where(F.col("fine") == nearer)
    # Copies that are alike in all of these columns are alike altogether, and come together.
    (time, key, doc_id, size, last), _ = first_over(items, ["time", "key", "doc_id", "size", "pass"], used, budget)

    def before(p: int) -> Column:
        mine = [finish(p), F.col("key"), F.coalesce("doc_id", F.lit(-(2**63))), F.col("size"), F.lit(p)]
        its = [F.lit(time), F.lit(key), F.lit(doc_id if doc_id is not None else -(2**63)), F.lit(size), F.lit(last)]
        return reduce(lambda rest, x: (x[0] < x[1]) | ((x[0] == x[1]) & rest), reversed(list(zip(mine, its))), F.lit(False))

    chosen = [F.when(F.coalesce(before(p), F.lit(False)), F.col("size")).otherwise(0) for p in range(passes)]
    return reduce(lambda a, b: a + b, chosen)


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    passes: int = PASSES,
    digits: int = 3,
) -> DataFrame:
    """Take documents, some of them repeatedly, so that sources come near their targets.

    Sources, by code point and null last, weigh weights in turn and share
    share times all words; no target is above passes times its source's words.
    Returns doc_id, size, source_size, target, taken: one row for each row of
    df.  A null text has no words and is taken 0 times; documents of equal ids
    and sizes in a source are alike, and reruns agree; a null id is shuffled
    like an empty one.  An empty table gives no rows.  Other columns are left
    out.  digits: hexadecimal digits of the shuffle order that make a range of
    a source; 3 leave a range of a source of 10^10 documents 2.4 million.
    """
    slim = staged(sizes(df, id_col, text_col, source_col), "mix-sizes")
    timed = staged(virtual_times(slim, weights, share, passes, digits), "mix-times")
    total = slim.agg(F.sum("size")).first()[0] or 0
    words = taken(timed, total * share, passes).cast("long")
    return timed.select("doc_id", "size", "source_size", "target", words.alias("taken"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


OP3_SQL = r"""
with sized as (
  select doc_id, source, md5(coalesce(doc_id::varchar, '')) as key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents
), sums as (
  select source, sum(size)::bigint as source_size,
         [5.0, 2.0, 1.0][((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::int]::double as weight,
         row_number() over (order by source is null, encode(source)) as rank
  from sized group by source
), capped as (
  select *, 2.0::double * source_size as cap, sum(source_size) over () * 1.5::double as total,
         sum(weight) over () as all_weight,
         coalesce(sum(2.0::double * source_size) over lower_first, 0) as used,
         coalesce(sum(weight) over lower_first, 0) as gone
  from sums
  window lower_first as (order by 2.0::double * source_size / weight, rank rows between unbounded preceding and 1 preceding)
), levels as (
  select *, (total - used) / (all_weight - gone) as level from capped
), chosen as (
  select arg_min(level, cap / weight) as level from levels where cap > weight * level
), targets as (
  select source, source_size, least(cap, coalesce(chosen.level * weight, cap)) as target from levels, chosen
), timed as (
  select doc_id, key, size, source_size, target,
         sum(size) over (partition by source order by key, doc_id, size rows between unbounded preceding and current row) as done
  from sized join targets using (source)
  where source is not null
  union all
  select doc_id, key, size, source_size, target,
         sum(size) over (order by key, doc_id, size rows between unbounded preceding and current row) as done
  from sized, (select source_size, target from targets where source is null)
  where source is null
), copies as (
  select doc_id, key, size, source_size, target, pass, (done + pass * source_size)::double / target as time
  from timed, (values (0), (1)) as passes(pass) where size > 0
), queue as (
  select *, sum(size) over (order by time, key, doc_id, size, pass rows between unbounded preceding and current row) as upto from copies
), got as (
  select doc_id, key, size, source_size, target, (sum(size) filter (upto <= (select 1.5::double * sum(size) from sized)))::bigint as taken
  from queue group by all
)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from got
union all
select doc_id, size, source_size, target, 0::bigint from timed where size = 0
"""
