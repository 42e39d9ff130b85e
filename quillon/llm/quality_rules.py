"""Quality rules as a learned decision list.

Sequential covering: a rule is grown on two thirds of the labelled rows, a
threshold at a time by information gain, pruned on the rest, and kept if it is
precise; what it covers is taken out and the next one grown.  The list becomes
one Spark conditional expression over columns of rates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quillon.llm.common import bounded_batches, documents, fresh, text_bytes
from quillon.llm.labelled import sample
from quillon.llm.textstats import COUNTS, RATES, counts, rates

#: Labelled rows that a list is learned from, at most about.
LABELLED = 20_000
THRESHOLDS, CONDITIONS, RULES = 64, 4, 16
PRECISION, LEAST_COVERED = 0.95, 3
LEAST_WORDS, MOST_REPEATED = 50, 50

Condition = tuple[str, str, float]


@dataclass(frozen=True)
class Rule:
    """Rejects where all conditions (rate, "<=" or ">", threshold) hold."""

    conditions: tuple[Condition, ...]
    precision: float

    def __str__(self) -> str:
        return " and ".join(f"{name} {sign} {at:.6g}" for name, sign, at in self.conditions)


def holds(x: np.ndarray, names: tuple[str, ...], conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, sign, at in conditions:
        values = x[:, names.index(name)]
        out &= values <= at if sign == "<=" else values > at
    return out


def cuts(values: np.ndarray) -> np.ndarray:
    """Thresholds between different values, at most THRESHOLDS of them, at even ranks."""
    distinct = np.unique(values)
    between = (distinct[1:] + distinct[:-1]) / 2
    if len(between) > THRESHOLDS:
        between = np.unique(np.quantile(values, np.linspace(0, 1, THRESHOLDS + 2)[1:-1], method="midpoint"))
    return between


def grow(x: np.ndarray, bad: np.ndarray, names: tuple[str, ...]) -> tuple[Condition, ...]:
    """Conditions added while they gain and rows to keep are covered."""
    rule: tuple[Condition, ...] = ()
    inside = np.ones(len(x), bool)
    while len(rule) < CONDITIONS and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        if not p0:
            break
        best, choice = 1e-9, None
        before = np.log2(p0 / (p0 + n0))
        for j, name in enumerate(names):
            values, flags = x[inside, j], bad[inside]
            for at in cuts(values):
                below = values <= at
                p, n = (flags & below).sum(), (~flags & below).sum()
                for sign, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                    if a and (gain := a * (np.log2(a / (a + b)) - before)) > best:
                        best, choice = gain, (name, sign, float(at))
        if choice is None:
            break
        choice = centred(choice, x[inside], names)
        rule += (choice,)
        inside &= holds(x, names, (choice,))
    return rule


def centred(choice: Condition, x: np.ndarray, names: tuple[str, ...]) -> Condition:
    """The same split of x with the threshold halfway between the values on either side of it."""
    name, sign, at = choice
    values = x[:, names.index(name)]
    return name, sign, float((values[values <= at].max() + values[values > at].min()) / 2)


def prune(rule: tuple[Condition, ...], x: np.ndarray, bad: np.ndarray, names: tuple[str, ...]) -> tuple[Condition, ...]:
    """The shortest leading part of a rule that does best on rows it wasn't grown on."""

    def worth(part: tuple[Condition, ...]) -> float:
        covered = holds(x, names, part)
        p, n = (covered & bad).sum(), (covered & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda part: (worth(part), -len(part)), default=())


def learn(x: np.ndarray, bad: np.ndarray, names: tuple[str, ...]) -> list[Rule]:
    """An ordered list of rules that cover bad rows; empty where there are no bad rows, or none that thresholds tell apart."""
    rules: list[Rule] = []
    held = np.arange(len(x)) % 3 == 2
    while len(rules) < RULES:
        rule = prune(grow(x[~held], bad[~held], names), x[held], bad[held], names)
        if not rule:
            break
        covered = holds(x, names, rule)
        p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
        unseen, wrong = int((covered & bad & held).sum()), int((covered & ~bad & held).sum())
        if p < LEAST_COVERED or p < PRECISION * (p + n) or unseen < PRECISION * (unseen + wrong):
            break
        rules.append(Rule(rule, p / (p + n)))
        x, bad, held = x[~covered], bad[~covered], held[~covered]
    return rules


def expression(rules: list[Rule]) -> Column:
    """The number, from 1, of the first rule that rejects; 0 where none does.  Over columns named as RATES."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = F.lit(True)
        for name, sign, at in rule.conditions:
            test = test & (F.col(name) <= at if sign == "<=" else F.col(name) > at)
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(0) if out is None else out.otherwise(0)


MEASURED = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + "," + ",".join(f"r_{r}:double" for r in RATES) + ">"


def measured(text: Column) -> Column:
    """COUNTS and RATES of texts, taken once a row."""

    @arrow_udf(MEASURED)
    def run(texts: pa.Array) -> pa.Array:
        found = [counts(t) for t in text_bytes(texts)]
        shares = [rates(c) for c in found]
        columns = [pa.array([c[i] for c in found], pa.int64()) for i in range(len(COUNTS))]
        columns += [pa.array([float(s[i]) for s in shares], pa.float64()) for i in range(len(RATES))]
        return pa.StructArray.from_arrays(columns, names=[*COUNTS, *(f"r_{r}" for r in RATES)])

    return run.asNondeterministic()(text)


def judged(df: DataFrame, text_col: str, rules: list[Rule], name: str) -> DataFrame:
    """df with a column more, of that name: the counts, base_failed, rule and kept."""
    bounded_batches(df.sparkSession)
    row, found = "__row", df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), measured(F.col(f"`{text_col}`").cast("string")).alias("__measured"))
    m = F.col("__measured")
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
    found = found.withColumns({"__r": F.struct(*[m[f"r_{r}"].alias(r) for r in RATES]), "__failed": failed})
    rule = expression([Rule(tuple((f"__r.{n}", s, a) for n, s, a in r.conditions), r.precision) for r in rules])
    verdict = F.struct(*[m[c].alias(c) for c in COUNTS], F.col("__failed").alias("base_failed"), rule.alias("rule"), (~F.col("__failed") & (rule == 0)).alias("kept"))
    return found.select(*[F.col(row)[c].alias(c) for c in df.columns], verdict.alias(name))


def learn_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = LABELLED) -> list[Rule]:
    """Rules that reject as labels.quality marks with 0, from bound labelled documents at most, those that fail the base
    left out.  Without labelled documents, or with those of one quality only, there is nothing to tell apart and no rule."""
    rows = sample(df, [text_col], labels, "quality", bound, id_col=id_col)
    bounded_batches(df.sparkSession)
    seen = rows.select("__labelled", "__label", measured(F.col(f"`{text_col}`").cast("string")).alias("m"))
    kept = seen.where((F.col("m.n_words") >= LEAST_WORDS) & (100 * F.col("m.n_repeat_words") <= MOST_REPEATED * F.col("m.n_words")))
    got = sorted(kept.select("__labelled", "__label", *[f"m.r_{r}" for r in RATES]).collect())
    x = np.array([r[2:] for r in got], float).reshape(-1, len(RATES))
    return learn(x, np.array([r[1] == 0 for r in got], bool), RATES)


def apply_rules(df: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule, which replace columns
    of those names.  A null text has no words; one of fewer than 50 words fails the base, an empty table stays empty,
    and repeated rows are judged alike.  Nothing is shuffled."""
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"]
    others, name = [f"`{c}`" for c in df.columns if c.lower() not in new], fresh(df, "__judged")
    return judged(df, text_col, rules, name).select(*others, *[F.col(name)[c].alias(c) for c in new])


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rules = learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return apply_rules(docs, rules).drop("text")
