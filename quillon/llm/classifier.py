"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + w.x + sum over factors of ((V'x)^2 - (V^2)'(x^2)) / 2),
the sum-of-squares form of all pairwise interactions, linear in the non-zero
inputs.  Inputs are the log counts of hashed words scaled to unit length,
standardised structure statistics, and standardised logs of metadata columns.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quillon.llm.common import bounded_batches, documents, text_bytes
from quillon.llm.labelled import sample
from quillon.llm.textstats import RATES, counts, rates

#: Labelled rows that the model is fitted on, at most about.
LABELLED = 6_000
BUCKETS, FACTORS, EPOCHS, BATCH, RATE, DECAY = 2048, 8, 12, 128, 0.02, 1e-4
THRESHOLD = 0.3
CLIP = 4.0


def features(text: bytes, metadata: Sequence[float | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words, their weights, and the statistics of a text."""
    words = text.split()
    found = Counter([w.lower() for w in words])
    weights = np.zeros(BUCKETS, np.float32)
    if found:
        places = np.fromiter((zlib.crc32(w) % BUCKETS for w in found), np.int64, len(found))
        np.add.at(weights, places, np.log1p(np.fromiter(found.values(), np.float32, len(found))))
    buckets = np.flatnonzero(weights)
    weights = weights[buckets]
    if len(weights):
        weights /= np.sqrt((weights * weights).sum())
    stats = [np.log1p(v) if v > 1 else v for v in rates(counts(text, words))]
    stats += [np.log1p(max(float(v), 0.0)) if v is not None else 0.0 for v in metadata]
    return buckets, weights, np.array(stats, np.float32)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # (BUCKETS + statistics,)
    factors: np.ndarray  # (BUCKETS + statistics, FACTORS)
    mean: np.ndarray
    scale: np.ndarray

    def score(self, buckets: np.ndarray, weights: np.ndarray, stats: np.ndarray) -> float:
        place = np.concatenate((buckets, np.arange(BUCKETS, len(self.linear))))
        x = np.concatenate((weights, np.clip((stats - self.mean) / self.scale, -CLIP, CLIP)))
        v = self.factors[place]
        both = x @ v
        z = self.bias + x @ self.linear[place] + 0.5 * (both @ both - ((x * x) @ (v * v)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, n_stats: int, seed: int = 7) -> Machine:
    """Adam on the logistic loss, in mini-batches of a fixed order; without both labels, the constant share of ones."""
    width = BUCKETS + n_stats
    stats = np.array([r[2] for r in rows], np.float32).reshape(-1, n_stats)
    mean, scale = (stats.mean(0), np.maximum(stats.std(0), 1e-6)) if len(rows) else (np.zeros(n_stats, np.float32), np.ones(n_stats, np.float32))
    share = (labels.sum() + 1) / (len(labels) + 2)
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(width, np.float32), np.zeros((width, FACTORS), np.float32), mean, scale)
    if len(set(labels.tolist())) < 2:
        return machine
    random = np.random.default_rng(seed)
    x = np.zeros((len(rows), width), np.float32)
    for i, (buckets, weights, _) in enumerate(rows):
        x[i, buckets] = weights
    x[:, BUCKETS:] = np.clip((stats - mean) / scale, -CLIP, CLIP)
    values = {"b": np.array([machine.bias], np.float32), "w": machine.linear, "v": random.normal(0, 0.02, (width, FACTORS)).astype(np.float32)}
    moments = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in values.items()}
    step = 0
    for _ in range(EPOCHS):
        for part in np.array_split(random.permutation(len(rows)), max(1, len(rows) // BATCH)):
            a, squares = x[part], x[part] ** 2
            both = a @ values["v"]
            z = values["b"] + a @ values["w"] + 0.5 * ((both**2).sum(1) - (squares @ values["v"] ** 2).sum(1))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            slopes = {
                "b": np.array([error.sum()]),
                "w": error @ a + DECAY * values["w"],
                "v": a.T @ (error[:, None] * both) - values["v"] * (error @ squares)[:, None] + DECAY * values["v"],
            }
            step += 1
            for k, g in slopes.items():
                first, second = moments[k]
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                values[k] = values[k] - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Machine(float(values["b"][0]), values["w"].astype(np.float32), values["v"].astype(np.float32), mean, scale)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def train(df: DataFrame, labels: DataFrame, text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",), bound: int = LABELLED) -> Machine:
    """Fit on bound labelled documents at most, none of them held out."""
    bounded_batches(df.sparkSession)
    rows = sample(df, [text_col, *metadata], labels, "quality", bound, where=~held_out())

    @arrow_udf("struct<buckets:binary,weights:binary,stats:binary>")
    def seen(texts: pa.Array, *columns: pa.Array) -> pa.Array:
        found = [features(t, m) for t, *m in zip(text_bytes(texts), *[c.to_pylist() for c in columns])]
        parts = [pa.array([f[i].astype(kind).tobytes() for f in found], pa.binary()) for i, kind in enumerate((np.int16, np.float32, np.float32))]
        return pa.StructArray.from_arrays(parts, names=["buckets", "weights", "stats"])

    found = rows.select("__labelled", "__label", seen(F.col(text_col).cast("string"), *[F.col(c).cast("double") for c in metadata]).alias("f"))
    got = sorted(found.select("__labelled", "__label", "f.*").collect(), key=lambda r: (r[0], bytes(r[3])))
    parts = [(np.frombuffer(r[2], np.int16).astype(np.int64), np.frombuffer(r[3], np.float32), np.frombuffer(r[4], np.float32)) for r in got]
    return fit(parts, np.array([r[1] for r in got], np.float32), len(RATES) + len(metadata))


def classify(df: DataFrame, machine: Machine, text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher for label 1), predicted (score at least 0.3), for every row of df, other
    columns left out.  A null text is an empty one, and an empty one has a score of its statistics; null metadata count
    as 0; repeated rows score alike; a row without an id is not held out.  Nothing is shuffled."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(machine)

    @arrow_udf("double")
    def scored(texts: pa.Array, *columns: pa.Array) -> pa.Array:
        model = shared.value
        return pa.array([model.score(*features(t, m)) for t, *m in zip(text_bytes(texts), *[c.to_pylist() for c in columns])], pa.float64())

    score = scored.asNondeterministic()(F.col(text_col).cast("string"), *[F.col(c).cast("double") for c in metadata])
    out = df.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
