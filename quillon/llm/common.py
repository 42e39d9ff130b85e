"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are cut at this size, so that a worker's memory does not depend on how long texts are.
BATCH_BYTES = "4m"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Cap the bytes of an Arrow batch for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints; one of our own only where none is set and executors are
    threads of the driver, as in tests.  ValueError on a cluster without one: its machines would not see one another's files."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
        where = sc.getCheckpointDir()
    return where


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut and a lost executor loses nothing.

    The files stay until the folder is cleared, as those of checkpoint() do.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def map_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    work: Callable[[list, list[bytes]], Iterable[list]],
    schema: str,
    done: Callable[[], None] = lambda: None,
) -> DataFrame:
    """Run work(ids, texts) over each Arrow batch, and done() after a task's last; work returns the columns of schema in order.

    Only the two named columns travel to Python, whatever else df holds and however it is named.
    """
    bounded_batches(df.sparkSession)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(work(batch.column(0).to_pylist(), text_bytes(batch.column(1))))
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)
        done()

    slim = df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return slim.mapInArrow(typed(run, schema), schema)


def arrow_schema(schema: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
        "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
        "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()),
    }
    fields = []
    for part in schema.split(","):
        name, kind = part.strip().split(" ")
        fields.append(pa.field(name, kinds[kind]))
    return pa.schema(fields)


def tidy() -> None:
    """Return freed memory to the system: Spark keeps a task's Python worker, and what it holds, for the next one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def typed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str):
    """run, with its batches cast to schema (an all-null column has no type of its own)."""

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for out in run(batches):
            yield pa.RecordBatch.from_arrays([out.column(i).cast(f.type) for i, f in enumerate(target)], schema=target)
        tidy()

    return cast


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one where df has a column of that name; Spark's names ignore case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add; Spark's names ignore case."""
    lower = {x.lower() for x in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower])


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows with equal first n_keys columns, from batches sorted by them."""
    key, rows = None, []
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        change = np.zeros(max(len(batch) - 1, 0), bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
        for first, last in zip(edges, edges[1:]):
            if first == last:
                continue
            here = tuple(int(c[first]) for c in columns)
            if here != key:
                if rows:
                    yield key, rows
                key, rows = here, []
            rows.append(batch.slice(first, last - first))
    if rows:
        yield key, rows


def column(rows: list[pa.RecordBatch], i: int) -> list:
    return [x for b in rows for x in b.column(i).to_pylist()]
