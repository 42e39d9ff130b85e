"""Bloom filters over well-mixed 64-bit hashes, for a broadcast whose size is checked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quillon.llm.common import staged, typed

PROBES = 4
#: Bits a hash, and the fewest where that would be too large a filter: there a hash never added is found with a chance of 16 %.
BITS_PER_HASH, FEWEST = 16, 4
#: Bits, as powers of 2, of a segment, and of the smallest and largest filter that is broadcast (16 KB to 128 MB).
SEGMENT, LEAST, MOST = 13, 17, 30


def probes(hashes: np.ndarray, mask: int) -> np.ndarray:
    """(PROBES, n) bit places, from the low half of a hash in steps of the high half."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    i = np.arange(PROBES, dtype=np.uint64)[:, None]
    return (hashes[None, :] + i * step[None, :]) & np.uint64(mask)


def put(bits: np.ndarray, places: np.ndarray) -> None:
    places = places.ravel()
    np.bitwise_or.at(bits, (places >> np.uint64(3)).astype(np.int64), (1 << (places & np.uint64(7))).astype(np.uint8))


def have(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    found = bits[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)
    return (found & 1).all(axis=0)


class SharedBloom:
    """A filter in segments: the top bits of a hash choose the segment, which holds all of its probes."""

    def __init__(self, log_bits: int, segments: dict[int, bytes]):
        self.shift = np.uint64(64 - (log_bits - SEGMENT))
        self.bits = np.zeros(1 << (log_bits - 3), np.uint8)
        size = 1 << (SEGMENT - 3)
        for i, part in segments.items():
            self.bits[i * size : (i + 1) * size] = np.frombuffer(part, np.uint8)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        base = (hashes >> self.shift) << np.uint64(SEGMENT)
        return have(self.bits, base[None, :] + probes(hashes, (1 << SEGMENT) - 1))


def shared_bloom(df: DataFrame, column: str) -> SharedBloom | None:
    """A filter of the hashes in a column of df, which is read twice, once to count; None where they are too many for a
    broadcast, more than 2^28.  Tasks build segments; only their bits reach the driver."""
    n = df.count()
    if n * FEWEST > 1 << MOST:
        return None
    log_bits = min(MOST, max(LEAST, int(n * BITS_PER_HASH - 1).bit_length() if n else 0))
    shift = 64 - (log_bits - SEGMENT)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: dict[int, np.ndarray] = {}
        for batch in batches:
            hashes = batch.column(1).to_numpy().view(np.uint64)
            which = batch.column(0).to_numpy()
            order = np.argsort(which, kind="stable")
            edges = np.flatnonzero(np.diff(which[order], prepend=-1))
            for first, last in zip(edges, [*edges[1:], len(order)]):
                part = order[first:last]
                bits = segments.setdefault(int(which[part[0]]), np.zeros(1 << (SEGMENT - 3), np.uint8))
                put(bits, probes(hashes[part], (1 << SEGMENT) - 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(segments), pa.int64()), pa.array([b.tobytes() for b in segments.values()], pa.binary())], names=["segment", "bits"])

    schema = "segment long, bits binary"
    keyed = df.where(F.col(column).isNotNull()).select(F.shiftrightunsigned(column, shift).cast("long").alias("segment"), F.col(column).alias("hash"))
    rows = keyed.repartition("segment").mapInArrow(typed(build, schema), schema).collect()
    return SharedBloom(log_bits, {r["segment"]: bytes(r["bits"]) for r in rows})


def tester(df: DataFrame, column: str) -> Callable[[pa.Array], np.ndarray] | None:
    """A test of Arrow arrays of xxhash64 values, for tasks: true for those of a column of df, false for nearly all others;
    None where the column is too long for a filter.

    The column's hashes are written to the shared folder, as they are counted before they are put in.
    """
    hashed = staged(df.where(F.col(column).isNotNull()).select(F.xxhash64(column).alias("hash")), "possible")
    if (bloom := shared_bloom(hashed, "hash")) is None:
        return None
    known = df.sparkSession.sparkContext.broadcast(bloom)
    return lambda hashes: known.value.contains(hashes.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def asks(test_of: Callable[[pa.Array], np.ndarray] | None) -> Callable[[Column], Column]:
    """A tester() as a test of columns; true for all where there is none, so whoever asks it joins exactly afterwards."""
    if test_of is None:
        return lambda hashes: F.lit(True)

    @arrow_udf("boolean")
    def test(hashes: pa.Array) -> pa.Array:
        return pa.array(test_of(hashes))

    return test


def possible(df: DataFrame, column: str) -> Callable[[Column], Column]:
    return asks(tester(df, column))
