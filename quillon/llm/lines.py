"""Line dedup across documents with two Bloom filters.

A line's key is the line without ASCII white space at its ends, A-Z in lower
case.  The once-seen filter is an array of 2^44 bits with one probe.  A task
sets the bits of its lines and sends only these, sorted and compressed, about 4
bytes each, to the partitions that own their ranges; hashes themselves stay.  A
bit that two tasks set, or two documents of a task, goes into the twice-seen
filter, which all tasks get.  The second pass asks that, and only suspected
repeats are shuffled, as 128-bit digests, to be confirmed exactly and given a
keeper.  Documents that lose no line never move; the others meet the digests
they must drop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quillon.llm.common import bounded_batches, documents, staged, text_bytes, typed, without
from quillon.llm.filters import SharedBloom, possible, shared_bloom
from quillon.llm.packing import differences, edges_of, sums
from quillon.llm.shingles import mixed

LEAST_CHARS = 40
LEAST_DOCS = 5
#: The once-seen filter has 2^PLACE_BITS bits.
PLACE_BITS = 44
#: Places that a task holds before it sends or merges them.
HELD = 1 << 21


def digest(line: bytes, least: int) -> bytes | None:
    """Digest of the line's key; None if the key has fewer than least code points."""
    if len(line) < least:
        return None
    key = line.strip().lower()  # of bytes: ASCII white space and letters only
    if len(key) < least or (not key.isascii() and len(key.decode("utf-8", "replace")) < least):
        return None
    return xxhash.xxh3_128_digest(key)


def digests(text: bytes, least: int) -> set[bytes]:
    found = {digest(line, least) for line in text.split(b"\n")}
    found.discard(None)
    return found


def places(keys: list[bytes]) -> np.ndarray:
    """Bits of the once-seen filter that digests set."""
    return np.frombuffer(b"".join(keys), np.uint64)[::2] >> np.uint64(64 - PLACE_BITS)


def once_seen(df: DataFrame, text_col: str, least: int, parts: int) -> DataFrame:
    """part, once, again: the bits that a task's documents set in the range of a part, and those that several of them set."""
    schema = "part long, once binary, again binary"

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        again = found[counts > 1]
        edges, others = edges_of(found, PLACE_BITS, parts), edges_of(again, PLACE_BITS, parts)
        some = np.flatnonzero(np.diff(edges)).tolist()
        columns = [some, [differences(found[edges[i] : edges[i + 1]]) for i in some], [differences(again[others[i] : others[i + 1]]) for i in some]]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["part", "once", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(places([key for text in text_bytes(batch.column(0)) for key in digests(text, least)]))
            n += len(held[-1])
            if n >= HELD:
                yield sent(held)
                held, n = [], 0
        if n:
            yield sent(held)

    return df.select(F.col(text_col).cast("string")).mapInArrow(typed(run, schema), schema)


def twice_seen(once: DataFrame, parts: int) -> DataFrame:
    """hash: a mix of each place that was set twice or more.  A task merges the bits of its part, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, twice, held, n = np.empty(0, np.uint64), np.empty(0, np.uint64), [], 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            found, counts = np.unique(np.concatenate([seen, *held]), return_counts=True)
            return found, np.union1d(twice, found[counts > 1])

        for batch in batches:
            for one, again in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held.append(sums(one))
                n += len(held[-1])
                twice = np.union1d(twice, sums(again))
                if n >= HELD:
                    seen, twice = merge()
                    held, n = [], 0
        if n:
            seen, twice = merge()
        yield pa.RecordBatch.from_arrays([pa.array(mixed(twice).view(np.int64))], names=["hash"])

    return once.repartitionById(parts, F.col("part").cast("int")).mapInArrow(typed(run, "hash long"), "hash long")


def suspects(df: DataFrame, id_col: str, text_col: str, least: int, twice: DataFrame) -> DataFrame:
    """key, doc_id: the keys of each document that were perhaps seen twice, once a row.  The twice-seen filter tells them;
    where it would be too large for all tasks, a join with its places does."""
    bloom = shared_bloom(twice, "hash")
    shared = None if bloom is None else df.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                own = digests(text, least)
                keys += own
                ids += [doc_id] * len(own)
            marks = mixed(places(keys))
            kept = np.flatnonzero(shared.value.contains(marks)) if shared is not None else range(len(keys))
            columns = [pa.array([keys[i] for i in kept], pa.binary()), pa.array([ids[i] for i in kept], pa.int64()), pa.array(marks[kept].view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "hash"])

    schema = "key binary, doc_id long, hash long"
    known = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    found = known.mapInArrow(typed(run, schema), schema)
    return (found.join(twice, "hash", "left_semi") if bloom is None else found).drop("hash")


def confirmed(found: DataFrame, least_docs: int) -> DataFrame:
    """key, keeper: the keys that enough documents hold, and the largest id among them.  Ids are made distinct by
    (key, id) before they meet by key, so a key that all documents hold is counted in parts."""
    counted = found.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
    return counted.where(F.col("n") >= least_docs).select("key", "keeper")


def to_drop(found: DataFrame, keepers: DataFrame) -> DataFrame:
    """doc_id, drops: the confirmed keys that a document holds and does not keep.  A key that very many documents hold is
    a skewed partition of a merge join, which Spark splits as it runs."""
    met = found.join(keepers.hint("merge"), "key").where(F.col("doc_id") != F.col("keeper"))
    return met.groupBy("doc_id").agg(F.collect_set("key").alias("drops"))


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS
) -> DataFrame:
    """Drop lines that many documents hold, everywhere but in the document with the largest id.

    Keys of at least least_chars code points found under at least least_docs
    distinct ids lose all their lines in all documents but that one; the other
    lines stay, joined by a line feed.  Returns all rows and columns of df, the
    text rewritten, with n_lines (before) and n_dropped, which replace columns
    of those names.  A null text counts as empty, an empty one has one empty
    line, and both become empty.  Rows that repeat an id are one document to the
    count and lose the same keys; rows without an id are neither counted nor
    changed.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    df = without(df, "n_lines", "n_dropped")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    twice = staged(twice_seen(once_seen(df, text_col, least_chars, parts), parts), "lines-twice")
    found = staged(suspects(df, id_col, text_col, least_chars, twice), "lines-suspects")
    # Written on its own, so that the join's sides are plain shuffles, which Spark can split.
    keepers = staged(confirmed(found, least_docs), "lines-keepers")
    drops = staged(to_drop(found, keepers), "lines-drops")

    @arrow_udf("struct<text:string,n_lines:bigint,n_dropped:bigint>")
    def rewritten(texts: pa.Array, drops: pa.Array) -> pa.Array:
        kept, n, gone = [], [], []
        for text, keys in zip(text_bytes(texts), drops.to_pylist()):
            lines = text.split(b"\n")
            keys = set(keys or ())
            stay = [line for line in lines if digest(line, least_chars) not in keys] if keys else lines
            kept.append(b"\n".join(stay))
            n.append(len(lines))
            gone.append(len(lines) - len(stay))
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=["text", "n_lines", "n_dropped"])

    text, own_id = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    moves = own_id.isNotNull() & possible(drops, "doc_id")(F.xxhash64(own_id))
    others = [c for c in df.columns if c.lower() != text_col.lower()]
    still = df.where(~moves).select(
        *[F.col(f"`{c}`") for c in others],
        text.alias(text_col),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.lit(0).cast("long").alias("n_dropped"),
    )
    # The caller's row travels as one column, so that none of its names can clash with ours.
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0))
    rows = df.where(moves).select(own_id.alias("id"), row.alias("row"), text.alias("text"))
    # A merge join at every size: where drops are few enough for a broadcast today they grow with the corpus.
    met = rows.join(drops.hint("merge"), F.col("id") == F.col("doc_id"), "left").select("row", rewritten("text", "drops").alias("new"))
    changed = met.select(*[F.col("row")[c].alias(c) for c in others], F.col("new.text").alias(text_col), F.col("new.n_lines").alias("n_lines"), F.col("new.n_dropped").alias("n_dropped"))
    return still.unionByName(changed).select(*[f"`{c}`" for c in df.columns], "n_lines", "n_dropped")


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
with lines as (
  select row, doc_id, i, lines[i] as line,
         translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select row_number() over () as row, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents) as split,
       lateral (select unnest(range(1, len(lines) + 1)) as i) as places
), keepers as (
  select key, max(doc_id) as keeper from lines where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), judged as (
  select row, doc_id, i, line, keeper is not null and doc_id <> keeper as gone from lines left join keepers using (key)
)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from judged group by row, doc_id
"""
