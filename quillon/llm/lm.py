"""Language-model scores of documents by stupid backoff, from counts of the same corpus.

Words are runs without ASCII white space, A-Z in lower case, all of them: there
is no vocabulary to grow out of.  For orders 2 and 3:

    S(w | u v) = c(u v w) / c(u v)        if c(u v w) >= 2
               = 0.4 S(w | v)             otherwise, and so on down to
    S(w)       = c(w) / N

The tables of n-gram counts are partitioned by the hash of the n-gram, of 56
bits, by which n-grams are told apart.  A block of documents explodes into its
distinct n-grams, each with its number in the block, and sends them to their
partitions; there they are summed over all blocks, and joined with what each
block asked for; the totals return to the block, which sums log S by document.
So an n-gram crosses the network once a block rather than once a document,
nothing is broadcast, and only the number of words reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, column, documents, groups, staged, text_bytes, tidy, typed
from quillon.llm.packing import differences, edges_of, packed, sums, unpacked
from quillon.llm.shingles import STEP, mixed

KEY_BITS = 56
BLOCK_BYTES = 8 << 20
SEEN = 2
BACKOFF = 0.4
ORDERS = (1, 2, 3)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: ASCII letters and white space only


def grams(words: np.ndarray, lengths: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the key of the n-gram of the given order ending there, from hashes of words, and whether the
    document reaches back that far."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    key = words.copy()
    for k in range(1, order):
        key[k:] += words[:-k] * np.uint64(int(STEP) ** k % 2**64)
    return mixed(key) >> np.uint64(64 - KEY_BITS), place >= order - 1


def codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=9)


def hashes(text: bytes, size: int) -> np.ndarray:
    """Of the words of a block, from its compressed text and their size."""
    found = codec().decompress(text, size, asbytes=True).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def blocks_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents: the number of all words, the documents' ids and numbers of words, and the words, compressed.
    A block ends with the document that brings it to BLOCK_BYTES."""
    schema = "block long, words long, bytes long, ids array<long>, lengths array<long>, text binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n = TaskContext.get().partitionId() << 24, 0
        ids, lengths, texts, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            text = b" ".join(texts)
            row = [first + n, sum(lengths), len(text), ids, lengths, codec().compress(text, asbytes=True)]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["block", "words", "bytes", "ids", "lengths", "text"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                found = words_of(text)
                ids.append(doc_id)
                lengths.append(len(found))
                texts.append(b" ".join(found))
                size += len(texts[-1]) + 1
                if size >= BLOCK_BYTES:
                    yield block()
                    n += 1
                    ids, lengths, texts, size = [], [], [], 0
        if ids:
            yield block()

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(typed(run, schema), schema)


def explode(blocks: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, parts: a block's distinct n-grams in the range of a bucket, as differences, and their numbers."""
    schema = "bucket long, block long, parts array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lengths, size, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words, lengths = hashes(text, size), np.array(lengths, np.int64)
                parts: list[list[bytes]] = [[] for _ in range(buckets)]
                for order in ORDERS:
                    key, full = grams(words, lengths, order)
                    keys, numbers = np.unique(key[full], return_counts=True)
                    edges = edges_of(keys, KEY_BITS, buckets)
                    for part, first, last in zip(parts, edges, edges[1:]):
                        part += [differences(keys[first:last]), packed(numbers[first:last])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(buckets), pa.int64()), pa.array([block] * buckets, pa.int64()), pa.array(parts, pa.list_(pa.binary()))], names=["bucket", "block", "parts"]
                )
        tidy()

    return blocks.select("block", "lengths", "bytes", "text").mapInArrow(run, schema)


def totals(asked: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, parts: for the n-grams that a block sent to a bucket, in their order, the corpus counts."""
    schema = "block long, bucket long, parts array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in groups(batches, 1):
            askers, sent = column(rows, 1), column(rows, 2)
            answers: list[list[bytes]] = [[] for _ in askers]
            for k in range(len(ORDERS)):
                keys = [sums(p[2 * k]) for p in sent]
                numbers = np.concatenate([unpacked(p[2 * k + 1]) for p in sent])
                _, place = np.unique(np.concatenate(keys), return_inverse=True)
                if len(place):
                    # Whole numbers, exact in doubles up to 2^53.
                    counts = np.bincount(place, weights=numbers.astype(np.float64))[place]
                else:
                    counts = np.empty(0)
                ends = np.cumsum([0, *map(len, keys)])
                for i in range(len(askers)):
                    answers[i].append(packed(counts[ends[i] : ends[i + 1]]))
            yield pa.RecordBatch.from_arrays([pa.array(askers, pa.int64()), pa.array([bucket] * len(askers), pa.int64()), pa.array(answers, pa.list_(pa.binary()))], names=["block", "bucket", "parts"])
        tidy()

    return asked.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(run, schema)


def scores(blocks: DataFrame, answers: DataFrame, total: int) -> DataFrame:
    """doc_id, n_tokens, n_backoff, log_score."""
    schema = "doc_id long, n_tokens long, n_backoff long, log_score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, 1):
            ids, lengths, size, text = (column(rows[:1], i)[0] for i in (2, 3, 4, 5))
            parts, lengths, words = column(rows, 6)[1:], np.array(lengths, np.int64), hashes(text, size)
            found = []
            for k, order in enumerate(ORDERS):
                key, full = grams(words, lengths, order)
                _, place = np.unique(key[full], return_inverse=True)
                here = np.zeros(len(words))
                if len(place):
                    here[full] = np.concatenate([unpacked(p[k]) for p in parts])[place]
                found.append((here, full))
            (one, _), (two, has_two), (three, has_three) = found
            with np.errstate(divide="ignore", invalid="ignore"):
                log_one, log_two, log_three = np.log(one), np.log(two), np.log(three)
                step = np.log(BACKOFF)
                last, last_two = np.roll(log_one, 1), np.roll(log_two, 1)
                low = np.where(two >= SEEN, log_two - last, step * has_two + log_one - np.log(max(total, 1)))
                score = np.where(three >= SEEN, log_three - last_two, step * has_three + low)
            back = (has_two & (two < SEEN)) | (has_three & (three < SEEN))
            ends = np.cumsum(lengths)
            summed = np.zeros(len(lengths))
            missed = np.zeros(len(lengths), np.int64)
            some = lengths > 0
            if some.any():
                summed[some] = np.add.reduceat(score, (ends - lengths)[some])
                missed[some] = np.add.reduceat(back.astype(np.int64), (ends - lengths)[some])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths), pa.array(missed), pa.array(summed)], names=["doc_id", "n_tokens", "n_backoff", "log_score"])

    home = blocks.select("block", F.lit(-1).cast("long").alias("bucket"), "ids", "lengths", "bytes", "text")
    together = home.unionByName(answers, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "bucket")
    return together.mapInArrow(typed(run, schema), schema)


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text with a trigram model of all texts of df.

    Returns doc_id, n_tokens, n_backoff (words whose longest n-gram was seen
    less than twice), log_score (sum of natural logarithms): one row for each
    row of df, other columns left out.  A null or empty text has no words and
    scores 0; a null id stays null; repeated rows count, and score, each for
    itself; an empty table gives no rows.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = staged(blocks_of(df, id_col, text_col), "blocks")
    total = blocks.agg(F.sum("words")).first()[0] or 0
    return scores(blocks, totals(explode(blocks, buckets), buckets), total)


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores(documents(spark, sf_dir))
    mean = F.round(F.col("log_score") / F.nullif(F.col("n_tokens"), F.lit(0)), 6)
    return found.select("doc_id", "n_tokens", "n_backoff", mean.alias("mean_log_score"))


OP2_SQL = r"""
with texts as (
  select row_number() over () as row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from documents
), said as (
  select row, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from texts
), context as (
  select row, i, word as w, lag(word, 1) over place as v, lag(word, 2) over place as u from said window place as (partition by row order by i)
), counted as (
  select row, i, v, u, count(*) over () as total, count(*) over (partition by w) as one,
         case when v is not null then count(*) over (partition by v, w) else 0 end as two,
         case when u is not null then count(*) over (partition by u, v, w) else 0 end as three
  from context
), histories as (
  select *, lag(one) over place as one_before, lag(two) over place as two_before from counted window place as (partition by row order by i)
), scored as (
  select row, case when three >= 2 then ln(three) - ln(two_before)
                   when two >= 2 then ln(two) - ln(one_before) + case when u is not null then ln(0.4::double) else 0 end
                   else ln(one) - ln(total) + case when v is not null then ln(0.4::double) else 0 end + case when u is not null then ln(0.4::double) else 0 end
              end as score,
         ((v is not null and two < 2) or (u is not null and three < 2))::int as back
  from histories
), summed as (
  select row, count(*) as n_tokens, sum(back) as n_backoff, sum(score) as score from scored group by row
)
select doc_id, coalesce(n_tokens, 0)::bigint as n_tokens, coalesce(n_backoff, 0)::bigint as n_backoff,
       round(score / n_tokens, 6) as mean_log_score
from texts left join summed using (row)
"""
