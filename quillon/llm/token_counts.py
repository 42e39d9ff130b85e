"""Token counts of the sections or fields of documents, each document encoded once as a whole.

The tokenizer's offset mapping gives every token a span of characters (that of
a token within a character is the character).  An interval join of tokens and
sections, both in order, attributes them by binary search; a token that crosses
a boundary goes by an explicit rule:

    most   the section that has most of its characters, the earlier of equals
    first  the section of its first character
    last   the section of its last character
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import documents, map_texts

RULES = ("most", "first", "last")
#: Between the fields of a document; it belongs to the field before it.
BETWEEN = "\n"


class Encoder:
    """A byte-level vocabulary of ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("quillon", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def spans(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a whole text, and first and last + 1 character of each."""
        ids = np.asarray(self.encoding.encode_to_numpy(text.decode("utf-8", "replace"), disallowed_special=()), np.int64)
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        if not text.isascii():
            leads = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
            before = np.concatenate(([0], np.cumsum(leads)))
            starts, ends = before[starts + 1] - 1, before[ends]
        return ids, starts, ends


@lru_cache(maxsize=4)
def loaded(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many cross a boundary.  bounds: first characters of the sections, from 0."""
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    # A section without characters begins where the next one does, and is passed over.
    crossing = np.flatnonzero(last > first)
    owner = last.copy() if rule == "last" else first.copy()
    if rule == "most":
        for i in crossing:
            edges = np.concatenate(([starts[i]], bounds[first[i] + 1 : last[i] + 1], [ends[i]]))
            owner[i] = first[i] + int(np.diff(edges).argmax())
    return np.bincount(owner, minlength=len(bounds)), len(crossing)


def line_starts(text: bytes) -> np.ndarray:
    """Characters at which lines begin; a line feed belongs to the line that it ends."""
    raw = np.frombuffer(text, np.uint8)
    after = np.flatnonzero(raw == 10) + 1
    if not text.isascii():
        after = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[after]
    return np.concatenate(([0], after))


def section_tokens(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "most", vocabulary: tuple[str, str] | None = None
) -> DataFrame:
    """Tokens by line of every whole text.

    Returns doc_id, n_tokens, n_sections, n_crossing, section_tokens (their sum
    is n_tokens): one row for each row of df, repeated rows included, other
    columns left out.  A null or empty text has one section without tokens; a
    null id stays null.  Row by row, without a shuffle.  vocabulary: the file of
    ranks and the pattern that splits texts.
    """
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")
    path, pattern = vocabulary or default_vocabulary()

    def work(ids: list, texts: list[bytes]) -> list[list]:
        encoder = loaded(path, pattern)
        out: list[list] = [[] for _ in range(4)]
        for text in texts:
            tokens, starts, ends = encoder.spans(text)
            each, crossing = attribute(starts, ends, line_starts(text), rule)
            for column, value in zip(out, (len(tokens), len(each), crossing, each)):
                column.append(value)
        return [ids, *out[:3], pa.array(out[3], pa.list_(pa.int64()))]

    return map_texts(df, id_col, text_col, work, "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>")


def field_tokens(
    df: DataFrame, fields: list[str], id_col: str = "doc_id", rule: str = "most", vocabulary: tuple[str, str] | None = None
) -> DataFrame:
    """Tokens of each field of documents that are their fields joined by line feeds: doc_id, n_tokens, n_crossing,
    field_tokens in the order of fields.  A null field is an empty one; a field's line feeds do not end it."""
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")
    path, pattern = vocabulary or default_vocabulary()
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    # The lengths of the fields lead the text: names and values of other columns can't interfere.
    lengths = F.concat_ws(",", *[F.length(v).cast("string") for v in values])
    joined = F.concat(lengths, F.lit(BETWEEN), F.concat_ws(BETWEEN, *values))

    def work(ids: list, texts: list[bytes]) -> list[list]:
        encoder = loaded(path, pattern)
        out: list[list] = [[] for _ in range(3)]
        for text in texts:
            head, _, body = text.partition(b"\n")
            sizes = [int(n) + 1 for n in head.split(b",")]
            tokens, starts, ends = encoder.spans(body)
            each, crossing = attribute(starts, ends, np.cumsum([0, *sizes[:-1]]), rule)
            for column, value in zip(out, (len(tokens), crossing, each)):
                column.append(value)
        return [ids, *out[:2], pa.array(out[2], pa.list_(pa.int64()))]

    schema = "doc_id long, n_tokens long, n_crossing long, field_tokens array<long>"
    return map_texts(df.select(F.col(id_col).alias("doc_id"), joined.alias("text")), "doc_id", "text", work, schema)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(documents(spark, sf_dir))
