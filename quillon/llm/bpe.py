"""Byte-pair encoding and decoding with a given vocabulary.

Merging: the symbols of a word form a doubly linked list, and a priority queue
holds the mergeable neighbours by (rank, place).  An entry popped after one of
its symbols was merged away or grew is stale and skipped.  Decoding joins the
vocabulary's strings with single spaces, as a tokenizer without a decoder does.

The vocabulary file is a parameter; it is opened on the executors, where the
tokenizer package is installed, and never copied.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import sys
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import documents, map_texts

#: Runs of text, and pieces of them, that a task remembers in each of two generations.
CACHE_RUNS, CACHE_WORDS = 60_000, 150_000
#: Longer words are encoded but not remembered.
CACHE_LENGTH = 64

#: Marks that, after letters, are a piece of their own.
CLOSING = frozenset(".,;:!?")

#: The printable stand-ins of bytes in a byte-level vocabulary are these ranges, all other bytes follow from 256 on.
PRINTABLE = ((33, 126), (161, 172), (174, 255))


#: Ranges of letters and numbers that Unicode 16 added; unicodedata of Python 3.13 ends before them.
NEWER = {
    "L": (
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
        (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
        (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF),
        (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    ),
    "N": (
        (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
        (0x1E5F1, 0x1E5FA),
    ),
}


#: Capital letters that unicodedata of Python 3.13 does not know, first and last, and the small letter of the first.
CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
SMALL = {c: chr(small + c - first) for first, last, small in CAPITALS for c in range(first, last + 1)}

#: Marks that Unicode added after version 9, whose normalisation the tokenizers library has: it takes them for
#: characters that neither move nor compose.  The last is the one vowel sign that composes since.
UNMOVED = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50),
    (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x1193D, 0x1193E),
    (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42),
    (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136),
    (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF), (0x11930, 0x11930),
)
_UNMOVED = regex.compile("([" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in UNMOVED) + "])")


def normal(text: str) -> str:
    """NFC and small letters, as the tokenizers library has them: its tables are of other Unicode versions than Python's."""
    if text.isascii():
        return text.lower()
    text = "".join(unicodedata.normalize("NFC", part) for part in _UNMOVED.split(text))
    # Letter by letter where the place in a word would matter to str.lower().
    text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
    return text.translate(SMALL) if max(text) > "\u1c88" else text


def byte_symbols() -> list[str]:
    plain = {b for first, last in PRINTABLE for b in range(first, last + 1)}
    out, extra = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


@lru_cache(maxsize=4)
def letters(kind: str) -> str:
    """The inside of a character class: all of a general category.  Spelled out, as the Unicode version of the regex
    module is ahead of the tokenizers library's and takes letters of newer scripts for letters."""
    runs: list[list[int]] = []
    for i in range(sys.maxunicode + 1):
        if unicodedata.category(chr(i))[0] == kind:
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in [*runs, *NEWER.get(kind, ())])


class Memory:
    """What was asked for lately, in two generations: a full young one takes the place of the old one, whose entries are
    young again when they are asked for."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        """Of the old generation, where the young one hasn't got it."""
        if (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            # Whoever holds the young dictionary keeps it.
            self.old = dict(self.young)
            self.young.clear()
        self.young[key] = value

    def clear(self) -> None:
        self.old = {}
        self.young.clear()


class WordBPE:
    """Encoder and decoder for a vocabulary whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.final = [self.vocab[s + self.suffix] for s in symbols]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.latin = regex.compile(split["pattern"]["Regex"])
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\p{L}", letters("L")).replace(r"\p{N}", letters("N")))
        self.special = regex.compile("|".join(map(regex.escape, self.added)) or "(?!)")
        self.cache, self.merged = Memory(CACHE_RUNS), Memory(CACHE_WORDS)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one piece, from its bytes."""
        ids = [self.inner[b] for b in word[:-1]] + [self.final[word[-1]]]
        n = len(ids)
        if n == 1:
            return ids
        after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if found := self.merges.get((ids[i], ids[i + 1])):
                heap.append((found[0], i, found[1], ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := self.merges.get((made, ids[k])):
                    heapq.heappush(heap, (found[0], i, found[1], made, ids[k]))
            if (h := before[i]) >= 0 and (found := self.merges.get((ids[h], made))):
                heapq.heappush(heap, (found[0], h, found[1], ids[h], made))
        return [x for x in ids if x >= 0]

    def split(self, text: str) -> list[str]:
        """Pieces of a normalised text."""
        if text.isalpha():
            return [text]
        if text[-1:] in CLOSING and text[:-1].isalpha():
            return [text[:-1], text[-1]]
        # Unicode versions agree on the first blocks, and the short pattern is quicker.
        return (self.latin if max(text, default="") < "\u0250" else self.pieces).findall(text)

    def plain(self, text: str) -> list[int]:
        """Ids of text without added tokens."""
        out: list[int] = []
        young, merged = self.merged.young.get, self.merged
        for piece in self.split(normal(text)):
            if (ids := young(piece)) is None and (ids := merged.get(piece)) is None:
                ids = tuple(self.merge(piece.encode()))
                if len(piece) <= CACHE_LENGTH:
                    merged.put(piece, ids)
            out += ids
        return out

    def chunk(self, raw: bytes) -> list[int]:
        """Ids of a run without ASCII white space; added tokens are found before anything is normalised."""
        text, at, out = raw.decode("utf-8", "replace"), 0, []
        for hit in self.special.finditer(text) if not text.isalpha() else ():
            out += self.plain(text[at : hit.start()])
            out.append(self.added[hit[0]])
            at = hit.end()
        return out + self.plain(text[at:])

    def known(self, raw: bytes) -> tuple[bytes, str]:
        """Packed ids of a run, and its decoded text with the space that follows."""
        if found := self.cache.get(raw):
            return found
        ids = self.chunk(raw)
        found = struct.pack(f"<{len(ids)}I", *ids), self.decode(ids) + " " if ids else ""
        if len(raw) <= CACHE_LENGTH:
            self.cache.put(raw, found)
        return found

    def encode(self, text: bytes) -> tuple[int, bytes, str]:
        """Count, ids as little-endian unsigned 32-bit integers, and decoded text.

        White space ends every piece, so a text is the concatenation of its
        runs; bytes.split() splits at ASCII white space only.
        """
        cache, known = self.cache.young.get, self.known
        parts = [cache(raw) or known(raw) for raw in text.split()]
        if not parts:
            return 0, b"", ""
        ids, texts = map(list, zip(*parts))
        packed = b"".join(ids)
        return len(packed) // 4, packed, "".join(texts)[:-1]

    def forget(self) -> None:
        self.cache.clear()
        self.merged.clear()

    def decode(self, ids: list[int]) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in ids])


@lru_cache(maxsize=4)
def loaded(path: str) -> WordBPE:
    return WordBPE(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded: one
    row for each row of df, repeated rows included; other columns are left out.
    A null or empty text has no tokens and decodes to an empty text; a null id
    stays null.  Work is row by row: no shuffle, and no group that could grow.
    """
    vocabulary = vocabulary or default_vocabulary()

    def work(ids: list, texts: list[bytes]) -> list[list]:
        codec = loaded(vocabulary)
        n, packed, decoded = [], [], []
        for text in texts:
            a, b, c = codec.encode(text)
            n.append(a)
            packed.append(b)
            decoded.append(c)
        return [ids, n, packed, decoded]

    return map_texts(df, id_col, text_col, work, "doc_id long, n_tokens long, ids binary, decoded string", lambda: loaded(vocabulary).forget())


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, ids: bool = False) -> DataFrame:
    """As encode_decode(), with digests of ids and decoded text taken in the same pass: doc_id, n_tokens, ids_sha256,
    decoded_sha256, and the ids themselves if asked for."""
    vocabulary = vocabulary or default_vocabulary()

    def work(keys: list, texts: list[bytes]) -> list[list]:
        codec = loaded(vocabulary)
        out: list[list] = [[] for _ in range(3 + ids)]
        for text in texts:
            count, packed, decoded = codec.encode(text)
            values = (count, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), packed)
            for column, value in zip(out, values):
                column.append(value)
        return [keys, *out]

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    return map_texts(df, id_col, text_col, work, schema, lambda: loaded(vocabulary).forget())


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
