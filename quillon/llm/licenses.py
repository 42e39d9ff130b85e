"""License scan by ordered signature rules.

Each text becomes its lower-case words joined by spaces.  An Aho-Corasick
automaton finds the rules' keywords in one pass; only rules whose keyword
occurs run their regex.  Detections are taken by falling priority, then length,
then place, and one that lies inside a detection already taken is dropped.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import documents, map_texts
from quillon.llm.license_rules import rules

#: A-Z lower-cased, and every ASCII byte but digits and letters a space.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))
#: Base phrases and their labels.
BASE = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@lru_cache(maxsize=1)
def compiled() -> tuple[ahocorasick.Automaton, list[tuple[int, str, re.Pattern]]]:
    by_keyword: dict[str, list[int]] = {}
    table = []
    for i, (priority, label, keyword, pattern) in enumerate(rules()):
        by_keyword.setdefault(keyword, []).append(i)
        table.append((priority, label, re.compile(rb"(?<= )(?:" + pattern.encode() + rb")(?= )")))
    automaton = ahocorasick.Automaton()
    for keyword, found in by_keyword.items():
        automaton.add_word(keyword, tuple(found))
    automaton.make_automaton()
    return automaton, table


class Furthest:
    """Largest end of the intervals added so far that begin at or before a place (a Fenwick tree of maxima)."""

    def __init__(self, starts: list[int]):
        self.place = {s: i + 1 for i, s in enumerate(sorted(set(starts)))}
        self.tree = [-1] * (len(self.place) + 1)

    def add(self, start: int, end: int) -> None:
        i = self.place[start]
        while i < len(self.tree):
            self.tree[i] = max(self.tree[i], end)
            i += i & -i

    def upto(self, start: int) -> int:
        i, best = self.place[start], -1
        while i:
            best = max(best, self.tree[i])
            i -= i & -i
        return best


def outermost(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (start, end, priority, rule), those not inside one that comes before them by priority, length, place, rule."""
    seen, kept = Furthest([d[0] for d in found]), []
    for d in sorted(found, key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
        if seen.upto(d[0]) < d[1]:
            kept.append(d)
            seen.add(d[0], d[1])
    return kept


def scan(text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, int, str]]]:
    """Number of words; base places (word, label); detections left (first word, words, priority, label) by place."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    automaton, table = compiled()
    # Bytes as Latin-1: keywords are ASCII and places stay those of the bytes.
    candidates = {i for _, group in automaton.iter(joined.decode("latin-1")) for i in group}
    base = []
    if candidates:
        for phrase, label in BASE:
            at = joined.find(b" " + phrase + b" ")
            while at >= 0:
                base.append((at, label))
                at = joined.find(b" " + phrase + b" ", at + 1)
    found = []
    for i in sorted(candidates):
        priority, _, pattern = table[i]
        found += [(m.start(), m.end(), priority, i) for m in pattern.finditer(joined)]
    kept = sorted(outermost(found)) if found else []
    # Places in words: count the spaces before, going forward once.
    stops = sorted({at for at, _ in base} | {d[0] - 1 for d in kept})
    index, at, n = {}, 0, 0
    for stop in stops:
        n += joined.count(b" ", at, stop)
        index[stop], at = n, stop
    places = sorted((index[at], label) for at, label in base)
    return len(words), places, [(index[s - 1], joined.count(b" ", s, e) + 1, p, table[i][1]) for s, e, p, i in kept]


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan every whole text.

    Returns doc_id, n_words, n_base (places of the base phrases), first_word and
    last_word (smallest and largest such place in words from 0, else null),
    base_labels, labels (base and surviving detections; both distinct, sorted,
    comma-joined), score (the highest priority among what was found, over 100),
    detections (label@first+words, by place): one row per row, repeated rows
    included.  A null or empty text has no words and no labels; a null id stays
    null; other columns are left out.
    """
    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, detections array<string>"
    )

    def work(ids: list, texts: list[bytes]) -> list[list]:
        out: list[list] = [[] for _ in range(8)]
        for text in texts:
            n, base, found = scan(text)
            own = {label for _, label in base}
            values = (
                n,
                len(base),
                base[0][0] if base else None,
                base[-1][0] if base else None,
                ",".join(sorted(own)),
                ",".join(sorted(own | {d[3] for d in found})),
                max((d[2] for d in found), default=0) / 100.0,
                [f"{label}@{first}+{length}" for first, length, _, label in found],
            )
            for column, value in zip(out, values):
                column.append(value)
        return [ids, *out]

    return map_texts(df, id_col, text_col, work, schema)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
