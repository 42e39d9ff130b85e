"""Counts of a text that quality rules and the quality classifier read."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: ASCII white space, symbols, and the other marks.
WHITE = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
SYMBOLS = b"#*$%&|<>"
MARKS = b"!\"'()+,-./:;=?@[\\]^_`{}~"
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct",
    "longest",
)
RATES = (
    "words", "mean_word", "symbol_rate", "mark_rate", "upper_rate", "digit_rate", "repeat_rate", "dup_line_rate", "distinct_rate",
    "line_words", "longest",
)


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words in runs of window words found twice or more, the first time included."""
    n = len(words)
    if n <= window:
        return 0
    # Equal words have equal hashes within a process, and no hash leaves it.
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    with np.errstate(over="ignore"):
        runs = hashes[: n - window + 1].copy()
        for k in range(1, window):
            runs = (runs ^ (runs >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - window + 1 + k]
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    twice = np.zeros(n - window + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(window):
        covered[k : n - window + 1 + k] |= twice
    return int(covered.sum())


def counts(text: bytes, words: list[bytes] | None = None) -> tuple[int, ...]:
    """COUNTS of a text: words are runs without ASCII white space."""
    if words is None:
        words = text.split()
    seen: set[bytes] = set()
    repeats = 0
    lines = text.split(b"\n")
    for line in lines:
        if line in seen:
            repeats += not (line.isspace() or not line)
        else:
            seen.add(line)
    return (
        len(words),
        len(text.decode("utf-8", "replace")) - sum(map(text.count, WHITE)),
        len(text) - len(text.translate(None, SYMBOLS)),
        repeats,
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, UPPER)),
        len(text) - len(text.translate(None, DIGITS)),
        len(text) - len(text.translate(None, MARKS)),
        len(set(words)),
        max(map(len, words), default=0),
    )


def rates(c: Iterable[float]) -> tuple[float, ...]:
    """RATES from COUNTS."""
    words, chars, symbols, dup, repeat, lines, upper, digits, marks, distinct, longest = c
    n, m = max(words, 1), max(chars, 1)
    return words, chars / n, symbols / m, marks / m, upper / m, digits / m, repeat / n, dup / max(lines, 1), distinct / n, words / max(lines, 1), longest
