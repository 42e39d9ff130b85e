"""Word shingles of texts as sorted 64-bit hashes, and the cells of a binary trie over them."""

from __future__ import annotations

import numpy as np
import xxhash

STEP = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.empty(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits (a public finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of so many words, A-Z lower-cased; fewer words make one run, none no run."""
    found = text.lower().split()  # of bytes: ASCII letters and white space only
    n = len(found)
    if not n:
        return EMPTY
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    with np.errstate(over="ignore"):
        size = min(n, words)
        out = hashes[: n - size + 1].copy()
        for k in range(1, size):
            out = out * STEP + hashes[k : n - size + 1 + k]
        # A short text's only run must not equal a full one.
        out = mixed(out + np.uint64(words - size))
    return np.unique(out)


def set_hash(shingles: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


class Bound:
    """What a link says of sets x and y: percent * union <= 100 * intersection.  With w = |x| + |y| and d the size of
    their symmetric difference this is (100 + percent) * d <= (100 - percent) * w, additive over parts of the universe."""

    def __init__(self, percent: int):
        self.percent = percent
        self.less, self.more = 100 - percent, 100 + percent
        #: Sets of up to same / 2 elements each that are linked are equal.
        self.same = -(-self.more // self.less) - 1
        self.small = self.same // 2
        #: A linked pair with w > same has a side of at least this size in either set.
        self.parent = -(-(self.same + 1) * percent // self.more)

    def difference(self, w):
        """The largest symmetric difference of linked sets."""
        return self.less * w // self.more


def cells(shingles: np.ndarray, document: np.ndarray, bound: Bound) -> tuple[np.ndarray, ...]:
    """Signatures of trie cells such that any two linked, different sets share one.

    shingles: those of several documents one after the other, each sorted.  The
    trie halves the universe of hashes again and again.  Where a cell meets the
    additive form of the link condition, one of its halves that isn't empty
    does; followed from the whole universe, this ends in a cell where both sets
    together have at most same elements, and there they are equal, while in the
    cell above they have more.  So a document's signatures are its cells of 1
    to small elements below a cell of at least parent elements.

    Returns document, signature (of depth and content), and of the cell two
    above, on the same path, its number of elements and 32 parities of them:
    the condition holds there too, and parities differ in no more places than
    sets do.  Then the cell's depth and its smallest shingle.
    """
    value = mixed(shingles + STEP)
    parity = np.uint32(1) << (shingles & np.uint64(31)).astype(np.uint32)
    above = further = None  # size and parities of the cell of each shingle, one and two levels up
    out: list[tuple] = []
    depth = 0
    with np.errstate(over="ignore"):
        while len(shingles) and depth < 64:
            prefix = shingles >> np.uint64(64 - depth) if depth else np.zeros(len(shingles), np.uint64)
            first = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (document[1:] != document[:-1]))))
            size = np.diff(np.append(first, len(shingles)))
            bits = np.bitwise_xor.reduceat(parity, first)
            here = np.repeat(size, size), np.repeat(bits, size)
            if depth:
                few = size <= bound.small
                at = first[few]
                content = np.add.reduceat(value, first)[few]
                out.append((document[at], mixed(content + np.uint64(depth) * STEP), further[0][at], further[1][at], np.full(len(at), depth), shingles[at]))
            further = above or here
            keep = here[0] >= bound.parent
            above = here[0][keep], here[1][keep]
            further = further[0][keep], further[1][keep]
            shingles, document, value, parity = shingles[keep], document[keep], value[keep], parity[keep]
            depth += 1
    if not out:
        return np.empty(0, np.int64), EMPTY, np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.int64), EMPTY
    return tuple(np.concatenate(x) for x in zip(*out))


def probes(shingles: np.ndarray, signature: int, depth: int, least: int, bound: Bound) -> np.ndarray:
    """Finer signatures of a cell that very many sets share: any two linked sets that share it on their path share one.

    In the cell two above, linked sets of a and b elements differ in at most
    difference(a + b).  Dealt into one group more than that, they agree in a
    whole group.  b isn't known here, but is near a, so each number of groups
    that is possible has its signatures.
    """
    up = max(depth - 2, 0)
    inside = shingles
    if up:
        shift = np.uint64(64 - up)
        prefix = np.uint64(least) >> shift
        inside = shingles[np.searchsorted(shingles >> shift, prefix) : np.searchsorted(shingles >> shift, prefix, "right")]
    a, out = len(inside), []
    value, dealt = mixed(inside + STEP), mixed(inside ^ STEP)
    with np.errstate(over="ignore"):
        for most in range(bound.difference(a + -(-a * bound.percent // 100)), bound.difference(a + a * 100 // bound.percent) + 1):
            content = np.zeros(most + 1, np.uint64)
            np.add.at(content, (dealt % np.uint64(most + 1)).astype(np.int64), value)
            group = np.arange(most + 1, dtype=np.uint64) + np.uint64(most << 32)
            out.append(mixed(np.uint64(signature) + mixed(group + STEP) + mixed(content)))
    return np.concatenate(out)
