"""Exact Jaccard self-join of word-shingle sets, and its components.

Equal sets are one class.  A join of all classes in the metric space of
Jaccard distance takes three steps, none of which can lose a link:

1. Cells.  Documents of no common shingle are all at distance 1 of each other
   and of every document taken as a pivot, so triangle inequality cannot part
   them.  A binary trie over shingle hashes does (shingles.cells): linked sets
   share a cell with equal content, along a path on which the link condition
   holds in every cell.  Classes that share such a cell, and pass the sizes and
   parities of the cell two above, are candidates; a cell emits a spanning
   forest of its candidate graph, never its pairs.  A cell that a phrase puts
   into very many documents is divided again by what linked sets must share of
   the cell two above (shingles.probes).
2. Regions.  The components of the candidates are families; within one,
   distances spread.  One beyond a block's size gets pivots, more the larger it
   is, far apart from one another.  A member's home is the region of its
   nearest pivot (a Voronoi region); it visits the region of another pivot
   where its distance to that one is at most twice the link radius more (by
   triangle inequality no link leaves these windows), each pair of regions
   once, in the region of the smaller number.  Regions of homes and visitors
   are divided again in the same way, as long as that makes work less.
3. Blocks.  The members of a region meet in one block, or those of a dense one
   in pairs of blocks of bounded size, where intersections are counted exactly.
   A block returns each member's number of links and a spanning forest.

Shuffled are signatures, then only the sets of candidate classes, a set once
for each region and block that it is in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quillon.llm.common import bounded_batches, column, documents, groups, map_texts, staged, text_bytes, typed
from quillon.llm.components import components, lookup
from quillon.llm.filters import possible, shared_bloom
from quillon.llm.shingles import Bound, cells, mixed, probes, set_hash, shingle_set

WORDS = 4
PERCENT = 85
#: Classes in a block, and their shingles (4 MB).  Documents whose cells are found together.  Entries of a matrix of counts.
BLOCK, BLOCK_SHINGLES, TOGETHER, ENTRIES = 128, 1 << 19, 200, 1 << 21
#: Pivots of a region at most, and members that they are chosen from.  Levels of regions; the work that is left of a region's if it is worth dividing.
PIVOTS, DRAWN, LEVELS, WORTH = 16, 32, 20, 0.7
#: Rows that a task reads before it finds candidates.  Rows, and comparisons, beyond which a cell is divided again.
READ, HOT_ROWS, HOT_WORK = 1 << 18, 1 << 16, 1 << 22
SIZE_BITS, ABOVE_BITS = 24, 8


def classes(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, n_shingles, class: the hash of the set, null where the set is empty or the row has no id."""

    def work(ids: list, texts: list[bytes]) -> list[list]:
        sets = [shingle_set(t, words) for t in texts]
        return [ids, [len(s) for s in sets], [set_hash(s) if len(s) and i is not None else None for i, s in zip(ids, sets)]]

    return map_texts(df, id_col, text_col, work, "doc_id long, n_shingles long, class long")


def set_class(words: int, test: Callable[[pa.Array], np.ndarray] | None) -> Callable[[Column, Column], Column]:
    """Of hashes and texts a struct: asked, whether test (of filters.tester; None holds for all) holds for the hash, and
    class of the text as classes() has it, null where the set is empty or isn't asked for.

    Both in one, and once a row: each further Python step of a task is a worker more, with its memory.
    """

    @arrow_udf("struct<asked:boolean,class:bigint>")
    def of(hashes: pa.Array, texts: pa.Array) -> pa.Array:
        asked = np.ones(len(hashes), bool) if test is None else test(hashes)
        found: list[int | None] = [None] * len(hashes)
        for i, t in zip(np.flatnonzero(asked).tolist(), text_bytes(texts.filter(pa.array(asked)))):
            s = shingle_set(t, words)
            found[i] = set_hash(s) if len(s) else None
        return pa.StructArray.from_arrays([pa.array(asked), pa.array(found, pa.int64())], names=["asked", "class"])

    return of.asNondeterministic()


def facts_of(size: np.ndarray, above: np.ndarray, parity: np.ndarray) -> np.ndarray:
    return (parity.astype(np.int64) << 32) | (np.minimum(above, (1 << ABOVE_BITS) - 1) << SIZE_BITS) | np.minimum(size, (1 << SIZE_BITS) - 1)


def signatures(df: DataFrame, id_col: str, text_col: str, words: int, bound: Bound, hot: DataFrame | None = None) -> DataFrame:
    """signature, class, facts for every class that a task sees, once a task.  hot: signatures to divide again; then finer
    ones for these alone."""
    schema = "signature long, class long, facts long"
    bounded_batches(df.sparkSession)
    bloom = None if hot is None else shared_bloom(hot, "signature")
    known = None if bloom is None else df.sparkSession.sparkContext.broadcast(bloom)
    divided = hot is not None

    def found(sets: list[np.ndarray], hashes: list[int]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets])
        document, signature, above, parity, depth, least = cells(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), bound)
        facts, key = facts_of(sizes[document], above, parity), np.array(hashes, np.int64)[document]
        if divided:
            # Where the filter would be too large, every cell is divided.
            at = np.flatnonzero(known.value.contains(mixed(signature))) if known is not None else np.arange(len(signature))
            finer = [probes(sets[document[i]], int(signature[i]), int(depth[i]), int(least[i]), bound) for i in at.tolist()]
            each = np.repeat(at, [len(f) for f in finer])
            signature, key, facts = np.concatenate([np.empty(0, np.uint64), *finer]), key[each], facts[each]
        return pa.RecordBatch.from_arrays([pa.array(signature.view(np.int64)), pa.array(key), pa.array(facts)], names=["signature", "class", "facts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sets, hashes, n = [], [], 0
            for text in text_bytes(batch.column(0)):
                s = shingle_set(text, words)
                if len(s) and (h := set_hash(s)) not in seen:
                    seen.add(h)
                    sets.append(s)
                    hashes.append(h)
                    n += len(s)
                if len(sets) >= TOGETHER or n >= TOGETHER * 1000:
                    yield found(sets, hashes)
                    sets, hashes, n = [], [], 0
            if sets:
                yield found(sets, hashes)

    return df.where(F.col(id_col).isNotNull()).select(F.col(text_col).cast("string")).mapInArrow(typed(run, schema), schema)


def agree(one: int, many: np.ndarray, bound: Bound) -> np.ndarray:
    """Which of many facts allow a link with one."""
    size, sizes = one & ((1 << SIZE_BITS) - 1), many & ((1 << SIZE_BITS) - 1)
    most = (1 << ABOVE_BITS) - 1
    above, aboves = (one >> SIZE_BITS) & most, (many >> SIZE_BITS) & most
    near = 100 * np.minimum(sizes, size) >= bound.percent * np.maximum(sizes, size)
    apart = np.bitwise_count(((many ^ one) >> 32).astype(np.uint32))
    return near & ((apart <= bound.difference(above + aboves)) | (np.maximum(aboves, above) == most))


def forest(first: int, last: int, keys: np.ndarray, facts: np.ndarray, bound: Bound, work: float) -> tuple[list[tuple[int, int]], bool]:
    """A spanning forest of the candidate graph of one cell, in memory that is linear in its classes, and whether it is
    whole: it isn't where that would take more than so many comparisons."""
    out, left = [], np.arange(first, last)
    while len(left) > 1:
        root, left, queue = left[0], left[1:], [left[0]]
        while queue and len(left):
            if (work := work - len(left)) < 0:
                return out, False
            hit = agree(int(facts[queue.pop()]), facts[left], bound)
            new, left = left[hit], left[~hit]
            queue += new.tolist()
            out += [(int(keys[root]), k) for k in keys[new].tolist()]
    return out, True


def whole_cells(batches: Iterator[pa.RecordBatch], most: float) -> Iterator[tuple[np.ndarray, ...] | int]:
    """signature, class and facts of whole cells, many together, from batches sorted by signature; of a cell of more rows
    than most only the signature."""
    held, n, passed = [], 0, None
    for batch in chain(batches, [None]):
        if batch is not None:
            part = [batch.column(i).to_numpy() for i in range(3)]
            if passed is not None:
                start = int(np.searchsorted(part[0], passed, "right"))
                part = [x[start:] for x in part]
            if not len(part[0]):
                continue
            passed = None
            held.append(part)
            n += len(part[0])
            if n < READ:
                continue
        if not held:
            continue
        every = [np.concatenate(x) for x in zip(*held)]
        cut = int(np.searchsorted(every[0], every[0][-1])) if batch is not None else len(every[0])
        if cut:
            yield tuple(x[:cut] for x in every)
        rest = [x[cut:] for x in every]
        held, n = ([rest], 0) if len(rest[0]) else ([], 0)
        if len(rest[0]) > most:
            passed = int(rest[0][0])
            yield passed
            held = []


def candidates(found: DataFrame, bound: Bound, last: bool = False) -> DataFrame:
    """a, b, hot: edges of the candidate forests of cells, and, with hot, the mixed signatures of cells that are to be divided
    again, as a.  Spark sorts; a task holds one cell at a time, or some.  With last, no cell is too large."""
    rows, work = (np.inf, np.inf) if last else (HOT_ROWS, HOT_WORK)

    def edges_of(signature: np.ndarray, key: np.ndarray, facts: np.ndarray) -> tuple[np.ndarray, list[int]]:
        order = np.lexsort((key, signature))
        signature, key, facts = signature[order], key[order], facts[order]
        new = np.concatenate(([True], (signature[1:] != signature[:-1]) | (key[1:] != key[:-1])))
        signature, key, facts = signature[new], key[new], facts[new]
        first = np.flatnonzero(np.concatenate(([True], signature[1:] != signature[:-1])))
        size = np.diff(np.append(first, len(signature)))
        two = first[size == 2]
        hit = two[agree_pairs(facts[two], facts[two + 1], bound)]
        edges, hot = [np.stack([key[hit], key[hit + 1]], axis=1)], []
        for i in np.flatnonzero(size > 2):
            some, whole = forest(first[i], first[i] + size[i], key, facts, bound, work)
            if some:
                edges.append(np.array(some, np.int64))
            if not whole:
                hot.append(int(signature[first[i]]))
        return np.unique(np.concatenate(edges), axis=0), hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_cells(batches, rows):
            pairs, hot = (np.empty((0, 2), np.int64), [part]) if isinstance(part, int) else edges_of(*part)
            a = np.concatenate([pairs[:, 0], mixed(np.array(hot, np.int64).view(np.uint64)).view(np.int64)])
            b = np.concatenate([pairs[:, 1], np.zeros(len(hot), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) >= len(pairs))], names=["a", "b", "hot"])

    schema = "a long, b long, hot boolean"
    return found.repartition("signature").sortWithinPartitions("signature").mapInArrow(typed(run, schema), schema)


def all_candidates(df: DataFrame, id_col: str, text_col: str, words: int, bound: Bound) -> DataFrame:
    """a, b: edges whose components hold all links."""
    first = staged(candidates(signatures(df, id_col, text_col, words, bound), bound), "candidates")
    edges, hot = first.where("not hot").select("a", "b"), first.where("hot").select(F.col("a").alias("signature"))
    if hot.take(1):
        again = candidates(signatures(df, id_col, text_col, words, bound, hot), bound, last=True)
        edges = edges.unionAll(again.select("a", "b"))
    return edges


def agree_pairs(x: np.ndarray, y: np.ndarray, bound: Bound) -> np.ndarray:
    """agree() element by element."""
    mask, most = (1 << SIZE_BITS) - 1, (1 << ABOVE_BITS) - 1
    near = 100 * np.minimum(x & mask, y & mask) >= bound.percent * np.maximum(x & mask, y & mask)
    a, b = (x >> SIZE_BITS) & most, (y >> SIZE_BITS) & most
    apart = np.bitwise_count(((x ^ y) >> 32).astype(np.uint32))
    return near & ((apart <= bound.difference(a + b)) | (np.maximum(a, b) == most))


def family_sets(df: DataFrame, id_col: str, text_col: str, words: int, members: DataFrame) -> DataFrame:
    """members (class, doc_id, ...) with set, sorted 64-bit hashes in binary.  Texts are found by a filter of the
    members' ids first, so that only those of candidates are shuffled."""
    maybe = possible(members, "doc_id")
    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # A merge join at every size: the filter, before its shuffle, and the sets, after it, are then never in one task, which
    # would have two Python workers.
    met = texts.where(maybe(F.xxhash64("doc_id"))).join(members.hint("merge"), "doc_id").select(*members.columns, "text")
    names, kept = [*members.columns, "set"], len(members.columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema) + ", set binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in text_bytes(batch.column(kept))]
            # A row that repeats the id with another text is another class.
            own = np.array([len(s) > 0 and set_hash(s) == h for s, h in zip(sets, batch.column("class").to_pylist())], bool)
            packed = pa.array([s.tobytes() for s, o in zip(sets, own) if o], pa.binary())
            rest = batch.filter(pa.array(own))
            yield pa.RecordBatch.from_arrays([*rest.columns[:kept], packed], names=names)

    return met.mapInArrow(typed(run, schema), schema)


def far_apart(sets: list[np.ndarray], most: int, radius: float) -> list[int]:
    """Numbers of at most so many sets, each in turn the farthest from those before it, none within the radius of another."""
    size, common = np.array([len(s) for s in sets]), overlaps(sets)
    distance = 1 - common / (size[:, None] + size[None, :] - common)
    chosen, nearest = [0], distance[0]
    while len(chosen) < most and nearest.max() > radius:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distance[chosen[-1]])
    return chosen


def homes(large: DataFrame, sets: DataFrame, bound: Bound) -> DataFrame:
    """large (region, class, mask, size, blocks) with home, the number of the nearest of its region's pivots, and visits,
    the smaller numbers of those whose region the member visits."""
    drawn = Window.partitionBy("region").orderBy(F.xxhash64("class", "region"), "class")
    chosen = large.withColumn("rank", F.row_number().over(drawn)).where(F.col("rank") <= DRAWN)
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    kept = ["region", "class", "mask", "size", "blocks"]
    part = F.pmod(F.xxhash64("class"), F.col("blocks"))
    rows = chosen.select(*kept, each.alias("part"), F.lit(0).alias("kind")).unionAll(large.select(*kept, part.alias("part"), F.lit(1).alias("kind")))
    rows = rows.join(sets.select("class", "set"), "class").select("region", "part", "kind", "class", "mask", "size", "blocks", "set")
    schema = "region long, class long, mask long, size long, home int, visits array<int>"
    radius = bound.less / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (region, _), found in groups(batches, 2):
            kinds, keys, packed = column(found, 2), column(found, 3), column(found, 7)
            # By class, so that all parts of a region number its pivots alike; repeated rows once.
            draws = [np.frombuffer(s, np.uint64) for _, s in sorted({k: s for t, k, s in zip(kinds, keys, packed) if t == 0}.items())]
            members = {k: (m, n, np.frombuffer(s, np.uint64)) for t, k, m, n, s in zip(kinds, keys, column(found, 4), column(found, 5), packed) if t}
            if not members:
                continue
            centres = [draws[i] for i in far_apart(draws, min(PIVOTS, max(2, column(found[:1], 6)[0])), radius)]
            size = np.array([len(p) for p in centres])
            universe = np.unique(np.concatenate(centres))
            inside = np.zeros((len(universe) + 1, len(centres)), np.uint8)
            for i, p in enumerate(centres):
                inside[np.searchsorted(universe, p), i] = 1
            out: list[list] = [[], []]
            for _, _, s in members.values():
                place = np.searchsorted(universe, s)
                place[universe[np.minimum(place, len(universe) - 1)] != s] = len(universe)
                common = inside[place].sum(axis=0, dtype=np.int64)
                distance = 1 - common / (size + len(s) - common)
                home = int(distance.argmin())
                out[0].append(home)
                out[1].append([i for i in range(home) if distance[i] - distance[home] <= 2 * radius + 1e-9])
            masks, sizes = [m for m, _, _ in members.values()], [n for _, n, _ in members.values()]
            columns = [pa.array([region] * len(members), pa.int64()), pa.array(list(members), pa.int64()), pa.array(masks, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out[0], pa.int32()), pa.array(out[1], pa.list_(pa.int32()))], names=["region", "class", "mask", "size", "home", "visits"])

    return rows.repartition("region", "part").sortWithinPartitions("region", "part", "kind").mapInArrow(typed(run, schema), schema)


def regions(members: DataFrame, sets: DataFrame, bound: Bound) -> DataFrame:
    """region, class, mask, blocks: where classes meet.  Members of a region whose masks have a common bit visit it together
    at some level, so another region has that pair."""
    work = members.select(F.col("family").alias("region"), "class", F.lit(0).cast("long").alias("mask"), F.col("size").cast("long").alias("size"))
    out, slim = None, ["region", "class", "mask", "blocks"]
    for level in range(LEVELS + 1):
        blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("long")
        large = work.groupBy("region").agg(blocks.alias("blocks")).where("blocks > 1")
        tagged = staged(lookup(work, "region", large, "region", "left"), "regions")
        done = tagged.where("blocks is null").withColumn("blocks", F.lit(1).cast("long"))
        large = tagged.where("blocks is not null")
        if level == LEVELS or not large.take(1):
            done = done.unionAll(large)
            return done.select(*slim) if out is None else out.unionAll(done.select(*slim))
        found = staged(homes(large, sets, bound), "homes")
        met = found.select("region", F.explode(F.concat(F.array("home"), F.col("visits"))).alias("pivot")).groupBy("region", "pivot").agg(F.count("*").alias("n"))
        whole = large.groupBy("region").agg(F.count("*").alias("n"))
        after = met.groupBy("region").agg(F.sum(F.col("n") * F.col("n")).alias("after"))
        worth = staged(whole.join(after, "region").where(F.col("after") <= WORTH * F.col("n") * F.col("n")).select("region", F.lit(True).alias("worth")), "worth")
        dense = lookup(large, "region", worth, "region", "left").where("worth is null")
        done = done.select(*slim).unionAll(dense.select(*slim))
        out = done if out is None else out.unionAll(done)
        visit = F.transform("visits", lambda i: F.struct(i.alias("pivot"), F.lit(1 << level).cast("long").alias("bit")))
        home = F.array(F.struct(F.col("home").alias("pivot"), F.lit(0).cast("long").alias("bit")))
        parts = lookup(found, "region", worth, "region").withColumn("to", F.explode(F.concat(home, visit)))
        work = staged(parts.select(F.xxhash64("region", "to.pivot", F.lit(level)).alias("region"), "class", F.col("mask").bitwiseOR(F.col("to.bit")).alias("mask"), "size"), "work")
    return out


def meetings(found: DataFrame, sets: DataFrame) -> DataFrame:
    """region, low, high, own, class, copies, mask, set: a row for each block pair that a class belongs to; own is its block."""
    own = F.pmod(F.xxhash64("class", F.lit(7)), F.col("blocks"))
    met = found.withColumn("own", own).join(sets.select("class", "copies", "set"), "class")
    other = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return other.select("region", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "class", "copies", "mask", "set")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, some columns of the incidence matrix at a time."""
    n = len(sets)
    element = np.concatenate(sets)
    member = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(element, kind="stable")
    element, member = element[order], member[order]
    place = np.cumsum(np.concatenate(([0], element[1:] != element[:-1])))
    out = np.zeros((n, n))
    width = max(1, ENTRIES // n)
    for start in range(0, int(place[-1]) + 1, width):
        a, b = np.searchsorted(place, (start, start + width))
        matrix = np.zeros((n, width), np.float32)
        matrix[member[a:b], place[a:b] - start] = 1
        out += matrix @ matrix.T
    return out.astype(np.int64)


def links(met: DataFrame, bound: Bound) -> DataFrame:
    """a, b, n: per block, members a with links there: b, one member of those connected with it, itself included, and n,
    the documents it is linked with."""
    schema = "a long, b long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), rows in groups(batches, 3):
            members = {k: x for k, *x in zip(*(column(rows, i) for i in (4, 3, 5, 6, 7)))}
            keys = np.array(sorted(members), np.int64)
            own, copies, mask = (np.array([members[k][i] for k in keys.tolist()], np.int64) for i in range(3))
            if len(keys) < 2 or (low != high and own.min() == own.max()):
                continue
            sets = [np.frombuffer(members[k][3], np.uint64) for k in keys.tolist()]
            common, size = overlaps(sets), np.array([len(s) for s in sets])
            linked = 100 * common >= bound.percent * (size[:, None] + size[None, :] - common)
            np.fill_diagonal(linked, False)
            linked &= (mask[:, None] & mask[None, :]) == 0
            if low != high:
                linked &= own[:, None] != own[None, :]
            root, left = np.arange(len(keys)), linked.any(axis=1)
            for i in np.flatnonzero(left):
                if left[i]:
                    reach, queue = np.zeros(len(keys), bool), [i]
                    reach[i] = True
                    while queue:
                        new = linked[queue.pop()] & ~reach
                        reach |= new
                        queue += np.flatnonzero(new).tolist()
                    root[reach], left[reach] = i, False
            have = linked.any(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(keys[have]), pa.array(keys[root[have]]), pa.array((linked @ copies)[have])], names=["a", "b", "n"])

    ordered = met.repartition("region", "low", "high").sortWithinPartitions("region", "low", "high")
    return ordered.mapInArrow(typed(run, schema), schema)


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, sets: bool = False) -> DataFrame:
    """Join documents whose shingle sets have percent * union <= 100 * intersection.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable by
    links, itself included), n_links (documents linked with it, equal ones
    included): one row for each row of df, other columns left out.  A null text
    or one without words has an empty set and is linked with nothing.  Rows
    that repeat an id are linked by their texts only; a row without an id takes
    no part and has a null component.  Sets are told apart by 64-bit hashes.

    With sets, also class, the hash of the row's set (null if it is empty or
    the row has no id), and first_class, that of the smallest pair of doc_id
    and class in its component.
    """
    bound = Bound(percent)
    slim = staged(classes(df, id_col, text_col, words), "classes")
    kinds = staged(slim.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("n_shingles").alias("size")), "kinds")
    families = components(all_candidates(df, id_col, text_col, words, bound))
    members = staged(families.select(F.col("node").alias("class"), F.col("label").alias("family")).join(kinds, "class"), "members")
    member_sets = staged(family_sets(df, id_col, text_col, words, members), "sets")
    found = staged(links(meetings(regions(members, member_sets, bound), member_sets), bound), "links")
    labels = components(found.select("a", "b"))
    firsts = labels.join(kinds, labels.node == kinds["class"]).groupBy("label").agg(F.min("doc_id").alias("first"), *([F.min(F.struct("doc_id", "class"))["class"].alias("first_class")] if sets else []))
    extra = ["first_class"] if sets else []
    linked = lookup(labels, "label", firsts, "label").select(F.col("node").alias("class"), "first", *extra)
    degrees = found.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    several = kinds.drop("size").join(linked, "class", "left").join(degrees, "class", "left").where("copies > 1 or first is not null")
    several = several.select("class", F.coalesce("first", "doc_id").alias("first"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), *extra)
    several = staged(several, "several").withColumnRenamed("class", "set_class")
    out = lookup(slim, "class", several, "set_class", "left")
    told = ["class", F.coalesce("first_class", "class").alias("first_class")] if sets else []
    return out.select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("component_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), *told)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))


OP7_SQL = r"""
with recursive worded as (
  select row_number() over () as row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from documents
), shingles as (
  select row, doc_id, unnest(list_distinct(case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
         else [array_to_string(words[i:i + 3], ' ') for i in range(1, len(words) - 2)] end)) as shingle
  from worded
), sizes as (
  select row, doc_id, count(*) as n from shingles group by row, doc_id
), links as (
  select a.row as x, b.row as y from shingles a join shingles b on a.shingle = b.shingle and a.row <> b.row
  join sizes p on p.row = a.row join sizes q on q.row = b.row
  group by a.row, b.row, p.n, q.n having 100 * count(*) >= 85 * (p.n + q.n - count(*))
), reach(x, y) as (
  select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x
), firsts as (
  select x, min(w.doc_id) as first from reach join worded w on w.row = reach.y group by x
), degrees as (
  select x, count(*) as n_links from links group by x
)
select w.doc_id, coalesce(s.n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(f.first, w.doc_id)) as component_id,
       coalesce(d.n_links, 0)::bigint as n_links
from worded w left join sizes s on s.row = w.row left join firsts f on f.x = w.row left join degrees d on d.x = w.row
"""
