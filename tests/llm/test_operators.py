"""Each operator on awkward rows, against a plain version of the contract or another library."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import bpe, classifier, components, filters, jaccard, licenses, lines, lm, media, mixing, quality_rules, shingles, textstats, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def multiset(df, *columns):
    return Counter(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*columns).collect())


# 1


def plain_lines(rows, least=40, docs=5):
    holders = defaultdict(set)
    key = lambda line: line.strip(WHITE).translate(LOWER)
    for r in rows:
        if r[0] is not None:
            for line in (r[1] or "").split("\n"):
                if len(key(line)) >= least:
                    holders[key(line)].add(r[0])
    out = Counter()
    for r in rows:
        found = (r[1] or "").split("\n")
        kept = [x for x in found if r[0] is None or len(holders.get(key(x), ())) < docs or max(holders[key(x)]) == r[0]]
        out[r[0], "\n".join(kept), len(found), len(found) - len(kept)] += 1
    return out


def test_lines(docs, rows, empty):
    got = lines.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert multiset(got, "doc_id", "text", "n_lines", "n_dropped") == plain_lines(rows)
    assert sum(n for (_, _, _, gone), n in plain_lines(rows).items() if gone) >= 7
    assert lines.dedup_lines(empty).count() == 0
    assert multiset(lines.dedup_lines(docs, least_chars=3, least_docs=2), "doc_id", "text", "n_lines", "n_dropped") == plain_lines(rows, 3, 2)


def test_lines_without_a_filter(docs, rows, monkeypatch):
    """Beyond the size of a broadcast, and with merges in many small steps."""
    monkeypatch.setattr(filters, "FEWEST", 1 << 40)
    monkeypatch.setattr(lines, "HELD", 5)
    assert multiset(lines.dedup_lines(docs), "doc_id", "text", "n_lines", "n_dropped") == plain_lines(rows)


def test_lines_keep_the_callers_columns(spark, docs, rows):
    names = ["__drops", "__drop_id", "__new", "drops", "row", "new", "id", "hash2"]
    got = lines.dedup_lines(docs.select("doc_id", "text", *[F.col("class").alias(n) for n in names]))
    assert multiset(got, "doc_id", "text", "n_lines", "n_dropped") == plain_lines(rows)
    assert all(len({r[n] for n in names}) == 1 for r in got.collect()) and multiset(got, "new") == Counter((r[5],) for r in rows)


def test_once_and_twice_seen(spark, docs, rows):
    twice = lines.twice_seen(lines.once_seen(docs, "text", 3, 4), 4)
    holders = Counter(k for r in rows for k in lines.digests((r[1] or "").encode(), 3))
    expected = {int(x) for x in shingles.mixed(lines.places([k for k, n in holders.items() if n > 1]))}
    assert {r[0] % 2**64 for r in twice.collect()} == expected and expected


def test_shared_bloom(spark):
    df = spark.range(30000).select(F.xxhash64("id").alias("hash"))
    bloom = filters.shared_bloom(df, "hash")
    rest = np.array([r[0] for r in spark.range(30000, 60000).select(F.xxhash64("id")).collect()]).view(np.uint64)
    known = np.array([r[0] for r in df.collect()]).view(np.uint64)
    assert bloom.contains(known).all() and bloom.contains(rest).mean() < 0.05
    assert not filters.shared_bloom(df.limit(0), "hash").contains(rest).any()


# 2


def test_lm(docs, rows, empty):
    texts = [[w for w in (r[1] or "").translate(LOWER).encode().split()] for r in rows]
    total = sum(map(len, texts))
    counts = [Counter(tuple(t[i : i + n]) for t in texts for i in range(len(t) - n + 1)) for n in (1, 2, 3)]

    def log_s(t, i, n):
        gram = tuple(t[i - n + 1 : i + 1])
        if n == 1:
            return np.log(counts[0][gram] / total)
        if counts[n - 1][gram] >= 2:
            return np.log(counts[n - 1][gram] / counts[n - 2][gram[:-1]])
        return np.log(0.4) + log_s(t, i, n - 1)

    expected = Counter()
    for r, t in zip(rows, texts):
        orders = [min(i + 1, 3) for i in range(len(t))]
        back = sum(n > 1 and counts[n - 1][tuple(t[i - n + 1 : i + 1])] < 2 for i, n in enumerate(orders))
        expected[r[0], len(t), back, round(sum((log_s(t, i, n) for i, n in enumerate(orders)), 0.0), 4)] += 1
    got = lm.lm_scores(docs).withColumn("s", F.round("log_score", 4))
    near = multiset(got, "doc_id", "n_tokens", "n_backoff", "s")
    assert sorted((k[0] or -1, k[1], k[2]) for k in near.elements()) == sorted((k[0] or -1, k[1], k[2]) for k in expected.elements())
    order = lambda c: sorted(c.elements(), key=lambda k: (k[0] if k[0] is not None else -1, k[1], k[3]))
    assert [k[3] for k in order(near)] == pytest.approx([k[3] for k in order(expected)], abs=2e-3)
    assert lm.lm_scores(empty).count() == 0


# 3


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= cap * sizes[s]}
        for s in over or open_:
            out[s] = cap * sizes[s] if s in over else weight[s] * level
        left -= sum(out[s] for s in over)
        open_ = open_ - over if over else set()
    return out


def test_mix(docs, rows, empty):
    size = lambda t: len(WORD.findall(t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    target = plain_targets(sizes)
    got = mixing.mix_sources(docs).collect()
    assert multiset(mixing.mix_sources(docs), "doc_id", "taken") == Counter((r["doc_id"], r["taken"]) for r in got)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    assert sorted({(r["source_size"], round(r["target"], 6)) for r in got}) == sorted({(sizes[s], round(target[s], 6)) for s in sizes})
    assert all(r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 2 * r["size"] for r in got)
    assert sum(r["taken"] for r in got) <= 1.5 * sum(sizes.values())
    taken = defaultdict(int)
    for r in got:
        taken[r["source_size"]] += r["taken"]
    for s, n in sizes.items():
        longest = max(size(r[1]) for r in rows if r[3] == s)
        assert abs(taken[n] - target[s]) <= max(longest, 1), s
    assert mixing.mix_sources(empty).count() == 0
    assert all(r["taken"] == 2 * r["size"] for r in mixing.mix_sources(docs, share=5.0).collect())


# 4


def test_tokens(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    for rule in token_counts.RULES:
        expected = Counter()
        for r in rows:
            text = r[1] or ""
            starts = [0, *(m.end() for m in re.finditer("\n", text))]
            each, crossing = [0] * len(starts), 0
            offsets = tokenizer.encode(text, add_special_tokens=False).offsets
            for a, b in offsets:
                shares = [max(0, min(b, e) - max(a, s)) for s, e in zip(starts, [*starts[1:], len(text)])]
                held = [i for i, n in enumerate(shares) if n]
                crossing += len(held) > 1
                each[{"first": held[0], "last": held[-1], "most": shares.index(max(shares))}[rule]] += 1
            expected[r[0], len(offsets), len(starts), crossing, tuple(each)] += 1
        assert multiset(token_counts.section_tokens(docs, rule=rule), "doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens") == expected
    assert token_counts.section_tokens(empty).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_tokens(docs, rule="none")


def test_field_tokens(spark):
    df = spark.createDataFrame([(1, "A title", None, "one\n\ntwo, three"), (2, None, None, None)], "doc_id long, a string, b string, c string")
    got = {r["doc_id"]: r for r in token_counts.field_tokens(df, ["a", "b", "c"]).collect()}
    whole = token_counts.section_tokens(spark.createDataFrame([(1, "A title\n\none\n\ntwo, three")], "doc_id long, text string")).first()
    assert got[1]["n_tokens"] == sum(got[1]["field_tokens"]) == whole["n_tokens"] and len(got[2]["field_tokens"]) == 3


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_field_tokens_against_the_library(spark, rule):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = [(1, "A title", "by  ", "one\n\ntwo, three"), (2, "", " naïve", "жук 日本"), (3, "x", "\n", "\n\n  y"), (4, "don", "'t", "")]
    got = {r["doc_id"]: r["field_tokens"] for r in token_counts.field_tokens(spark.createDataFrame(rows, "doc_id long, a string, b string, c string"), ["a", "b", "c"], rule=rule).collect()}
    for doc_id, *fields in rows:
        owner = [i for i, f in enumerate(fields) for _ in f + "\n"][:-1]
        expected = [0, 0, 0]
        for first, last in tokenizer.encode("\n".join(fields), add_special_tokens=False).offsets:
            owners = owner[first : max(last, first + 1)]
            expected[owners[0] if rule == "first" else owners[-1] if rule == "last" else max(sorted(set(owners)), key=owners.count)] += 1
        assert got[doc_id] == expected


# 5


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=900), st.integers(0, 4))
def test_png(data, how):
    payload = media.padded(data)
    assert len(payload) % 192 == 0 and len(payload) and payload.startswith(data)
    assert media.decode_png(media.encode_png(payload, how)).tobytes() == payload


def test_png_mixed_filters():
    rows = np.frombuffer(media.padded(bytes(range(256)) * 9), np.uint8).reshape(-1, 192)
    raw = np.stack([media.filtered(rows, i % 5)[i] for i in range(len(rows))])
    assert (media.unfiltered(raw) == rows).all()


def test_png_damage():
    good = media.encode_png(media.padded(b"text"))
    for i in range(0, len(good), 3):
        with pytest.raises(media.MediaError):
            media.decode_png(good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :])
    with pytest.raises(media.MediaError):
        media.decode_png(good[:-12])


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=30_000))
def test_feature_is_of_the_cosine_transform(data):
    """Against boxes and a transform written out."""
    rows = np.frombuffer(media.padded(data), np.uint8).reshape(-1, 64, 3)
    gray = rows @ np.array(media.LUMA) / 1000.0

    def boxed(x):
        n, out = len(x), np.zeros((32, x.shape[1]))
        for k in range(32):
            a, b = k * n / 32, (k + 1) * n / 32
            for i in range(int(a), min(n, int(np.ceil(b)))):
                out[k] += x[i] * max(0.0, min(b, i + 1) - max(a, i)) * 32 / n
        return out

    small = boxed(boxed(gray).T).T
    assert np.allclose(media.resampled(media.resampled(gray).T).T, small)
    wave = lambda k, t: np.cos(np.pi * k * (2 * t + 1) / 64)
    low = np.array([sum(small[i, j] * wave(u, i) * wave(v, j) for i in range(32) for j in range(32)) for u in range(8) for v in range(8)])
    clear = np.abs(low - np.median(low[1:])) > 1e-3
    bits = np.array([b == "1" for b in f"{int(media.cosine_hash(rows.reshape(len(rows), 192)), 16):064b}"])
    assert ((low > np.median(low[1:])) == bits)[clear].all()


def test_media(docs, rows, empty):
    got = media.from_media(media.to_media(docs))
    expected = Counter()
    for r in rows:
        data = (r[1] or "").encode()
        payload = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        expected[r[0], len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    assert multiset(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == expected
    by_text = defaultdict(set)
    for r in got.collect():
        by_text[r["payload_sha256"], r["n_bytes"]].add((r["media_sha256"], r["feature"], r["media_bytes"]))
    assert all(len(v) == 1 for v in by_text.values()) and media.to_media(empty).count() == 0


# 6


def test_bpe(docs, rows, empty, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        expected[r[0], len(ids), bytes(struct.pack(f"<{len(ids)}I", *ids)), tokenizer.decode(ids, skip_special_tokens=False)] += 1
    got = bpe.encode_decode(docs)
    assert Counter((r[0], r[1], bytes(r[2]), r[3]) for r in got.collect()) == expected
    assert bpe.encode_decode(empty).count() == 0
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    codec = bpe.WordBPE(public_tokenizers.path("word_bpe_49k.json"))
    for r in rows[-70:]:
        assert list(codec.encode((r[1] or "").encode())[1]) == list(struct.pack(f"<{len(x)}I", *x) if (x := tokenizer.encode(r[1] or "", add_special_tokens=False).ids) else b"")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_bpe_any_text(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = test_bpe_any_text.__dict__.setdefault("tokenizer", Tokenizer.from_file(path))
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    n, packed, decoded = bpe.loaded(path).encode(text.encode())
    assert (n, packed) == (len(ids), struct.pack(f"<{len(ids)}I", *ids)) and decoded == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_of_other_unicode_versions():
    """Letters and marks that Python's tables and the library's differ on, alone, doubled, and beside marks of each class."""
    import unicodedata

    import public_tokenizers
    from tokenizers import Tokenizer, normalizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, codec = Tokenizer.from_file(path), bpe.loaded(path)
    odd = [chr(c) for a, b, _ in bpe.CAPITALS for c in range(a, b + 1)] + [chr(c) for a, b in bpe.UNMOVED for c in range(a, b + 1)]
    classes = {unicodedata.combining(chr(i)): chr(i) for i in range(0x2000)}
    texts = odd + [f"a{c}{c}B{c} x" for c in odd] + [f"e{x}" for c in odd for m in classes.values() for x in (c + m, m + c, f"{m}{c}\u0323")]
    texts += ["\u0eca\ua82c", "\u09c7\u09fe\u0323", "a\u1df6\u0323", "\U00011935\U00011930\u0323", "ΑΣ Σ\u0301σΣ", "\u1100\u1161\u11a8"]
    small, nfc = normalizers.Lowercase(), normalizers.NFC()
    assert [bpe.normal(t) for t in texts] == [small.normalize_str(nfc.normalize_str(t)) for t in texts]
    for text, e in zip(texts[::7], tokenizer.encode_batch(texts[::7], add_special_tokens=False)):
        assert codec.encode(text.encode())[1] == struct.pack(f"<{len(e.ids)}I", *e.ids), text


# 7


def plain_join(rows, words=4, percent=85):
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(LOWER))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()})
    n, near = len(rows), defaultdict(set)
    for i in range(n):
        for j in range(i):
            if sets[i] and rows[i][0] is not None and rows[j][0] is not None:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common) and common:
                    near[i].add(j)
                    near[j].add(i)
    out = Counter()
    for i in range(n):
        seen, queue = {i}, [i]
        while queue:
            new = near[queue.pop()] - seen
            seen |= new
            queue += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out[rows[i][0], len(sets[i]), min(ids) if rows[i][0] is not None else None, len(near[i])] += 1
    return out


@pytest.mark.parametrize("percent", [85, 70])
def test_jaccard(docs, rows, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)  # families of several blocks, and so pivots
    got = multiset(jaccard.jaccard_join(docs, percent=percent), "doc_id", "n_shingles", "component_id", "n_links")
    assert got == plain_join(rows, percent=percent)


def test_jaccard_empty(empty):
    assert jaccard.jaccard_join(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([85, 80, 70, 50]), st.integers(1, 200))
def test_cells_lose_no_link(seed, percent, n):
    rng, bound = np.random.default_rng(seed), shingles.Bound(percent)
    x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    y = np.unique(np.concatenate([rng.permutation(x)[: len(x) - rng.integers(0, len(x) // 4 + 1)], rng.integers(0, 2**63, rng.integers(0, n // 5 + 1)).astype(np.uint64)]))
    common = len(np.intersect1d(x, y))
    if 100 * common < percent * (len(x) + len(y) - common) or (len(x) == len(y) == common) or not common:
        return
    found = shingles.cells(np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)]), bound)
    facts = [{int(s): (int(a), int(p), int(depth), int(least)) for d, s, a, p, depth, least in zip(*found) if d == k} for k in (0, 1)]
    shared = facts[0].keys() & facts[1].keys()
    meet = lambda s: np.intersect1d(*[shingles.probes(z, s, *facts[k][s][2:], bound) for k, z in enumerate((x, y))]).size
    assert any((facts[0][s][1] ^ facts[1][s][1]).bit_count() <= bound.difference(facts[0][s][0] + facts[1][s][0]) and meet(s) for s in shared)


def phrased(rng, n, copies=3):
    """Random texts that hold a common phrase, and copies of some of them that differ in a word."""
    texts = []
    for i in range(n):
        words = [f"r{rng.randrange(10**7)}" for _ in range(25)]
        words[10:10] = "we use cookies to make this site work better".split()
        texts += [" ".join(words)] + [" ".join([*words, f"x{k}"]) for k in range(copies if i % 20 == 0 else 0)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rows_held,work", [(1 << 16, 2), (2, 1)])
def test_jaccard_with_a_phrase_in_all_documents(spark, monkeypatch, rows_held, work):
    import random

    monkeypatch.setattr(jaccard, "HOT_ROWS", rows_held)
    monkeypatch.setattr(jaccard, "HOT_WORK", work)
    monkeypatch.setattr(jaccard, "READ", 1)
    given = phrased(random.Random(2), 300)
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    bound = shingles.Bound(85)
    assert jaccard.candidates(jaccard.signatures(df, "doc_id", "text", 4, bound), bound).where("hot").count() > 0
    assert multiset(jaccard.jaccard_join(df), "doc_id", "n_shingles", "component_id", "n_links") == plain_join(given)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=30), st.integers(1, 7), st.integers(1, 12), st.integers(2, 20))
def test_whole_cells(sizes, batch, read, most):
    """Cells come whole, in batches of any size; one that can't be held comes as its signature, once."""
    import pyarrow as pa

    signature = np.repeat(np.arange(len(sizes)) * 3 - 20, sizes).astype(np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(x)] * 3, names=["a", "b", "c"]) for x in np.array_split(signature, max(1, len(signature) // batch))]
    held = jaccard.READ
    jaccard.READ = read
    try:
        parts = list(jaccard.whole_cells(iter(batches), most))
    finally:
        jaccard.READ = held
    passed, got = {p for p in parts if isinstance(p, int)}, [p for p in parts if not isinstance(p, int)]
    assert len(passed) == sum(isinstance(p, int) for p in parts) and all(sizes[(p + 20) // 3] > most for p in passed)
    counts = Counter(x for p in got for x in set(p[0].tolist()))
    assert counts == Counter(set(signature.tolist()) - passed)
    assert sorted(x for p in got for x in p[0].tolist()) == [x for x in signature.tolist() if x not in passed]


def test_a_phrase_costs_no_square(spark, monkeypatch):
    """Rows that a divided cell sends grow with its classes, and the comparisons left are few."""
    import random

    monkeypatch.setattr(jaccard, "HOT_WORK", 5)
    bound, asked = shingles.Bound(85), []
    for n in (400, 1600):
        df = spark.createDataFrame(phrased(random.Random(4), n, 0), "doc_id long, text string").repartition(3)
        first = jaccard.candidates(jaccard.signatures(df, "doc_id", "text", 4, bound), bound)
        finer = jaccard.signatures(df, "doc_id", "text", 4, bound, first.where("hot").select(F.col("a").alias("signature")))
        cells = [r[0] for r in finer.groupBy("signature").count().select("count").collect()]
        asked.append((sum(cells), sum(c * c for c in cells)))
    (rows_1, pairs_1), (rows_2, pairs_2) = asked
    assert rows_2 <= 8 * rows_1 and pairs_2 <= 10 * pairs_1 and pairs_2 < 0.05 * 1600**2


def groups_of_sets(spark, n_groups, each, seed=0):
    """Sets in clear groups, each a little different from its group's centre, as members of one family."""
    rng, rows = np.random.default_rng(seed), []
    for _ in range(n_groups):
        centre = rng.integers(0, 2**63, 120).astype(np.uint64)
        for _ in range(each):
            s = np.unique(np.concatenate([rng.permutation(centre)[:112], rng.integers(0, 2**63, 6).astype(np.uint64)]))
            rows.append((shingles.set_hash(s), 1, len(s), 1, bytearray(s.tobytes())))
    return spark.createDataFrame(rows, "class long, family long, size long, copies long, set binary")


def test_regions_lose_no_pair_and_send_little(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    bound, sent = shingles.Bound(85), []
    for n_groups in (5, 20):
        sets = groups_of_sets(spark, n_groups, 40)
        met = jaccard.meetings(jaccard.regions(sets, sets, bound), sets).cache()
        got = {tuple(sorted((r.a, r.n) for r in [x])) for x in jaccard.links(met, bound).groupBy("a").agg(F.sum("n").alias("n")).collect()}
        every = [(r[0], set(np.frombuffer(bytes(r[4]), np.uint64).tolist())) for r in sets.collect()]
        linked = lambda x, y: 100 * len(x & y) >= 85 * len(x | y)
        plain = {k: sum(linked(x, y) for other, y in every if other != k) for k, x in every}
        assert got == {((k, n),) for k, n in plain.items() if n}
        sent.append(met.count())
    # Four times the groups, far from one another: four times the sets sent, and a quarter of those of all pairs of blocks.
    assert sent[1] <= 5 * sent[0] and sent[1] < 800 * (800 / 16) / 4


def test_regions_of_small_families(spark):
    sets = groups_of_sets(spark, 2, 3)
    assert jaccard.regions(sets, sets, shingles.Bound(85)).select("region", "mask", "blocks").distinct().collect() == [(1, 0, 1)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    mixed = lambda i: int(shingles.mixed(np.array([i], np.uint64)).view(np.int64)[0])
    got = components.components(spark.createDataFrame([(mixed(a), mixed(b)) for a, b in edges], "a long, b long")).collect()
    label = {r["node"]: r["label"] for r in got}
    assert len({label[mixed(i)] for i in range(41)}) == len({label[mixed(i)] for i in range(100, 160)}) == 1
    assert len(set(label.values())) == 3 and len(got) == 41 + 60 + 2
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 8 and 10


def test_counts(rows):
    for r in rows:
        text = r[1] or ""
        words, seen, dup = WORD.findall(text), set(), 0
        for line in text.split("\n"):
            dup += line in seen and bool(WORD.search(line))
            seen.add(line)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        assert textstats.counts(text.encode())[:5] == (len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), dup, len(covered))


@pytest.fixture(scope="module")
def labelled(spark):
    """Clean prose, and junk of symbols; some labels twice, some null."""
    import random

    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 120))]
        rows.append((i, " ".join(w + "$$" if bad else w for w in words), None if i % 9 == 0 else 500, "x"))
        labels += [(i, int(not bad), 0)] * (1 + i % 2)
    labels += [(None, 1, 0), (3, None, 0), (999, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, quality string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules(spark, docs, rows, empty, labelled):
    df, labels = labelled
    rules = quality_rules.learn_rules(df, labels)
    assert 1 <= len(rules) <= 3 and "symbol_rate" in str(rules[0])
    got = quality_rules.apply_rules(df, rules)
    assert {r["doc_id"]: r["kept"] for r in got.collect()} == {i: i % 4 != 0 for i in range(400)}
    judged = quality_rules.apply_rules(docs, rules)
    assert judged.count() == len(rows) and set(docs.columns) <= set(judged.columns)
    for r in judged.collect():
        words = WORD.findall(r["text"] or "")
        assert r["n_words"] == len(words) and r["base_failed"] == (len(words) < 50 or 100 * r["n_repeat_words"] > 50 * len(words))
        assert r["kept"] == (not r["base_failed"] and r["rule"] == 0)
    assert quality_rules.apply_rules(empty, rules).count() == 0
    assert quality_rules.learn_rules(df, labels.limit(0)) == [] and quality_rules.learn_rules(df, labels.where("quality = 1")) == []
    assert quality_rules.apply_rules(df, []).where("kept").count() == 400


def test_rules_keep_the_callers_columns(docs, rows):
    names = ["__measured", "__r", "__failed", "__judged", "__row", "__judged_"]
    got = quality_rules.apply_rules(docs.select("doc_id", "text", *[F.col("class").alias(n) for n in names]), [])
    assert all({r[n] for n in names} == {r["__r"]} for r in got.collect()) and multiset(got, "__r") == Counter((r[5],) for r in rows)


def test_sample_is_bounded(spark):
    """However often an id repeats, with whatever texts, and however many labels there are."""
    from quillon.llm.labelled import sample

    docs = spark.range(100_000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"))
    labels = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    got = sample(docs, ["text"], labels, "quality", 400).collect()
    assert len(got) <= 3 and len({r["__labelled"] for r in got}) == len(got) and got == sample(docs.repartition(7), ["text"], labels, "quality", 400).collect()
    many = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    assert sample(many, ["text"], many.withColumn("quality", F.lit(0)), "quality", 100).count() == 100
    assert sample(many.where("doc_id < 5"), ["text"], many.withColumn("quality", F.lit(0)), "quality", 10_000).count() == 5


def test_decision_list():
    rng = np.random.default_rng(0)
    x = rng.random((900, 2))
    bad = (x[:, 0] > 0.7) & (x[:, 1] <= 0.5) | (x[:, 0] <= 0.1)
    rules = quality_rules.learn(x, bad, ("a", "b"))
    hit = np.any([quality_rules.holds(x, ("a", "b"), r.conditions) for r in rules], axis=0)
    assert (hit & ~bad).sum() <= 0.02 * len(x) and (hit & bad).sum() >= 0.9 * bad.sum()


def test_classifier(docs, rows, empty, labelled):
    df, labels = labelled
    machine = classifier.train(df, labels)
    got = classifier.classify(df, machine).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    unseen = [(r["score"], r["doc_id"] % 4 != 0) for r in got if r["held_out"]]
    assert min(s for s, good in unseen if good) > max(s for s, good in unseen if not good)
    assert classifier.classify(docs, machine).where("score between 0 and 1").count() == len(rows) and classifier.classify(empty, machine).count() == 0
    constant = classifier.train(df, labels.limit(0))
    assert {r["score"] for r in classifier.classify(df, constant).collect()} == {0.5}


def test_machine_is_a_factorisation_machine():
    rng = np.random.default_rng(1)
    width = classifier.BUCKETS + 3
    m = classifier.Machine(0.3, rng.normal(size=width), rng.normal(size=(width, classifier.FACTORS)), np.zeros(3), np.ones(3))
    buckets, weights, stats = np.array([4, 90, 700]), np.array([0.5, 0.2, 0.8]), np.array([0.1, -0.3, 0.2])
    place, x = np.concatenate((buckets, classifier.BUCKETS + np.arange(3))), np.concatenate((weights, stats))
    z = 0.3 + x @ m.linear[place] + sum(x[i] * x[j] * (m.factors[place[i]] @ m.factors[place[j]]) for i in range(6) for j in range(i))
    assert m.score(buckets, weights, stats) == pytest.approx(1 / (1 + np.exp(-z)))


# 9


def test_licenses(docs, rows, empty):
    expected = Counter()
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").translate(LOWER))
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
        at = [i for i, _ in places]
        expected[r[0], len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))] += 1
    got = licenses.scan_licenses(docs)
    assert multiset(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == expected
    for r in got.collect():
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert licenses.scan_licenses(empty).count() == 0


def test_license_rules():
    assert len(licenses.rules()) >= 200
    for priority, label, keyword, pattern in licenses.rules():
        assert 0 < priority <= 100 and re.fullmatch(r"[a-z0-9.\-]+", label) and keyword
    _, base, found = licenses.scan(b"Apache License, Version 2.0; see the GNU Lesser General Public License 2.1, and the MIT license (MIT)")
    assert [d[3] for d in found] == ["apache-2.0", "lgpl-2.1", "mit"] and [b[1] for b in base] == ["apache", "gpl", "mit"]
    assert licenses.scan(b"mitlicense mit licenses")[2] == []


def test_license_rules_without_the_prefilter(rows):
    """The scan against every rule's regex on every text, and a sample sentence of every rule."""
    table = [(p, label, re.compile(f"(?<= )(?:{pattern})(?= )")) for p, label, _, pattern in licenses.rules()]
    samples = [re.sub(r"\([^()]*\)\??|\{[^}]*\}|\[[^]]*\]", "", pattern).replace("?", "").replace("  ", " ") for _, _, _, pattern in licenses.rules()]
    texts = [r[1] for r in rows if r[1]] + [keyword for _, _, keyword, _ in licenses.rules()] + [" x ".join(samples[i : i + 9]) for i in range(0, len(samples), 7)]
    seen = 0
    for text in texts:
        joined = f" {' '.join(re.findall(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', text.translate(LOWER)))} "
        found = [(m.start(), m.end(), p, i) for i, (p, _, regex) in enumerate(table) for m in regex.finditer(joined)]
        kept = []
        for d in sorted(found, key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
                kept.append(d)
        expected = [(joined.count(" ", 0, s - 1), joined[s:e].count(" ") + 1, p, table[i][1]) for s, e, p, i in sorted(kept)]
        assert licenses.scan(text.encode())[2] == expected
        seen += len(expected)
    assert seen > 400


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9), st.integers(1, 3), st.integers(0, 5)), max_size=25))
def test_outermost(found):
    found = [(s, s + n, p, k) for s, n, p, k in found]
    kept = []
    for d in sorted(found, key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
        if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
            kept.append(d)
    assert licenses.outermost(found) == kept
