import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, class long, label string, size double, key string, hash string"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def awkward_rows():
    """Nulls, empty, blank and very long texts, exact and near copies, repeated rows, shared lines, other scripts."""
    rng = random.Random(3)
    shared = "This very line stands in many documents, word for word."
    base = prose(rng, 120)
    near = base.split()
    texts = [None, "", "   \t\n \n", "one", "one two three", "ONE two\tthree", base, base, base.upper()]
    for i in range(70):  # a family of near copies
        words = list(near)
        for _ in range(i % 6):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    for i in range(8):
        texts.append(f"{prose(rng, 60)}\n  {shared.upper() if i % 2 else shared} \t\n{prose(rng, 3)}\n{shared}")
    texts += [prose(rng, 30000, 5000), "ж" * 3000 + " " + "слово " * 200, "naïve Ünïcode x İ ΑΣ ﷺ <|endoftext|>", "a\n\n\nb\n\r\n c", "x" * 5000]
    texts += ["Licensed under the Apache License, Version 2.0. MIT License. GNU General Public License v3!", "mit licensemit license mité license", "| a | b | c # $ " * 40]
    texts += [prose(rng, rng.randrange(1, 300)) for _ in range(60)]
    rows = []
    for i, t in enumerate(texts):
        source = None if i % 11 == 0 else ("hot" if i % 3 else f"s{i % 4}")
        rows.append((i * 7 % 1009, t, "en", source, len(t) if t is not None else None, i, "l", 0.5, "k", "h"))
    rows += [rows[6], rows[90]]  # repeated rows
    rows.append((None, base, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, COLUMNS).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
