"""Registered queries against their SQL, and the pipeline by stages."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", ["op1_lines", "op2_lm", "op3_mix", "op7_jaccard"])
def test_sql(spark, tables, name):
    from quillon.llm.queries import ORACLE_SQL, QUERIES

    df, expected = QUERIES[name](spark, SF), tables.sql(ORACLE_SQL[name])
    names = sorted(df.columns)
    assert names == sorted(expected.columns)
    text = lambda rs, cs: sorted(repr([round(r[cs.index(c)], 6) if isinstance(r[cs.index(c)], float) else r[cs.index(c)] for c in names]) for r in rs)
    assert text(df.collect(), df.columns) == text(expected.fetchall(), expected.columns)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [len(p.STAGES), p.ORACLE_SQL] == [5, None]
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in p.STAGES[:-1]:
        out = p.staged(stage(spark, docs, SF), "test")
        assert out.columns == docs.columns, name
        now = {r[0] for r in out.select("doc_id").collect()}
        assert now <= ids
        if name == "line dedup":
            assert now == ids and out.where(F.length("text") != F.col("n_chars")).count() == 0
        if name == "n-gram Jaccard join":
            from quillon.llm.jaccard import jaccard_join

            assert now == {r[0] for r in jaccard_join(docs, words=p.NEAR_WORDS, percent=p.NEAR_PERCENT).where("doc_id = component_id").select("doc_id").collect()}
        docs, ids = out, now
    last = p.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.where("n_tokens * 4 != length(ids)").count() == 0


def test_stages_keep_the_callers_columns(spark, docs):
    import corpus_pipeline as p

    extra = ["__copies", "__copy", "copies", "row", "taken_id", "class", "__judged", "__drops", "gone_id"]
    given = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.col("hash").alias(c) for c in extra])
    for _, stage in p.STAGES[1:4]:
        given = p.staged(stage(spark, given, SF), "test")
        assert given.columns[5:] == extra and {r[c] for r in given.collect() for c in extra} <= {"h", None}


def test_pipeline_on_awkward_rows(spark, docs, tmp_path):
    import corpus_pipeline as p

    home = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    assert p.run(spark, home).count() > 0
    empty = spark.read.parquet(f"{home}/documents.parquet").limit(0)
    empty.write.parquet(f"{home}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{home}/none/labels.parquet")
    assert p.run(spark, f"{home}/none").count() == 0


def test_near_duplicates_of_the_pipeline(spark, docs, rows):
    import corpus_pipeline as p
    from test_operators import plain_join

    word = [f"d{i}" for i in range(400)]
    replaced = lambda n: " ".join(f"r{i}" if i in range(20, 20 + 40 * n, 40) else w for i, w in enumerate(word[:200]))
    texts = [" ".join(word[:200]), replaced(4), " ".join(word[200:320]), " ".join(word[200:345]), " ".join(word[345:]), f"{' '.join(word[345:])} and fifteen more {' '.join(word[:12])}"]
    more = [(2000 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    given = docs.select("doc_id", "text", "lang", "source", "n_chars").unionAll(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = [r[0] for r in p.one_of_each(spark, given, SF).select("doc_id").collect()]
    plain = plain_join([*rows, *more], words=5, percent=80)
    assert sorted(k for k in kept if k is not None) == sorted({d for d, _, first, _ in plain if d is not None and d == first})
    assert kept.count(None) == 1
    # Four words of 200 replaced, 176 of 216 runs of five words in common; 25 words appended to 120, 116 of 141.
    assert [k for k in sorted(k for k in kept if k is not None) if k >= 2000] == [2000, 2002, 2004, 2005]


def test_near_duplicates_that_share_an_id(spark):
    import corpus_pipeline as p

    text = {k: " ".join(f"{k}{i}" for i in range(100)) for k in "ABCDEF"}
    near = lambda k, n: text[k].replace(f"{k}{n}", "other", 1)
    given = [(1, text["A"]), (5, text["A"]), (5, text["B"])]  # B has no other document
    given += [(6, text["C"]), (6, near("C", 50)), (6, text["C"]), (9, near("C", 99))]  # near copies under one id: one stays
    given += [(7, text["D"]), (7, text["E"]), (8, near("E", 99))]  # two components that start with one id
    given += [(10, text["F"]), (10, text["F"].upper()), (10, " "), (10, ""), (10, ""), (10, None), (10, None)]  # equal sets; no words
    given += [(None, text["A"]), (None, text["A"])]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in given]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = p.one_of_each(spark, docs, SF)
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == docs.columns and len(kept) == len(set(kept)) + 1
    in_c = [t for i, t in kept if i == 6]
    assert len(in_c) == 1 and in_c[0] in (text["C"], near("C", 50))
    rest = {(1, text["A"]), (5, text["B"]), (7, text["D"]), (7, text["E"]), (10, min(text["F"], text["F"].upper())), (10, " "), (10, ""), (10, None), (None, text["A"])}
    assert {k for k in kept if k[0] != 6} == rest


def test_near_duplicates_take_one_python_step_a_task(spark, docs, tmp_path, monkeypatch):
    """A task that chains Python steps holds a worker for each, and an executor's memory is theirs too."""
    import re

    import corpus_pipeline as p
    from pyspark.sql import DataFrameWriter

    chains, write = [], DataFrameWriter.parquet

    def watched(self, path, *args, **kwargs):
        if self._df is not None:
            open_steps = []  # places, in the text of the plan, of what stands above a line within the same stage
            for line in self._df._jdf.queryExecution().executedPlan().toString().split("\n"):
                at = len(re.match(r"[\s:+\-*()\d]*", line)[0])
                open_steps = [(k, n) for k, n in open_steps if k < at]
                above = open_steps[-1][1] if open_steps else 0
                n = 0 if "Exchange" in line[at:].split(" ")[0] else above + bool(re.match("ArrowEvalPython|MapInArrow", line[at:]))
                open_steps.append((at, n))
                chains.append(n)
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    given = docs.select("doc_id", "text", "lang", "source", "n_chars")
    p.one_of_each(spark, given, SF).write.parquet(str(tmp_path / "out"))
    assert max(chains) == 1
