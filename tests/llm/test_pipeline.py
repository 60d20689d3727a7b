import os
import random
import re

import pytest

import corpus_pipeline
from lodestone.llm import decontam, linededup, quality, queries, simhash

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "SentencePiece encoding"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        out = spark.createDataFrame(out.toPandas(), out.schema) if name != names[-1] else out
        if name == "quality rules":
            kept = {r.doc_id for r in quality.judged(docs, spark.read.parquet(f"{DIR}/labels.parquet")).where("kept").collect()}
            assert {r.doc_id for r in out.collect()} == kept
        elif name == "line dedup":
            assert out.count() == docs.count() and out.where("n_chars <> length(text)").count() == 0
            assert {(r.doc_id, r.text) for r in out.collect()} == {(r.doc_id, r.text) for r in linededup.deduplicated(docs).collect()}
        elif name == "SimHash near-dedup":
            assert out.count() == simhash.near_duplicates(docs, shingle_words=5).select("component_id").distinct().count()
        elif name == "benchmark decontamination":
            assert out.count() == decontam.contamination(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).where("n_hit = 0").count()
        if name != names[-1]:
            assert out.columns == docs.columns and out.count() > 0
        docs = out
    assert docs.where("not round_trip").count() == 0


WORDS = "amber birch cedar delta ember frost grove haven inlet jetty knoll larch maple north olive pearl quartz ridge stone thorn umber vale willow yarrow zephyr".split()


def long_text(seed, n=60):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with a benchmark of one passage, and documents with null, repeated and shared ids and columns of other names."""
    d = str(tmp_path_factory.mktemp("odd"))
    passage = long_text("passage", 14)
    spark.createDataFrame([(1, passage), (None, long_text("other", 12)), (3, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    leak = long_text("lead") + " " + passage
    rows = [
        (None, long_text("a")), (None, leak), (None, None), (8, long_text("b")), (8, leak + " end"), (1, long_text("c")), (5, long_text("c")), (5, long_text("d")), (6, long_text("e")), (6, long_text("e")), (7, None), (9, ""),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, item string, row int")
    return d, docs.repartition(3), rows, leak


def found(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_decontamination_judges_each_row(spark, odd):
    d, docs, rows, leak = odd
    got = corpus_pipeline.decontamination(spark, docs, d)
    assert found(got) == sorted(((i, t) for i, t in rows if not (t or "").startswith(leak)), key=str)
    assert got.columns == corpus_pipeline.COLUMNS and corpus_pipeline.decontamination(spark, docs.limit(0), d).count() == 0


def test_simhash_keeps_one_row_of_each_text(spark, odd):
    d, docs, rows, leak = odd
    got = corpus_pipeline.simhash_dedup(spark, docs, d)
    # One of (1, c) and (5, c), one of the two rows (6, e), one without words; the row with an id before those without.
    want = [(None, long_text("a")), (8, long_text("b")), (1, long_text("c")), (5, long_text("d")), (6, long_text("e")), (7, None)]
    rest = [x for x in found(got) if x not in want]
    assert set(want) <= set(found(got)) and len(found(got)) == len(set(found(got)))
    assert set(rest) in ({(None, leak), (8, leak + " end")}, {(8, leak + " end")})  # far enough apart, or one
    assert got.columns == corpus_pipeline.COLUMNS and corpus_pipeline.simhash_dedup(spark, docs.limit(0), d).count() == 0


@pytest.mark.parametrize("name", ["quality rules", "line dedup"])
def test_other_stages_take_odd_rows(spark, odd, name):
    d, docs, rows, _ = odd
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, d)
    assert got.columns == corpus_pipeline.COLUMNS and stage(spark, docs.limit(0), d).count() == 0
    # Nothing is labelled: texts of ten words or more are kept; lines of 60 words that stand earlier go, their rows stay.
    assert len(found(got)) == (len([t for _, t in rows if t]) if name == "quality rules" else len(rows))
    assert {i for i, _ in found(got)} == {i for i, t in rows if t or name != "quality rules"}


def test_encoding_takes_odd_rows(spark, odd):
    d, docs, rows, _ = odd
    got = corpus_pipeline.sentencepiece(spark, docs, d)
    assert got.where("not round_trip").count() == 0 and got.where("sample = 0").count() in (0, len(rows))
    assert corpus_pipeline.sentencepiece(spark, docs.limit(0), d).count() == 0


def test_every_operator_has_a_query(spark):
    found = queries.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in found) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(found)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_is_its_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DIR).toPandas(), c.execute(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    shown = lambda f: sorted(tuple("" if v is None or v != v else str(int(v) if isinstance(v, float) else v) for v in r) for r in f[columns].astype(object).itertuples(index=False))
    assert sorted(got.columns) == columns and shown(got) == shown(want.astype(object).where(want.notna(), None))
