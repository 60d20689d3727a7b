import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine, build_index
from lodestone.functions.scoring import SearchSettings
from lodestone.operators import bm25, chunks, dense, search
from lodestone.plans import catalog
from lodestone.sources.embedding import backend

ROWS = [
    (5, "platform:strsplit", "platform_api", "СтрРазделить", "StrSplit", "method", "Разделяет строку на части и возвращает массив строк."),
    (1, "bsp:to_array", "bsp", "СтроковыеФункции.РазложитьСтрокуВМассив", "", "method", "Разбивает строку в массив подстрок."),
    (2, "bsp:from_array", "bsp", "СтроковыеФункции.СтрокаИзМассива", "", "method", "Соединяет элементы массива в строку."),
    (0, "lang:topic", "bsl_lang", "Строка", "String", "topic", "Тип строка. Массив символов."),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(o, i, d, ru, en, k, t) for o, i, d, ru, en, k, t in ROWS] + [(10 + n, f"noise:{n}", "platform_api", f"Шум{n}", f"Noise{n}", "property", f"Прочее описание номер {n}.") for n in range(40)]
    frame = spark.createDataFrame(rows, "chunk_ord bigint, id string, domain string, title_ru string, title_en string, entity_kind string, text string")
    return chunks.with_texts(chunks.completed(frame)).persist()


def reference_bm25(docs, query):
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for doc in docs:
        for t in set(doc):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    return [sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query) for d in docs]


def test_bm25_is_the_formula(spark, corpus):
    from lodestone.functions.text import stems

    rows = corpus.select("chunk_ord", stems(F.col("lexical_text")).alias("toks")).orderBy("chunk_ord").collect()
    asked = spark.createDataFrame([(1, "*", "разделить строку строку шум", 60)], "query_id bigint, scope string, query string, depth int")
    terms = asked.select(stems(F.col("query")).alias("t")).first().t
    want = reference_bm25([r.toks for r in rows], terms)
    got = {r.chunk_ord: r for r in bm25.ranked(asked, bm25.build(corpus)).collect()}
    assert len(got) == len(rows)  # chunks without a term rank too
    order = sorted(range(len(rows)), key=lambda i: (-round(want[i], 9), rows[i].chunk_ord))
    for place, i in enumerate(order, 1):
        assert got[rows[i].chunk_ord].rank == place and got[rows[i].chunk_ord].raw == pytest.approx(want[i], abs=1e-9)


def test_domains_have_their_own_statistics(spark, corpus):
    corpora = {r.scope: r.n for r in bm25.build(corpus).corpora.collect()}
    assert corpora == {"*": 44, "platform_api": 41, "bsp": 2, "bsl_lang": 1}


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(3)
    points, asked = rng.normal(size=(300, 8)), rng.normal(size=(4, 8))
    frame = spark.createDataFrame([(i, str(i), "ab"[i % 2], p.tolist()) for i, p in enumerate(points)], "chunk_ord bigint, id string, domain string, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, "*" if i < 3 else "a", 7, q.tolist()) for i, q in enumerate(asked)], "query_id bigint, scope string, depth int, vector array<double>")
    got = dense.nearest(frame, queries).collect()
    for i, q in enumerate(asked):
        inside = [j for j in range(300) if i < 3 or j % 2 == 0]
        want = sorted(inside, key=lambda j: ((points[j] - q) ** 2).sum())[:7]
        assert [r.chunk_ord for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == want


def test_cells_find_most_neighbours(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(400, 6)) + rng.integers(0, 4, 400)[:, None]
    frame = spark.createDataFrame([(i, str(i), "a", p.tolist()) for i, p in enumerate(points)], "chunk_ord bigint, id string, domain string, vector array<double>")
    queries = spark.createDataFrame([(i, "*", 10, points[i].tolist()) for i in range(0, 400, 80)], "query_id bigint, scope string, depth int, vector array<double>")
    cells, centres = dense.with_cells(frame, 12)
    exact = {(r.query_id, r.id) for r in dense.nearest(frame, queries, "cosine").collect()}
    found = {(r.query_id, r.id) for r in dense.probed(cells, centres, queries, 6).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_few_probes_lose_no_neighbour(spark):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(600, 16))
    frame = spark.createDataFrame([(i, str(i), "ab"[i % 2], p.tolist()) for i, p in enumerate(points)], "chunk_ord bigint, id string, domain string, vector array<double>")
    queries = spark.createDataFrame([(i, "*" if i % 40 else "a", 10, points[i].tolist()) for i in range(0, 600, 20)], "query_id bigint, scope string, depth int, vector array<double>")
    cells, centres = dense.with_cells(frame)
    exact = {(r.query_id, r.id, r["rank"]) for r in dense.nearest(frame, queries, "cosine").collect()}
    assert {(r.query_id, r.id, r["rank"]) for r in dense.probed(cells, centres, queries, 2).collect()} == exact


def test_cells_are_asked_for_every_twentieth_vector(spark):
    d = "/root/testdata/sf0.001"
    rows = catalog.QUERIES["ann_cells"](spark, d).collect()
    ids = {r.vec_id for r in spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 20 = 0").collect()}
    assert {r.query_id for r in rows} == ids and len(rows) == 10 * len(ids)


@pytest.mark.parametrize(("n", "cells"), [(3, 1), (32, 8), (100, 10), (33, 8), (10**6, 256)])
def test_cell_count(n, cells):
    assert dense.cell_count(n) == cells


def run(spark, corpus, query, domain, k):
    frame = corpus.select("chunk_ord", "id", "domain", F.array(F.lit(1.0), F.lit(1.0)).alias("vector"))  # all vectors alike: words decide
    queries = spark.createDataFrame([(1, query, domain, k)], "query_id bigint, query string, domain string, k int")
    wanted = spark.createDataFrame([(1, [1.0, 1.0])], "query_id bigint, vector array<double>")
    return search.search(queries, corpus, bm25.build(corpus), frame, wanted, SearchSettings()).orderBy("rank").collect()


def test_search_over_all_domains(spark, corpus):
    rows = run(spark, corpus, "строку в массив", "all", 5)
    assert [r.rank for r in rows] == [1, 2, 3, 4, 5]
    assert rows[0].id in ("platform:strsplit", "bsp:to_array") and "intent" in rows[0].match_sources
    assert set(rows[0].asDict()) >= {"id", "domain", "title", "score", "entity_kind", "html_path", "excerpt", "excerpt_start", "excerpt_end", "highlight_terms", "match_sources", "match_explanation", "semantic_excerpt", "semantic_highlight_terms", "score_breakdown"}
    assert rows[0].score_breakdown.total == rows[0].score


def test_search_by_name(spark, corpus):
    assert run(spark, corpus, "СтрРазделить", "platform_api", 3)[0].id == "platform:strsplit"


def test_search_in_a_domain(spark, corpus):
    assert {r.domain for r in run(spark, corpus, "строку", "bsp", 5)} == {"bsp"}
    assert run(spark, corpus, "строку", "nothing", 5) == []


def test_domain_names_are_checked():
    with pytest.raises(ValueError, match="domain"):
        search.domain_predicate("x' OR 1=1")


def test_engine_over_a_written_index(spark, corpus, tmp_path):
    n = build_index(corpus.select("chunk_ord", *[c for c in chunks.FIELDS]), str(tmp_path / "index"), backend("hashing"), "2020-01-01")
    engine = Engine(spark, str(tmp_path / "index"), backend("hashing"))
    engine.warm()
    assert n == 44 and "platform:strsplit" in {r.id for r in engine.search("СтрРазделить", limit=30).collect()}
    assert engine.topic("bsp:to_array").count() == 1 and engine.topic("none").count() == 0
    assert {r.domain: r.n for r in engine.stats().collect()} == {"platform_api": 41, "bsp": 2, "bsl_lang": 1, "total": 44}
    with pytest.raises(ValueError):
        engine.search("x", limit=99)


def test_unknown_backend():
    with pytest.raises(ValueError, match="provider"):
        backend("nothing")


def test_larger_side_wins_and_keeps_the_place(spark, corpus):
    asked = search.requests(spark.createDataFrame([(1, "строку", "all", 5)], "query_id bigint, query string, domain string, k int"), SearchSettings())
    own = search.fused_domains(asked, bm25.build(corpus), SearchSettings())
    low = own.withColumn("score", F.lit(0.0)).withColumn("seen", F.struct(F.lit(0).alias("source"), F.lit("").alias("domain"), F.lit(1).alias("rank")))
    got = search.larger(low, own).collect()
    assert len(got) == own.count() and all(r.score > 0 and r.seen.source == 0 for r in got)
