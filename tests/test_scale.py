"""Operators that avoid whole reads, sorts in one task and rewrites: each against a plain version."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25, dense, hierarchy, numbering, search
from lodestone.operators.ranking import _first_rows, best_rows
from lodestone.streaming.incremental import ScanStore, change_stream, listing
from lodestone.tables import Versions, written

# --- top rows of any depth -------------------------------------------------------------------------------------


@pytest.mark.parametrize("depth", [0, 1, 7, 400])
def test_best_rows_beyond_sparks_limit(spark, depth):
    rng = random.Random(depth)
    rows = [(rng.choice([None, "a", "b", "hot"]), rng.choice([0.5, 1.0, rng.random()]), i) for i in range(3000)]
    rows += [("hot", 1.0, 3000 + i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "g string, x double, i bigint").repartition(6)
    want = {}
    for g, x, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        want.setdefault(g, []).append(i)
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "5")
    try:
        got = best_rows(frame, ["g"], ["x", "i"], depth).collect()
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    assert sorted((str(r.g), r["rank"], r.i) for r in got) == sorted((str(g), n, i) for g, ids in want.items() for n, i in enumerate(ids[:depth], 1))


def test_tasks_keep_no_more_than_they_must():
    import pyarrow as pa

    batches = (pa.RecordBatch.from_pydict({"g": ["a"] * 9000 + ["b"] * 1000, "x": np.random.default_rng(n).random(10_000)}) for n in range(40))
    kept = pa.Table.from_batches(list(_first_rows(["g"], ["x"], 1500)(batches)))
    assert kept.num_rows == 3000


def test_a_deep_search_shuffles_no_whole_group(spark, lexical):
    requests = spark.createDataFrame([(1, "*", "w1 w2", 1500)], "query_id bigint, scope string, query string, depth int")
    plan = bm25.ranked(requests, lexical)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan  # what a task keeps is cut before the exchange of the window


# --- postings by blocks ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i, f"c{i}", rng.choice(["de", "en", "en", "fr"]), " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(3000)]
    rows += [(3000 + i, f"c{3000 + i}", "en", "w0 " * 40) for i in range(200)] + [(3200, "none", "de", None), (3201, "tie1", "fr", "w399 w0"), (3202, "tie2", "fr", "w399 w0")]
    return spark.createDataFrame(rows, "chunk_ord bigint, id string, domain string, lexical_text string").repartition(4)


@pytest.fixture(scope="module")
def lexical(spark, corpus):
    return bm25.build(corpus).persist()


ASKED = [
    (1, "*", "w0 w399", 5), (2, "en", "w0 w1 w2", 10), (3, "fr", "w399 w398 w0 w0", 3), (4, "*", "w0", 20), (5, "*", "nothing here", 4), (6, "xx", "w0", 4), (7, "de", "w350", 400), (8, "*", "", 3),
    (9, "*", " ".join(f"w{i}" for i in range(0, 400, 9)), 8), (10, "en", "w7 w31 w110 unknown", 15),
]


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame(ASKED, "query_id bigint, scope string, query string, depth int")


def rows_of(found):
    return sorted((r.query_id, r.scope, r["rank"], r.chunk_ord, r.id, round(r.raw, 8)) for r in found.collect())


def test_blocks_give_the_rows_of_all_postings(spark, lexical, requests):
    plain = rows_of(bm25.ranked(requests, lexical))
    assert rows_of(bm25.ranked(requests, lexical, plain_hits=0)) == plain
    few = bm25.LEAST_SAVING
    bm25.LEAST_SAVING = 0  # go by blocks however many they are
    try:
        assert rows_of(bm25.ranked(requests, lexical, plain_hits=0)) == plain
        for row in ASKED[:4]:
            assert rows_of(bm25.ranked(requests.where(F.col("query_id") == row[0]), lexical, plain_hits=0)) == [r for r in plain if r[0] == row[0]]
    finally:
        bm25.LEAST_SAVING = few


def test_a_common_word_is_hardly_read(spark, lexical):
    one = spark.createDataFrame([(1, "*", "w0 w399", 3)], "query_id bigint, scope string, query string, depth int")
    search = bm25.by_blocks(one, lexical, plain_hits=0)
    wanted, _ = search.needed()
    read, there = wanted.groupby("tok")["n"].sum(), search.blocks.groupby("tok")["n"].sum()
    assert there["w0"] > 1500 and read.get("w0", 0) == 0 and read["w399"] <= there["w399"]
    alone = bm25.by_blocks(one.withColumn("query", F.lit("w0")), lexical, plain_hits=0)
    assert alone.needed()[0]["n"].sum() < 0.5 * alone.hits
    assert rows_of(bm25.ranked(one, lexical, plain_hits=0)) == rows_of(bm25.ranked(one, lexical))


def test_blocks_bound_their_postings(spark, lexical):
    averages = {r.scope: r.avgdl for r in lexical.corpora.collect()}
    blocks = {(r.domain, r.tok, r.level): r for r in lexical.blocks.collect()}
    assert sum(b.n for b in blocks.values()) == lexical.postings.count()
    for r in lexical.postings.where("chunk_ord % 7 = 0").collect():
        impact = lambda avg: r.tf * 2.5 / (r.tf + 1.5 * (0.25 + 0.75 * r.dl / avg))  # noqa: B023, E731
        b = blocks[r.domain, r.tok, r.level]
        assert b.low - 1e-9 <= impact(averages[r.domain]) <= b.high + 1e-9 and b.low_all - 1e-9 <= impact(averages["*"]) <= b.high_all + 1e-9


def test_stored_postings_read_their_terms_folders(spark, lexical, corpus, requests, tmp_path):
    bm25.write(bm25.build(corpus), str(tmp_path / "lexical"))
    stored = bm25.read(spark, str(tmp_path / "lexical"))
    assert rows_of(bm25.ranked(requests, stored)) == rows_of(bm25.ranked(requests, lexical))
    some = bm25.of_terms(stored.postings, ["w3", "w390"], stored.buckets)
    assert len({f.split("bucket=")[1].split("/")[0] for f in some.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}) <= 2
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]


# --- cells -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(12, 10)) * 3
    return np.concatenate([centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 10)) * 0.3, np.zeros((2, 10)), np.repeat(rng.normal(size=(1, 10)), 30, axis=0)])


@pytest.fixture(scope="module")
def vectors(spark, points):
    return spark.createDataFrame([(i, f"v{i}", "ab"[i % 2], p.tolist()) for i, p in enumerate(points)], "chunk_ord bigint, id string, domain string, vector array<double>").repartition(5)


def asked_vectors(spark, points, step=20, depth=10):
    return spark.createDataFrame([(i, "*" if i % 3 else "a", depth, points[i].tolist()) for i in range(0, len(points), step)], "query_id bigint, scope string, depth int, vector array<double>")


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_by_blocks_is_exact(spark, points, vectors, metric):
    old = dense.QUERY_BLOCK, dense.CELLS_AT_ONCE, dense.EXACT_CELLS
    queries = asked_vectors(spark, points)
    unit = points / np.where((n := np.linalg.norm(points, axis=1)) == 0, 1, n)[:, None]
    for block, at_once, exact in (old, (13, 500, 1)):
        dense.QUERY_BLOCK, dense.CELLS_AT_ONCE, dense.EXACT_CELLS = block, at_once, exact
        try:
            got = {(r.query_id, r["rank"]): r for r in dense.nearest(vectors, queries, metric).collect()}
        finally:
            dense.QUERY_BLOCK, dense.CELLS_AT_ONCE, dense.EXACT_CELLS = old
        for q in range(0, len(points), 20):
            distance = ((points - points[q]) ** 2).sum(1) if metric == "l2" else 1 - unit @ unit[q]
            inside = [j for j in range(len(points)) if q % 3 or j % 2 == 0]
            want = sorted(inside, key=lambda j: (round(distance[j], 7), j))[:10]
            assert [got[q, n].distance for n in range(1, 11)] == pytest.approx([distance[j] for j in want], abs=1e-7)


def test_cells_lose_no_neighbour_and_read_few(spark, points, vectors, tmp_path):
    dense.write_cells(vectors, str(tmp_path))
    cells, centres, radius = dense.read_cells(spark, str(tmp_path))
    queries = asked_vectors(spark, points)
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_ord) for r in df.collect())
    assert key(dense.probed(cells, centres, queries, 2, radius=radius)) == key(dense.nearest(vectors, queries, "cosine"))
    one = queries.where("query_id = 40")
    block = next(dense.query_blocks(one, "cosine"))
    looks = np.zeros((1, len(centres)), bool)
    looks[0, 3] = True
    files = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plan = files(dense._scanned(cells, dense.replace(block, away=np.zeros((1, len(centres))), looks=looks, reach=np.array([0.5])), "cosine"))
    assert "PartitionFilters: [" in plan and "off" in plan.split("PushedFilters:")[1].split("\n")[0]
    near = dense.probed(cells.where(F.col("cell") >= 0), centres, one, 1, radius=radius)
    assert key(near) == key(dense.nearest(vectors, one, "cosine"))


def test_nearest_without_queries_or_vectors(spark, points, vectors):
    queries = asked_vectors(spark, points, 300)
    assert dense.nearest(vectors, queries.limit(0)).count() == 0 and dense.nearest(vectors.limit(0), queries).count() == 0


# --- numbers and trees -----------------------------------------------------------------------------------------


def test_numbers_follow_the_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b", "hot", "hot"]), rng.randrange(10_000), i) for i in range(5000)]
    frame = spark.createDataFrame(rows, "g string, x int, i int").repartition(7)
    got = numbering.numbered(frame, ["g", "x", "i"]).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    assert [(r.g, r.x, r.i) for r in sorted(got, key=lambda r: r.number)] == order and {r.number for r in got} == set(range(5000))
    within = {(r.g, r.x, r.i): r.number for r in numbering.numbered_within(frame, ["g"], ["x", "i"]).collect()}
    for g in (None, "a", "b", "hot"):
        assert [within[r] for r in order if r[0] == g] == list(range(sum(r[0] == g for r in rows)))
    assert numbering.numbered(frame.limit(0), ["x"]).count() == 0 and numbering.numbered_within(frame.limit(0), ["g"], ["x"]).count() == 0


def test_trees_by_pointer_doubling(spark):
    rng = random.Random(6)
    parents = {i: rng.randrange(i) if i else None for i in range(300)}
    parents |= {i: i - 1 for i in range(301, 400)} | {300: 12_345}  # a chain of a hundred below a node whose parent isn't there
    parents |= {500: 502, 501: 500, 502: 501, 503: 500, 504: 504}  # a cycle of three, one below it, one of its own
    rows = [("t", i, p, i * 7 % 1000) for i, p in parents.items()] + [("u", 1, None, 5), ("u", 2, 1, 4), (None, 1, 9, 1), (None, 2, 1, 1), ("t", None, 1, 1)]
    frame = spark.createDataFrame(rows, "tree string, node bigint, up bigint, ord bigint").repartition(5)
    got = {(r.tree, r.node): r for r in hierarchy.in_reading_order(frame, "node", "up", "ord", "tree").collect()}
    trails = {}
    for tree, node, *_ in rows:
        trail, at, of = [], node, {n: (p, o) for t, n, p, o in rows if t == tree}
        while at in of and at is not None and len(trail) <= 600:
            trail.insert(0, of[at][1])
            at = of[at][0]
        if node is not None and len(trail) <= 600:
            trails[tree, node] = trail
    assert {k: r.trail for k, r in got.items()} == trails and {k[1] for k in got if k[0] == "t"}.isdisjoint(range(500, 505))
    assert all(r.depth == len(r.trail) - 1 for r in got.values()) and got["t", 399].root == 300 and got["t", 5].root == 0
    for tree in ("t", "u", None):
        order = sorted((k for k in trails if k[0] == tree), key=lambda k: trails[k])
        assert [trails[k] for k in sorted(order, key=lambda k: got[k].reading_ord)] == [trails[k] for k in order]
    assert hierarchy.with_trails(frame.limit(0), "node", "up", "ord").count() == 0


# --- versions and scans ----------------------------------------------------------------------------------------


def test_versions_are_switched_last(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    assert v.current() is None and v.next() == 1
    spark.range(3).write.parquet(v.folder(1))
    assert v.current() is None  # written, but not published
    v.publish(1)
    reader = spark.read.parquet(v.folder(v.current()))
    assert v.current() == 1 and v.next() == 2
    spark.range(5).write.parquet(v.folder(2))
    assert v.current() == 1 and v.next() == 2  # a crash before publishing: the folder is cleared
    spark.range(7).write.parquet(v.folder(2))
    v.publish(2)
    assert reader.count() == 3 and spark.read.parquet(v.folder(v.current())).count() == 7
    with pytest.raises(RuntimeError):
        v.publish(2)
    assert v.drop_old(1) == [1] and v.marked() == [2] and v.drop_old(1) == []


CODE = 'Запрос = Новый Запрос("ВЫБРАТЬ Ссылка ИЗ Справочник.Товары КАК Т");'


def files(spark, rows):
    return spark.createDataFrame(rows, "label string, path string, content string")


def now(store):
    return {(r.config_label, r.module_path): r.code for r in store.examples().collect()}


def test_scans_change_and_delete(spark, tmp_path):
    store = ScanStore(spark, str(tmp_path / "scans"))
    text = lambda c: c * 60
    assert store.state().count() == 0 and now(store) == {}
    assert store.scan(files(spark, [("l", "a", text("a")), ("l", "b", text("b")), ("m", "a", text("m")), ("l", "empty", None)])) == {"new": 4, "changed": 0, "gone": 0, "unchanged": 0}
    assert now(store) == {("l", "a"): text("a"), ("l", "b"): text("b"), ("m", "a"): text("m")}
    # b is changed, a is gone, c is new; the tree m isn't listed, so it stays.
    assert store.scan(files(spark, [("l", "b", text("B")), ("l", "c", text("c")), ("l", "empty", "")])) == {"new": 1, "changed": 1, "gone": 1, "unchanged": 1}
    assert now(store) == {("l", "b"): text("B"), ("l", "c"): text("c"), ("m", "a"): text("m")}
    before = store.versions.current()
    assert store.scan(files(spark, [("l", "b", text("B")), ("l", "c", text("c")), ("l", "empty", "")]))["unchanged"] == 3 and store.versions.current() == before
    assert store.scan(files(spark, []), labels=["m"])["gone"] == 1 and ("m", "a") not in now(store)
    store.scan(files(spark, [("m", "a", text("n"))]))  # there again
    want = {("l", "b"): text("B"), ("l", "c"): text("c"), ("m", "a"): text("n")}
    assert now(store) == want
    store.compacted()
    assert now(store) == want and len(store.versions.marked()) == 1 and {(r.label, r.path) for r in store.state().collect()} == set(want) | {("l", "empty")}


def test_a_scan_cut_off_leaves_no_trace(spark, tmp_path, monkeypatch):
    store = ScanStore(spark, str(tmp_path / "scans"))
    store.scan(files(spark, [("l", "a", "a" * 60)]))
    monkeypatch.setattr(store.versions, "publish", lambda version: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.scan(files(spark, [("l", "a", "z" * 60)]))
    again = ScanStore(spark, str(tmp_path / "scans"))
    assert now(again) == {("l", "a"): "a" * 60}
    assert again.scan(files(spark, [("l", "a", "z" * 60)]))["changed"] == 1 and now(again) == {("l", "a"): "z" * 60}


def test_streams_of_changes(spark, tmp_path):
    store, source = ScanStore(spark, str(tmp_path / "scans")), tmp_path / "changes"
    schema = "label string, path string, content string, at bigint"
    rows = spark.createDataFrame([("l", "a", "a" * 60, 1), ("l", "b", "b" * 60, 1), ("l", "b", None, 2)], schema)
    rows.coalesce(1).write.json(str(source))
    stream = lambda: store.follow(spark.readStream.schema(schema).json(str(source)), str(tmp_path / "cp")).awaitTermination()
    stream()
    assert now(store) == {("l", "a"): "a" * 60}
    spark.createDataFrame([("l", "a", CODE + " " * 60, 3), ("l", "c", "c" * 60, 3)], schema).coalesce(1).write.mode("append").json(str(source))
    stream()
    assert set(now(store)) == {("l", "a"), ("l", "c")} and now(store)["l", "a"].startswith("Запрос")
    version = store.versions.current()
    stream()  # nothing new
    assert store.versions.current() == version


def test_listings_and_streams_of_a_folder(spark, tmp_path):
    folder = tmp_path / "src (1)+x"
    (folder / "deep er").mkdir(parents=True)
    (folder / "a.bsl").write_text("a" * 70, encoding="utf-8")
    (folder / "deep er" / "б.os").write_text("b" * 70, encoding="utf-8")
    assert {r.path for r in listing(spark, str(folder), "l").collect()} == {"a.bsl", "deep er/б.os"}
    store = ScanStore(spark, str(tmp_path / "scans"))
    store.follow(change_stream(spark, str(folder), "l"), str(tmp_path / "cp")).awaitTermination()
    assert set(now(store)) == {("l", "a.bsl"), ("l", "deep er/б.os")}
    assert store.scan(listing(spark, str(folder), "l"))["unchanged"] == 2
    (folder / "a.bsl").unlink()
    assert store.scan(listing(spark, str(folder), "l"))["gone"] == 1 and set(now(store)) == {("l", "deep er/б.os")}


# --- searches of chunks that are read once ---------------------------------------------------------------------


def test_a_scan_of_the_texts_gives_the_rows_of_all_postings(spark, lexical, corpus, requests):
    scanned = bm25.unstored(corpus)
    assert rows_of(bm25.ranked(requests, scanned)) == rows_of(bm25.ranked(requests, lexical))
    at_once = bm25.SCORES_AT_ONCE
    bm25.SCORES_AT_ONCE = 50  # a few chunks at a time
    try:
        assert rows_of(bm25.ranked(requests, scanned)) == rows_of(bm25.ranked(requests, lexical))
    finally:
        bm25.SCORES_AT_ONCE = at_once
    numbers = lambda index: sorted((r.scope, r.tok, r.df, round(r.idf, 9)) for r in index.terms.collect()) + sorted((r.scope, r.n, round(r.avgdl, 9), round(r.avg_idf, 9)) for r in index.corpora.collect())
    assert numbers(scanned) == numbers(lexical)


def test_a_scan_knows_negative_weights_and_empty_texts(spark):
    tiny = spark.createDataFrame([(0, "a", "x", "p q"), (1, "b", "x", "p"), (2, "c", None, "p r"), (3, "d", "x", None)], "chunk_ord bigint, id string, domain string, lexical_text string")
    asked = spark.createDataFrame([(1, "*", "p q", 4), (2, "x", "p", 3), (3, "*", "r", 2)], "query_id bigint, scope string, query string, depth int")
    assert rows_of(bm25.ranked(asked, bm25.unstored(tiny))) == rows_of(bm25.ranked(asked, bm25.build(tiny)))


def test_a_search_of_the_benchmark_shuffles_no_text_and_no_postings(spark):
    from lodestone.plans import catalog

    ranked, relevant, _ = catalog.benchmark_search(spark, "/root/testdata/sf0.001")
    for rows, scanned in ((ranked, True), (relevant, False)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and ("MapInArrow" in plan) == scanned and "InMemoryRelation" not in plan


def test_pages_are_python_objects_a_few_at_a_time():
    import pyarrow as pa

    from lodestone.functions import markup

    most = []

    class Watched(list):
        """A column that notes how many of its rows become objects at once."""

        def slice(self, at, n):
            return Watched(self[at : at + n])

        def to_pylist(self):
            most.append(len(self))
            return list(self)

    rows = ["a", None, *["b"] * 2500]
    assert markup.in_parts(str.upper, pa.string(), Watched(rows)).to_pylist() == ["A", "", *["B"] * 2500]
    assert max(most) <= markup.ROWS and markup.in_parts(str.upper, pa.string(), Watched()).to_pylist() == []


def test_pages_come_in_small_batches(spark):
    from lodestone.plans import catalog

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    catalog.QUERIES["markdown_sections"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500


def test_cells_fitted_on_some_vectors_hold_all_and_lose_no_neighbour(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"v{i}", "x", (rng.normal(size=6) + 3 * (i % 4)).tolist()) for i in range(900)]
    vectors = spark.createDataFrame(rows, "chunk_ord bigint, id string, domain string, vector array<double>").repartition(3)
    queries = vectors.where("chunk_ord % 20 = 0").selectExpr("chunk_ord AS query_id", "'*' AS scope", "7 AS depth", "vector")
    fit = dense.FIT
    dense.FIT = 150
    try:
        cells, centres = dense.with_cells(vectors)
        assert cells.count() == 900 and len(centres) == 30
    finally:
        dense.FIT = fit
    for r in cells.where("chunk_ord % 50 = 0").collect():
        away = np.linalg.norm(centres - np.array(r.vector) / np.linalg.norm(r.vector), axis=1)
        assert r.cell == away.argmin() and abs(r.off - away.min()) < 1e-9
    found = lambda rows: sorted((r.query_id, r["rank"], r.chunk_ord) for r in rows.collect())
    assert found(dense.probed(cells, centres, queries)) == found(dense.nearest(vectors, queries, "cosine"))


def test_rows_beyond_the_bar_go_and_ties_stay():
    rng = np.random.default_rng(3)
    best, distance = dense.NearestRows(np.array([3, 5])), rng.integers(0, 2000, (2, 300_000)) / 100
    distance[0, ::7] += 1e-12  # equal to nine digits
    ords = rng.permutation(300_000)
    for at in range(0, 300_000, 1000):
        best.add(np.array([0, 1]), distance[:, at : at + 1000], ords[at : at + 1000], ords[at : at + 1000].astype(object))
    of, _, got, _, _ = best.first()
    for q, depth in ((0, 3), (1, 5)):
        assert got[of == q].tolist() == ords[np.lexsort((ords, np.round(distance[q], 9)))][:depth].tolist()
    with pytest.raises(ValueError):
        import pyarrow as pa

        dense.points_of(pa.array([[1.0], [1.0, 2.0]]))


def test_a_hybrid_search_keeps_no_postings(spark):
    from lodestone.plans import catalog

    request, index, _, _ = catalog.prepared(spark, "/root/testdata/sf0.001")
    assert index.words is not None and not index.postings.is_cached and not index.forward.is_cached
    plan = bm25.ranked(request.withColumn("depth", F.lit(20)), index)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan and "InMemoryTableScan" not in plan


def test_a_hybrid_search_reads_the_texts_once_and_shuffles_none(spark, monkeypatch):
    from lodestone.plans import catalog

    scans, plain = [], bm25.by_scan
    monkeypatch.setattr(bm25, "by_scan", lambda *a: scans.append(a) or plain(*a))
    request, index, vecs, qv = catalog.prepared(spark, "/root/testdata/sf0.001")
    found = search.candidates(request, index, vecs, qv, catalog.SETTINGS)
    assert len(scans) == 1
    # The same candidates as by a search of its own for the domains.
    apart = search.larger(search.fused_hybrid(request, index, vecs, qv, catalog.SETTINGS), search.fused_domains(request, index, catalog.SETTINGS))
    rows = lambda x: sorted((r.query_id, r.id, round(r.score, 9), r.seen) for r in x.collect())
    assert rows(found) == rows(apart)
    found = written(found.select("id"), "candidates")
    read = catalog.corpus(spark, "/root/testdata/sf0.001", found)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "RoundRobin" not in plan
    assert {r.id for r in read.select("id").collect()} == {r.id for r in found.distinct().collect()}
