"""Index versions, late fetch, kept query vectors, kept model answers."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestone import config
from lodestone.engine import Engine, build_index, drop_index, index_meta, located, rebuild_index
from lodestone.operators import chunks, examples, search
from lodestone.sources.chat import Ledger
from lodestone.sources.embedding import HashingBackend, Memo, backend, embedded
from lodestone.tables import Versions


def some_chunks(spark, n, word="text"):
    rows = spark.range(n).select(F.col("id").alias("chunk_ord"), F.concat(F.lit("c:"), "id").alias("id"), F.when(F.col("id") % 3 == 0, "bsp").otherwise("bsl_lang").alias("domain"), F.concat(F.lit("Title"), "id").alias("title_en"), F.concat(F.lit(f"{word} number "), "id").alias("text"))
    return chunks.completed(rows)


def test_a_search_during_a_rebuild(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    assert rebuild_index(some_chunks(spark, 40), path, backend("hashing"), "2020-01-01") == 40
    engine = Engine(spark, path, backend("hashing"))
    before = [r.asDict() for r in engine.search("Title7", limit=5).collect()]
    assert before and before[0]["id"] == "c:7"
    rebuild_index(some_chunks(spark, 60, "other"), path, backend("hashing"), "2020-01-02")
    assert [r.asDict() for r in engine.search("Title7", limit=5).collect()] == before  # its version is still there
    fresh = Engine(spark, path, backend("hashing"))
    assert index_meta(spark, path)["indexed_count"] == 60 and fresh.index.chunks.where("text like 'other%'").count() == 60
    # Late fetch gives what all chunks give.
    asked = spark.createDataFrame([(1, "Title50", "all", 9), (2, "number 7", "bsp", 4), (3, "x", "none", 4)], "query_id bigint, query string, domain string, k int")
    wanted = embedded(asked.select("query_id", "query"), "query", fresh.model, queries=True)
    whole = search.search(asked, fresh.index.chunks, fresh.index.lexical, fresh.index.vectors, wanted, fresh.settings)
    late = search.search(asked, fresh.index.of, fresh.index.lexical, fresh.index.vectors, wanted, fresh.settings)
    assert sorted(whole.collect(), key=str) == sorted(late.collect(), key=str) and late.count() == 13
    monkeypatch.setattr(Versions, "publish", lambda self, version: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        rebuild_index(some_chunks(spark, 5), path, backend("hashing"), "2020-01-03")
    monkeypatch.undo()
    assert index_meta(spark, path)["built_at" if "built_at" in index_meta(spark, path) else "indexed_count"] in ("2020-01-02", 60)
    rebuild_index(some_chunks(spark, 45), path, backend("hashing"), "2020-01-04", keep=1)
    assert Versions(spark, path).marked() == [3] and drop_index(spark, path) and not drop_index(spark, path)


def test_an_index_without_a_provider_fits_its_settings(spark, tmp_path):
    path = str(tmp_path / "index")
    build_index(some_chunks(spark, 10), path, backend("hashing"), "2020-01-01")
    assert index_meta(spark, path)["embedding_provider"] == "hashing" and located(spark, path) == path
    settings = config.EmbeddingSettings(provider="hashing")
    assert settings.aligned(index_meta(spark, path)) == settings.resolved()


def test_only_the_candidates_slices_are_read(spark, tmp_path):
    rows = some_chunks(spark, 3000).withColumn("text", F.repeat("text", 50))
    chunks.write_sliced(rows, str(tmp_path / "c"), 16)
    stored = spark.read.parquet(str(tmp_path / "c"))
    wanted = spark.createDataFrame([("c:5",), ("c:77",), ("c:5",), ("none",)], "id string")
    got = chunks.fetched(stored, wanted, 16)
    assert {(r.id, r.domain) for r in got.collect()} == {("c:5", "bsl_lang"), ("c:77", "bsl_lang")} and "slice" not in got.columns
    files = got.select(F.input_file_name()).distinct().count()
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert files <= 2 and "slice" in scan.split("PartitionFilters:")[1].split("]")[0] and "In(id" in scan
    many = chunks.fetched(stored, rows.select("id"), 16)
    assert many.count() == 3000
    assert [chunks.slices_for(n) for n in (0, 4096, 4097, 1 << 40)] == [1, 1, 2, chunks.MOST_SLICES]


class Counting(HashingBackend):
    """Writes down what it was asked."""

    def __init__(self, log):
        super().__init__()
        self.log = log

    def embed_queries(self, texts):
        with open(self.log, "a", encoding="utf-8") as out:
            out.writelines(t + "\n" for t in texts)
        return [self.embed_query(t) for t in texts]


def test_a_second_search_asks_the_model_for_nothing(spark, tmp_path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    log, path = tmp_path / "asked", str(tmp_path / "index")
    model = Counting(str(log))
    build_index(some_chunks(spark, 20), path, model, "2020-01-01")
    plain = Engine(spark, path, model).search("Title7", limit=3).collect()
    log.write_text("")
    for _ in range(2):
        engine = Engine(spark, path, model, memo=str(tmp_path / "memo"))
        assert engine.search("Title7", limit=3).collect() == plain
        assert log.read_text().split("\n")[:-1] == ["Title7"]
    engine.search("Title8", limit=3).collect()
    assert log.read_text().split("\n")[:-1] == ["Title7", "Title8"]
    memo = Memo(spark, str(tmp_path / "memo"))
    memo.MOST = 1
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "Title7")], "query_id bigint, query string")
    found = {r.query_id: r.vector for r in memo.embedded(rows, "query", model).collect()}
    assert set(found) == {1, 2, 3, 4} and found[1] == found[2] and len(memo.versions.marked()) == 1
    assert memo.embedded(rows.limit(0), "query", model).count() == 0


class Failing:
    """Fails for some prompts, as often as it is told to."""

    def __init__(self, folder):
        self.folder = folder

    def answer(self, prompt):
        import pathlib
        import uuid

        pathlib.Path(self.folder, f"{prompt}-{uuid.uuid4().hex}").touch()
        if prompt == "down" and not pathlib.Path(self.folder, "up").exists():
            raise OSError("no service")
        if prompt == "shaky" and len(list(pathlib.Path(self.folder).glob("shaky-*"))) < 3:
            raise TimeoutError
        return prompt.upper()


def test_model_answers_are_kept(spark, tmp_path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    calls = tmp_path / "calls"
    calls.mkdir()
    asked = lambda p: len(list(calls.glob(f"{p}-*")))
    ledger = Ledger(spark, str(tmp_path / "ledger"), batch=2, tries=3, pause=0.01)
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", "a", "shaky", "down", None, "c"])], "ex_ord bigint, prompt string")
    got = {r.ex_ord: (r.answer, r.error) for r in ledger.answered(rows, "prompt", Failing(str(calls))).collect()}
    assert got == {0: ("A", None), 1: ("B", None), 2: ("A", None), 3: ("SHAKY", None), 4: (None, "OSError: no service"), 5: ("", None), 6: ("C", None)}
    assert asked("a") == 1 and asked("shaky") == 3 and asked("down") == 3 and len(ledger.versions.marked()) == 3
    (calls / "up").touch()
    again = {r.ex_ord: r.answer for r in ledger.answered(rows, "prompt", Failing(str(calls))).collect()}
    assert again[4] == "DOWN" and asked("a") == 1 and asked("c") == 1 and asked("down") == 4
    assert ledger.answered(rows.limit(0), "prompt", Failing(str(calls))).count() == 0


def test_a_run_that_is_cut_off_goes_on(spark, tmp_path, monkeypatch):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    calls = tmp_path / "calls"
    calls.mkdir()
    ledger = Ledger(spark, str(tmp_path / "ledger"), batch=3, pause=0.01)
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(9)], "ex_ord bigint, prompt string")
    publish = ledger.versions.publish
    monkeypatch.setattr(ledger.versions, "publish", lambda v: publish(v) if v < 3 else (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ledger.answered(rows, "prompt", Failing(str(calls)))
    again = Ledger(spark, str(tmp_path / "ledger"), batch=3)
    assert {r.ex_ord: r.answer for r in again.answered(rows, "prompt", Failing(str(calls))).collect()} == {i: f"P{i}" for i in range(9)}
    assert len(list(calls.iterdir())) == 12  # the batch that was cut off is asked again, no other


def test_links_by_blocks_of_titles(spark):
    titles = [(i, f"t{i}", f"alpha{i} beta{i % 7} gamma gamma und der {'wort' * (i % 3)}") for i in range(60)]
    topics = spark.createDataFrame([*titles, (60, "none", "ab cd"), (61, "null", None)], "topic_ord bigint, id string, title string")
    texts = [(i, f"e{i}", f"xalpha{i % 60}x beta{i % 5} ... gammas", "" if i % 2 else "WORTWORT") for i in range(90)] + [(90, "null", None, None), (91, "empty", "", "")]
    code = spark.createDataFrame(texts, "ex_ord bigint, id string, code string, query_text string").repartition(3)
    want = {}
    for e, _, a, b in texts:
        low = " ".join(x for x in (a, b) if x is not None).lower()
        hits = [(sum(w in low for w in words), len(words), o, t) for o, t, title in titles for words in [[w for w in title.lower().split() if len(w) > 3]]]
        best = sorted((-h / n, o, t) for h, n, o, t in hits if h >= 2)[:3]
        if best:
            want[e] = ([t for *_, t in best], -best[0][0])
    for size in (16_000_000, 200, 1):
        got = {r.ex_ord: (r.topic_ids, r.relevance) for r in examples.linked_by_words(code, topics, block_bytes=size).collect()}
        assert got == want
    assert examples.linked_by_words(code, topics.limit(0)).count() == 0
