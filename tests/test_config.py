import pytest
from pyspark.sql import functions as F

from lodestone import config
from lodestone.engine import Engine, build_index, drop_index, index_meta, readiness
from lodestone.operators import bm25, chunks, dense
from lodestone.sources.embedding import backend, query_vectors


def test_defaults_without_a_file(tmp_path):
    assert config.load(str(tmp_path / "none.yaml")) == config.Settings()


def test_a_file_changes_what_it_names(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("index_dir: here/index\nsearch: {final_top_k: 7}\nbsp: {enabled: 'yes'}\nlocal_configs: [{path: a, label: b}]\n")
    found = config.load(str(path))
    assert found.search.final_top_k == 7 and found.search.rrf_k == 60 and found.bsp.enabled and found.index_dir == tmp_path / "here/index"
    assert found.local_configs == ({"path": "a", "label": "b"},)


@pytest.mark.parametrize("text", ["search: {rrf_k: 0}", "search: 3", "[1]", "bsp: {enabled: maybe}", "embedding: {timeout: x}", "index_dir: 5", "local_configs: [{path: a}]"])
def test_wrong_values_are_errors(tmp_path, text):
    (tmp_path / "c.yaml").write_text(text)
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "c.yaml"))


def test_unknown_names_are_reported(tmp_path):
    (tmp_path / "c.json").write_text('{"search": {"colour": 1}}')
    with pytest.warns(UserWarning, match="search.colour"):
        config.load(str(tmp_path / "c.json"))


def test_an_update_is_whole_or_nothing(tmp_path):
    path = str(tmp_path / "c.yaml")
    assert config.update(path, "embedding", {"provider": "ollama"}).embedding.provider == "ollama"
    before = (tmp_path / "c.yaml").read_text()
    with pytest.raises(ValueError):
        config.update(path, "embedding", {"timeout": -1})
    assert (tmp_path / "c.yaml").read_text() == before and len(list(tmp_path.iterdir())) == 1


def test_providers_and_models():
    s = config.EmbeddingSettings
    assert s().resolved().provider == "sentence_transformers" and s(base_url="http://x").resolved().model == "text-embedding-3-small"
    assert s(provider="huggingface").resolved().provider == "sentence_transformers"
    with pytest.warns(UserWarning):
        assert s(provider="ollama", model="intfloat/multilingual-e5-base").resolved().model == "nomic-embed-text"
    with pytest.raises(ValueError, match="provider"):
        s(provider="nothing").resolved()
    built = {"indexed_count": 3, "embedding_provider": "sentence_transformers", "embedding_model": "intfloat/multilingual-e5-small"}
    aligned = s(provider="ollama", query_prefix="").aligned(built)
    assert (aligned.model, aligned.query_prefix) == ("intfloat/multilingual-e5-small", "query: ")
    assert s(provider="ollama").aligned({}) == s(provider="ollama").resolved()


def test_equal_queries_are_embedded_once():
    class Counting:
        model_id, asked = "m", []

        def embed_queries(self, texts):
            self.asked.append(list(texts))
            return [[len(t)] for t in texts]

    known = {}
    assert query_vectors(Counting(), ["a", "bb", "a"], known) == [[1], [2], [1]] and query_vectors(Counting(), ["bb"], known) == [[2]]
    assert Counting.asked == [["a", "bb"]]


def test_an_installation(spark, tmp_path):
    rows = chunks.completed(spark.range(300).select(F.col("id").alias("chunk_ord"), F.concat(F.lit("c:"), "id").alias("id"), F.lit("bsp").alias("domain"), F.concat(F.lit("Title"), "id").alias("title_en"), F.concat(F.lit("text number "), "id").alias("text")))
    index, export = str(tmp_path / "index"), str(tmp_path / "export")
    settings = config.Settings(index_dir=tmp_path / "index", export_dir=tmp_path / "export", embedding=config.EmbeddingSettings(provider="hashing"))
    assert [r.code for r in readiness(spark, settings).collect()] == ["export_missing"]
    rows.write.json(export)
    assert [r.code for r in readiness(spark, settings).collect()] == ["index_missing"]
    build_index(rows, index, backend("hashing"), "2020-01-01", provider="hashing")
    assert readiness(spark, settings).collect() == [] and index_meta(spark, index)["vector_index_built"]
    with pytest.raises(ValueError, match="built with"):
        Engine(spark, index, backend("hashing", dimensions=8))
    other = config.Settings(index_dir=tmp_path / "index", export_dir=tmp_path / "export", embedding=config.EmbeddingSettings(provider="hashing", model="hashing-8"))
    assert [r.code for r in readiness(spark, other).collect()] == ["embedding_mismatch"]
    engine = Engine.configured(spark, other)
    assert engine.model.model_id == "hashing-64"
    # The stored index gives what one built in memory gives.
    asked = spark.createDataFrame([(1, "*", "title7 title12", 9)], "query_id bigint, scope string, query string, depth int")
    fresh = bm25.ranked(asked, bm25.build(spark.read.parquet(f"{index}/chunks"))).select("id", "rank", F.round("raw", 9)).collect()
    assert sorted(bm25.ranked(asked, engine.index.lexical).select("id", "rank", F.round("raw", 9)).collect()) == sorted(fresh)
    vectors = engine.index.vectors.where("chunk_ord < 5").select(F.col("chunk_ord").alias("query_id"), F.lit("*").alias("scope"), F.lit(3).alias("depth"), "vector")
    key = lambda rows: {(r.query_id, r.id, r["rank"]) for r in rows.collect()}
    assert key(engine.neighbours(vectors)) == key(dense.nearest(engine.index.vectors, vectors, "cosine"))
    questions = spark.createDataFrame([("Title7", "bsp", ["c:7"]), ("Title8", "bsp", ["none"])], "query string, domain string, expected_topic_ids array<string>")
    got = engine.evaluated(questions).first()
    assert got.queries == 2 and 0 < got.mrr <= 0.5 and got.latency_ms > 0
    assert drop_index(spark, index) and not drop_index(spark, index)
