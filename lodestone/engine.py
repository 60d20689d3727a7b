"""The engine's front door: an index on disk, and searches, topics, counts and examples over it."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions.scoring import SearchSettings
from lodestone.functions.text import expanded_query
from lodestone.operators import bm25, chunks, dense, evaluation, examples, search, stats
from lodestone.sources import jsonl
from lodestone.sources.embedding import Backend, Memo, embedded, provider_of
from lodestone.tables import Versions


@dataclass
class Index:
    chunks: DataFrame
    vectors: DataFrame
    lexical: bm25.Bm25Index
    sliced: DataFrame | None = None
    slices: int = 0

    def of(self, wanted: DataFrame) -> DataFrame:
        """The chunks of the ids in ``wanted``."""
        return self.chunks if self.sliced is None else chunks.fetched(self.sliced, wanted, self.slices)


#: An index of fewer vectors has no cells: a plain search is as fast.
CELLS_FROM = 256


def build_index(rows: DataFrame, path: str, model: Backend, built_at: str, platform_version: str = "", cells: bool = True, provider: str = "") -> int:
    """Writes chunks with their texts, postings and statistics, vectors (with their cells, if ``cells`` and there are enough) and
    the build's description; gives the number of chunks.

    rows: chunks with chunk_ord. Of several chunks with one id the first stays. An empty table writes an empty index.
    """
    spark = rows.sparkSession
    ready = chunks.with_texts(chunks.first_by_id(chunks.completed(rows)))
    slices = chunks.slices_for(rows.count())
    chunks.write_sliced(ready, f"{path}/chunks", slices)
    spark.createDataFrame([(slices,)], "slices int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    stored = spark.read.schema(ready.schema).parquet(f"{path}/chunks")
    found = embedded(stored.select("chunk_ord", "id", "domain", "semantic_text"), "semantic_text", model)
    chunks.write_index(found, f"{path}/vectors")
    bm25.write(bm25.build(stored), f"{path}/lexical")
    n, size = stored.count(), dense.check_dimensions(spark.read.schema(found.schema).parquet(f"{path}/vectors"))
    cells = cells and n >= CELLS_FROM
    if cells:
        dense.write_cells(spark.read.schema(found.schema).parquet(f"{path}/vectors"), path)
    jsonl.write_index_meta(spark, f"{path}/meta", n, built_at, platform_version, provider or provider_of(model), model.model_id, size or None, cells)
    return n


def rebuild_index(rows: DataFrame, path: str, model: Backend, built_at: str, platform_version: str = "", cells: bool = True, provider: str = "", keep: int = 2) -> int:
    """Like ``build_index``, as a new version in the folder ``path``, which becomes current when it is whole. Searches that are open go on
    with the version that they have opened; the newest ``keep`` versions stay. A build that fails leaves the current one as it is."""
    versions = Versions(rows.sparkSession, path)
    version = versions.next()
    n = build_index(rows, versions.folder(version), model, built_at, platform_version, cells, provider)
    versions.publish(version)
    versions.drop_old(keep)
    return n


def located(spark: SparkSession, path: str) -> str:
    """The folder of the current version, or ``path`` itself where an index lies without versions."""
    versions = Versions(spark, path)
    current = versions.current()
    return path if current is None else versions.folder(current)


def open_index(spark: SparkSession, path: str) -> Index:
    path = located(spark, path)
    rows = spark.read.parquet(f"{path}/chunks")
    slices = spark.read.parquet(f"{path}/layout").first().slices if there(spark, f"{path}/layout") else 0
    return Index(rows.drop("slice"), spark.read.parquet(f"{path}/vectors"), bm25.read(spark, f"{path}/lexical"), rows if slices else None, slices)


def there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def drop_index(spark: SparkSession, path: str) -> bool:
    """Deletes an index with all its versions; whether there was one. A folder without an index's description stays as it is."""
    if not there(spark, f"{located(spark, path)}/meta"):
        return False
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def index_meta(spark: SparkSession, path: str) -> dict:
    """The description of a built index; empty without one."""
    path = located(spark, path)
    found = jsonl.read_index_meta(spark, f"{path}/meta").first() if there(spark, f"{path}/meta") else None
    return found.asDict() if found else {}


def readiness(spark: SparkSession, settings: Settings) -> DataFrame:
    """(severity, code) of what keeps searches over this installation from working or being good; no rows if all is well."""
    index, export = located(spark, str(settings.index_dir)), str(settings.export_dir)
    meta, has_export, has_index = index_meta(spark, index), there(spark, export), there(spark, f"{index}/chunks")
    n_indexed, n_bsp, readable = 0, 0, False
    if has_index:
        try:
            counts = spark.read.parquet(f"{index}/chunks").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("domain") == "bsp").alias("bsp")).first()
            n_indexed, n_bsp, readable = counts.n, counts.bsp, True
        except (AnalysisException, PySparkException):
            readable = False
    own = settings.embedding.resolved()
    n_export = jsonl.read_chunks(spark, export).count() if has_export else 0
    fits = settings.embedding.aligned(meta) == own
    state = [(has_export and n_export > 0, bool(meta), has_index, readable, settings.build_vector_index, meta.get("vector_index_built"), settings.bsp.enabled, fits, n_export, n_indexed, n_bsp)]
    names = "export_there boolean, meta_there boolean, index_there boolean, index_readable boolean, wants_vector_index boolean, vector_index_built boolean, bsp_expected boolean, embedding_matches boolean, n_export bigint, n_indexed bigint, n_bsp bigint"
    return stats.readiness_issues(spark.createDataFrame(state, names), vectors_from=CELLS_FROM)


class Engine:
    """Searches one index. Every method gives a DataFrame; nothing runs until it is read.

    Queries must be embedded by the model that the index was built with; another one is an error.
    """

    @classmethod
    def configured(cls, spark: SparkSession, settings: Settings, code: DataFrame | None = None, memo: str | None = None) -> Engine:
        """Over the installation's index, with the model that it was built with, whatever the settings name now."""
        path = str(settings.index_dir)
        return cls(spark, path, settings.embedding.aligned(index_meta(spark, path)).backend(), settings.search, code, memo)

    def __init__(self, spark: SparkSession, path: str, model: Backend, settings: SearchSettings | None = None, code: DataFrame | None = None, memo: str | None = None):
        """memo: a folder where vectors of queries are kept from one search to the next."""
        self.spark, self.model, self.settings, self.code = spark, model, settings or SearchSettings(), code
        self.memo = Memo(spark, memo) if memo else None
        path = located(spark, path)  # whatever is published later, this engine stays with its version
        built = index_meta(spark, path).get("embedding_model")
        if built and built != model.model_id:
            raise ValueError(f"the index was built with the model {built!r}, not {model.model_id!r}")
        self.path, self.index = path, open_index(spark, path)

    def neighbours(self, queries: DataFrame) -> DataFrame:
        """Nearest chunks by cosine of (query_id, scope, depth, vector): only cells that can hold some are looked into, if there are cells."""
        if not there(self.spark, f"{self.path}/cells"):
            return dense.nearest(self.index.vectors, queries, "cosine")
        cells, centres, radius = dense.read_cells(self.spark, self.path)
        return dense.probed(cells, centres, queries, radius=radius)

    def evaluated(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """(queries, mrr, latency_ms) of questions (query, domain, expected_topic_ids), asked as one batch; the latency is a query's share."""
        # Numbered by their content, so that every pass gives the same numbers.
        rows = questions.select("query", F.coalesce("domain", F.lit("all")).alias("domain"), "expected_topic_ids").distinct()
        rows = rows.withColumn("query_id", F.xxhash64("query", "domain", "expected_topic_ids"))
        began = time.perf_counter()
        found = self.search_batch(rows.select("query_id", "query", "domain", F.lit(k).alias("k"))).select("query_id", "id", "rank").collect()
        took = 1000 * (time.perf_counter() - began)
        ranked = self.spark.createDataFrame([tuple(r) for r in found], "query_id bigint, id string, rank int")
        relevant = rows.select("query_id", F.explode("expected_topic_ids").alias("id"))
        return evaluation.mean_reciprocal_rank(ranked, relevant, rows, k).withColumn("latency_ms", F.lit(took) / F.greatest("queries", F.lit(1)))

    def warm(self) -> None:
        """Loads the statistics and the model, so that the first search doesn't have to."""
        for table in (self.index.lexical.postings, self.index.lexical.terms, self.index.lexical.corpora):
            table.count()
        self.model.embed_query("warm")

    def search_batch(self, queries: DataFrame) -> DataFrame:
        """queries: query_id, query, domain, k. Result rows of all of them."""
        texts = queries.select("query_id", expanded_query(F.col("query")).alias("query"))
        wanted = embedded(texts, "query", self.model, queries=True) if self.memo is None else self.memo.embedded(texts, "query", self.model)
        return search.search(queries, self.index.of, self.index.lexical, self.index.vectors, wanted, self.settings)

    def search(self, query: str, domain: str = "all", limit: int | None = None) -> DataFrame:
        if not query.strip():
            raise ValueError("an empty query")
        if limit is not None and not 1 <= limit <= 50:
            raise ValueError("limit is between 1 and 50")
        row = self.spark.createDataFrame([(1, query, domain, limit)], "query_id bigint, query string, domain string, k int")
        return self.search_batch(row).drop("query_id").orderBy("rank")

    def topic(self, topic_id: str) -> DataFrame:
        """The chunk with an id, with its code examples if there are any."""
        found = chunks.topic(self.index.chunks, topic_id)
        return found if self.code is None else examples.topics_with_examples(found, self.code)

    def stats(self) -> DataFrame:
        counts = stats.by_domain(self.index.chunks)
        return counts if self.code is None else counts.unionByName(self.code.agg(F.lit("examples").alias("domain"), F.count(F.lit(1)).alias("n")))

    def find_examples(self, query: str = "", topic_id: str = "", limit: int = 5) -> DataFrame:
        """Examples of a topic, or that match a query; a topic goes first."""
        if self.code is None or not (query or topic_id):
            raise ValueError("a query or a topic is needed, and code to search")
        return examples.of_topic(self.code, topic_id, limit) if topic_id else examples.searched(self.code, query, limit)
