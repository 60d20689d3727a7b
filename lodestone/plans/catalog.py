"""Queries over the driver tables: each applies an operator to its whole table. Documents stand for chunks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import markup, scoring, text
from lodestone.functions.scoring import SearchSettings
from lodestone.operators import bm25, chunks, dense, evaluation, examples, hierarchy, numbering, search, stats
from lodestone.plans import sql
from lodestone.sources import chat, help_book, modules
from lodestone.streaming.incremental import ScanStore
from lodestone.tables import shared_dir, small_batches, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The query batch: id, text, domain, results, and whose vector it has.
ASKED = [(1, "the other nation with this", "all", 5, 10), (2, "of the and for thing", "en", 5, 20), (3, "der und die mit", "de", 3, 30), (4, "строку в массив", "all", 4, 40)]
ASKED_SQL = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}', '{'*' if d == 'all' else d}', {k}, {v})" for i, q, d, k, v in ASKED) + ") v(query_id, query, scope, k, vec))"
QUERY = ASKED[0][1]
NAMES = ["СтрРазделить", "HTTPСоединение.Получить", "getPath value", "strSplit.Join x", "ТаблицаЗначений"]
SETTINGS = SearchSettings()


def registered(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores, where it comes in fewer parts than there are: a small table in one file. Larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def corpus(spark: SparkSession, d: str, found: DataFrame | None = None) -> DataFrame:
    """The documents as chunks; of ``found`` (a written table with ``id``) only, if that is given."""
    title = F.regexp_extract("text", r"^[^.\n]*", 0)
    docs = table(spark, d, "documents")
    docs = spread(docs) if found is None else search.of_candidates(docs, F.concat_ws(":", "lang", "doc_id"), found)
    rows = docs.select(F.col("doc_id").alias("chunk_ord"), F.concat_ws(":", "lang", "doc_id").alias("id"), F.col("lang").alias("domain"), F.lit("").alias("title_ru"), title.alias("title_en"), F.col("source").alias("path"), F.lit("page").alias("entity_kind"), F.lit("").alias("html_path"), F.lit("").alias("syntax"), "text")
    rows = rows.withColumn("lexical_text", F.trim(F.concat_ws(" ", title, text.split_identifier(title)))).withColumn("semantic_text", F.col("text"))
    return rows.withColumn("search_text", F.concat_ws(" ", "lexical_text", "semantic_text"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id")
    return rows.select(F.col("vec_id").alias("chunk_ord"), F.concat_ws(":", "lang", "vec_id").alias("id"), F.col("lang").alias("domain"), F.col("embedding").alias("vector"))


VECTORS_SQL = "vecs AS (SELECT vec_id AS chunk_ord, lang || ':' || CAST(vec_id AS VARCHAR) AS id, lang AS domain, embedding AS vector FROM embeddings JOIN documents ON doc_id = vec_id)"


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([x[:4] for x in ASKED], "query_id bigint, query string, domain string, k int")


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([(x[0], x[4]) for x in ASKED], "query_id bigint, vec_id bigint")
    return table(spark, d, "embeddings").join(F.broadcast(wanted), "vec_id").select("query_id", F.col("embedding").alias("vector"))


def one(spark: SparkSession, values: list[str], name: str = "x") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def values_sql(values: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{v}')" for v in values) + ") v(x)"


# --- words -----------------------------------------------------------------------------------------------------


@registered(f"SELECT doc_id, array_to_string({sql.tokens('text')}, ' ') AS tokens, CAST(len({sql.tokens('text')}) AS INTEGER) AS n_tokens FROM documents")
def tokenize(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", text.normalized(F.col("text")).alias("tokens"), F.size(text.tokens(F.col("text"))).alias("n_tokens"))


@registered(f"SELECT doc_id, array_to_string({sql.stems('text')}, ' ') AS stems FROM documents")
def stem_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.stems(F.col("text")), " ").alias("stems"))


@registered(f"SELECT item_id, array_to_string({sql.content_stems('text')}, ' ') AS stems FROM benchmark")
def content_stems(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(text.content_stems(F.col("text")), " ").alias("stems"))


@registered(f"SELECT x AS name, {sql.split_identifier('x')} AS words FROM (SELECT p_name AS x FROM part UNION ALL SELECT x FROM {values_sql(NAMES)})")
def split_identifier(spark, d):
    rows = table(spark, d, "part").select(F.col("p_name").alias("x")).union(one(spark, NAMES))
    return rows.select(F.col("x").alias("name"), text.split_identifier(F.col("x")).alias("words"))


@registered(f"SELECT page_id, array_to_string({sql.tokens('url')}, ' ') AS normalized FROM pages")
def normalize(spark, d):
    return table(spark, d, "pages").select("page_id", text.normalized(F.col("url")).alias("normalized"))


PAIRS = [("строку", "строки"), ("массив", "массива"), ("раз", "разделить"), ("ab", "abc"), ("дом", "кот"), ("split", "splitting"), ("я", "я")]


@registered("SELECT a, b, " + sql.related("a", "b") + " AS related FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ") v(a, b)")
def tokens_related_pairs(spark, d):
    return spark.createDataFrame(PAIRS, "a string, b string").withColumn("related", text.related(F.col("a"), F.col("b")))


TURNS = {"строку в массив": "строку в массив. преобразовать строку в массив. получить массив из строку. разделить строку", "число в дату": "число в дату. преобразовать число в дату. получить дату из число", "split string": "split string", "в": "в"}


@registered("SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{e}')" for q, e in TURNS.items()) + ") v(x, expanded)")
def transformation_expand(spark, d):
    return one(spark, list(TURNS)).withColumn("expanded", text.expanded_query(F.col("x")))


# --- counts and filters ----------------------------------------------------------------------------------------


@registered("SELECT coalesce(lang, 'total') AS domain, count(*) AS n FROM documents GROUP BY ROLLUP (lang)")
def domain_stats(spark, d):
    return stats.by_domain(table(spark, d, "documents").select(F.col("lang").alias("domain")))


@registered("SELECT DISTINCT lang AS domain FROM documents WHERE lang <> ''")
def domain_list(spark, d):
    return stats.known_domains(table(spark, d, "documents").select(F.col("lang").alias("domain")))


@registered("SELECT doc_id, length(text) AS size FROM documents WHERE lang = 'de'")
def domain_filter(spark, d):
    rows = table(spark, d, "documents").where(search.domain_predicate("de", "lang"))
    return rows.select("doc_id", F.length("text").cast("bigint").alias("size"))


ALIAS_ROWS = ["bsl", "query", "all", "", "en"]


@registered("SELECT * FROM (VALUES ('bsl', 'bsl_lang'), ('query', 'query_lang'), ('all', '*'), ('', '*'), ('en', 'en')) v(x, scope)")
def alias_filter(spark, d):
    return one(spark, ALIAS_ROWS).withColumn("scope", search.scope_of(F.col("x")))


# --- BM25 ------------------------------------------------------------------------------------------------------


def index_of(spark, d) -> bm25.Bm25Index:
    return bm25.build(corpus(spark, d)).persist()


def searched_once(spark, d) -> bm25.Bm25Index:
    return bm25.unstored(corpus(spark, d))


@registered(f"WITH {sql.CHUNKS}, {sql.BM25} SELECT chunk_ord, tok, tf FROM postings")
def bm25_postings(spark, d):
    return index_of(spark, d).postings.select("chunk_ord", "tok", "tf")


@registered(f"WITH {sql.CHUNKS}, {sql.BM25} SELECT scope, tok, df, round(idf, 6) AS idf FROM terms")
def bm25_term_stats(spark, d):
    return index_of(spark, d).terms.select("scope", "tok", "df", F.round("idf", 6).alias("idf"))


@registered(f"WITH {sql.CHUNKS}, {sql.BM25} SELECT scope, n, round(avgdl, 6) AS avgdl, round(avg_idf, 6) AS avg_idf FROM sizes JOIN means USING (scope)")
def bm25_corpus_stats(spark, d):
    return index_of(spark, d).corpora.select("scope", "n", F.round("avgdl", 6).alias("avgdl"), F.round("avg_idf", 6).alias("avg_idf"))


TOP_SQL = "SELECT query_id, scope, CAST(rank AS INTEGER) AS rank, id, round(raw, 6) AS score"


def top(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "scope", "rank", "id", F.round("raw", 6).alias("score"))


@registered(f"WITH {sql.CHUNKS}, {sql.BM25}, asked AS (SELECT CAST(1 AS BIGINT) AS query_id, '*' AS scope, '{QUERY}' AS query), {sql.ranked('asked')} {TOP_SQL} FROM ranked WHERE rank <= 20")
def bm25_topk(spark, d):
    request = spark.createDataFrame([(1, "*", QUERY, 20)], "query_id bigint, scope string, query string, depth int")
    return top(bm25.ranked(request, searched_once(spark, d)))


@registered(f"WITH {sql.CHUNKS}, {sql.BM25}, asked AS (SELECT CAST(1 AS BIGINT) AS query_id, lang AS scope, '{QUERY}' AS query FROM (SELECT DISTINCT lang FROM documents)), {sql.ranked('asked')} {TOP_SQL} FROM ranked WHERE rank <= 20")
def bm25_topk_domain(spark, d):
    index = searched_once(spark, d)
    request = stats.known_domains(corpus(spark, d)).select(F.lit(1).cast("bigint").alias("query_id"), F.col("domain").alias("scope"), F.lit(QUERY).alias("query"), F.lit(20).alias("depth"))
    return top(bm25.ranked(request, index))


@registered(f"WITH {sql.CHUNKS}, {sql.BM25}, asked AS (SELECT item_id AS query_id, '*' AS scope, text AS query FROM benchmark), {sql.ranked('asked')} {TOP_SQL} FROM ranked WHERE rank <= 5")
def bm25_batch(spark, d):
    request = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("*").alias("scope"), F.col("text").alias("query"), F.lit(5).alias("depth"))
    return top(bm25.ranked(request, searched_once(spark, d)))


# --- vectors ---------------------------------------------------------------------------------------------------


@registered(f"SELECT vec_id, round(sqrt({sql.dot('embedding', 'embedding')}), 5) AS norm FROM embeddings")
def vector_norm(spark, d):
    unit = dense.normalized(F.transform("embedding", lambda x: x * 2))
    rows = table(spark, d, "embeddings").select("vec_id", unit.alias("unit"))
    return rows.select("vec_id", F.round(F.sqrt(F.aggregate("unit", F.lit(0.0), lambda s, x: s + x * x)), 5).alias("norm"))


def vector_requests(spark, d, depth: int = 10, filtered: bool = False) -> DataFrame:
    """Every vector whose id is divisible by 20; with ``filtered`` every other one asks in the domain of its document, if it has one."""
    rows = table(spark, d, "embeddings").where("vec_id % 20 = 0").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id", "left")
    own = F.when(F.col("vec_id") % 40 == 0, F.coalesce("lang", F.lit("*"))).otherwise("*") if filtered else F.lit("*")
    return rows.select(F.col("vec_id").alias("query_id"), own.alias("scope"), F.lit(depth).alias("depth"), F.col("embedding").alias("vector"))


def near_sql(distance: str, where: str, depth: int) -> str:
    return f"""WITH {VECTORS_SQL}, e AS (SELECT vec_id AS query_id, CASE WHEN vec_id % 40 = 0 THEN coalesce(lang, '*') ELSE '*' END AS scope, embedding FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE vec_id % 20 = 0), far AS (
  SELECT e.query_id, v.chunk_ord, v.id, {distance} AS distance FROM e JOIN vecs v ON {where}), near AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_ord) AS rank FROM far)
SELECT CAST(query_id AS BIGINT) AS query_id, id, CAST(rank AS INTEGER) AS rank, round(distance, 6) + 0.0 AS distance FROM near WHERE rank <= {depth}"""


L2, COSINE = sql.squared_distance("v.vector", "e.embedding"), f"1 - {sql.dot('v.vector', 'e.embedding')} / sqrt({sql.dot('v.vector', 'v.vector')}) / sqrt({sql.dot('e.embedding', 'e.embedding')})"


def near(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "id", "rank", (F.round("distance", 6) + 0.0).alias("distance"))  # no -0.0


@registered(near_sql(L2, "true", 10))
def knn_l2(spark, d):
    return near(dense.nearest(vectors(spark, d), vector_requests(spark, d)))


@registered(near_sql(COSINE, "true", 10))
def knn_cosine(spark, d):
    return near(dense.nearest(vectors(spark, d), vector_requests(spark, d), "cosine"))


@registered(near_sql(L2, "e.scope = '*' OR e.scope = v.domain", 10))
def knn_filtered(spark, d):
    return near(dense.nearest(vectors(spark, d), vector_requests(spark, d, filtered=True)))


@registered(f"""WITH b AS (SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id), {VECTORS_SQL}, near AS (
  SELECT query_id, v.id, {sql.squared_distance('v.vector', 'b.embedding')} AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round({sql.squared_distance('v.vector', 'b.embedding')}, 9), v.chunk_ord) AS rank FROM b, vecs v)
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(distance, 6) + 0.0 AS distance FROM near WHERE rank <= 5""")
def knn_batch(spark, d):
    rows = table(spark, d, "benchmark").join(table(spark, d, "embeddings").withColumnRenamed("vec_id", "item_id"), "item_id")
    return near(dense.nearest(vectors(spark, d), rows.select(F.col("item_id").alias("query_id"), F.lit("*").alias("scope"), F.lit(5).alias("depth"), F.col("embedding").alias("vector"))))


@registered(near_sql(L2, "true", 10).replace("round(distance, 6) + 0.0 AS distance", "round(1.35 / (60 + rank), 6) AS rrf, round(1.0 / (1.0 + distance), 6) AS similarity"))
def dense_scores(spark, d):
    parts = search.dense_parts(dense.nearest(vectors(spark, d), vector_requests(spark, d)), SETTINGS)
    return parts.select("query_id", "id", F.col("dense_rank").alias("rank"), F.round("dense_rrf", 6).alias("rrf"), F.round("dense_similarity", 6).alias("similarity"))


@registered(near_sql(COSINE, "true", 10))
def ann_cells(spark, d):
    """Neighbours by cells of every vector whose id is divisible by 20: the exact ones, as no cell is left out that can hold one."""
    path = f"{shared_dir(spark).rstrip('/')}/lodestone-cells-{uuid.uuid4().hex}"
    dense.write_cells(vectors(spark, d), path)
    cells, centres, radius = dense.read_cells(spark, path)
    return near(dense.probed(cells, centres, vector_requests(spark, d), radius=radius))


# --- fusion ----------------------------------------------------------------------------------------------------


def prepared(spark, d):
    return search.requests(asked(spark), SETTINGS), searched_once(spark, d), vectors(spark, d), query_vectors(spark, d)


#: Everything up to the candidates of each query.
FUSED = f"""WITH {sql.CHUNKS}, {sql.BM25}, {VECTORS_SQL}, {ASKED_SQL},
req AS (SELECT *, CASE WHEN scope = '*' THEN greatest(8 * k, 20) ELSE greatest(4 * k, 20) END AS candidates FROM asked),
{sql.ranked('req', 'lexical')},
near AS (SELECT a.query_id, v.id, {L2} AS distance, a.candidates, row_number() OVER (PARTITION BY a.query_id ORDER BY round({L2}, 9), v.chunk_ord) AS rank
  FROM req a JOIN embeddings e ON e.vec_id = a.vec JOIN vecs v ON a.scope = '*' OR a.scope = v.domain),
parts AS (
  SELECT query_id, id, 1.35 / (60 + rank) AS dense_rrf, 1.0 / (1.0 + distance) AS dense_similarity, 0.0 AS bm25_rrf, rank AS dense_rank, NULL AS bm25_rank, distance AS dense_distance, NULL AS bm25_raw, rank AS seen FROM near WHERE rank <= candidates
  UNION ALL SELECT query_id, id, 0.0, 0.0, 1.0 / (60 + rank), NULL, rank, NULL, raw, 1000000 + rank FROM lexical WHERE rank <= 20),
summed AS (SELECT query_id, id, sum(dense_rrf) AS dense_rrf, sum(dense_similarity) AS dense_similarity, sum(bm25_rrf) AS bm25_rrf, max(dense_rank) AS dense_rank, max(bm25_rank) AS bm25_rank, max(dense_distance) AS dense_distance, max(bm25_raw) AS bm25_raw, min(seen) AS seen,
  sum(dense_rrf) + sum(dense_similarity) + sum(bm25_rrf) AS score FROM parts GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM summed),
hybrid AS (SELECT p.* FROM placed p JOIN req r USING (query_id) WHERE place <= candidates OR n <= 40),
own AS (SELECT query_id, query, s.scope, least(s.n, greatest(20, 4 * k, 2 * CAST(floor(sqrt(s.n)) AS BIGINT))) AS candidates FROM asked a JOIN sizes s ON s.scope <> '*' WHERE a.scope = '*'),
{sql.ranked('own', 'own_ranked')},
domains AS (SELECT query_id, id, 0.0 AS dense_rrf, 0.0 AS dense_similarity, 1.0 / (60 + rank) AS bm25_rrf, NULL AS dense_rank, rank AS bm25_rank, NULL AS dense_distance, raw AS bm25_raw,
  2000000 + 100000 * dense_rank() OVER (ORDER BY scope) + rank AS seen, 1.0 / (60 + rank) AS score FROM own_ranked JOIN own USING (query_id, scope) WHERE rank <= candidates),
sides AS (SELECT query_id, id, dense_rrf, dense_similarity, bm25_rrf, dense_rank, bm25_rank, dense_distance, bm25_raw, seen, score, 0 AS side FROM hybrid UNION ALL SELECT *, 1 FROM domains),
found AS (SELECT * EXCLUDE (seen), min(seen) OVER (PARTITION BY query_id, id) AS seen, row_number() OVER (PARTITION BY query_id, id ORDER BY round(score, 12) DESC, side) AS pick FROM sides)
"""
FUSED_ROWS = "SELECT CAST(query_id AS BIGINT) AS query_id, id, round(score, 6) AS score, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(bm25_rank AS INTEGER) AS bm25_rank"


def fused(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "id", F.round("score", 6).alias("score"), "dense_rank", "bm25_rank")


@registered(FUSED + FUSED_ROWS + " FROM hybrid")
def hybrid_domain(spark, d):
    return fused(search.fused_hybrid(*prepared(spark, d), SETTINGS))


@registered(FUSED + FUSED_ROWS + " FROM domains")
def bm25_only_fusion(spark, d):
    request, index, _, _ = prepared(spark, d)
    return fused(search.fused_domains(request, index, SETTINGS))


@registered(FUSED + FUSED_ROWS + " FROM found WHERE pick = 1")
def hybrid_all(spark, d):
    return fused(search.candidates(*prepared(spark, d), SETTINGS))


@registered(FUSED + "SELECT CAST(query_id AS BIGINT) AS query_id, count(*) AS kept, max(n) AS n FROM hybrid GROUP BY query_id")
def candidate_trim(spark, d):
    request, index, vecs, qv = prepared(spark, d)
    wanted = request.join(qv, "query_id").select("query_id", "scope", F.col("dense_depth").alias("depth"), "vector")
    both = search.dense_parts(dense.nearest(vecs, wanted), SETTINGS).unionByName(search.bm25_parts(bm25.ranked(request.withColumn("depth", F.lit(20)), index), SETTINGS))
    every = search.summed(both)
    kept = search.trimmed(every, request, SETTINGS).groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"))
    return kept.join(every.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id")


@registered(f"WITH {sql.CHUNKS}, {ASKED_SQL} SELECT CAST(query_id AS BIGINT) AS query_id, id, round({sql.title_bonus('query', 'lexical_text')}, 6) AS bonus FROM asked JOIN chunks ON scope = '*' OR scope = domain")
def title_bonus(spark, d):
    # Titles and queries are split into words before they meet.
    requests = search.requests(asked(spark), SETTINGS).select("query_id", "scope", scoring.asked_words(F.col("query")).alias("asked"))
    titles = corpus(spark, d).select("id", "domain", scoring.title_words(F.col("lexical_text")).alias("own"))
    rows = F.broadcast(requests).join(titles, (F.col("scope") == "*") | (F.col("scope") == F.col("domain")))
    return rows.select("query_id", "id", F.round(scoring.title_bonus_of(F.col("asked"), F.col("own")), 6).alias("bonus"))


INTENTS = [("строку в массив", "Разделить строку и получить массив", "method", "platform_api", 0.1), ("строку в массив", "Разделить строку и получить массив", "function", "bsp", 0.06), ("строку в массив", "строка и массив", "page", "bsp", -0.02), ("split text words", "split text words", "method", "x", 0.06), ("массив", "массив", "method", "x", 0.0)]


@registered("SELECT q, t, kind, domain, CAST(b AS DOUBLE) AS bonus FROM (VALUES " + ", ".join(f"('{q}', '{t}', '{k}', '{m}', {b})" for q, t, k, m, b in INTENTS) + ") v(q, t, kind, domain, b)")
def intent_bonus(spark, d):
    rows = spark.createDataFrame([x[:4] for x in INTENTS], "q string, t string, kind string, domain string")
    return rows.withColumn("bonus", F.round(scoring.intent_bonus(F.col("q"), F.col("t"), F.col("kind"), F.col("domain")), 6))


RESCORED = FUSED + f""", final AS (SELECT f.*, r.query, r.k, c.domain, c.title, c.text, c.lexical_text, {sql.title_bonus('r.query', 'c.lexical_text')} AS title_bonus FROM found f JOIN asked r USING (query_id) JOIN chunks c ON c.id = f.id WHERE pick = 1),
best AS (SELECT *, score + title_bonus AS total, row_number() OVER (PARTITION BY query_id ORDER BY round(score + title_bonus, 12) DESC, seen) AS rank FROM final)
"""


@registered(RESCORED + "SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, id, round(total, 6) AS total, round(title_bonus, 6) AS title_bonus FROM best WHERE rank <= k")
def rerank_final(spark, d):
    request, index, vecs, qv = prepared(spark, d)
    found = written(search.candidates(request, index, vecs, qv, SETTINGS), "candidates")
    rows = search.best(search.rescored(found, request, corpus(spark, d, found)))
    return rows.select("query_id", "rank", "id", F.round("total", 6).alias("total"), F.round("title_bonus", 6).alias("title_bonus"))


MATCHED = sql.distinct(f"list_filter({sql.tokens('query')}, lambda t: list_contains({sql.tokens('lexical_text || chr(32) || text')}, t))")


@registered(RESCORED + f"""SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, id, domain, CASE WHEN title = '' THEN id ELSE title END AS title, round(total, 4) AS score,
  array_to_string(CASE WHEN len({MATCHED}) > 0 THEN {MATCHED} ELSE {sql.tokens('query')} END, ',') AS highlight_terms, array_to_string({sql.semantic_terms('query', 'text')}, ',') AS semantic_highlight_terms,
  array_to_string(list_filter([CASE WHEN dense_rrf > 0 OR dense_similarity > 0 THEN 'semantic' END, CASE WHEN bm25_rrf > 0 THEN 'bm25' END, CASE WHEN title_bonus > 0 THEN 'title' END], lambda s: s IS NOT NULL), ',') AS match_sources
  FROM best WHERE rank <= k""")
def search_results(spark, d):
    qv = query_vectors(spark, d)
    found = search.search(asked(spark), lambda found: corpus(spark, d, found), searched_once(spark, d), vectors(spark, d), qv)
    return found.select("query_id", "rank", "id", "domain", "title", "score", *[F.array_join(c, ",").alias(c) for c in ("highlight_terms", "semantic_highlight_terms", "match_sources")])


@registered(f"SELECT doc_id, array_to_string({sql.distinct(f'''list_filter({sql.tokens(chr(39) + QUERY + chr(39))}, lambda t: list_contains({sql.tokens('text')}, t))''')}, ',') AS terms FROM documents")
def matched_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.matched_terms(F.lit(QUERY), F.col("text")), ",").alias("terms"))


@registered(f"SELECT item_id, array_to_string({sql.semantic_terms(chr(39) + QUERY + chr(39), 'text')}, ',') AS terms FROM benchmark")
def semantic_highlights(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(text.semantic_terms(F.lit(QUERY), F.col("text")), ",").alias("terms"))


@registered(RESCORED + f"""SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, array_to_string(list_filter([CASE WHEN dense_rrf > 0 OR dense_similarity > 0 THEN 'semantic' END, CASE WHEN bm25_rrf > 0 THEN 'bm25' END, CASE WHEN title_bonus > 0 THEN 'title' END], lambda s: s IS NOT NULL), ',') AS sources,
  round(dense_rrf, 4) AS dense_rrf, round(dense_similarity, 4) AS dense_similarity, round(bm25_rrf, 4) AS bm25_rrf, round(title_bonus, 4) AS title_bonus, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(bm25_rank AS INTEGER) AS bm25_rank, round(dense_distance, 4) AS dense_distance, round(bm25_raw, 4) AS bm25_raw FROM best WHERE rank <= k""")
def score_breakdown(spark, d):
    qv = query_vectors(spark, d)
    found = search.search(asked(spark), lambda found: corpus(spark, d, found), searched_once(spark, d), vectors(spark, d), qv)
    parts = ["dense_rrf", "dense_similarity", "bm25_rrf", "title_bonus", "dense_rank", "bm25_rank", "dense_distance", "bm25_raw"]
    return found.select("query_id", "rank", F.array_join("match_sources", ",").alias("sources"), *[F.col("score_breakdown")[p].alias(p) for p in parts])


def excerpt_sql(size: int) -> str:
    return f"""WITH p AS (SELECT doc_id, text, length(text) AS n, list_min(list_filter([strpos(lower(text), 'nation') - 1, strpos(lower(text), 'other') - 1], lambda x: x >= 0)) AS hit FROM documents),
w AS (SELECT *, least(n, greatest(0, hit - {size // 2}) + {size}) AS e FROM p)
SELECT doc_id, CASE WHEN n <= {size} THEN text WHEN hit IS NULL THEN text[1:{size}] || '...' ELSE (CASE WHEN greatest(0, e - {size}) > 0 THEN '...' ELSE '' END) || substr(text, greatest(0, e - {size}) + 1, e - greatest(0, e - {size})) || (CASE WHEN e < n THEN '...' ELSE '' END) END AS excerpt,
CAST(CASE WHEN n <= {size} OR hit IS NULL THEN 0 ELSE greatest(0, e - {size}) END AS INTEGER) AS "begin", CAST(CASE WHEN n <= {size} THEN n WHEN hit IS NULL THEN {size} ELSE e END AS INTEGER) AS "end" FROM w"""


@registered(excerpt_sql(500))
def excerpt(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.excerpt(F.col("text"), F.array(F.lit("nation"), F.lit("Other")), 500).alias("e"))
    return rows.select("doc_id", "e.excerpt", "e.begin", "e.end")


@registered(excerpt_sql(360))
def semantic_excerpt(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.excerpt(F.col("text"), F.array(F.lit("nation"), F.lit("other")), 360).alias("e"))
    return rows.select("doc_id", "e.excerpt", "e.begin", "e.end")


TOLD = """concat_ws('; ', CASE WHEN dense_rank IS NOT NULL THEN 'Семантический поиск: rank ' || dense_rank END, CASE WHEN bm25_rank IS NOT NULL THEN 'BM25: rank ' || bm25_rank END, CASE WHEN title_bonus > 0 THEN 'совпадение с названием добавило бонус' END)"""


@registered(RESCORED + f"SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, id, {TOLD} || '.' AS explanation FROM best WHERE rank <= k")
def match_explanation(spark, d):
    found = search.search(asked(spark), lambda found: corpus(spark, d, found), searched_once(spark, d), vectors(spark, d), query_vectors(spark, d))
    return found.select("query_id", "rank", "id", F.col("match_explanation").alias("explanation"))


# --- topics and examples ---------------------------------------------------------------------------------------


@registered("SELECT lang || ':' || CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE lang || ':' || CAST(doc_id AS VARCHAR) = (SELECT lang || ':7' FROM documents WHERE doc_id = 7)")
def get_topic(spark, d):
    key = table(spark, d, "documents").where("doc_id = 7").select(F.concat(F.col("lang"), F.lit(":7"))).first()
    return chunks.topic(corpus(spark, d), key[0] if key else "").select("id", "text")


def code(spark, d) -> DataFrame:
    rows = table(spark, d, "conversations")
    order = F.col("conv_id") * 1000 + F.col("turn")
    return rows.select(order.alias("ex_ord"), order.cast("string").alias("id"), F.col("text").alias("code"), F.lit("").alias("query_text"), F.lit("").alias("summary"))


def topics(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("topic_ord"), F.col("item_id").cast("string").alias("id"), F.col("text").alias("title"))


LINKED = """WITH t AS (SELECT item_id AS topic_ord, CAST(item_id AS VARCHAR) AS id, list_filter(regexp_split_to_array(trim(lower(text)), '\\s+'), lambda w: length(w) > 3) AS words FROM benchmark),
e AS (SELECT conv_id * 1000 + turn AS ex_ord, lower(text || ' ') AS low FROM conversations),
m AS (SELECT ex_ord, topic_ord, id, len(list_filter(words, lambda w: contains(low, w))) AS hits, len(words) AS n FROM e, t WHERE len(words) > 0),
r AS (SELECT *, hits / n AS share, row_number() OVER (PARTITION BY ex_ord ORDER BY hits / n DESC, topic_ord) AS pos FROM m WHERE hits >= 2),
linked AS (SELECT ex_ord, string_agg(id, ',' ORDER BY pos) AS topic_ids, max(share) AS relevance FROM r WHERE pos <= 3 GROUP BY ex_ord)
"""


@registered(LINKED + "SELECT ex_ord, topic_ids, round(relevance, 6) AS relevance FROM linked")
def keyword_link(spark, d):
    found = examples.linked_by_words(code(spark, d), topics(spark, d))
    return found.select("ex_ord", F.array_join("topic_ids", ",").alias("topic_ids"), F.round("relevance", 6).alias("relevance"))


@registered(LINKED + "SELECT ex_ord, round(relevance, 6) AS relevance FROM linked WHERE list_contains(string_split(topic_ids, ','), '3') ORDER BY linked.relevance DESC, ex_ord LIMIT 5")
def find_by_topic(spark, d):
    return examples.of_topic(examples.linked_by_words(code(spark, d), topics(spark, d)), "3").select("ex_ord", F.round("relevance", 6).alias("relevance"))


@registered(LINKED + ", x AS (SELECT t.topic_ord, ex_ord, row_number() OVER (PARTITION BY t.topic_ord ORDER BY relevance DESC, ex_ord) AS place FROM t JOIN linked ON list_contains(string_split(topic_ids, ','), t.id)) SELECT t.topic_ord, coalesce(string_agg(CAST(ex_ord AS VARCHAR), ',' ORDER BY place) FILTER (place <= 5), '') AS examples FROM t LEFT JOIN x USING (topic_ord) GROUP BY t.topic_ord")
def topic_with_examples(spark, d):
    found = examples.topics_with_examples(topics(spark, d), examples.linked_by_words(code(spark, d), topics(spark, d)))
    return found.select("topic_ord", F.array_join("examples", ",").alias("examples"))


@registered("""WITH e AS (SELECT conv_id * 1000 + turn AS ex_ord, lower(text || '  ') AS low FROM conversations),
s AS (SELECT ex_ord, CASE WHEN contains(low, 'the other nation with this') THEN 1.0 ELSE len(list_filter(['the', 'other', 'nation', 'with', 'this'], lambda w: contains(low, w))) / 5 END AS overlap FROM e)
SELECT ex_ord, round(overlap, 6) AS overlap FROM s WHERE overlap > 0.3 ORDER BY s.overlap DESC, ex_ord LIMIT 20""")
def example_search(spark, d):
    return examples.searched(code(spark, d), QUERY, 20).select("ex_ord", F.round("overlap", 6).alias("overlap"))


SOURCE = 'Запрос = Новый Запрос("ВЫБРАТЬ Ссылка ИЗ Справочник.Товары КАК Т");\nА = 1;\nТ = "SELECT Name FROM Catalog.Items WHERE x = \\"1\\"";'


@registered()
def code_literal_extract(spark, d):
    files = table(spark, d, "conversations").select(F.lit("conv").alias("label"), F.concat_ws("/", "conv_id", "turn").alias("path"), F.col("text").alias("content"))
    extra = spark.createDataFrame([("literal", "Module.bsl", SOURCE)], files.schema)
    return examples.snippets(files.union(extra)).select("id", "query_text", "start_line", F.length("code").alias("size"))


#: Every conversation as a source file with a query text in its middle.
LINES = 20


@registered(f"""WITH f AS (SELECT conv_id, turn, regexp_split_to_array(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS lines FROM (SELECT conv_id, turn, replace(text, '"', '') AS text FROM conversations)),
g AS (SELECT conv_id, turn, list_concat(list_transform(range({LINES}), lambda i: 'before ' || i), ['x = "SELECT name FROM conversation"'], lines) AS lines FROM f)
SELECT conv_id, turn, {LINES + 1} AS start_line, array_to_string(lines[{LINES + 1 - 15 + 1}:{LINES + 1 + 15}], chr(10)) AS code FROM g""")
def snippet_window(spark, d):
    head = "\n".join(f"before {i}" for i in range(LINES)) + '\nx = "SELECT name FROM conversation"\n'
    plain = F.translate(F.regexp_replace("text", r"\r\n?", "\n"), '"', "")
    files = table(spark, d, "conversations").select(F.lit("c").alias("label"), F.concat_ws(":", "conv_id", "turn").alias("path"), F.concat(F.lit(head), plain).alias("content"))
    key = F.split("module_path", ":")
    return examples.snippets(files).select(key[0].cast("bigint").alias("conv_id"), key[1].cast("bigint").alias("turn"), "start_line", "code")


# --- ingestion -------------------------------------------------------------------------------------------------


def paired(spark, d) -> DataFrame:
    """Documents as pages in two languages: neighbours share a path."""
    rows = corpus(spark, d).withColumn("locale", F.when(F.col("chunk_ord") % 2 == 0, "ru").otherwise("en"))
    rows = rows.withColumn("path", F.floor(F.col("chunk_ord") / 2).cast("string")).withColumn("domain", F.lit("x"))
    return chunks.completed(rows.withColumn("title_ru", F.when(F.col("locale") == "ru", F.col("title_en")).otherwise("")))


@registered("""WITH p AS (SELECT doc_id, doc_id // 2 AS key, regexp_extract(text, '^[^.\\n]*', 0) AS title, text FROM documents)
SELECT min(doc_id) AS chunk_ord, arg_min(title, doc_id) FILTER (doc_id % 2 = 0) AS title_ru, coalesce(nullif(max(title) FILTER (doc_id % 2 = 1), ''), arg_min(title, doc_id)) AS title_en, arg_min(text, doc_id) AS text FROM p GROUP BY key""")
def bilingual_merge(spark, d):
    return chunks.merged_languages(paired(spark, d)).select("chunk_ord", "title_ru", "title_en", "text")


@registered("SELECT lang AS domain, doc_id FROM documents WHERE lang <> 'de' UNION ALL SELECT 'de', item_id FROM benchmark")
def replace_domain_union(spark, d):
    old = table(spark, d, "documents").select(F.col("lang").alias("domain"), "doc_id")
    return chunks.replaced_domain(old, table(spark, d, "benchmark").select(F.lit("de").alias("domain"), F.col("item_id").alias("doc_id")), "de")


@registered("SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark UNION ALL SELECT 'pages', page_id, html FROM pages")
def union_all(spark, d):
    sides = [("documents", "doc_id", "text"), ("benchmark", "item_id", "text"), ("pages", "page_id", "html")]
    first, *rest = [table(spark, d, name).select(F.lit(name).alias("origin"), F.col(key).alias("id"), F.col(content).alias("text")) for name, key, content in sides]
    for other in rest:
        first = first.unionByName(other)
    return first


@registered("SELECT source AS id, min(doc_id) AS chunk_ord FROM documents GROUP BY source")
def dedup_first(spark, d):
    return chunks.first_by_id(table(spark, d, "documents").select(F.col("source").alias("id"), F.col("doc_id").alias("chunk_ord")))


@registered("SELECT CAST(d.doc_id AS VARCHAR) AS path, substr(sha256(d.text), 1, 16) AS hash FROM documents d LEFT JOIN (SELECT doc_id, text FROM documents WHERE source = 'src0') s ON s.doc_id = d.doc_id WHERE s.doc_id IS NULL")
def file_hash_anti_join(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), "source")
    seen = files.where("source = 'src0'").select("path", text.short_hash(F.col("content")).alias("hash"))
    return examples.changed_files(files, seen).select("path", "hash")


@registered("SELECT page_id, 'page' AS kind FROM pages WHERE lower(url) LIKE '%.html' UNION ALL SELECT page_id, 'topic' FROM pages WHERE lower(url) NOT LIKE '%.html'")
def entity_kind(spark, d):
    return table(spark, d, "pages").select("page_id", chunks.entity_kind(F.col("url"), F.lit("")).alias("kind"))


@registered()
def html_to_markdown(spark, d):
    return small_batches(table(spark, d, "pages")).select("page_id", markup.html_to_markdown(F.col("html")).alias("markdown"))


@registered()
def markdown_sections(spark, d):
    rows = small_batches(table(spark, d, "pages")).select("page_id", markup.markdown_sections(markup.html_to_markdown(F.col("html"))).alias("sections"))
    return rows.select("page_id", F.explode("sections").alias("section", "text"))


@registered()
def behavior_sections(spark, d):
    rows = small_batches(table(spark, d, "documents")).select("doc_id", markup.behaviour_section_map(F.col("text")).alias("sections"))
    return rows.select("doc_id", *[F.col("sections")[k].alias(k) for k in markup.BEHAVIOUR_HEADINGS])


MODULE = "#Область ПрограммныйИнтерфейс\n// Делит строку.\n// Параметры:\n//  Строка - что делить\n// Возвращаемое значение:\n//  Массив\nФункция Разделить(Строка) Экспорт\nКонецФункции\nПроцедура Внутри() Экспорт\nКонецПроцедуры\n#КонецОбласти\n#Область Служебные\nФункция Скрыта() Экспорт\n#КонецОбласти\n"


@registered("SELECT 'СтроковыеФункции' AS module, * FROM (VALUES ('Разделить', 'method', 'Делит строку.', 'Строка - что делить', 'Массив', 7), ('Внутри', 'procedure', '', '', '', 9)) v(name, kind, description, parameters, return_value, line_no)")
def bsl_exports(spark, d):
    files = spark.createDataFrame([("CommonModules/СтроковыеФункции/Ext/Module.bsl", MODULE)], "path string, content string")
    return modules.methods(files).select("module", "name", "kind", "description", "parameters", "return_value", "line_no")


TOC = '{3,{1,0,2,2,3,{"ru","Корень"},"/root.html"},{2,1,0,{"ru","Первая"},{"en","First"},"/a/first.html"},{3,1,1,4,{"Вторая","Second"},"/b.html"},{4,3,0,{"#","Leaf"},"\\leaf.html"}}'
TOC_ROWS = [(0, 1, 0, "Корень", "", "root.html"), (1, 2, 1, "Первая", "First", "a/first.html"), (2, 3, 1, "Вторая", "Second", "b.html"), (3, 4, 2, "", "Leaf", "leaf.html")]


@registered("SELECT * FROM (VALUES " + ", ".join(f"({o}, CAST({b} AS BIGINT), {p}, '{r}', '{e}', '{h}')" for o, b, p, r, e, h in TOC_ROWS) + ") v(reading_ord, block_id, depth, title_ru, title_en, html_path)")
def toc_flatten(spark, d):
    pages = spark.createDataFrame([("book", *r) for r in help_book.toc_records(TOC)], "file string, " + help_book.PAGES)
    return help_book.in_reading_order(pages).select("reading_ord", "block_id", "depth", "title_ru", "title_en", "html_path")


@registered("SELECT doc_id, row_number() OVER (ORDER BY lang NULLS FIRST, source NULLS FIRST, doc_id) - 1 AS number, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS in_source FROM documents")
def global_numbering(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source")
    return numbering.numbered_within(numbering.numbered(rows, ["lang", "source", "doc_id"]), ["source"], ["doc_id"], "in_source").select("doc_id", "number", "in_source")


@registered("""WITH RECURSIVE n AS (SELECT doc_id, CASE WHEN doc_id > 0 THEN doc_id // 2 END AS up FROM documents),
t AS (SELECT doc_id, doc_id AS root, 0 AS depth, [doc_id] AS trail FROM n WHERE up IS NULL OR up NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT n.doc_id, t.root, t.depth + 1, list_append(t.trail, n.doc_id) FROM n JOIN t ON n.up = t.doc_id)
SELECT doc_id, root, CAST(depth AS INTEGER) AS depth, array_to_string(trail, '/') AS trail, row_number() OVER (ORDER BY trail) - 1 AS reading_ord FROM t""")
def tree_reading_order(spark, d):
    """A document's parent has half its number."""
    nodes = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") > 0, F.floor(F.col("doc_id") / 2)).alias("up"))
    found = hierarchy.in_reading_order(nodes, "doc_id", "up", "doc_id")
    return found.select("doc_id", "root", "depth", F.array_join(F.transform("trail", lambda x: x.cast("string")), "/").alias("trail"), "reading_ord")


@registered("""WITH n AS (SELECT r_regionkey AS node, NULL AS up, r_name AS name FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name FROM nation),
t AS (SELECT n.node, n.name, p.name AS root_name, CASE WHEN p.node IS NULL THEN 0 ELSE 1 END AS depth, coalesce(p.name || '/', '') || n.name AS trail FROM n LEFT JOIN n p ON n.up = p.node)
SELECT name, depth, trail, row_number() OVER (ORDER BY string_split(trail, '/')) - 1 AS reading_ord FROM t""")
def nation_tree(spark, d):
    regions = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("node"), F.lit(None).cast("bigint").alias("up"), F.col("r_name").alias("name"))
    nations = table(spark, d, "nation").select((100 + F.col("n_nationkey")).cast("bigint").alias("node"), F.col("n_regionkey").cast("bigint").alias("up"), F.col("n_name").alias("name"))
    found = hierarchy.in_reading_order(regions.unionByName(nations), "node", "up", "name")
    return found.select("name", "depth", F.array_join("trail", "/").alias("trail"), "reading_ord")


@registered("""WITH f AS (SELECT conv_id, conv_id || '/' || turn AS path, CASE WHEN conv_id % 3 = 0 THEN 'changed ' ELSE '' END || replace(text, '"', '') AS content FROM conversations WHERE conv_id % 5 <> 0)
SELECT path, substr(sha256(content), 1, 16) AS hash, CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 1 END AS version,
  CASE WHEN length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) > 50 THEN content[1:2000] END AS code FROM f""")
def scan_changes(spark, d):
    """Conversations as a tree of files, scanned, then scanned again after a third has changed and a fifth is gone."""
    turns = table(spark, d, "conversations").select("conv_id", F.lit("c").alias("label"), F.concat_ws("/", "conv_id", "turn").alias("path"), F.translate("text", '"', "").alias("content"))
    store = ScanStore(spark, f"{shared_dir(spark).rstrip('/')}/lodestone-scans-{uuid.uuid4().hex}")
    store.scan(turns.select("label", "path", "content"))
    later = turns.where("conv_id % 5 <> 0").withColumn("content", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("changed "), "content")).otherwise(F.col("content")))
    store.scan(later.select("label", "path", "content"))
    found = store.examples().select(F.col("module_path").alias("path"), "code")
    return store.state().select("path", "hash", "version").join(found, "path", "left")


@registered("SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS answer FROM conversations")
def json_answers(spark, d):
    fenced = F.concat(F.lit("```json\n"), F.trim("text"), F.lit("\n```"))
    return table(spark, d, "conversations").select("conv_id", "turn", chat.json_text(fenced).alias("answer"))


# --- evaluation and readiness ----------------------------------------------------------------------------------


def benchmark_search(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = corpus(spark, d)
    index = bm25.unstored(docs, "text")
    ranked = bm25.ranked(items.withColumn("scope", F.lit("*")).withColumn("depth", F.lit(5)), index)
    # A document that holds an item has all of its words but the outer two, which may be parts of others. The documents that have the
    # rarest one are looked at where they are, to compare the whole item.
    stems = text.stems(F.col("query"))
    inner = F.when(F.size(stems) > 2, F.slice(stems, F.lit(2), F.greatest(F.size(stems) - 2, F.lit(1)))).otherwise(stems)
    words = items.select("query_id", F.explode(inner).alias("tok")).join(index.terms.where("scope = '*'").select("tok", "df"), "tok")
    rarest = words.groupBy("query_id").agg(F.min(F.struct("df", "tok"))["tok"].alias("tok")).join(items, "query_id").groupBy("tok").agg(F.collect_list(F.struct("query_id", "query")).alias("items"))
    rarest = written(rarest, "rarest")  # no more rows than items
    rare = F.broadcast(rarest.agg(F.collect_list("tok").alias("rare")))
    own = docs.select("id", F.col("text").alias("_own")).join(rare, F.lit(True)).select("id", "_own", F.explode(F.array_intersect(text.stems(F.col("_own")), "rare")).alias("tok"))
    held = own.join(F.broadcast(rarest), "tok").select("id", F.explode(F.filter("items", lambda x: F.col("_own").contains(x["query"]))).alias("item"))
    relevant = held.select(F.col("item.query_id").alias("query_id"), "id").distinct()
    return ranked, relevant, items


MRR_SQL = f"""WITH {sql.CHUNKS.replace("AS lexical_text", "AS titles, text AS lexical_text")}, {sql.BM25}, asked AS (SELECT item_id AS query_id, '*' AS scope, text AS query FROM benchmark), {sql.ranked('asked')},
rel AS (SELECT item_id AS query_id, id FROM benchmark b JOIN chunks c ON contains(c.text, b.text)),
rr AS (SELECT a.query_id, coalesce(1.0 / min(r.rank), 0.0) AS rr FROM asked a LEFT JOIN (SELECT * FROM ranked JOIN rel USING (query_id, id) WHERE rank <= 5) r USING (query_id) GROUP BY a.query_id)
SELECT count(*) AS queries, round(avg(rr), 6) AS mrr FROM rr"""


@registered(MRR_SQL)
def mrr_at_5(spark, d):
    return evaluation.mean_reciprocal_rank(*benchmark_search(spark, d)).select("queries", F.round("mrr", 6).alias("mrr"))


ORDERS = [(1, "a,b,c", "a,b,c", 1.0), (2, "c,b,a", "a,b,c", 0.0), (3, "a,c,b", "a,b,c", 0.5), (4, "a", "a,b", 1.0), (5, "x,y", "a,b", 0.0), (6, "b,x,a,c", "a,b,c", 0.5)]


@registered("SELECT CAST(i AS BIGINT) AS i, CAST(a AS DOUBLE) AS agreement FROM (VALUES " + ", ".join(f"({i}, {a})" for i, _, _, a in ORDERS) + ") v(i, a)")
def order_agreement(spark, d):
    rows = spark.createDataFrame([x[:3] for x in ORDERS], "i bigint, ranked string, gold string")
    return rows.select("i", F.round(evaluation.order_agreement(F.split("ranked", ","), F.split("gold", ",")), 6).alias("agreement"))


@registered("""SELECT round(avg(CASE WHEN toxic IS NOT NULL AND (lang = 'en' OR lang = 'de') THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN toxic IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS validity FROM documents LEFT JOIN labels USING (doc_id)""")
def link_accuracy(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    answers = rows.select(F.array("lang").alias("predicted"), F.array(F.lit("en"), F.lit("de")).alias("expected"), F.col("toxic").isNotNull().alias("valid"))
    return evaluation.linking_accuracy(answers).select(F.round("accuracy", 6).alias("accuracy"), F.round("validity", 6).alias("validity"))


@registered("SELECT o_orderpriority AS track, arg_max(o_orderkey, row(round(0.45 * a + 0.25 * v + 0.15 * (1 - least(c / 0.01, 1.0)) + 0.15 * (1 - least(l / 5000.0, 1.0)), 9), o_orderkey)) AS model FROM (SELECT o_orderpriority, o_orderkey, (o_custkey % 100) / 100.0 AS a, (o_orderkey % 7) / 7.0 AS v, o_totalprice / 10.0 AS l, (o_custkey % 13) / 1000.0 AS c FROM orders) GROUP BY 1")
def composite_score(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("track"), F.col("o_orderkey").alias("model"), ((F.col("o_custkey") % 100) / 100.0).alias("accuracy"), ((F.col("o_orderkey") % 7) / 7.0).alias("validity"), (F.col("o_totalprice") / 10.0).alias("latency_ms"), ((F.col("o_custkey") % 13) / 1000.0).alias("cost"))
    scored = rows.withColumn("score", F.round(scoring.composite(*map(F.col, ["accuracy", "validity", "latency_ms", "cost"])), 9))
    return scored.groupBy("track").agg(F.max_by("model", F.struct("score", "model")).alias("model"))


@registered("SELECT 'warning' AS severity, 'partial_index' AS code WHERE (SELECT count(*) FROM labels) < 0.95 * (SELECT count(*) FROM documents) UNION ALL SELECT 'error', 'not_ready' WHERE (SELECT count(*) FROM labels) < 0.95 * (SELECT count(*) FROM documents)")
def readiness_issues(spark, d):
    yes, no = F.lit(True), F.lit(False)
    counts = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n_export")).join(table(spark, d, "labels").agg(F.count(F.lit(1)).alias("n_indexed")))
    return stats.readiness_issues(counts.select("n_export", "n_indexed", yes.alias("export_there"), yes.alias("meta_there"), yes.alias("index_there"), yes.alias("index_readable"), no.alias("wants_vector_index"), F.lit(None).cast("boolean").alias("vector_index_built"), no.alias("bsp_expected"), yes.alias("embedding_matches"), F.lit(0).alias("n_bsp")))
