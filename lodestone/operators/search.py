"""Hybrid search: a query is a row, and a batch of them is one plan.

Candidates are the nearest vectors and the best BM25 chunks, each giving a reciprocal-rank score; the scores of one chunk
are added. A query over all domains also takes each domain's own BM25 candidates, where the larger score wins. Bonuses for
titles and intents re-rank what is left, and the best rows are explained.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scoring, text
from lodestone.functions.scoring import SearchSettings
from lodestone.operators import bm25, dense
from lodestone.operators.bm25 import EVERYWHERE, Bm25Index
from lodestone.tables import written

#: Short names of domains.
ALIASES = {"bsl": "bsl_lang", "query": "query_lang"}
PARTS = ["dense_rrf", "dense_similarity", "bm25_rrf"]
#: Candidates' ids up to which they are sent to the tasks that read the chunks.
FEW = 100_000


def scope_of(domain: Column) -> Column:
    """The scope that a request names: none, '' and 'all' are everywhere; aliases are resolved."""
    named = F.coalesce(*[F.when(domain == short, F.lit(full)) for short, full in ALIASES.items()], domain)
    return F.when(domain.isNull() | domain.isin("", "all"), EVERYWHERE).otherwise(named)


def domain_predicate(domain: str, column: str = "domain") -> Column:
    """Equality with a domain's name, which must be one word."""
    import re

    if not re.fullmatch(r"\w+", domain):
        raise ValueError(f"not a domain's name: {domain!r}")
    return F.col(column) == F.lit(domain)


def requests(queries: DataFrame, s: SearchSettings) -> DataFrame:
    """query_id, query, scope, k, candidates (how many are kept), dense_depth. k defaults to the settings' for null and 0."""
    k = F.when(F.coalesce("k", F.lit(0)) > 0, F.col("k")).otherwise(s.final_top_k)
    rows = queries.select("query_id", "query", scope_of(F.col("domain")).alias("scope"), k.cast("int").alias("k"))
    everywhere = F.greatest(8 * F.col("k"), F.lit(s.dense_top_k), F.lit(s.bm25_top_k))
    candidates = F.when(F.col("scope") == EVERYWHERE, everywhere).otherwise(F.greatest(4 * F.col("k"), F.lit(s.dense_top_k)))
    return rows.withColumn("candidates", candidates).withColumn("dense_depth", F.greatest("candidates", F.lit(s.dense_top_k)))


def domain_requests(asked: DataFrame, corpora: DataFrame, s: SearchSettings) -> DataFrame:
    """A request for each domain of each query over all domains; candidates grow with the root of the domain's size."""
    sizes = corpora.where(F.col("scope") != EVERYWHERE).select(F.col("scope").alias("own"), "n")
    wanted = F.greatest(F.lit(max(s.dense_top_k, s.bm25_top_k)), 4 * F.col("k"), 2 * F.floor(F.sqrt("n")))
    rows = asked.where(F.col("scope") == EVERYWHERE).join(sizes, F.lit(True))  # domains are few
    return rows.select("query_id", "query", F.col("own").alias("scope"), "k", F.least("n", wanted).cast("int").alias("candidates"))


def dense_parts(hits: DataFrame, s: SearchSettings) -> DataFrame:
    rank = F.col("rank")
    return hits.select(
        "query_id", "id", scoring.reciprocal_rank(rank, s.dense_rrf_weight, s.rrf_k).alias("dense_rrf"), scoring.similarity(F.col("distance"), s.dense_similarity_weight).alias("dense_similarity"),
        F.lit(0.0).alias("bm25_rrf"), rank.alias("dense_rank"), F.lit(None).cast("int").alias("bm25_rank"), F.col("distance").alias("dense_distance"), F.lit(None).cast("double").alias("bm25_raw"),
        F.struct(F.lit(0).alias("source"), F.lit("").alias("domain"), rank.alias("rank")).alias("seen"),
    )


def bm25_parts(hits: DataFrame, s: SearchSettings, source: int = 1) -> DataFrame:
    rank = F.col("rank")
    return hits.select(
        "query_id", "id", F.lit(0.0).alias("dense_rrf"), F.lit(0.0).alias("dense_similarity"), scoring.reciprocal_rank(rank, s.bm25_rrf_weight, s.rrf_k).alias("bm25_rrf"),
        F.lit(None).cast("int").alias("dense_rank"), rank.alias("bm25_rank"), F.lit(None).cast("double").alias("dense_distance"), F.col("raw").alias("bm25_raw"),
        F.struct(F.lit(source).alias("source"), (F.col("scope") if source > 1 else F.lit("")).alias("domain"), rank.alias("rank")).alias("seen"),
    )


def summed(parts: DataFrame) -> DataFrame:
    """One row for each query and chunk: the parts added, as one aggregation over the union of both sides."""
    out = parts.groupBy("query_id", "id").agg(*[F.sum(p).alias(p) for p in PARTS], *[F.max(c).alias(c) for c in ("dense_rank", "bm25_rank", "dense_distance", "bm25_raw")], F.min("seen").alias("seen"))
    return out.withColumn("score", F.col("dense_rrf") + F.col("dense_similarity") + F.col("bm25_rrf"))


def trimmed(fused: DataFrame, asked: DataFrame, s: SearchSettings, natural: bool = True) -> DataFrame:
    """The best ``candidates`` of each query; all, if there are no more than both sides give by themselves."""
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "seen")
    rows = fused.withColumn("_at", F.row_number().over(best)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    keep = (F.col("_at") <= F.col("candidates")) | (F.lit(natural) & (F.col("_n") <= s.dense_top_k + s.bm25_top_k))
    return rows.join(asked.select("query_id", "candidates"), "query_id").where(keep).drop("_at", "_n", "candidates")


def fused_hybrid(asked: DataFrame, index: Bm25Index, vectors: DataFrame, query_vectors: DataFrame, s: SearchSettings, metric: str = "l2", hits: DataFrame | None = None) -> DataFrame:
    """Candidates of both sides for each request. hits: the BM25 ranks of these requests, and maybe of others, if they are there."""
    wanted = asked.join(query_vectors.select("query_id", "vector"), "query_id").select("query_id", "scope", F.col("dense_depth").alias("depth"), "vector")
    near = dense_parts(dense.nearest(vectors, wanted, metric), s)
    ranked = bm25.ranked(asked.withColumn("depth", F.lit(s.bm25_top_k)), index) if hits is None else hits.join(asked.select("query_id", "scope"), ["query_id", "scope"], "left_semi")
    lexical = bm25_parts(ranked, s)
    return trimmed(summed(near.unionByName(lexical)), asked, s)


def fused_domains(asked: DataFrame, index: Bm25Index, s: SearchSettings, hits: DataFrame | None = None) -> DataFrame:
    """Each domain's own BM25 candidates of the queries over all domains; hits as above."""
    own = domain_requests(asked, index.corpora, s)
    ranked = bm25.ranked(own.withColumn("depth", F.greatest("candidates", F.lit(s.bm25_top_k))), index) if hits is None else hits
    kept = ranked.join(own.select("query_id", "scope", "candidates"), ["query_id", "scope"]).where(F.col("rank") <= F.col("candidates"))
    return bm25_parts(kept, s, source=2).withColumn("score", F.col("bm25_rrf"))


def larger(main: DataFrame, other: DataFrame) -> DataFrame:
    """Of two candidate sets, the row of the larger score for each query and chunk; ``main`` wins ties and keeps its place."""
    both = main.withColumn("_side", F.lit(0)).unionByName(other.withColumn("_side", F.lit(1)))
    by = Window.partitionBy("query_id", "id")
    first = F.row_number().over(by.orderBy(F.desc(F.round("score", 12)), "_side"))
    return both.withColumn("_first", first).withColumn("seen", F.min("seen").over(by)).where("_first = 1").drop("_first", "_side")


def candidates(asked: DataFrame, index: Bm25Index, vectors: DataFrame, query_vectors: DataFrame, s: SearchSettings, metric: str = "l2") -> DataFrame:
    hits = ranked_together(asked, index, s) if index.words is not None else None
    return larger(fused_hybrid(asked, index, vectors, query_vectors, s, metric, hits), fused_domains(asked, index, s, hits))


def ranked_together(asked: DataFrame, index: Bm25Index, s: SearchSettings) -> DataFrame:
    """The BM25 ranks of the requests and of those to single domains by one search, so that the texts are read once for both."""
    own = domain_requests(asked, index.corpora, s).withColumn("depth", F.greatest("candidates", F.lit(s.bm25_top_k)))
    every = asked.withColumn("depth", F.lit(s.bm25_top_k)).select("query_id", "query", "scope", "depth").unionByName(own.select("query_id", "query", "scope", "depth"))
    return written(bm25.ranked(every, index), "hits")


def of_candidates(rows: DataFrame, own_id: Column, found: DataFrame) -> DataFrame:
    """The rows that are candidates, picked before anything is worked out from their texts and, if candidates are few, before any is shuffled.

    found: a written table with ``id``.
    """
    ids = found.select(F.col("id").alias("_found")).distinct()
    few = ids.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(ids) if few else ids, own_id == F.col("_found"), "left_semi")


def rescored(found: DataFrame, asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates with their chunk, the bonuses and the total; candidates without a chunk are dropped."""
    rows = found.join(asked.select("query_id", "query", "k"), "query_id").join(chunks, "id")
    query, own = F.col("query"), explained_text()
    rows = rows.withColumn("title_bonus", scoring.title_bonus(query, F.col("lexical_text"))).withColumn("intent_bonus", scoring.intent_bonus(query, own, F.col("entity_kind"), F.col("domain")))
    return rows.withColumn("total", F.col("score") + F.col("title_bonus") + F.col("intent_bonus"))


def best(rows: DataFrame) -> DataFrame:
    """The ``k`` rows of the largest totals for each query, with their rank; ties as first seen."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("total", 12)), "seen")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("k"))


def explained_text() -> Column:
    return F.coalesce(F.nullif("semantic_text", F.lit("")), F.col("text"), F.lit(""))


def explained(rows: DataFrame) -> DataFrame:
    """Result rows: title, rounded scores, sources, an explanation, highlights and excerpts."""
    query, own = F.col("query"), explained_text()
    rows = rows.withColumn("semantic_highlight_terms", text.semantic_terms(query, own)).withColumn("_matched", text.matched_terms(query, F.col("search_text")))
    terms = F.when(F.size("_matched") > 0, F.col("_matched")).otherwise(text.tokens(query))
    rows = rows.withColumn("highlight_terms", terms).withColumn("_excerpt", text.excerpt(F.col("text"), F.col("highlight_terms"), 500))
    parts = ["dense_rrf", "dense_similarity", "bm25_rrf", "title_bonus", "intent_bonus"]
    name = {"intent_bonus": "semantic_intent_bonus"}
    breakdown = F.struct(F.round("total", 4).alias("total"), *[F.round(p, 4).alias(name.get(p, p)) for p in parts], "dense_rank", "bm25_rank", F.round("dense_distance", 4).alias("dense_distance"), F.round("bm25_raw", 4).alias("bm25_raw"))
    return rows.select(
        "query_id", "rank", "id", "domain", F.coalesce(F.nullif("title_ru", F.lit("")), F.nullif("title_en", F.lit("")), "id").alias("title"), F.round("total", 4).alias("score"), "entity_kind", "html_path",
        F.col("_excerpt.excerpt").alias("excerpt"), F.col("_excerpt.begin").alias("excerpt_start"), F.col("_excerpt.end").alias("excerpt_end"), "highlight_terms",
        scoring.match_sources(*map(F.col, parts)).alias("match_sources"), scoring.match_explanation(*map(F.col, ["dense_rank", "bm25_rank", "title_bonus", "intent_bonus"])).alias("match_explanation"),
        text.excerpt(own, F.col("semantic_highlight_terms"), 360)["excerpt"].alias("semantic_excerpt"), "semantic_highlight_terms", breakdown.alias("score_breakdown"),
    )


def search(queries: DataFrame, chunks: DataFrame | Callable[[DataFrame], DataFrame], index: Bm25Index, vectors: DataFrame, query_vectors: DataFrame, settings: SearchSettings | None = None, metric: str = "l2") -> DataFrame:
    """queries: query_id, query, domain, k. Result rows of each query, best first by ``rank``; none for an unknown domain.

    chunks: the chunks with their texts, or what finds those of candidates (a written table with ``id``), so that no other text is read.
    """
    s = settings or SearchSettings()
    asked = requests(queries, s)
    found = candidates(asked, index, vectors, query_vectors, s, metric)
    if callable(chunks):
        found = written(found, "candidates")
        chunks = chunks(found)
    return explained(best(rescored(found, asked, chunks)))
