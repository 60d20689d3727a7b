"""Scores, bonuses and their explanation, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import ACTION_STEMS, EXECUTABLE_KINDS, STATIC_KINDS, content_stems, is_transformation, normalized, related_stems, stem, stems, strings, tokens, valued


@dataclass(frozen=True)
class SearchSettings:
    """How candidates are taken and weighed."""

    rrf_k: int = 60
    dense_top_k: int = 20
    bm25_top_k: int = 20
    final_top_k: int = 5
    dense_rrf_weight: float = 1.35
    bm25_rrf_weight: float = 1.0
    dense_similarity_weight: float = 1.0

    def __post_init__(self) -> None:
        for name in ("rrf_k", "dense_top_k", "bm25_top_k", "final_top_k"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) < 1:
                raise ValueError(f"{name} must be a positive integer")
        for name in ("dense_rrf_weight", "bm25_rrf_weight", "dense_similarity_weight"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")


def reciprocal_rank(rank: Column, weight: float, k: int) -> Column:
    return F.lit(float(weight)) / (F.lit(k) + rank)


def similarity(distance: Column, weight: float) -> Column:
    """Falls from the weight with distance; an unknown distance counts as 1."""
    return F.lit(float(weight)) / (1.0 + F.greatest(F.coalesce(distance, F.lit(1.0)), F.lit(0.0)))


def title_bonus(query: Column, title: Column) -> Column:
    """Rewards query words that the title has, and the query as a phrase of it; more for queries that are a name."""
    return title_bonus_of(asked_words(query), title_words(title))


def asked_words(query: Column) -> Column:
    """What ``title_bonus_of`` needs of a query: its stems, its words as a phrase, and whether it is a name."""
    return F.struct(stems(query).alias("stems"), normalized(query).alias("phrase"), (F.size(content_stems(query)) <= 1).alias("name"))


def title_words(title: Column) -> Column:
    """What ``title_bonus_of`` needs of a title: each of its stems once, and its words as a phrase."""
    once = lambda own: F.struct(F.array_distinct(F.transform(F.array_distinct(own), stem)).alias("stems"), F.array_join(own, " ").alias("phrase"))
    return valued(tokens(title), once)


def title_bonus_of(asked: Column, own: Column) -> Column:
    """``title_bonus`` of a query's ``asked_words`` and a title's ``title_words``. Where each title meets several queries, both are best made
    before they meet."""

    def bonus(x: Column) -> Column:
        asked, own = x["asked"]["stems"], x["own"]["stems"]
        covered = F.size(F.filter(asked, lambda q: F.exists(own, lambda t: related_stems(q, t)))) / F.size(asked)
        phrase = x["own"]["phrase"].contains(x["asked"]["phrase"]).cast("double")
        found = F.when(x["asked"]["name"], 0.02 * covered + 0.03 * phrase).otherwise(0.004 * covered + 0.006 * phrase)
        return F.when((F.size(asked) > 0) & (F.size(own) > 0), found).otherwise(0.0)

    return valued(F.struct(asked.alias("asked"), own.alias("own")), bonus)


def intent_bonus(query: Column, text: Column, kind: Column, domain: Column) -> Column:
    """Rewards entities that do what a query of two content words or more asks for; holds back those that only are."""
    asked, own = content_stems(query), F.array_distinct(stems(text))
    acts = F.exists(own, lambda s: F.exists(strings(ACTION_STEMS), lambda a: s.startswith(a)))
    turns = is_transformation(query)
    doing = F.lower(F.coalesce(kind, F.lit(""))).isin(EXECUTABLE_KINDS) & acts
    being = F.lower(F.coalesce(kind, F.lit(""))).isin(STATIC_KINDS)
    platform = F.when(turns & (F.lower(F.coalesce(domain, F.lit(""))) == "platform_api"), 0.04).otherwise(0.0)
    bonus = F.when(doing, F.lit(0.06) + platform).when(turns & being, -0.02).otherwise(0.0)
    relevant = (F.size(asked) >= 2) & (F.size(F.array_intersect(asked, own)) >= 2)
    return F.when(relevant, bonus).otherwise(0.0)


def match_sources(dense_rrf: Column, dense_similarity: Column, bm25_rrf: Column, title: Column, intent: Column) -> Column:
    """Which parts of the search contributed, in a fixed order."""
    parts = [((dense_rrf > 0) | (dense_similarity > 0), "semantic"), (bm25_rrf > 0, "bm25"), (title > 0, "title"), (intent > 0, "intent")]
    return F.array_compact(F.array(*[F.when(found, F.lit(name)) for found, name in parts]))


def match_explanation(dense_rank: Column, bm25_rank: Column, title: Column, intent: Column) -> Column:
    """The same as a sentence."""
    told = F.concat_ws(
        "; ",
        F.when(dense_rank.isNotNull(), F.concat(F.lit("Семантический поиск: rank "), dense_rank.cast("string"))),
        F.when(bm25_rank.isNotNull(), F.concat(F.lit("BM25: rank "), bm25_rank.cast("string"))),
        F.when(title > 0, F.lit("совпадение с названием добавило бонус")),
        F.when(intent > 0, F.lit("описание совпало с намерением запроса")),
    )
    return F.when(told == "", F.lit("Результат попал в выдачу по суммарному гибридному score.")).otherwise(F.concat(told, F.lit(".")))


def composite(accuracy: Column, validity: Column, latency_ms: Column, cost: Column, most_latency: float = 5000.0, most_cost: float = 0.01) -> Column:
    """Accuracy 0.45, valid answers 0.25, cheapness 0.15 and speed 0.15; cost and latency count up to their bounds."""
    spent = lambda x, most: 1.0 - F.least(x / F.lit(most), F.lit(1.0))
    return 0.45 * accuracy + 0.25 * validity + 0.15 * spent(cost, most_cost) + 0.15 * spent(latency_ms, most_latency)
