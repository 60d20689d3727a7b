"""Retrieval and ranking quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scoring import composite


def reciprocal_ranks(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rr): 1 / the first rank up to k at which a relevant id stands, else 0, for every query."""
    first = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    return queries.select("query_id").join(first, "query_id", "left").select("query_id", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def mean_reciprocal_rank(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    return reciprocal_ranks(ranked, relevant, queries, k).agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr"))


def order_agreement(ranked: Column, gold: Column) -> Column:
    """Share of neighbours in the ranking, of those in the gold order, that stand in its order. With fewer than two of
    them, whether the first ranked is the first of the gold order."""
    common = F.filter(ranked, lambda x: F.array_contains(gold, x))
    pairs = F.zip_with(F.slice(common, 1, F.greatest(F.size(common) - 1, F.lit(0))), F.slice(common, 2, F.greatest(F.size(common) - 1, F.lit(0))), lambda a, b: (F.array_position(gold, a) < F.array_position(gold, b)).cast("int"))
    share = F.aggregate(pairs, F.lit(0), lambda s, x: s + x) / F.greatest(F.size(common) - 1, F.lit(1))
    alone = (F.get(ranked, F.lit(0)) == F.get(gold, F.lit(0))).cast("double")
    return F.when(F.size(common) >= 2, share).otherwise(F.coalesce(alone, F.lit(0.0)))


def linking_accuracy(rows: DataFrame) -> DataFrame:
    """rows: predicted, expected (arrays), valid (boolean). Share of rows that hit an expected topic, and of valid answers."""
    hit = F.col("valid") & F.arrays_overlap("predicted", "expected")
    return rows.agg(F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("accuracy"), F.avg(F.col("valid").cast("double")).alias("validity"))


def best_models(rows: DataFrame) -> DataFrame:
    """rows: track, model, accuracy, validity, latency_ms, cost. The model of the largest composite score in each track."""
    scored = rows.withColumn("score", composite(*map(F.col, ["accuracy", "validity", "latency_ms", "cost"])))
    return scored.groupBy("track").agg(F.max_by("model", F.struct("score", "model")).alias("model"), F.max("score").alias("score"))
