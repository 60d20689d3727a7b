"""Counts: by domain, of modules, and what is missing for a search to work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_domain(chunks: DataFrame) -> DataFrame:
    """(domain, n): rows of each domain ('unknown' for none) and the 'total', in one aggregation."""
    named = chunks.select(F.coalesce(F.nullif("domain", F.lit("")), F.lit("unknown")).alias("domain"))
    return named.rollup("domain").count().select(F.coalesce("domain", F.lit("total")).alias("domain"), F.col("count").alias("n"))


def known_domains(chunks: DataFrame) -> DataFrame:
    return chunks.where("domain <> ''").select("domain").distinct().orderBy("domain")


def module_stats(methods: DataFrame) -> DataFrame:
    """methods: module, description, parameters, return_value. Distinct modules, methods, and methods without a comment."""
    bare = (F.col("description") == "") & (F.col("parameters") == "") & (F.col("return_value") == "")
    return methods.agg(F.countDistinct("module").alias("modules"), F.count(F.lit(1)).alias("methods"), F.count_if(bare).alias("without_comment"))


#: Severity of each issue.
ISSUES = {"export_missing": "error", "index_missing": "error", "index_broken": "error", "partial_index": "warning", "embedding_mismatch": "warning", "vector_index_missing": "warning", "bsp_not_indexed": "warning", "not_ready": "error"}


def readiness_issues(state: DataFrame, complete: float = 0.95, vectors_from: int = 256) -> DataFrame:
    """(severity, code) of what keeps a search from working or being good.

    state, one row: export_there, meta_there, index_there, index_readable, wants_vector_index, vector_index_built (nullable),
    bsp_expected, embedding_matches (booleans), n_export, n_indexed, n_bsp.
    """
    share = F.col("n_indexed") >= complete * F.col("n_export")
    ready = F.col("export_there") & F.col("meta_there") & F.col("index_there") & F.col("index_readable") & (F.col("n_indexed") > 0) & ((F.col("n_export") == 0) | share)
    rules = {
        "export_missing": ~F.col("export_there"),
        "index_missing": (F.col("n_export") > 0) & ~F.col("index_there"),
        "index_broken": (F.col("meta_there") & ~F.col("index_there")) | (F.col("index_there") & ~F.col("index_readable")),
        "partial_index": (F.col("n_indexed") > 0) & (F.col("n_export") > 0) & ~share,
        "embedding_mismatch": (F.col("n_indexed") > 0) & ~F.col("embedding_matches"),
        "vector_index_missing": ready & F.col("wants_vector_index") & (F.col("n_indexed") >= vectors_from) & ~F.coalesce("vector_index_built", F.lit(True)),
        "bsp_not_indexed": ready & F.col("bsp_expected") & (F.col("n_bsp") == 0),
    }
    rules["not_ready"] = ~ready & ~(rules["export_missing"] | rules["index_missing"] | rules["index_broken"])
    found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(ISSUES[code]).alias("severity"), F.lit(code).alias("code"))) for code, when in rules.items()]))
    return state.select(F.inline(found))
