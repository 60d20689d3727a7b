"""From ``documents`` to training sequences: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last give the columns
of ``documents``. Rows are judged one by one: rows with a null id, or with one id, stay or go by their own texts; an empty table stays
empty; other columns than those of ``documents`` are not passed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, linededup, pieces, quality, simhash
from lodestone.llm.common import materialized

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that break a rule; the labels set the cutoffs. Null and empty texts fail the base rules."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out of the texts that stand earlier in the corpus, as they are or an edit apart. Null texts stay null."""
    n_chars = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    return linededup.deduplicated(docs).withColumn("n_chars", n_chars).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each near-duplicate group.

    The stage is for texts whose five-word shingles have a similarity of 0.9 or more: 3 differing bits find nearly all of
    those (see the README), and fewer of the pairs from 0.8 to 0.9. Texts without words are one group; rows without an
    id come last in theirs.
    """
    return simhash.keep_first(docs, shingle_words=5, max_bits=3).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark window. Null texts hold none."""
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of sampled segmentations of every text; null and empty texts have one, without pieces."""
    return pieces.samples(docs, k=3)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", sentencepiece),
]

#: Gumbel sampling over a piece lattice isn't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
