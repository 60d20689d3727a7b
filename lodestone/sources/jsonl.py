"""Chunks and examples as JSON lines, and the small files beside an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodestone.operators.chunks import FIELDS, SCHEMA, completed

EXAMPLES = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("config_label", T.StringType()), T.StructField("module_path", T.StringType()), T.StructField("code", T.StringType()), T.StructField("query_text", T.StringType()),
    T.StructField("start_line", T.IntegerType()), T.StructField("topic_ids", T.ArrayType(T.StringType())), T.StructField("relevance", T.DoubleType()), T.StructField("summary", T.StringType()),
])
_IDS = T.ArrayType(T.StringType())
_OPTIONS = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType())]))
#: Evaluation sets.
EVALUATION = {
    "retrieval_qa": T.StructType([T.StructField("query", T.StringType()), T.StructField("domain", T.StringType()), T.StructField("expected_topic_ids", _IDS)]),
    "example_linking": T.StructType([T.StructField("code", T.StringType()), T.StructField("expected_topic_ids", _IDS), T.StructField("topic_options", _OPTIONS)]),
    "reranking": T.StructType([T.StructField("query", T.StringType()), T.StructField("candidates", _OPTIONS), T.StructField("gold_ranking", _IDS)]),
}
INDEX_META = T.StructType([
    T.StructField("indexed_count", T.LongType()), T.StructField("built_at", T.StringType()), T.StructField("platform_version", T.StringType()), T.StructField("embedding_provider", T.StringType()),
    T.StructField("embedding_model", T.StringType()), T.StructField("embedding_dimensions", T.IntegerType()), T.StructField("vector_index_built", T.BooleanType()),
])


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with a fixed schema: unknown keys are left out, absent ones are '', blank lines are skipped."""
    return completed(spark.read.schema(SCHEMA).json(path).where("id is not null"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.select(*FIELDS).write.mode("overwrite").json(path)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.sql import functions as F

    rows = spark.read.schema(EXAMPLES).json(path)
    return rows.withColumn("topic_ids", F.coalesce("topic_ids", F.array().cast("array<string>")))


def write_examples(examples: DataFrame, path: str) -> None:
    examples.select(*[f.name for f in EXAMPLES.fields if f.name in examples.columns]).write.mode("overwrite").json(path)


def read_evaluation(spark: SparkSession, name: str, path: str) -> DataFrame:
    return spark.read.schema(EVALUATION[name]).json(path)


def read_index_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_META).option("multiLine", True).json(path)


def write_index_meta(spark: SparkSession, path: str, indexed_count: int, built_at: str, platform_version: str, provider: str, model: str, dimensions: int | None = None, vector_index_built: bool | None = None) -> None:
    spark.createDataFrame([(indexed_count, built_at, platform_version, provider, model, dimensions, vector_index_built)], INDEX_META).coalesce(1).write.mode("overwrite").json(path)
