"""Command line: ``python -m lodestone.cli ingest | ingest-modules | index | search | stats | status | evaluate | drop | scan-examples``."""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone import config
from lodestone.engine import Engine, drop_index, readiness, rebuild_index
from lodestone.operators import chunks, examples, stats
from lodestone.sources import help_book, jsonl, modules
from lodestone.sources.embedding import backend


def numbered(rows):
    """Rows with chunk_ord by id, for sources without an order of their own."""
    return rows if "chunk_ord" in rows.columns else rows.withColumn("chunk_ord", F.xxhash64("id").bitwiseAND(F.lit((1 << 62) - 1)))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lodestone")
    parser.add_argument("--provider", default="hashing", help="embedding provider")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, values in {"ingest": ["books", "out"], "ingest-modules": ["folder", "old", "out"], "index": ["chunks", "out"], "search": ["index", "query"], "stats": ["index"], "status": ["config"], "evaluate": ["index", "questions", "out"], "drop": ["index"], "scan-examples": ["folder", "label", "chunks", "out"]}.items():
        command = commands.add_parser(name)
        for value in values:
            command.add_argument(value)
        command.add_argument("--domain", default="all")
        command.add_argument("--limit", type=int, default=5)
        command.add_argument("--version", default="")
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    if a.command == "ingest":
        merged = chunks.merged_languages(help_book.read_books(spark, a.books, a.version))
        jsonl.write_chunks(merged, a.out)
        written = jsonl.read_chunks(spark, a.out)
        written.rollup("hbk_source").count().select(F.coalesce("hbk_source", F.lit("total")).alias("book"), "count").orderBy("book").show(200, truncate=False)
    elif a.command == "ingest-modules":
        methods = modules.methods(modules.read_modules(spark, a.folder))
        stats.module_stats(methods).show()
        found = modules.chunks_of(methods, a.version)
        jsonl.write_chunks(chunks.replaced_domain(jsonl.read_chunks(spark, a.old).select(*chunks.FIELDS), found, modules.DOMAIN), a.out)
    elif a.command == "index":
        rows = jsonl.read_chunks(spark, a.chunks)
        rows = rows if a.domain == "all" else rows.where(F.col("domain") == a.domain)
        print(rebuild_index(numbered(rows), a.out, backend(a.provider), datetime.date.today().isoformat(), a.version, provider=a.provider))
    elif a.command == "status":
        issues = readiness(spark, config.load(a.config))
        issues.show(truncate=False)
    elif a.command == "evaluate":
        found = Engine(spark, a.index, backend(a.provider)).evaluated(jsonl.read_evaluation(spark, "retrieval_qa", a.questions), a.limit)
        found.coalesce(1).write.mode("overwrite").json(a.out)
    elif a.command == "drop":
        print("dropped" if drop_index(spark, a.index) else "no index there")
    elif a.command == "search":
        Engine(spark, a.index, backend(a.provider)).search(a.query, a.domain, a.limit).select("rank", "score", "id", "title", "match_explanation").show(truncate=80)
    elif a.command == "stats":
        Engine(spark, a.index, backend(a.provider)).stats().show()
    else:
        files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{bsl,os,BSL,OS}").text(a.folder)
        rows = files.select(F.lit(a.label).alias("label"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
        found = examples.snippets(rows).withColumn("ex_ord", F.xxhash64("id")).withColumn("summary", F.lit(""))
        topics = numbered(jsonl.read_chunks(spark, a.chunks)).select(F.col("chunk_ord").alias("topic_ord"), "id", F.concat_ws(" ", "title_ru", "title_en").alias("title"))
        jsonl.write_examples(examples.linked_by_words(found, topics), a.out)


if __name__ == "__main__":
    main()
