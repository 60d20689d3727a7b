"""Chat models as a row function: prompts are answered on the executors, answers are parsed natively."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.numbering import numbered
from lodestone.tables import Versions, written

#: How many topics, and how much code, a prompt holds; the least relevance of a link.
MOST_TOPICS, MOST_CODE, LEAST_RELEVANCE = 30, 1500, 0.7
ANSWER = "topic_ids array<string>, relevance double, summary string"


class Chat(Protocol):
    """Answers a prompt. Instances are sent to the executors."""

    def answer(self, prompt: str) -> str: ...


class HttpChat:
    """A service with the widespread ``/chat/completions`` interface."""

    def __init__(self, base_url: str, model: str, api_key: str = "", timeout: float = 120.0):
        self.base_url, self.model, self.api_key, self.timeout = base_url.rstrip("/"), model, api_key, timeout

    def answer(self, prompt: str) -> str:
        import urllib.request

        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        with urllib.request.urlopen(urllib.request.Request(f"{self.base_url}/chat/completions", body, headers), timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]


def json_text(answer: Column) -> Column:
    """The JSON of an answer: what its first code fence holds, else all of it."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.trim(F.when(answer.rlike(r"(?s)```.*?```"), fenced).otherwise(answer), F.lit(" \n\t\r"))


def _answers(model: Chat):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prompts = batch.column(batch.num_columns - 1).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([model.answer(p) for p in prompts], pa.string())], names=[*batch.schema.names[:-1], "answer"])

    return run


def answered(rows: DataFrame, prompt_col: str, model: Chat) -> DataFrame:
    """The rows with ``answer`` in place of the prompt."""
    others = [c for c in rows.columns if c != prompt_col]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others) + ", answer string"
    return rows.select(*others, prompt_col).mapInArrow(_answers(model), schema)


LEDGER = "key string, answer string, error string, tries int"


def _tried(model: Chat, tries: int, pause: float):
    """Answers with a number of tries each; what fails every time is told in ``error``, and the other rows go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for prompt in batch.column(1).to_pylist():
                answer, error, at = None, None, 0
                while answer is None and at < tries:
                    at += 1
                    try:
                        answer, error = model.answer(prompt), None
                    except Exception as wrong:  # a service fails in many ways; all of them are one row's error
                        error = f"{type(wrong).__name__}: {wrong}"[:500]
                        if at < tries:
                            time.sleep(pause * 2 ** (at - 1))
                rows.append((answer, error, at))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", "answer", "error", "tries"])

    return run


class Ledger:
    """Prompts and what a model has answered, by a hash of both. Prompts are asked in batches, and each batch's answers are kept before the
    next one is asked: a run that is cut off goes on where it was, and a lost executor costs its batch. Errors are kept too and asked again
    by the next run."""

    def __init__(self, spark: SparkSession, path: str, batch: int = 1000, tries: int = 3, pause: float = 1.0):
        self.spark, self.versions, self.batch, self.tries, self.pause = spark, Versions(spark, path), batch, tries, pause

    def table(self) -> DataFrame:
        """The newest row of each prompt: answer, or error, and how often it was tried."""
        folders = [self.versions.folder(v) for v in self.versions.marked()]
        if not folders:
            return self.spark.createDataFrame([], LEDGER)
        rows = self.spark.read.schema(LEDGER).parquet(*folders)
        return rows.groupBy("key").agg(F.max_by(F.struct("answer", "error"), F.struct(F.col("answer").isNotNull(), "error")).alias("s"), F.sum("tries").cast("int").alias("tries")).select("key", "s.answer", "s.error", "tries")

    def answered(self, rows: DataFrame, prompt_col: str, model: Chat, model_id: str = "") -> DataFrame:
        """The rows with ``answer`` and ``error`` in place of the prompt. Equal prompts are asked once; a null prompt is an empty one."""
        keyed = rows.withColumn("_key", F.sha2(F.concat_ws("\n", F.lit(model_id), F.coalesce(prompt_col, F.lit(""))).cast("binary"), 256))
        known = self.table().where("error is null").select(F.col("key").alias("_known"))
        fresh = keyed.select(F.col("_key").alias("key"), F.coalesce(prompt_col, F.lit("")).alias("prompt")).dropDuplicates(["key"]).join(known, F.col("key") == F.col("_known"), "left_anti")
        fresh = written(numbered(fresh, ["key"], "at"), "prompts")
        many = fresh.count()
        for begin in range(0, many, self.batch):
            part = fresh.where(F.col("at").between(begin, begin + self.batch - 1)).select("key", "prompt")
            version = self.versions.next()
            # Calls wait for the service, so a batch is dealt to all cores.
            dealt = part.repartition(self.spark.sparkContext.defaultParallelism)
            dealt.mapInArrow(_tried(model, self.tries, self.pause), LEDGER).write.mode("overwrite").parquet(self.versions.folder(version))
            self.versions.publish(version)
        found = self.table().select(F.col("key").alias("_known"), "answer", "error")
        return keyed.join(found, F.col("_key") == F.col("_known"), "left").select(*[c for c in rows.columns if c != prompt_col], "answer", "error")


def linked_by_model(examples: DataFrame, topics: DataFrame, model: Chat, ledger: Ledger | None = None) -> DataFrame:
    """Examples that a model links to topics (id, title, domain) with enough relevance. Answers that aren't JSON link nothing.

    With a ``ledger`` answers are kept, failing calls are tried again, and a run that is cut off goes on where it was.
    """
    listed = topics.orderBy("topic_ord").limit(MOST_TOPICS).select("id", "title", "domain").toJSON().collect()  # MOST_TOPICS rows
    told = "Choose the topics that the code is about. Topics: [" + ", ".join(listed) + ']. Answer as JSON {"topic_ids": [], "relevance": 0.0, "summary": ""}. Query: '
    query = F.coalesce(F.nullif("query_text", F.lit("")), F.lit("(none)"))
    prompt = F.concat(F.lit(told), query, F.lit("\nCode:\n"), F.substring("code", 1, MOST_CODE))
    prompts = examples.select("ex_ord", prompt.alias("prompt"))
    told_by = answered(prompts, "prompt", model) if ledger is None else ledger.answered(prompts, "prompt", model)
    parsed = told_by.select("ex_ord", F.from_json(json_text(F.col("answer")), ANSWER).alias("a"))
    good = parsed.where((F.col("a.relevance") >= LEAST_RELEVANCE) & (F.size("a.topic_ids") > 0)).select("ex_ord", "a.topic_ids", "a.relevance", "a.summary")
    return examples.drop("topic_ids", "relevance", "summary").join(good, "ex_ord")
