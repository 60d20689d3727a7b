"""Embedding backends: text to vectors, in Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.tables import Versions


class Backend(Protocol):
    """What turns texts into vectors. Instances are sent to the executors."""

    model_id: str

    def embed_passages(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray: ...


class HashingBackend:
    """Vectors of hashed words; needs no model. Passages are cut at ``max_chars`` characters, as models cut them."""

    def __init__(self, dimensions: int = 64, max_chars: int = 2000):
        self.model_id, self.dimensions, self.max_chars = f"hashing-{dimensions}", dimensions, max_chars

    def embed_passages(self, texts: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text[: self.max_chars].lower()):
                h = zlib.crc32(word.encode())
                row[h % self.dimensions] += 1 if h >> 31 else -1
        lengths = np.sqrt((out**2).sum(1, keepdims=True))
        return (out / np.where(lengths == 0, 1, lengths)).astype(np.float32)

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_passages([text])[0]


class HttpBackend:
    """A service with the widespread ``/embeddings`` interface. Failed calls are repeated with growing pauses."""

    def __init__(self, base_url: str, model: str, api_key: str = "", batch: int = 16, timeout: float = 120.0, tries: int = 3, passage_prefix: str = "", query_prefix: str = "", max_chars: int = 2000):
        self.model_id, self.base_url, self.api_key = model, base_url.rstrip("/"), api_key
        self.batch, self.timeout, self.tries, self.max_chars = batch, timeout, tries, max_chars
        self.passage_prefix, self.query_prefix = passage_prefix, query_prefix

    def _call(self, texts: list[str]) -> np.ndarray:
        import json
        import time
        import urllib.error
        import urllib.request

        body = json.dumps({"model": self.model_id, "input": texts}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        for attempt in range(self.tries):
            try:
                with urllib.request.urlopen(urllib.request.Request(f"{self.base_url}/embeddings", body, headers), timeout=self.timeout) as reply:
                    rows = sorted(json.load(reply)["data"], key=lambda x: x["index"])
                out = np.array([r["embedding"] for r in rows], np.float32)
                lengths = np.sqrt((out**2).sum(1, keepdims=True))
                return out / np.where(lengths == 0, 1, lengths)
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if attempt + 1 == self.tries:
                    raise
                time.sleep(min(2**attempt, 30))
        raise AssertionError

    def embed_passages(self, texts: list[str]) -> np.ndarray:
        parts = [self._call([self.passage_prefix + t[: self.max_chars] for t in texts[at : at + self.batch]]) for at in range(0, len(texts), self.batch)]
        return np.vstack(parts) if parts else np.empty((0, 0), np.float32)

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_queries([text])[0]

    def embed_queries(self, texts: list[str]) -> np.ndarray:
        """Vectors of many queries, a call for each batch of them."""
        return np.vstack([self._call([self.query_prefix + t for t in texts[at : at + self.batch]]) for at in range(0, len(texts), self.batch)])


class LocalModelBackend:
    """A model on the machine by the ``sentence_transformers`` library, where that is installed; loaded on first use in each process."""

    def __init__(self, model: str = "intfloat/multilingual-e5-base", device: str = "cpu", batch: int = 64, passage_prefix: str = "passage: ", query_prefix: str = "query: "):
        self.model_id, self.device, self.batch = model, device, batch
        self.passage_prefix, self.query_prefix = passage_prefix, query_prefix

    def _encoded(self, texts: list[str]) -> np.ndarray:
        if "_model" not in self.__dict__:
            from sentence_transformers import SentenceTransformer

            self._model = SentenceTransformer(self.model_id, device=self.device)
        return np.asarray(self._model.encode(texts, batch_size=self.batch, normalize_embeddings=True, show_progress_bar=False), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_model"}

    def embed_passages(self, texts: list[str]) -> np.ndarray:
        return self._encoded([self.passage_prefix + t for t in texts])

    def embed_query(self, text: str) -> np.ndarray:
        return self._encoded([self.query_prefix + text])[0]

    def embed_queries(self, texts: list[str]) -> np.ndarray:
        return self._encoded([self.query_prefix + t for t in texts])


def ollama(model: str = "nomic-embed-text", base_url: str = "http://localhost:11434/v1", **options) -> HttpBackend:
    """A local service with its usual address."""
    return HttpBackend(base_url, model, **options)


BACKENDS: dict[str, Callable[..., Backend]] = {"hashing": HashingBackend, "http": HttpBackend, "openai_compatible": HttpBackend, "ollama": ollama, "sentence_transformers": LocalModelBackend, "huggingface": LocalModelBackend}

#: How many query vectors a process remembers.
REMEMBERED = 1024


def query_vectors(model: Backend, texts: list[str], known: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Vectors of queries; each distinct one is asked for once, all new ones together where the model can."""
    fresh = [t for t in dict.fromkeys(texts) if t not in known]
    if len(known) + len(fresh) > REMEMBERED:
        fresh = list(dict.fromkeys(texts))
        known.clear()
    if fresh:
        many = getattr(model, "embed_queries", None)
        known.update(zip(fresh, many(fresh) if many else [model.embed_query(t) for t in fresh], strict=True))
    return [known[t] for t in texts]


def backend(provider: str, **options) -> Backend:
    if provider not in BACKENDS:
        raise ValueError(f"unknown embedding provider {provider!r}; there are {', '.join(BACKENDS)}")
    return BACKENDS[provider](**options)


def provider_of(model: Backend) -> str:
    """The provider's name of a backend; empty for one that isn't among ``BACKENDS``."""
    names = {"HashingBackend": "hashing", "HttpBackend": "openai_compatible", "LocalModelBackend": "sentence_transformers"}
    return names.get(type(model).__name__, "")


def _embedded(model: Backend, queries: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            found = query_vectors(model, texts, known) if queries else model.embed_passages(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([v.tolist() for v in found], pa.list_(pa.float32()))], names=[*batch.schema.names[:-1], "vector"])

    return run


def embedded(rows: DataFrame, text_col: str, model: Backend, queries: bool = False) -> DataFrame:
    """The rows with ``vector`` (array<float>) in place of the text column."""
    others = [c for c in rows.columns if c != text_col]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others) + ", vector array<float>"
    return rows.select(*others, text_col).mapInArrow(_embedded(model, queries), schema)


MEMO = "key string, vector array<float>"


class Memo:
    """Query vectors that are kept: a table by a hash of the model and the text. A text that isn't there yet is embedded once, and what a
    lookup has embedded is one version of the table, so the next lookup, in any session, asks the model for nothing."""

    #: Versions that are folded into one when there are more.
    MOST = 50

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)

    def table(self) -> DataFrame:
        folders = [self.versions.folder(v) for v in self.versions.marked()]
        return self.spark.read.schema(MEMO).parquet(*folders) if folders else self.spark.createDataFrame([], MEMO)

    def _keep(self, rows: DataFrame) -> None:
        version = self.versions.next()
        rows.write.mode("overwrite").parquet(self.versions.folder(version))
        self.versions.publish(version)

    def embedded(self, rows: DataFrame, text_col: str, model: Backend) -> DataFrame:
        """Like ``embedded`` for queries; a null text is an empty one. The model is asked only for texts without a kept vector."""
        key = F.sha2(F.concat_ws("\n", F.lit(model.model_id), F.coalesce(text_col, F.lit(""))).cast("binary"), 256)
        keyed = rows.withColumn("_key", key)
        fresh = keyed.select("_key", text_col).dropDuplicates(["_key"]).join(self.table(), F.col("_key") == F.col("key"), "left_anti")
        if not fresh.isEmpty():
            found = embedded(fresh, text_col, model, queries=True)
            self._keep(found.select(F.col("_key").alias("key"), "vector"))
        if len(self.versions.marked()) > self.MOST:
            self._keep(self.table().dropDuplicates(["key"]))
            self.versions.drop_old(keep=1)
        kept = self.table().dropDuplicates(["key"]).withColumnRenamed("key", "_kept")
        return keyed.join(kept, F.col("_key") == F.col("_kept")).select(*[c for c in rows.columns if c != text_col], "vector")
