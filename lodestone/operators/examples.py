"""Code examples: query texts in sources, links to topics, and search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import short_hash

#: The two patterns of a query text in a source, and its least length.
CONSTRUCTED = r'(?isu)(?:Запрос\s*=\s*Новый\s+Запрос|New\s+Query)\s*\(\s*"([^"]*(?:\\.[^"]*)*)"'
SELECTING = r'(?isu)"((?:[^"\\]|\\.)*(?:SELECT|ВЫБРАТЬ)[^"]*(?:[^"\\]|\\.)*)"'
MORE_THAN, AROUND, HEAD = 20, 15, 2000


def query_texts(content: Column) -> Column:
    """Query literals of a source: those given to a query's constructor, then any string that selects."""
    found = F.concat(F.regexp_extract_all(content, F.lit(CONSTRUCTED), 1), F.regexp_extract_all(content, F.lit(SELECTING), 1))
    plain = F.transform(found, lambda q: F.trim(F.replace(F.replace(q, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit(" \n\t\r")))
    return F.filter(plain, lambda q: F.length(q) > MORE_THAN)


def snippets(files: DataFrame) -> DataFrame:
    """files: label, path, content. An example for each query text, with the lines around it; a file without one gives its head."""
    rows = files.select("label", "path", "content", F.posexplode_outer(query_texts(F.col("content"))).alias("at", "query_text"))
    place = F.position(F.substring("query_text", 1, 40), F.col("content"))
    line = F.when(place > 0, F.size(F.split(F.substring("content", F.lit(1), place - 1), "\n"))).otherwise(0)
    lines = F.split(F.regexp_replace("content", r"\r\n?", "\n"), "\n")
    low = F.greatest(F.lit(0), F.col("start_line") - AROUND)
    rows = rows.withColumn("start_line", F.when(F.col("query_text").isNull(), 0).otherwise(line).cast("int"))
    code = F.when(F.col("query_text").isNull(), F.substring("content", 1, HEAD)).otherwise(F.array_join(F.slice(lines, low + 1, F.col("start_line") + AROUND - low), "\n"))
    kept = rows.where(F.col("query_text").isNotNull() | (F.length(F.trim(F.col("content"), F.lit(" \n\t\r"))) > 50))
    number = F.coalesce("at", F.lit(0)).cast("string")
    return kept.select(F.concat_ws(":", "label", "path", number).alias("id"), F.col("label").alias("config_label"), F.col("path").alias("module_path"), code.alias("code"), F.coalesce("query_text", F.lit("")).alias("query_text"), "start_line")


def changed_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """files (path, content) whose hash isn't in seen (path, hash), with their hash."""
    return files.withColumn("hash", short_hash(F.col("content"))).join(seen.select("path", "hash"), ["path", "hash"], "left_anti")


def title_words(title: Column, longer_than: int = 3) -> Column:
    return F.filter(F.split(F.trim(F.lower(title)), r"\s+"), lambda w: F.length(w) > longer_than)


@dataclass
class Titles:
    """Some topics' title words, each once, and for each word the topics that have it, as often as they have it."""

    words: list[str]
    begins: np.ndarray
    topics: np.ndarray
    ords: np.ndarray
    ids: list[str]
    sizes: np.ndarray


def title_blocks(topics: DataFrame, most_bytes: int) -> Iterator[Titles]:
    """The topics (topic_ord, id, title), so many at a time as have title words of ``most_bytes`` together, or one."""
    rows = topics.select("topic_ord", "id", title_words(F.col("title")).alias("words")).where(F.size("words") > 0).toLocalIterator()
    block, size = [], 0
    for row in chain(rows, [None]):
        own = 0 if row is None else sum(len(w.encode()) + 8 for w in row.words)
        if block and (row is None or size + own > most_bytes):
            number: dict[str, int] = {}
            pairs = np.array([(number.setdefault(w, len(number)), at) for at, r in enumerate(block) for w in r.words], np.int64)
            pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
            yield Titles(list(number), np.searchsorted(pairs[:, 0], np.arange(len(number) + 1)), pairs[:, 1], np.array([r.topic_ord for r in block]), [r.id for r in block], np.array([len(r.words) for r in block]))
            block, size = [], 0
        if row is not None:
            block.append(row)
            size += own


LINKS = "array<struct<share:double,topic_ord:bigint,id:string>>"


def _linked(shared, least: int, most: int):
    """Adds a block's best topics to the links so far (the last column; the text is the one before)."""
    link = pa.list_(pa.struct([("share", pa.float64()), ("topic_ord", pa.int64()), ("id", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        titles: Titles = shared.value
        automaton = ahocorasick.Automaton()
        for i, word in enumerate(titles.words):
            automaton.add_word(word, i)
        automaton.make_automaton()
        for batch in batches:
            out = []
            for text, before in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                words = {i for _, i in automaton.iter(text or "")}
                hits = np.bincount(np.concatenate([titles.topics[titles.begins[i] : titles.begins[i + 1]] for i in words]) if words else [], minlength=1).astype(np.int64)
                at = np.flatnonzero(hits >= least)
                share = hits[at] / titles.sizes[at]
                first = np.lexsort((titles.ords[at], -share))[:most]
                found = [{"share": float(share[i]), "topic_ord": int(titles.ords[at[i]]), "id": titles.ids[at[i]]} for i in first]
                out.append(sorted([*before, *found], key=lambda x: (-x["share"], x["topic_ord"]))[:most])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, link)], names=batch.schema.names)

    return run


def linked_by_words(examples: DataFrame, topics: DataFrame, least: int = 2, most: int = 3, block_bytes: int = 16_000_000) -> DataFrame:
    """Examples with topic_ids (the ``most`` topics of the largest share of title words in the code) and relevance (that share).

    examples: ex_ord, code, query_text and more. topics: topic_ord, id, title. A word counts where it is part of the text, and
    as often as the title has it; a topic needs ``least`` of them. An automaton over all title words of a block of topics goes to the tasks, which go
    through each text once for it; blocks are ``block_bytes`` large at most. No pairs are listed and nothing is shuffled. Without
    topics no example is linked.
    """
    low = F.lower(F.concat_ws(" ", "code", "query_text"))
    rows = examples.withColumns({"_text": low, "_links": F.array().cast(LINKS)})
    for titles in title_blocks(topics, block_bytes):
        rows = rows.mapInArrow(_linked(examples.sparkSession.sparkContext.broadcast(titles), least, most), rows.schema)
    found = rows.where(F.size("_links") > 0)
    return found.select(*examples.columns, F.transform("_links", lambda x: x["id"]).alias("topic_ids"), F.element_at("_links", 1)["share"].alias("relevance"))


def of_topic(examples: DataFrame, topic_id: str, most: int = 5) -> DataFrame:
    """The most relevant examples linked to a topic."""
    return examples.where(F.array_contains("topic_ids", topic_id)).orderBy(F.desc("relevance"), "ex_ord").limit(most)


def topics_with_examples(topics: DataFrame, examples: DataFrame, most: int = 5) -> DataFrame:
    """Topics with a list of their most relevant examples (empty without any)."""
    links = examples.select("ex_ord", F.col("id").alias("example_id"), "relevance", F.explode("topic_ids").alias("id"))
    best = Window.partitionBy("id").orderBy(F.desc("relevance"), "ex_ord")
    top = links.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= most)
    lists = top.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "example_id"))), lambda x: x["example_id"]).alias("examples"))
    return topics.join(lists, "id", "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


def searched(examples: DataFrame, query: str, most: int = 5, above: float = 0.3) -> DataFrame:
    """Examples that have the query, or more than ``above`` of its words, best first."""
    low = F.lower(F.concat_ws(" ", "code", "query_text", "summary"))
    words = [w for w in query.lower().split() if len(w) > 2]
    share = sum((low.contains(w).cast("int") for w in words), F.lit(0)) / len(words) if words else F.lit(0.0)
    scored = examples.withColumn("overlap", F.when(low.contains(query.lower()), 1.0).otherwise(share))
    return scored.where((F.col("overlap") > above)).orderBy(F.desc("overlap"), "ex_ord").limit(most)
