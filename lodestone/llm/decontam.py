"""Benchmark decontamination: a prefix-filtered set join with exact verification.

A benchmark item's windows are its runs of ``window_words`` words (an item with fewer words is one window). A
document is hit where it contains a whole window. Containing a window means containing all of its shingles, so it
is enough to look for one of them, the window's necessary prefix; the rarest one over all documents gives the
fewest candidates. The shingle's offset in its window fixes where the window must begin in the document, and the
document's length bounds it: one candidate place for each match, whose words are then compared exactly.

Passes over the documents: one counts in how many documents each benchmark shingle occurs, one finds the prefixes.
Both skip shingles outside the benchmark with a bit filter whose size has a fixed upper bound, whatever the
benchmark's size; matches then meet the windows in an ordinary join, which Spark broadcasts only below its own
threshold and deals anew where one shingle is very common.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import broadcast_if_small, materialized, need, spread, tuned
from lodestone.llm.keyfilter import KeyFilter, maybe
from lodestone.llm.wordhash import alnum_words, run_hashes, word_codes

#: Words of a shingle; an item with fewer words has one shingle, the whole item.
SHINGLE_WORDS = 5



def _windows(window_words: int, shingle_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lengths, shingles = [], [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = alnum_words(text)
                size = min(window_words, len(words))
                wide = min(shingle_words, size)
                if not words or item is None:
                    continue
                hashes = run_hashes(word_codes(words), wide).view(np.int64).tolist()
                for at in range(len(words) - size + 1):
                    ids.append(item)
                    texts.append(b" ".join(words[at : at + size]).decode(errors="replace"))
                    lengths.append(size)
                    shingles.append(hashes[at : at + size - wide + 1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(lengths, pa.int32()), pa.array(shingles, pa.list_(pa.int64()))], names=["item", "window", "size", "shingles"])

    return run


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, window_words: int, shingle_words: int) -> DataFrame:
    """(item string, window string, size int, shingles array<bigint>): an item's distinct windows."""
    schema = "item string, window string, size int, shingles array<bigint>"
    items = need(benchmark, id_col, text_col).select(F.col(id_col).cast("string"), F.col(text_col))
    return items.mapInArrow(_windows(window_words, shingle_words), schema).dropDuplicates(["item", "window"])


def _batch_words(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, the codes of all of them in a row, and where each text begins in that row."""
    words = [alnum_words(t) for t in texts]
    begins = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return words, word_codes([x for w in words for x in w]), begins


def _matches(codes: np.ndarray, begins: np.ndarray, wide: int, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place in the row of codes, hash) of the shingles that pass the filter and lie in one document."""
    hashes = run_hashes(codes, wide)
    at = maybe(table, bits, hashes)
    doc = np.searchsorted(begins, at, side="right") - 1
    inside = at + wide <= begins[doc + 1]
    return doc[inside], at[inside], hashes[at[inside]].view(np.int64)


def _frequencies(shared, bits: int, widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint32)
        for batch in batches:
            _, codes, begins = _batch_words(batch.column(0).cast(pa.binary()).to_pylist())
            pairs = [np.stack([doc, h]) for doc, _, h in (_matches(codes, begins, w, table, bits) for w in widths)]
            once = np.unique(np.concatenate(pairs, axis=1), axis=1)[1] if pairs else np.empty(0, np.int64)
            shingle, n = np.unique(once, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingle, pa.int64()), pa.array(n, pa.int64())], names=["shingle", "n"])

    return run


def _places(shared, bits: int, widths: list[int], reach: int):
    """reach: how many words around a prefix belong to a window at most."""
    hit = pa.struct([("prefix", pa.int64()), ("at", pa.int32()), ("around", pa.string()), ("in_around", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint32)
        for batch in batches:
            words, codes, begins = _batch_words(batch.column(1).cast(pa.binary()).to_pylist())
            hits: list[list[dict]] = [[] for _ in words]
            for wide in widths:
                for doc, place, h in zip(*(x.tolist() for x in _matches(codes, begins, wide, table, bits)), strict=True):
                    at = place - int(begins[doc])
                    low = max(0, at - reach)
                    around = b" ".join(words[doc][low : at + wide + reach]).decode(errors="replace")
                    hits[doc].append({"prefix": h, "at": at, "around": around, "in_around": at - low})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(hits, pa.list_(hit))], names=["id", "n_words", "hits"])

    return run


def hit_windows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window_words: int = 10, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, n_words, begin, end, item): the windows found in each document, in words, end excluded.

    A document without one has one row with nulls, so that n_words of every document is there.
    """
    spark = tuned(docs.sparkSession)
    docs = need(docs, id_col, text_col)
    windows = materialized(benchmark_windows(benchmark, item_col, item_text_col, window_words, shingle_words), "windows")
    wide = F.least("size", F.lit(shingle_words))
    widths = [r.wide for r in windows.select(wide.alias("wide")).distinct().collect()]  # shingle_words values at most
    spots = windows.select("item", "window", "size", F.posexplode("shingles").alias("offset", "shingle"))

    known = KeyFilter(spots.select("shingle").distinct(), "shingle")
    counted = docs.select(text_col).mapInArrow(_frequencies(known.shared, known.bits, widths), "shingle bigint, n bigint")
    often = counted.groupBy("shingle").agg(F.sum("n").alias("docs"))
    rarest = F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "shingle", "offset")).alias("rarest")
    prefixes = spots.join(often, "shingle", "left").groupBy("item", "window", "size").agg(rarest)
    prefixes = materialized(prefixes.select("item", "window", "size", F.col("rarest.shingle").alias("prefix"), F.col("rarest.offset").alias("offset")), "prefixes")

    wanted = KeyFilter(prefixes.select("prefix").distinct(), "prefix")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, n_words bigint, hits array<struct<prefix:bigint,at:int,around:string,in_around:int>>"
    places = docs.mapInArrow(_places(wanted.shared, wanted.bits, widths, max(0, window_words - 1)), schema)
    rows = places.select("id", "n_words", F.explode_outer("hits").alias("hit"))
    rows = rows.select("id", "n_words", "hit", F.coalesce("hit.prefix", spread(F.col("id"))).alias("prefix"))
    begin = F.col("hit.at") - F.col("offset")
    # Positional and length bounds first; then the words themselves.
    first = F.col("hit.in_around") - F.col("offset")
    fits = (begin >= 0) & (first >= 0) & (begin + F.col("size") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("hit.around", " "), F.greatest(first, F.lit(0)) + 1, F.col("size")), " ") == F.col("window")
    found = rows.join(prefixes, "prefix", "left").withColumn("found", F.coalesce(fits & same, F.lit(False)))
    of = lambda c: F.when(F.col("found"), c)
    return found.select("id", "n_words", of(begin).alias("begin"), of(begin + F.col("size")).alias("end"), of(F.col("item")).alias("item"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per id: n_words, n_hit (words inside a found window), items (sorted array of the items found).

    Null and empty texts have no words. Rows with the same id (null included) count as one document: n_words is that of the
    longest, n_hit and items are of all together; exact repeats change nothing. Items without words, or with a
    null id, have no window. Other columns are not read. An empty benchmark leaves every document clean.
    """
    found = hit_windows(docs, benchmark, id_col, **how)
    before = F.max("end").over(Window.partitionBy("id").orderBy(F.asc_nulls_first("begin"), "end", "item").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("end") - F.greatest("begin", F.coalesce(before, F.col("begin")))
    covered = found.withColumn("fresh", F.greatest(fresh, F.lit(0)).cast("bigint"))
    out = covered.groupBy("id").agg(F.max("n_words").alias("n_words"), F.coalesce(F.sum("fresh"), F.lit(0)).alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "items")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose texts hold no window. Each row is judged by its own text: rows with one id, or with none, stay or go
    one by one, and equal texts alike. Null and empty texts stay. An empty table stays empty, an empty benchmark drops none."""
    key = F.unhex(F.sha2(F.col(text_col).cast("binary"), 256))
    found = hit_windows(docs.select(key.alias("text_key"), text_col), benchmark, "text_key", text_col, **how)
    leaks = materialized(found.where(F.col("item").isNotNull()).select(F.col("id").alias("_leak")).distinct(), "leaks")
    return docs.join(broadcast_if_small(leaks, 100_000), key == F.col("_leak"), "left_anti")
