"""Line dedup: a deletion-neighbourhood join over the lines of all documents.

A line that occurs again, or that is within ``max_edits`` edits (1, in characters) of a line that occurs earlier, is
removed; the earliest stays. Earlier is by document id, then place. Blank lines always stay. The edit must be at most a
twentieth of the line, so lines shorter than ``min_chars`` (20) have to be equal: an edit makes another line of a short one
("yes" and "yet", "1." and "2.").

Two lines are one edit apart if deleting a character at the same place leaves the same rest (a substitution), or if
deleting one from the longer leaves the shorter. So every line emits its variants as hashed keys: (rest, place) for
each character and the line itself. All lines of one (rest, place) are within an edit of one another, so each is tied
to the earliest of them, and each shorter line to the longer ones that become it: as many ties as keys, never all
pairs of a group. Each tie's edit distance is then verified on the texts.

Only lines that can have a neighbour emit variants. An edit leaves the first or the last half of a line as it was,
so lines are first keyed by their halves (four hashes of a line); what shares a half with no other line is out. Lines
are 128-bit hashes up to here; the texts of those left are fetched by a second pass that skips the others. They are
keyed once more by all but one of ``PARTS`` parts, as an edit touches one part, with the same result for what shares no key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import materialized, need, tuned
from lodestone.llm.keyfilter import KeyFilter, maybe
from lodestone.llm.wordhash import mixed

MIN_CHARS, PARTS = 20, 16
#: A line with more than one in so many of all lines is common; there are fewer common lines than that.
COMMON = 20_000
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


def line_key(line: str) -> tuple[int, int]:
    """128 bits of a line (XXH3), as two signed numbers."""
    import xxhash

    whole = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
    return int.from_bytes(whole[:8], "little", signed=True), int.from_bytes(whole[8:], "little", signed=True)


def outlines(line: str, parts: int) -> list[int]:
    """Hashes of the line without one of its parts, for each part, as a line of its own length and as one that had a
    character less: two lines an edit apart have one in common. With two parts that is either half."""
    import xxhash

    n, out = len(line), set()
    for m in (n - 1, n):
        for part in range(parts):
            head, tail = m * part // parts, m - m * (part + 1) // parts
            kept = line[:head].encode("utf-8", "surrogatepass") + b"\xff" + line[n - tail :].encode("utf-8", "surrogatepass")
            h = xxhash.xxh3_64_intdigest(kept, seed=m * parts + part)
            out.add(h - (1 << 64) if h >> 63 else h)
    return sorted(out)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), base, np.uint64), dtype=np.uint64)])[:n]


def variants(line: str) -> tuple[np.ndarray, int]:
    """(a hash of what is left without each character, the hash of the whole line), in time linear in the line."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(codes)
    up, down = _powers(_BASE, n + 1), _powers(_INVERSE, n)
    # heads[j]: the polynomial hash of the first j characters.
    heads = np.concatenate([[np.uint64(0)], np.cumsum(codes * down, dtype=np.uint64) * up[:n]])
    rest = heads[n] + (heads[:-1] - heads[1:]) * up[n - 1 - np.arange(n)] if n else np.empty(0, np.uint64)
    salt = lambda h, length: mixed(h * np.uint64(3) + np.uint64(length))
    return salt(rest, n - 1).view(np.int64), int(salt(heads[n : n + 1], n).view(np.int64)[0])


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, place, first, second, parts = [], [], [], [], []
            known: dict[str, tuple] = {}
            for row, text in enumerate(batch.column(2).to_pylist()):
                for at, line in enumerate(text.split("\n") if text else ()):
                    if not line.strip():
                        continue
                    if (seen := known.get(line)) is None:
                        seen = known[line] = (*line_key(line), outlines(line, 2) if len(line) >= min_chars else None)
                    owner.append(row)
                    place.append(at)
                    first.append(seen[0])
                    second.append(seen[1])
                    parts.append(seen[2])
            owners = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(owners), batch.column(1).take(owners), pa.array(place, pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(parts, pa.list_(pa.int64()))],
                names=["id", "text_key", "place", "h1", "h2", "halves"],
            )

    return run


def _wanted_lines(shared, bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint32)
        for batch in batches:
            lines = list({line for text in batch.column(0).to_pylist() if text for line in text.split("\n") if len(line) >= min_chars and line.strip()})
            keys = np.array([line_key(x) for x in lines], np.int64).reshape(-1, 2)
            at = maybe(table, bits, keys[:, 0].view(np.uint64) if len(keys) else np.empty(0, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys[at, 0]), pa.array(keys[at, 1]), pa.array([lines[i] for i in at], pa.string())], names=["h1", "h2", "line"])

    return run


def _outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [outlines(line, PARTS) for line in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["h1", "h2", "outlines"])


def _sharing(keyed: DataFrame) -> DataFrame:
    """(h1, h2) of the lines of (h1, h2, key) that share a key with another line."""
    return keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1").select("h1", "h2").distinct()


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for h1, h2, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            rest, whole = variants(line)
            keys, places = np.append(rest, whole), np.append(np.arange(len(rest)), -1).astype(np.int32)
            for at in range(0, len(keys), 50_000):  # a line can be a whole text
                n = len(keys[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + n]), pa.array(places[at : at + n]), pa.array(np.full(n, h1)), pa.array(np.full(n, h2))], names=["rest", "place", "h1", "h2"])


def _later_lines(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(h1, h2) of the lines within an edit of an earlier one. lines: (h1, h2, first); texts: (h1, h2, line)."""
    keys = materialized(texts.mapInArrow(_variants, "rest bigint, place int, h1 bigint, h2 bigint").join(lines.select("h1", "h2", "first"), ["h1", "h2"]), "variants")
    who = F.struct("first", "h1", "h2")
    same = keys.where("place >= 0").withColumn("earliest", F.min(who).over(Window.partitionBy("rest", "place")))
    ties = same.where("earliest.first < first").select("h1", "h2", F.col("earliest.h1").alias("e1"), F.col("earliest.h2").alias("e2"))
    short = keys.where("place < 0").select("rest", who.alias("short"))
    pair = F.array_sort(F.array("short", who))
    grown = keys.where("place >= 0").join(short, "rest").select(pair[0].alias("a"), pair[1].alias("b")).where("a.first < b.first")
    ties = ties.union(grown.select("b.h1", "b.h2", "a.h1", "a.h2")).distinct()
    met = ties.join(texts, ["h1", "h2"]).join(texts.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("earlier")), ["e1", "e2"])
    return met.where(F.levenshtein("line", "earlier", 1).between(0, 1)).select("h1", "h2").distinct()


def removed_lines(docs: DataFrame, id_col: str, text_col: str, max_edits: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, text_key, places: the line numbers to remove) of the documents that lose any."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    rows = need(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, text_key bigint, place int, h1 bigint, h2 bigint, halves array<bigint>"
    lines = materialized(rows.mapInArrow(_lines(max(4, min_chars)), schema), "lines")
    at = F.struct("id", "text_key", "place")
    distinct = lines.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    if max_edits:
        distinct = materialized(distinct, "distinct-lines")
        keyed = lines.where("halves is not null").select("h1", "h2", "halves").dropDuplicates(["h1", "h2"]).select("h1", "h2", F.explode("halves").alias("key"))
        maybe_near = materialized(distinct.join(_sharing(keyed), ["h1", "h2"]).select("h1", "h2", "first"), "maybe-near")
        wanted = KeyFilter(maybe_near.select("h1").distinct(), "h1")
        found = rows.select("text").mapInArrow(_wanted_lines(wanted.shared, wanted.bits, max(4, min_chars)), "h1 bigint, h2 bigint, line string")
        texts = materialized(found.dropDuplicates(["h1", "h2"]).join(maybe_near.select("h1", "h2"), ["h1", "h2"]), "near-texts")
        outlined = texts.mapInArrow(_outlined, "h1 bigint, h2 bigint, outlines array<bigint>").select("h1", "h2", F.explode("outlines").alias("key"))
        texts = materialized(texts.join(_sharing(outlined), ["h1", "h2"]), "narrowed-texts")
        later = _later_lines(maybe_near, texts).withColumn("later", F.lit(True))
        distinct = distinct.join(later, ["h1", "h2"], "left")
    else:
        distinct = distinct.withColumn("later", F.lit(None).cast("boolean"))
    # Only lines with something to remove meet their occurrences.
    marked = distinct.where("later or first < last").select("h1", "h2", "first", F.coalesce("later", F.lit(False)).alias("later"), "n")
    # Occurrences of a common line must not meet in one task: at most ``COMMON`` lines can have more than their share of all
    # occurrences, so these few are sent to the occurrences, and no other line has more than that share.
    marked = materialized(marked, "marked-lines")
    is_common = F.col("n") > lines.count() // COMMON
    common = F.broadcast(marked.where(is_common).drop("n"))
    occurrences = lines.select("id", "text_key", "place", "h1", "h2")
    rare = occurrences.join(common.select("h1", "h2"), ["h1", "h2"], "left_anti").join(marked.where(~is_common).drop("n"), ["h1", "h2"])
    gone = occurrences.join(common, ["h1", "h2"]).unionByName(rare).where(F.col("later") | (at != F.col("first")))
    return gone.groupBy("id", "text_key").agg(F.collect_set("place").alias("places"))


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, places: pa.Array) -> pa.Array:
    """The texts without the lines at these places; null stays null."""

    def left(text: str, gone: list[int]) -> str:
        drop = set(gone)
        return "\n".join(line for at, line in enumerate(text.split("\n")) if at not in drop)

    return pa.array([None if text is None else left(text, gone) for text, gone in zip(texts.to_pylist(), places.to_pylist(), strict=True)], pa.string())


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the repeated lines taken out of the text, and n_lines and n_removed (bigint) at the end.

    A text whose lines all go is empty; a null text stays null and has 0 lines, an empty one has 1. Rows with a
    null id come first. Rows that repeat an id and its text are one document: all lose the same lines. All columns of
    ``docs`` stay; none but the id and the text are looked at.
    """
    tuned(docs.sparkSession)
    gone = removed_lines(docs, id_col, text_col, **how)
    gone = gone.select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), F.col("places").alias("_places"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_col].alias("_own"), F.xxhash64(docs[text_col]).alias("_text_key"))
    met = rows.join(gone, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left")
    text = F.col("_row")[text_col]
    kept = _without(F.when(F.col("_places").isNotNull(), text), F.col("_places"))  # only texts that lose lines go to Python
    n_lines = F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0))
    columns = [F.when(F.col("_places").isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns]
    return met.select(*columns, F.when(text.isNull(), 0).otherwise(n_lines).cast("bigint").alias("n_lines"), F.coalesce(F.size("_places"), F.lit(0)).cast("bigint").alias("n_removed"))
