"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance.

A fingerprint has 64 bits. It is split into ``2 * max_bits`` blocks; two fingerprints that differ in at most
``max_bits`` bits agree on at least half of the blocks, so each fingerprint gets a key for every choice of that
many blocks, and equal keys are candidates. With 3 bits that is 6 blocks, 20 keys of 32 bits: at N distinct
fingerprints a key holds N / 2^32 others by chance, so candidates stay in proportion to the input.

Equal fingerprints are one node from the start, so groups of exact copies cost nothing. A key that still holds
more than ``crowd`` distinct fingerprints is refined: the same choice of blocks again, within the bits that the key
leaves open. Twice refined (32, 48, 56 bits), a key holds 256 distinct fingerprints at most, whatever the data.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialized, need, tuned
from lodestone.llm.components import connected_components

BITS = 64
#: Of each byte value, its eight bits, lowest first.
BYTE_BITS = [[(byte >> bit) & 1 for bit in range(8)] for byte in range(256)]


def fingerprint_bytes(text: bytes | None, shingle_words: int = 3) -> int:
    """The SimHash of a UTF-8 text, as a signed 64-bit number; 0 without words."""
    import xxhash

    if text is None:
        return 0
    words = text.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle_words:
        hashes = [digest(join(words), 42)]
    else:
        hashes = [digest(join(x), 42) for x in zip(*(words[i:] for i in range(shingle_words)), strict=False)]
    lanes, table = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), np.array(BYTE_BITS)
    counts = np.concatenate([np.bincount(lanes[:, lane], minlength=256) @ table for lane in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle_words: int = 3) -> Column:
    """Column of fingerprints (bigint) of a string column; Arrow batches, one pass over the bytes."""

    @F.arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_bytes(x, shingle_words) for x in texts.cast(pa.binary()).to_pylist()], pa.int64())

    return simhash(text)


def as_hex(fp: Column) -> Column:
    """16 lower-case hex digits of the unsigned value."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_masks(open_bits: list[int], blocks: int, keep: int) -> list[tuple[int, list[int]]]:
    """(mask, bits left open) for every choice of ``keep`` of the ``blocks`` blocks of ``open_bits``."""
    blocks = min(blocks, len(open_bits))
    edges = [round(i * len(open_bits) / blocks) for i in range(blocks + 1)]
    parts = [open_bits[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for chosen in combinations(range(blocks), min(keep, blocks)):
        fixed = {bit for i in chosen for bit in parts[i]}
        out.append((sum(1 << bit for bit in fixed), [b for b in open_bits if b not in fixed]))
    return out


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _keyed(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """A row for each node and mask: way (which mask), key (the node's bits under it), node, fp."""
    ways = F.array(*[F.struct(F.lit(i).cast("bigint").alias("way"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("bigint")).alias("key")) for i, m in enumerate(masks)])
    return nodes.select("node", "fp", F.inline(ways))


def _together(rows: DataFrame) -> DataFrame:
    """Rows whose key another fingerprint has too, with the number of those that have it."""
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("way", "key"))).where("n > 1")


def _verified(rows: DataFrame, max_bits: int) -> DataFrame:
    """Links among the fingerprints of each key; the distance is part of the join, so no candidate pair is emitted."""
    a, b = (rows.select("way", "key", F.col("node").alias(x), F.col("fp").alias(f"{x}_fp")) for x in ("src", "dst"))
    near = (F.col("src_fp") < F.col("dst_fp")) & (F.bit_count(F.col("src_fp").bitwiseXOR(F.col("dst_fp"))) <= max_bits)
    return a.join(b, ["way", "key"]).where(near).select("src", "dst")


def links(nodes: DataFrame, max_bits: int = 3, crowd: int = 256, blocks: int | None = None) -> DataFrame:
    """All pairs (src, dst: node) of distinct fingerprints that differ in ``max_bits`` bits or fewer; may repeat pairs.

    nodes: (node bigint, fp bigint), each fingerprint once.
    """
    blocks = blocks or 2 * max_bits
    keep = blocks - max_bits
    first = block_masks(list(range(BITS)), blocks, keep)
    level = materialized(_together(_keyed(nodes, [m for m, _ in first])), "simhash")
    ways, out = {i: (m, rest) for i, (m, rest) in enumerate(first)}, None
    while True:
        # A key that leaves 8 bits open has 256 distinct fingerprints at most.
        refined = (F.col("n") > crowd) & F.col("way").isin([way for way, (_, rest) in ways.items() if len(rest) > 8])
        found = _verified(level.where(~refined), max_bits)
        out = found if out is None else out.union(found)
        crowded = level.where(refined)
        there = [r.way for r in crowded.select("way").distinct().collect()]  # ways are masks: a few thousand at most
        if not there:
            return out
        deeper: dict[int, tuple[int, list[int]]] = {}
        finer = []
        for way in there:
            mask, rest = ways[way]
            for i, (more, left) in enumerate(block_masks(rest, blocks, keep)):
                deeper[way * 1000 + i] = (mask | more, left)
                finer.append((way, way * 1000 + i, _signed(mask | more)))
        # A row for each mask, 20 for each way that is there.
        masks = F.broadcast(nodes.sparkSession.createDataFrame(finer, "way bigint, next bigint, mask bigint"))
        rows = crowded.select("node", "fp", "way").distinct().join(masks, "way")
        level, ways = materialized(_together(rows.select("node", "fp", F.col("next").alias("way"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))), "simhash"), deeper


def _with_components(prints: DataFrame, max_bits: int, crowd: int, blocks: int | None) -> DataFrame:
    """prints (id, fp and more) with component (a node) and component_id (the least id of all its rows)."""
    # A fingerprint is a node, with an id or without.
    nodes = materialized(prints.groupBy("fp").agg(F.min("id").cast("bigint").alias("least")).withColumn("node", F.col("fp")), "nodes")
    parts = connected_components(links(nodes.select("node", "fp"), max_bits, crowd, blocks))
    joined = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(joined.select("fp", "component").join(names, "component"), "fp", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle_words: int = 5, max_bits: int = 3, blocks: int | None = None, crowd: int = 256) -> DataFrame:
    """(id, fp bigint, component_id) of each row of ``docs``; linked transitively at ``max_bits`` differing bits.

    component_id is the smallest id reachable. Null and empty texts have the fingerprint 0 and link like any other.
    Rows with a null id take part; they have a component_id only if a row with an id is reachable. Repeated rows
    come back as often as they went in. Other columns of ``docs`` are not read. An empty table gives an empty one.
    """
    tuned(docs.sparkSession)
    docs = need(docs, id_col, text_col)
    prints = materialized(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle_words).alias("fp")), "prints")
    return _with_components(prints, max_bits, crowd, blocks).select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle_words: int = 5, max_bits: int = 3, blocks: int | None = None, crowd: int = 256) -> DataFrame:
    """``docs`` with exactly one row of each near-duplicate component: that with the smallest id, rows without one last.

    Rows are told apart one by one, so several rows with one id, or with none, stay where their texts are in different
    components, and of repeated rows one stays. Null and empty texts are one component. An empty table stays empty.
    """
    tuned(docs.sparkSession)
    number, print_ = "_lodestone_row", "_lodestone_fp"
    rows = docs.withColumns({number: F.monotonically_increasing_id(), print_: fingerprint(F.col(text_col), shingle_words)})
    rows = materialized(rows, "rows")  # written, so that the numbers stay
    prints = rows.select(F.col(id_col).alias("id"), F.col(print_).alias("fp"), F.col(number).alias("row"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    members = materialized(_with_components(prints, max_bits, crowd, blocks).select("component", order.alias("order")), "members")
    # Rows meet the kept ones by their own numbers, never by component, which may be that of a third of all rows.
    kept = members.groupBy("component").agg(F.min("order").alias("first")).select(F.col("first.row").alias("_kept"))
    later = members.select(F.col("order.row").alias("_later")).join(kept, F.col("_later") == F.col("_kept"), "left_anti")
    return rows.join(later, rows[number] == later["_later"], "left_anti").drop(number, print_)
