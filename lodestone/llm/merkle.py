"""Merkle manifest of a dataset: a tree over each group's rows, a tree over the groups' roots, and proofs for every row.

Leaves are sorted over all partitions by a range exchange, so each partition holds a stretch of consecutive leaves. A
pass over a stretch keeps a mountain range: a stack of peaks by level, where the last leaf of ``fanout`` carries into the next level like
a digit of a number in that base. What a carry completes becomes a node record; peaks whose run isn't all in the stretch are passed on.
These unaligned edges, a few for each partition and level, meet by (group, level, run) in groups of ``fanout`` rows at most
and are merged level by level. The last run of a level is hashed as short as it is, without padding.

Only leaf digests travel: texts are read once and never shuffled. Of the partitions the driver sees their first and last group and the
counts of these; of groups, it sees how many levels the largest has. Group roots are the leaves of one more tree, built by the same passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import broadcast_if_small, id_crc, materialized, need, tuned

FANOUT = 16
#: Node records that a task gathers before it sends them.
FLUSH = 2000
CHILD = pa.struct([("digest", pa.string()), ("id", pa.string()), ("altered", pa.string())])


def field(column: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(*columns: Column) -> Column:
    return digest(F.concat(*[field(c) for c in columns]))


@dataclass
class Edge:
    """What a partition has to know of others: rows of its first group before it, and whether its last group goes on after it."""

    offset: int
    goes_on: bool


class Mountains:
    """The peaks of one stretch of a group's leaves, by level: lists of (place in the level, child)."""

    def __init__(self, fanout: int, emit: Callable[[int, int, list[dict], str], None], left_over: Callable[[int, int, dict], None]):
        self.fanout, self.emit, self.left_over = fanout, emit, left_over
        self.levels: list[list[tuple[int, dict]]] = []

    def push(self, level: int, at: int, child: dict) -> None:
        """Adds a node; a carry follows where it is the last of its run."""
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append((at, child))
            if (at + 1) % self.fanout:
                return
            if len(self.levels[level]) < self.fanout:  # the run began before the stretch
                self._leave(level)
                return
            at, child = self._closed(level)
            level += 1

    def _closed(self, level: int) -> tuple[int, dict]:
        run, self.levels[level] = self.levels[level], []
        at, children = run[0][0] // self.fanout, [c for _, c in run]
        self.emit(level + 1, at, children, joined := hashlib.sha256("".join(c["digest"] for c in children).encode()).hexdigest())
        return at, {"digest": joined, "id": None, "altered": None}

    def _leave(self, level: int) -> None:
        for at, child in self.levels[level]:
            self.left_over(level, at, child)
        self.levels[level] = []

    def end(self, total: int | None) -> None:
        """The stretch is over; with the group's number of leaves, if the group is over too, short runs close."""
        level, count = 0, total
        while count is not None and count > 1 and level < len(self.levels):
            run = self.levels[level]
            if run and run[-1][0] == count - 1 and run[0][0] % self.fanout == 0:
                at, child = self._closed(level)
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append((at, child))
            level, count = level + 1, -(-count // self.fanout)
        for left in range(len(self.levels)):
            self._leave(left)


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, each row's place within its group there, and whether it is the group's last row there."""
    part, group, rank, held = TaskContext.get().partitionId(), object(), 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        groups, ranks = batch.column(0).to_pylist(), []
        for one in groups:
            rank = rank + 1 if one == group else 0
            group = one
            ranks.append(rank)
        ends = [a != b for a, b in zip(groups, groups[1:], strict=False)]
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held[0].columns, pa.array([*held[1], held[2] != groups[0]])], names=[*held[0].schema.names, "last"])
        whole = pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(groups), pa.int32()), pa.array(ranks, pa.int64())], names=[*batch.schema.names, "part", "rank"])
        held = whole, ends, group
    if held is not None:
        yield pa.RecordBatch.from_arrays([*held[0].columns, pa.array([*held[1], True])], names=[*held[0].schema.names, "last"])


def _climbed(edges, fanout: int):
    """Node records and left-over peaks of the stretches of ranked rows that a task reads, file splits included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge_of: dict[int, Edge] = edges.value
        out: list[tuple] = []
        place, mountains = None, None  # of the row that would go on with the stretch

        def started(group: str | None) -> Mountains:
            return Mountains(fanout, lambda level, at, children, d: out.append((group, level, at, d, children, False, None)), lambda level, at, c: out.append((group, level, at, c["digest"], [], True, c)))

        def sent() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.list_(CHILD), pa.bool_(), CHILD]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["grp", "level", "at", "digest", "children", "left_over", "peak"])

        for batch in batches:
            for group, id_, leaf, altered, part, rank, last in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                edge = edge_of[part, group] if (part, group) in edge_of else None
                at = rank + (edge.offset if edge else 0)
                if place != (group, at):
                    if mountains is not None:
                        mountains.end(None)
                    mountains = started(group)
                mountains.push(0, at, {"digest": leaf, "id": id_, "altered": altered})
                place = group, at + 1
                if last and not (edge and edge.goes_on):
                    mountains.end(at + 1)
                    place, mountains = None, None
            if len(out) >= FLUSH:
                yield sent()
        if mountains is not None:
            mountains.end(None)
        if out:
            yield sent()

    return run


NODES = "grp string, level int, at bigint, digest string, children array<struct<digest:string,id:string,altered:string>>, left_over boolean, peak struct<digest:string,id:string,altered:string>"


def edges_of(ends: list[tuple]) -> dict[tuple[int, str | None], Edge]:
    """ends: of each partition that has rows, its number, first group and its rows there, last group and its rows there."""
    out: dict[tuple[int, str | None], Edge] = {}
    before, open_group = 0, object()
    ends = sorted(ends, key=lambda e: e[0])
    for (part, first, n_first, last, n_last), after in zip(ends, [*ends[1:], None], strict=False):
        offset = before if first == open_group else 0
        goes_on = after is not None and after[1] == last
        out[part, first] = Edge(offset, goes_on and first == last)
        if last != first:
            out[part, last] = Edge(0, goes_on)
        before, open_group = (offset + n_first if first == last else n_last), last
    return out


def trees(leaves: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """(nodes, tops) of one tree for each group.

    leaves: grp string, id string, leaf string, altered string, and ``order``, a struct to sort a group's leaves by; all written
    tables, as they are read twice. nodes: grp, level (1 above the leaves), at, digest, children (digest, and id and
    altered of leaves). tops: grp, digest (of a lone leaf itself), levels, leaves, and the lone leaf as ``peak``.
    """
    spark = leaves.sparkSession
    ordered = leaves.repartitionByRange("grp", "order").sortWithinPartitions("grp", "order").select("grp", "id", "leaf", "altered")
    ranked = materialized(ordered.mapInArrow(_ranked, "grp string, id string, leaf string, altered string, part int, rank bigint, last boolean"), "ranked")
    counts = materialized(ranked.where("last").select("part", "grp", (F.col("rank") + 1).alias("n")), "counts")
    ends = counts.groupBy("part").agg(F.min(F.struct("grp", "n")).alias("a"), F.max(F.struct("grp", "n")).alias("b"))
    edges = spark.sparkContext.broadcast(edges_of([(r.part, *r.a, *r.b) for r in ends.collect()]))  # two entries a partition at most
    totals = counts.groupBy("grp").agg(F.sum("n").alias("leaves"))
    found = materialized(ranked.mapInArrow(_climbed(edges, fanout), NODES), "climbed")

    per_level = "case when leaves <= 1 then 0 " + " ".join(f"when leaves <= {fanout**k} then {k}" for k in range(1, 16) if fanout**k < 1 << 62) + " end"
    totals = materialized(totals.withColumn("levels", F.expr(per_level).cast("int")), "totals")
    most = totals.agg(F.max("levels")).first()[0] or 0
    edge_rows = found.where("left_over").select("grp", "level", "at", "peak").join(broadcast_if_small(totals.withColumnRenamed("grp", "of")), F.col("grp").eqNullSafe(F.col("of"))).drop("of")
    made, tops, above = found.where("not left_over").select("grp", "level", "at", "digest", "children"), edge_rows.where("level = levels"), None
    for level in range(most):
        open_ = edge_rows.where((F.col("level") == level) & (F.col("level") < F.col("levels")))
        open_ = open_ if above is None else open_.unionByName(above.where(f"levels > {level}"))
        runs = open_.groupBy("grp", "levels", "leaves", F.floor(F.col("at") / fanout).alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "peak"))).alias("run"))  # fanout rows at most
        children = F.transform("run", lambda x: x["peak"])
        joined = digest(F.concat_ws("", F.transform("run", lambda x: x["peak"]["digest"])))
        merged = materialized(runs.select("grp", F.lit(level + 1).alias("level"), "at", joined.alias("digest"), children.alias("children"), "levels", "leaves"), "merged")
        made = made.unionByName(merged.drop("levels", "leaves"))
        above = merged.select("grp", "level", "at", F.struct("digest", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("altered")).alias("peak"), "levels", "leaves")
        tops = tops.unionByName(above.where("level = levels"))
    return made, tops.select("grp", F.col("peak.digest").alias("digest"), "levels", "leaves", "peak")


def _beside(children: Column, at: Column) -> Column:
    """The digests before and after the child at ``at`` (from 0), each joined."""
    digests = F.transform(children, lambda c: c["digest"])
    return F.struct(F.concat_ws("", F.slice(digests, F.lit(1), at)).alias("before"), F.concat_ws("", F.slice(digests, at + 2, F.size(children))).alias("after"))


def with_paths(nodes: DataFrame, tops: DataFrame, upper: DataFrame | None = None, fanout: int = FANOUT) -> DataFrame:
    """(grp, id, altered, leaf, path) of every leaf; path: from the leaf up, the digests before and after it in its run.

    upper: (id, path) of the groups' roots in a tree of their own (id: the group), which continues the paths.
    """
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    if upper is None:
        heads = tops.withColumn("path", nothing)
    else:
        heads = tops.join(broadcast_if_small(upper.select(F.col("id").alias("of"), "path")), F.col("grp").eqNullSafe(F.col("of")), "left").drop("of").withColumn("path", F.coalesce("path", nothing))
    heads = materialized(heads, "heads")
    out = heads.where("levels = 0").select("grp", F.col("peak.id").alias("id"), F.col("peak.altered").alias("altered"), F.col("digest").alias("leaf"), "path")
    ways = None
    most = heads.agg(F.max("levels")).first()[0] or 0
    for level in range(most, 0, -1):
        here = heads.where(f"levels = {level}").select("grp", F.lit(0).cast("bigint").alias("at"), "path")
        ways = here if ways is None else here.unionByName(ways)
        records = nodes.where(f"level = {level}").select(F.col("grp").alias("_grp"), F.col("at").alias("_at"), "children")
        met = ways.join(records, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("at") == F.col("_at")))
        each = met.select("grp", "at", "path", "children", F.posexplode("children").alias("pos", "child"))
        path = F.concat(F.array(_beside(F.col("children"), F.col("pos"))), F.col("path")).alias("path")
        if level == 1:
            out = out.unionByName(each.select("grp", F.col("child.id").alias("id"), F.col("child.altered").alias("altered"), F.col("child.digest").alias("leaf"), path))
        else:
            ways = materialized(each.select("grp", (F.col("at") * fanout + F.col("pos")).alias("at"), path), "ways")
    return out


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give; a run of one is hashed too."""
    return F.aggregate(path, leaf, lambda d, p: digest(F.concat(p["before"], d, p["after"])))


def proof_digest(path: Column) -> Column:
    """Digest of all digests of a path, level by level, left to right."""
    return digest(F.concat_ws("", F.transform(path, lambda p: F.concat(p["before"], p["after"]))))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), altered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """(id, group, leaf, altered, path, subroot, root) of each row.

    ``columns`` are hashed into the leaf, in their order. A group's leaves ascend by id (null first); rows with the same id by their leaf, so
    equal rows are next to each other and interchangeable. A null group is a group, the first one. An empty table gives an empty one. Other
    columns are not read. ``altered``: what stands in a column's place, where ``when`` holds, for the digest ``altered``.
    """
    tuned(docs.sparkSession)
    docs = need(docs, *dict.fromkeys((id_col, group_col, *columns)))
    leaf = leaf_digest(*[F.col(c) for c in columns])
    other = leaf_digest(*[(altered or {}).get(c, F.col(c)) for c in columns])
    change = F.lit(False) if when is None else when
    hashed = docs.select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).alias("key"), leaf.alias("leaf"), F.when(change, other).alias("altered"))
    hashed = materialized(hashed.withColumn("row", F.monotonically_increasing_id()), "leaves")  # written, so that row stays
    leaves = hashed.select("grp", F.col("key").cast("string").alias("id"), "leaf", F.coalesce("altered", "leaf").alias("altered"), F.struct("key", "leaf", "row").alias("order"))
    nodes, tops = trees(leaves)
    tops = materialized(tops, "tops")
    subroots = tops.select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("id"), F.col("digest").alias("leaf"), F.col("digest").alias("altered"), F.struct("grp").alias("order"))
    root_nodes, root = trees(subroots)
    upper = materialized(with_paths(root_nodes, root).select("id", "path"), "upper")
    rows = with_paths(nodes, tops, upper)
    named = tops.select(F.col("grp").alias("of"), F.col("digest").alias("subroot"))
    out = rows.join(broadcast_if_small(named), F.col("grp").eqNullSafe(F.col("of")))
    top = root.select("digest").first()
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("grp").alias(group_col), "leaf", "altered", "path", "subroot", F.lit(top.digest if top else None).cast("string").alias("root"))


def verified(docs: DataFrame, folds: int = 5) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of ``documents``.

    The text of a row whose crc32(id as text) is divisible by ``folds`` (a null id counts as '') is tampered with before it
    is verified: A-Z become lower case. Nulls stay nulls, so such rows, and texts without A-Z, verify.
    """
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = manifest(docs, altered={"text": lowered}, when=F.pmod(id_crc(F.col("doc_id")), F.lit(folds)) == 0)
    root = folded(F.col("altered"), F.col("path"))
    found = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
