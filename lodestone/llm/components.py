"""Connected components of an undirected graph whose edges are rows.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond"):
each round is two hash aggregations and two joins on the node, so no component is ever gathered in one task or
on the driver. Before each round every partition replaces its edges by a star of each of its own components,
which leaves the components as they are and shortens long chains at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop_table, materialized

EDGES = "src bigint, dst bigint"


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's edges; gives an edge from each node to the least node it is joined to."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = above[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    src = [x for x in above if root(x) != x]
    dst = [root(x) for x in src]
    for at in range(0, len(src), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(src[at : at + 50_000], pa.int64()), pa.array(dst[at : at + 50_000], pa.int64())], names=["src", "dst"])


def _stars(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_local_stars, EDGES)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of the node and its neighbours."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("least")).select("src", F.least("src", "least").alias("least"))
    return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src > dst")
    least = down.groupBy("src").agg(F.min("dst").alias("least"))
    tied = down.join(least, "src")
    return tied.select(F.col("dst").alias("src"), F.col("least").alias("dst")).union(least.select("src", F.col("least").alias("dst"))).where("src > dst").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst: bigint); component is its least reachable node.

    Nodes without an edge to another node, and edges with a null, don't appear. Repeated edges and both
    directions count once.
    """
    edges = edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).where("src <> dst")
    now = materialized(_stars(edges).distinct(), "cc")
    for _ in range(max_rounds):
        after = materialized(_small_star(_stars(_large_star(now))), "cc")
        # A star forest that a round leaves as it is has converged: every node points at its component's least node.
        changed = not (after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty())
        drop_table(now)
        now = after
        if not changed:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
