"""Vectors: normalisation, exact nearest neighbours and cells for approximate search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lodestone.tables import written

#: Query vectors that go to every task at once; distances that a task has at once; numbers up to which squared differences are added up one by one.
QUERY_BLOCK, CELLS_AT_ONCE, EXACT_CELLS = 2000, 1 << 21, 1 << 22
#: Vectors that centres are found from, about.
FIT = 20_000
#: What distances from centres are widened by, for rounding.
SLACK = 1e-7
#: How far apart two distances that are equal to nine digits can be.
ROUNDED = 2e-9


def normalized(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is. In double precision."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(wide, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def check_dimensions(vectors: DataFrame, vector_col: str = "vector") -> int:
    """The one size that all vectors have; an error if there are several."""
    sizes = [r[0] for r in vectors.select(F.size(vector_col)).distinct().limit(3).collect()]
    if len(sizes) > 1:
        raise ValueError(f"vectors of different sizes: {sorted(sizes)}")
    return sizes[0] if sizes else 0


@dataclass
class Block:
    """Queries that go to the tasks together: their keys, depths and vectors; with cells, how far each is from each centre, which cells it
    looks into, and how far from their centre vectors of a cell may lie for it."""

    keys: list[tuple]
    depths: np.ndarray
    vectors: np.ndarray
    away: np.ndarray | None = None
    looks: np.ndarray | None = None
    reach: np.ndarray | None = None

    def groups(self) -> dict[str, np.ndarray]:
        """The queries of each scope."""
        scopes = np.array([scope for _, scope in self.keys], object)
        return {scope: np.flatnonzero(scopes == scope) for scope in dict.fromkeys(scopes.tolist())}


def points_of(vectors: pa.Array) -> np.ndarray:
    """A row for each vector; all have one size and no nulls, as a matrix needs."""
    sizes = set(vectors.value_lengths().unique().to_pylist())
    values = vectors.flatten()
    if len(sizes) > 1 or None in sizes or values.null_count:
        raise ValueError(f"vectors of different sizes, or with nulls: {sorted(s for s in sizes if s is not None)}")
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1) if len(vectors) else np.empty((0, 0))


class NearestRows:
    """The nearest rows of each query so far; what can't be among them is dropped from time to time."""

    def __init__(self, depths: np.ndarray):
        self.depths, self.bar = depths, np.full(len(depths), np.inf)
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, of: np.ndarray, distance: np.ndarray, ords: np.ndarray, ids: np.ndarray) -> None:
        """of: queries; distance: a row for each of them, a column for each vector. Most are beyond the bar, which one comparison tells; it
        sinks when rows are dropped, so that distances are ordered for the few that are left only."""
        depth = int(self.depths[of].max())
        if 0 < depth <= distance.shape[1] and len(fresh := np.flatnonzero(np.isinf(self.bar[of]))):
            self.bar[of[fresh]] = np.partition(distance[fresh], depth - 1, axis=1)[:, depth - 1]
        row, column = np.nonzero(distance <= self.bar[of][:, None] + ROUNDED)
        kept = distance[row, column]
        self.parts.append((of[row], np.round(kept, 9), ords[column], ids[column], kept))
        self.size += len(row)
        if self.size > 4 * int(self.depths.sum()) + 100_000:
            self.parts = [self.first()]
            held, shown = self.parts[0][:2]
            self.size = len(held)
            ends = np.searchsorted(held, np.arange(len(self.depths)), "right")
            full = np.flatnonzero((np.bincount(held, minlength=len(self.depths)) >= self.depths) & (self.depths > 0))
            self.bar[full] = np.minimum(self.bar[full], shown[ends[full] - 1])

    def first(self) -> tuple:
        """The first rows of each query by distance, then place."""
        if not self.parts:
            return tuple(np.empty(0, t) for t in (np.int64, float, np.int64, object, float))
        of, shown, ords, ids, distance = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ords, shown, of))
        of = of[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        keep = order[place < self.depths[of]]
        return of[place < self.depths[of]], shown[keep], ords[keep], ids[keep], distance[keep]


def _nearest(shared, metric: str):
    """Per partition, each query's ``depth`` nearest vectors: a bounded number of rows, whatever the partition's size. One matrix product for
    the queries of a scope and the vectors of a batch, or of a cell in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        best, groups = NearestRows(block.depths), block.groups()
        lengths_sq = (block.vectors**2).sum(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            ords, ids = batch.column(0).to_numpy(zero_copy_only=False), np.array(batch.column(1).to_pylist(), object)
            domains = np.array([d or "" for d in batch.column(2).to_pylist()], object)
            points = points_of(batch.column(3))
            if metric == "cosine":
                lengths = np.sqrt((points**2).sum(1))
                points = points / np.where(lengths == 0, 1, lengths)[:, None]
            cells = None if block.looks is None else batch.column(4).to_numpy(zero_copy_only=False)
            for cell in [None] if cells is None else np.unique(cells).tolist():
                there = np.arange(len(points)) if cell is None else np.flatnonzero(cells == cell)
                for scope, of in groups.items():
                    if cell is not None:
                        of = of[block.looks[of, cell]]
                    inside = there if scope == "*" else there[domains[there] == scope]
                    step = max(1, CELLS_AT_ONCE // max(1, len(of)))
                    for at in range(0, len(inside) if len(of) else 0, step):
                        part = inside[at : at + step]
                        if metric == "cosine":
                            distance = 1 - block.vectors[of] @ points[part].T
                        elif len(of) * len(part) * points.shape[1] <= EXACT_CELLS:
                            distance = ((block.vectors[of][:, None, :] - points[part][None, :, :]) ** 2).sum(2)
                        else:
                            distance = np.maximum(0, lengths_sq[of][:, None] + (points[part] ** 2).sum(1)[None, :] - 2 * block.vectors[of] @ points[part].T)
                        best.add(of, distance, ords[part], ids[part])
        of, _, ords, ids, distance = best.first()
        keys = [block.keys[i] for i in of.tolist()]
        columns = [[k[0] for k in keys], [k[1] for k in keys], ords.tolist(), ids.tolist(), distance.tolist()]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["query_id", "scope", "chunk_ord", "id", "distance"])

    return run


def query_blocks(queries: DataFrame, metric: str) -> Iterator[Block]:
    """The queries (query_id, scope, depth, vector), ``QUERY_BLOCK`` at a time; at length 1 for cosine."""
    rows = queries.select("query_id", "scope", "depth", "vector").toLocalIterator()
    while part := list(islice(rows, QUERY_BLOCK)):
        vectors = np.array([r.vector for r in part], np.float64)
        if metric == "cosine":
            lengths = np.sqrt((vectors**2).sum(1))
            vectors = vectors / np.where(lengths == 0, 1, lengths)[:, None]
        yield Block([(r.query_id, r.scope) for r in part], np.array([r.depth for r in part], np.int64), vectors)


FOUND = "query_id bigint, scope string, chunk_ord bigint, id string, distance double"


def _scanned(vectors: DataFrame, block: Block, metric: str) -> DataFrame:
    """What the tasks keep for one block. Vectors of other domains, and of cells or distances from a centre that no query wants, are filtered
    out by the scan: cells are folders of a stored table."""
    scopes = {scope for _, scope in block.keys}
    rows = vectors if "*" in scopes else vectors.where(F.col("domain").isin(sorted(scopes)))
    columns = [F.col("chunk_ord").cast("bigint"), F.col("id").cast("string"), "domain", "vector"]
    if block.looks is not None:
        cells = np.flatnonzero(block.looks.any(0)).tolist()
        rows = rows.where(F.col("cell").isin(cells))
        if block.reach is not None and "off" in vectors.columns and cells:
            low = np.where(block.looks, block.away - block.reach[:, None], np.inf).min(0)
            high = np.where(block.looks, block.away + block.reach[:, None], -np.inf).max(0)
            low, high = low - SLACK, high + SLACK
            rows = rows.where(F.col("off").between(float(max(0.0, low[cells].min())), float(min(4.0, high[cells].max()))))
            of_cell = lambda x: F.element_at(F.create_map(*[F.lit(v) for c in cells for v in (c, float(np.clip(x[c], -4, 4)))]), F.col("cell"))
            rows = rows.where((F.col("off") >= of_cell(low)) & (F.col("off") <= of_cell(high)))
        columns.append("cell")
    shared = vectors.sparkSession.sparkContext.broadcast(block)
    return rows.select(*columns).mapInArrow(_nearest(shared, metric), FOUND)


def _placed(found: DataFrame, queries: DataFrame) -> DataFrame:
    depths = queries.select("query_id", "scope", F.col("depth").alias("_depth"))
    order = Window.partitionBy("query_id", "scope").orderBy(F.round("distance", 9), "chunk_ord")
    return found.withColumn("rank", F.row_number().over(order)).join(depths, ["query_id", "scope"]).where(F.col("rank") <= F.col("_depth")).drop("_depth")


def nearest(vectors: DataFrame, queries: DataFrame, metric: str = "l2") -> DataFrame:
    """(query_id, scope, chunk_ord, id, distance, rank): exact neighbours by squared L2 or cosine distance, ties by chunk_ord.

    vectors: chunk_ord, id, domain, vector. queries: query_id, scope, depth, vector; a stated set, sent to the tasks in blocks
    of ``QUERY_BLOCK``. Each task keeps only its nearest, so one small shuffle by query ends the search.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError("metric is l2 or cosine")
    parts = [_scanned(vectors, block, metric) for block in query_blocks(queries, metric)]
    return _placed(reduce(DataFrame.union, parts) if parts else vectors.sparkSession.createDataFrame([], FOUND), queries)


def cell_count(n: int) -> int:
    """How many cells ``n`` vectors are split into: the root of n between 8 and 256, fewer for tiny sets."""
    return max(1, n // 4) if n <= 32 else min(256, max(8, int(n**0.5)))


def with_cells(vectors: DataFrame, n_cells: int | None = None, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """The vectors with the ``cell`` of each (that of the nearest centre) and ``off``, how far it is, at length 1, from the centre; and the centres.

    Centres are found by k-means over about ``FIT`` vectors, chosen by a hash of chunk_ord, where there are more. Every vector gets a cell, and
    searches by cells stay exact wherever the centres are.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    some = vectors if n <= FIT else vectors.where(F.pmod(F.xxhash64("chunk_ord"), F.lit(n)) < FIT)
    rows = some.select(array_to_vector(normalized(F.col("vector"))).alias("features"))
    centres = np.array(KMeans(k=n_cells or cell_count(n), seed=seed, maxIter=10).fit(rows).clusterCenters())
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    at = vectors.columns.index("vector")

    def with_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = shared.value
        lengths_sq = (middle**2).sum(1)
        for batch in batches:
            cells, off = np.empty(0, np.int32), np.empty(0)
            if batch.num_rows:
                points = points_of(batch.column(at))
                lengths = np.sqrt((points**2).sum(1))
                points = points / np.where(lengths == 0, 1, lengths)[:, None]
                cells = (lengths_sq[None, :] - 2 * points @ middle.T).argmin(1).astype(np.int32)
                off = np.sqrt(((points - middle[cells]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(off)], names=[*batch.schema.names, "cell", "off"])

    return vectors.mapInArrow(with_distances, StructType([*vectors.schema.fields, StructField("cell", IntegerType()), StructField("off", DoubleType())])), centres


def radii(cells: DataFrame, n_cells: int) -> np.ndarray:
    """Of each cell, the largest distance of one of its vectors from its centre; -1 for an empty cell."""
    out = np.full(n_cells, -1.0)
    for r in cells.groupBy("cell").agg(F.max("off").alias("far")).collect():
        out[r.cell] = r.far
    return out


def write_cells(vectors: DataFrame, path: str) -> None:
    """Stores vectors by cells: a folder for each, its rows by their distance from the centre; and the centres with their radii."""
    spark = vectors.sparkSession
    dealt, centres = with_cells(vectors)
    dealt.repartition("cell", F.pmod("chunk_ord", F.lit(4))).sortWithinPartitions("cell", "off").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    radius = radii(spark.read.parquet(f"{path}/cells"), len(centres))
    rows = [(i, c.tolist(), float(r)) for i, (c, r) in enumerate(zip(centres, radius, strict=True))]
    spark.createDataFrame(rows, "cell int, centre array<double>, radius double").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def read_cells(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(vectors, centres, radii) that ``write_cells`` has stored."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # a row for each cell
    return spark.read.parquet(f"{path}/cells"), np.array([r.centre for r in rows]), np.array([r.radius for r in rows])


def probed(cells: DataFrame, centres: np.ndarray, queries: DataFrame, n_probe: int = 8, metric: str = "cosine", radius: np.ndarray | None = None) -> DataFrame:
    """Like ``nearest``, looking only into the cells that can hold one of a query's neighbours.

    The ``n_probe`` cells whose centres are nearest to each query come first and give each query a distance that its neighbours don't exceed.
    At length 1 the vectors of a cell lie within its radius of its centre, so a cell can be left out if that keeps all of
    them farther away; of the others those vectors are looked at whose own distance from the centre allows it. No neighbour is
    lost, whatever the number of cells, and no cell is read twice for a query. Only cosine allows that: other metrics look
    into every cell. cells: with ``cell`` and ``off``; ``radius``: of each cell, found by a scan if it isn't given.
    """
    if metric != "cosine":
        return nearest(cells, queries, metric)
    if radius is None:
        radius = radii(cells, len(centres))
    parts = []
    for block in query_blocks(queries, metric):
        away = np.sqrt(np.maximum(0, ((block.vectors[:, None, :] - centres[None, :, :]) ** 2).sum(2))) if block.vectors.size * len(centres) <= EXACT_CELLS else np.sqrt(np.maximum(0, 1 + (centres**2).sum(1)[None, :] - 2 * block.vectors @ centres.T))
        first = np.zeros(away.shape, bool)
        np.put_along_axis(first, np.argsort(away, axis=1)[:, :n_probe], True, axis=1)
        first &= radius[None, :] >= 0
        begun = written(_scanned(cells, replace(block, away=away, looks=first), metric), "probed")
        wanted = cells.sparkSession.createDataFrame([(*k, int(d)) for k, d in zip(block.keys, block.depths, strict=True)], "query_id bigint, scope string, depth int")
        last = {(r.query_id, r.scope): r.distance for r in _placed(begun, wanted).join(wanted, ["query_id", "scope"]).where("rank = depth").collect()}
        # At length 1 a cosine distance d is an L2 distance of sqrt(2 d); a little more for rounding and ties.
        reach = np.array([np.sqrt(2 * max(0.0, last[k]) + 1e-8) + 1e-8 if k in last else np.inf for k in block.keys])
        rest = ~first & (radius >= 0)[None, :] & (away - radius[None, :] <= reach[:, None])
        parts.append(begun)
        if rest.any():
            parts.append(_scanned(cells, replace(block, away=away, looks=rest, reach=reach), metric))
    return _placed(reduce(DataFrame.union, parts) if parts else cells.sparkSession.createDataFrame([], FOUND), queries)
