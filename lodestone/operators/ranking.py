"""The best rows of each group, for any depth, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task holds beyond what it must keep before it drops the others.
SLACK = 50_000


def _kept(table: pa.Table, keys: list[str], order: list[str], depth: int) -> pa.Table:
    """The first ``depth`` rows of each group by ``order``."""
    table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in [*keys, *order]]))
    if not table.num_rows:
        return table
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in keys:
        codes = table[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    at = np.arange(table.num_rows)
    return table.filter(pa.array(at - np.maximum.accumulate(np.where(new, at, 0)) < depth))


def _first_rows(keys: list[str], order: list[str], depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, least = None, 0, SLACK
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            fresh += batch.num_rows
            if fresh >= least:
                held, fresh = _kept(held, keys, order, depth), 0
                least = max(SLACK, held.num_rows)
        if held is not None:
            yield from _kept(held, keys, order, depth).combine_chunks().to_batches(10_000)

    return run


def group_limit(df: DataFrame) -> int:
    """Up to this depth Spark itself limits each group before the shuffle of a window."""
    return int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))


def best_rows(df: DataFrame, keys: list[str], order: list[str], depth: int, name: str = "rank") -> DataFrame:
    """The first ``depth`` rows of each group by the columns ``order``, all ascending, with their rank.

    Beyond the depth that Spark limits by itself every task keeps the first ``depth`` rows of its groups, so what is shuffled and ranked
    grows with depth and tasks and not with the groups. Nulls of ``keys`` are a group; ``order`` has none. Without
    rows, or with depth 0, nothing is left.
    """
    if depth > group_limit(df):
        df = df.mapInArrow(_first_rows(keys, order, depth), df.schema)
    best = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(best)).where(F.col(name) <= depth)
