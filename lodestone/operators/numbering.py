"""Numbers by a global order, without a task that sees all rows: a range exchange, counts by partition and prefix sums."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.tables import written

#: Bits that Spark's increasing ids give to the row within its partition.
ROW_BITS = 33


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``df`` with each row's place (from 0) by the columns ``order``, ascending, nulls first.

    Rows that tie get successive numbers in any order. Each task sorts its own range; the driver sees one count for each
    partition. The sorted rows are written, so that numbers stay. An empty table stays empty.
    """
    at, part = "_lodestone_at", "_lodestone_part"
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(ordered.withColumn(at, F.monotonically_increasing_id()), "numbered").withColumn(part, F.shiftrightunsigned(at, ROW_BITS))
    counts = sorted((r[0], r[1]) for r in rows.groupBy(part).count().collect())  # a row for each partition
    before = [0, *accumulate(n for _, n in counts)]
    offsets = [(p, b - (p << ROW_BITS)) for (p, _), b in zip(counts, before, strict=False)]
    shift = df.sparkSession.createDataFrame(offsets, f"{part} bigint, _lodestone_shift bigint")
    return rows.join(F.broadcast(shift), part).withColumn(name, F.col(at) + F.col("_lodestone_shift")).drop(part, at, "_lodestone_shift")


def numbered_within(df: DataFrame, group: list[str], order: list[str], name: str = "number") -> DataFrame:
    """Like ``numbered``, from 0 in each group; null is a group. No group is gathered: its first number is taken off."""
    rows = numbered(df, [*group, *order], "_lodestone_place")
    firsts = rows.groupBy(*[F.col(c).alias(f"_of_{c}") for c in group]).agg(F.min("_lodestone_place").alias("_lodestone_first"))
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    met = rows.join(firsts, same).withColumn(name, F.col("_lodestone_place") - F.col("_lodestone_first"))
    return met.drop("_lodestone_place", "_lodestone_first", *[f"_of_{c}" for c in group])
