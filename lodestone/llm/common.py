"""What the operators share: written intermediate tables, input checks and byte-level word splitting."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts can be long, so the default of 10,000 rows could take gigabytes.
ARROW_ROWS = "500"

#: Where tables are written when the session names no shared folder (tests on one machine).
FALLBACK_DIR = "/tmp/checkpoints/lodestone"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of this session; everything else stays as the cluster has it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def give_back() -> None:
    """Returns to the system what this Python worker has freed. Workers take turns, and an idle one would keep it beside those that run."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # where the C library has it
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``. Only on one machine may it be unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or FALLBACK_DIR


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lodestone-{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage: a lost executor costs the tasks it ran and none of what is written. Column statistics and
    pruning hold for the readers, which a checkpoint of rows would not give.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialized`` wrote, once nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lodestone-" in path:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_if_small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """A hint to broadcast ``df``, given only after a count has shown that it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns. Extra columns, whatever their names, never reach an operator's plan."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df.select(*columns)


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z; no other character changes."""
    return F.translate(column, UPPER, LOWER)


def spread(column: Column) -> Column:
    """A key for rows that are to match nothing: as many values as ids, so that no partition gathers them."""
    return F.xxhash64(F.lit("lodestone-no-match"), column)


def id_crc(column: Column) -> Column:
    """crc32 of an id's decimal text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))
