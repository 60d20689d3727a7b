"""Tables that are written between passes, and folders of versions of which one is current."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where tables are written when the session names no shared folder (tests on one machine).
FALLBACK_DIR = "/tmp/checkpoints/lodestone"


#: Rows of one Arrow batch. Pages can be long, and a batch is held several times over in a task; the default is 10,000 rows.
ARROW_ROWS = "500"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the Arrow batches of its session bounded."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``. Only on one machine may it be unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or FALLBACK_DIR


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back; a lost executor costs the tasks it ran and none of what is written."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/lodestone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """The file system that Spark resolves a path with."""

    def __init__(self, spark: SparkSession, path: str):
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._base, self._fs = path.rstrip("/"), self._hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str = ""):
        return self._hadoop.Path(f"{self._base}/{name}" if name else self._base)

    def there(self, name: str = "") -> bool:
        return self._fs.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self.path(name))) if self.there(name) else []

    def delete(self, name: str = "") -> bool:
        return self._fs.delete(self.path(name), True)

    def make(self, name: str) -> bool:
        """Creates an empty file; false if it was there."""
        return self._fs.createNewFile(self.path(name))


class Versions:
    """Versions of a set of tables, each in a folder of its own. A version is current once its mark is there, which is made last and by one
    step of the file system; readers keep the folder that they have opened, and a version left unfinished by a crash is written again."""

    MARKS, FOLDER = "_current", "version"

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.files = path.rstrip("/"), Files(spark, path)

    def marked(self) -> list[int]:
        return sorted(int(n) for n in self.files.names(self.MARKS) if n.isdigit())

    def current(self) -> int | None:
        """The newest finished version; none if there is none."""
        return max(self.marked(), default=None)

    def folder(self, version: int) -> str:
        return f"{self.path}/{self.FOLDER}={version}"

    def next(self) -> int:
        """The number of the version to write; what a crash has left of it is deleted."""
        version = (self.current() or 0) + 1
        self.files.delete(f"{self.FOLDER}={version}")
        return version

    def publish(self, version: int) -> None:
        """Makes a whole version current; an error if another writer was first."""
        if not self.files.make(f"{self.MARKS}/{version}"):
            raise RuntimeError(f"version {version} of {self.path} was published by another writer")

    def drop_old(self, keep: int = 2) -> list[int]:
        """Deletes all but the newest ``keep`` versions, marks last, and gives their numbers. ``keep`` covers what readers have open."""
        old = self.marked()[:-keep] if keep else self.marked()
        for version in old:
            self.files.delete(f"{self.FOLDER}={version}")
            self.files.delete(f"{self.MARKS}/{version}")
        return old
