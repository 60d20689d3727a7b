"""Incremental scans of source trees: only new or changed files are read again, and what is known is kept.

A ``ScanStore`` keeps what scans have found, keyed by (label, path). A scan appends the state of the files that it has seen change, with its version,
and the examples of these; the newest state of a file says which of its examples count and whether it is gone. Nothing is rewritten
by a scan, so it costs what has changed; ``compacted`` folds all scans into one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lodestone.functions.text import short_hash
from lodestone.operators.examples import changed_files, snippets
from lodestone.tables import Versions, written


def merged_scan(files: DataFrame, seen: DataFrame, examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(examples, seen) after a scan: those of changed files replace what these files gave before; the rest stays.

    files: label, path, content. seen: path, hash. examples as ``snippets`` gives them.
    """
    changed = changed_files(files, seen)
    paths = changed.select("path")
    kept = examples.join(paths.withColumnRenamed("path", "module_path"), "module_path", "left_anti").select(*examples.columns)
    found = snippets(changed.select("label", "path", "content")).select(*examples.columns)
    return kept.unionByName(found), seen.join(paths, "path", "left_anti").select("path", "hash").unionByName(changed.select("path", "hash"))


def watch(spark: SparkSession, folder: str, label: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """A file stream over a tree of sources: each new file's examples are appended to ``out`` (Parquet, partitioned by hash
    prefix), exactly once by the stream's checkpoint. Stops when all files there are read, if ``once``."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{bsl,os,BSL,OS}").load(folder)
    rows = files.select(F.lit(label).alias("label"), relative_path(F.col("_metadata.file_path"), folder).alias("path"), F.col("value").alias("content"))
    found = snippets(rows).withColumn("bucket", F.substring(short_hash(F.col("id")), 1, 2))
    writer = found.writeStream.format("parquet").partitionBy("bucket").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start(out)


STATE = "label string, path string, hash string, gone boolean"
EXAMPLES = "id string, config_label string, module_path string, code string, query_text string, start_line int"


class ScanStore:
    """Scans of source trees in a folder: a version for each scan, with its ``state`` and ``examples``; current once it is published.

    A scan that a crash cuts off leaves no trace: its version isn't published, and the next scan writes over it. A batch of a stream that is
    given again finds its mark and is skipped.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)

    def _read(self, name: str, schema: str) -> DataFrame:
        """All published rows with their ``version``, which is the folder's."""
        marked = self.versions.marked()
        there = [v for v in marked if self.versions.files.there(f"{Versions.FOLDER}={v}/{name}")]
        if not there:
            return self.spark.createDataFrame([], f"{schema}, version int")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.versions.folder(v)}/{name}" for v in there])
        return rows.withColumn("version", F.regexp_extract(F.col("_metadata.file_path"), f"/{Versions.FOLDER}=(\\d+)/{name}/", 1).cast("int"))

    def state(self) -> DataFrame:
        """(label, path, hash, version) of the files that are there: the newest state of each, unless it is gone."""
        newest = self._read("state", STATE).groupBy("label", "path").agg(F.max_by(F.struct("hash", "gone", "version"), "version").alias("s"))
        return newest.where("not s.gone").select("label", "path", "s.hash", "s.version")

    def examples(self) -> DataFrame:
        """The examples of the files as they are now."""
        found = self._read("examples", EXAMPLES)
        now = self.state().select(F.col("label").alias("config_label"), F.col("path").alias("module_path"), "version")
        return found.join(now, ["config_label", "module_path", "version"], "left_semi").drop("version")

    def _append(self, state: DataFrame, contents: DataFrame) -> int:
        version = self.versions.next()
        folder = self.versions.folder(version)
        state.write.mode("overwrite").parquet(f"{folder}/state")
        snippets(contents).write.mode("overwrite").parquet(f"{folder}/examples")
        self.versions.publish(version)
        return version

    def scan(self, files: DataFrame, labels: list[str] | None = None) -> dict[str, int]:
        """Takes in a whole listing of trees (label, path, content): files that are new or changed since the last scan are read, and files of
        the listed labels that aren't there any more are gone. ``labels``: those that are listed, where one may have no file left.

        Gives how many files are new, changed, gone and unchanged. A null content is an empty file; of repeated paths the content with the
        smallest hash counts. A scan without a change writes nothing.
        """
        listed = files.select("label", "path", F.coalesce("content", F.lit("")).alias("content")).withColumn("hash", short_hash(F.col("content")))
        known = self.state().select(F.col("label").alias("_label"), F.col("path").alias("_path"), F.col("hash").alias("_hash"))
        now = listed.groupBy("label", "path").agg(F.min("hash").alias("hash"))
        both = now.join(known, (F.col("label") == F.col("_label")) & (F.col("path") == F.col("_path")), "full_outer")
        what = F.when(F.col("_path").isNull(), "new").when(F.col("path").isNull(), "gone").when(F.col("hash") != F.col("_hash"), "changed").otherwise("unchanged")
        theirs = now.select("label") if labels is None else now.select("label").union(self.spark.createDataFrame([(x,) for x in labels], "label string"))
        mine = theirs.distinct().withColumnRenamed("label", "_listed")
        both = both.withColumn("what", what).join(F.broadcast(mine), F.coalesce("label", "_label") == F.col("_listed"), "left_semi")  # a row for each tree
        both = written(both.select(F.coalesce("label", "_label").alias("label"), F.coalesce("path", "_path").alias("path"), F.coalesce("hash", "_hash").alias("hash"), "what"), "scan")
        counts = {"new": 0, "changed": 0, "gone": 0, "unchanged": 0} | {r["what"]: r["count"] for r in both.groupBy("what").count().collect()}
        if counts["new"] + counts["changed"] + counts["gone"]:
            state = both.where("what <> 'unchanged'").select("label", "path", "hash", (F.col("what") == "gone").alias("gone"))
            fresh = state.where("not gone").select("label", "path", "hash")
            self._append(state, listed.join(fresh, ["label", "path", "hash"], "left_semi").dropDuplicates(["label", "path"]).select("label", "path", "content"))
        return counts

    def apply(self, changes: DataFrame) -> int:
        """Takes in changes of single files (label, path, content, at): a null content means that the file is gone. Of several changes of a file
        the last by ``at`` counts. Gives the version; the current one if there are no changes."""
        last = changes.groupBy("label", "path").agg(F.max_by("content", F.struct("at", "content")).alias("content"))
        last = written(last.select("label", "path", "content", short_hash(F.coalesce("content", F.lit(""))).alias("hash"), F.col("content").isNull().alias("gone")), "changes")
        if last.isEmpty():
            return self.versions.current() or 0
        return self._append(last.select("label", "path", "hash", "gone"), last.where("not gone").select("label", "path", "content"))

    def follow(self, changes: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """A stream of changes, as for ``apply``; every batch is a version. A batch that the stream gives again after a crash is known by its
        mark and left out if it was taken in."""
        files, store = self.versions.files, self

        def take(rows: DataFrame, batch: int) -> None:
            if str(batch) not in files.names("_batches"):
                store.apply(rows)
                files.make(f"_batches/{batch}")

        writer = changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()

    def compacted(self) -> int:
        """Folds all scans into one version; older ones are deleted."""
        state, found = self.state().drop("version").withColumn("gone", F.lit(False)), self.examples()
        version = self.versions.next()
        state.write.mode("overwrite").parquet(f"{self.versions.folder(version)}/state")
        found.write.mode("overwrite").parquet(f"{self.versions.folder(version)}/examples")
        self.versions.publish(version)
        self.versions.drop_old(keep=1)
        return version


def change_stream(spark: SparkSession, folder: str, label: str) -> DataFrame:
    """New files under a folder as changes, for ``ScanStore.follow``; paths are relative to the folder, whatever its name holds."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{bsl,os,BSL,OS}").load(folder)
    return files.select(F.lit(label).alias("label"), relative_path(F.col("_metadata.file_path"), folder).alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("at"))


def listing(spark: SparkSession, folder: str, label: str) -> DataFrame:
    """All source files under a folder as (label, path, content), for ``ScanStore.scan``."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{bsl,os,BSL,OS}").load(folder)
    return files.select(F.lit(label).alias("label"), relative_path(F.col("_metadata.file_path"), folder).alias("path"), F.col("value").alias("content"))


def relative_path(path: Column, folder: str) -> Column:
    """What follows the last part of ``folder`` in a file's path."""
    last = folder.rstrip("/").rsplit("/", 1)[-1]
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^.*?/" + re.escape(last) + "/", "")
