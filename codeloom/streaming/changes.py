"""Streams of file changes and events: upkeep of an index, windows, sessions, duplicates."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.extract import extract_chunks
from codeloom.sources.formats import Catalog

CHANGE_DDL = "file_path string, op string, seq bigint, content string"


def last_changes(changes: DataFrame) -> DataFrame:
    """The last change of each file: file_path, op, content; of equal seq a removal counts."""
    last = F.max(F.struct("seq", F.col("op") == "unlink", "op", "content")).alias("last")
    return changes.groupBy("file_path").agg(last).select("file_path", F.col("last.op").alias("op"), F.col("last.content").alias("content"))


def apply_changes(catalog: Catalog, changes: DataFrame) -> int:
    """Applies a batch of changes: files are parsed, their rows replaced, removed files dropped, whole-program tables invalidated."""
    last = last_changes(changes)
    return catalog.replace_files(extract_chunks(last.where("op <> 'unlink'")), last.select("file_path"))


def maintain(spark: SparkSession, folder: str, catalog: Catalog, checkpoint: str, trigger: dict | None = None, per_batch: int = 1000) -> StreamingQuery:
    """A stream over JSON files of changes in ``folder`` that keeps ``catalog`` up to date.

    One micro-batch is one transaction. A batch that ran but whose end wasn't noted runs again;
    replacing the rows of a file twice gives the same table.
    """
    stream = spark.readStream.schema(CHANGE_DDL).option("maxFilesPerTrigger", per_batch).json(folder)

    def batch(changes: DataFrame, number: int) -> None:
        done = catalog.manifest()["meta"].get("batch", -1)
        if number > done and not changes.isEmpty():
            apply_changes(catalog, changes)
            catalog.commit({}, meta={"batch": number})

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def catch_up(files: DataFrame, built_at: str | None) -> DataFrame:
    """Files (file_path, modified_at, ...) that a first scan has to look at: those changed after the index was built; all if it never was."""
    return files if built_at is None else files.where(F.col("modified_at").isNull() | (F.col("modified_at") > F.lit(built_at).cast("timestamp")))


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The table ``events`` of a folder as a stream with an event time."""
    static = spark.read.parquet(f"{folder}/events.parquet")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value per window and type."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events per user and session; a session ends after ``gap`` without any (the debouncing of changes)."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), "n")


def without_duplicates(events: DataFrame, late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_to_table(result: DataFrame, mode: str, checkpoint: str, sink: str) -> DataFrame:
    """Runs a stream over what is there and returns the result, written by batch as Parquet in the shared folder."""
    spark = result.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{sink}/{number}")

    query = result.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = result.schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    numbers = sorted(int(n) for n in names if n.isdigit())
    if not numbers:
        return spark.createDataFrame([], schema)
    wanted = [numbers[-1]] if mode == "complete" else numbers
    return spark.read.schema(schema).parquet(*(f"{sink}/{n}" for n in wanted))


def freshness(catalog: Catalog, head: str | None, dirty: int) -> str:
    """Whether the index is of the commit at hand."""
    indexed = catalog.manifest()["meta"].get("commit")
    if not indexed or not head:
        return "unknown"
    return "stale" if indexed != head else "syncing" if dirty else "fresh"


def single_writer(path: str) -> Callable[[], None]:
    """Takes the writer's lock, taking over that of a dead process; returns how to give it back."""
    for _ in range(2):
        try:
            fd = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            os.write(fd, str(os.getpid()).encode())
            os.close(fd)
            return lambda: os.unlink(path)
        except FileExistsError:
            try:
                with open(path) as f:
                    os.kill(int(f.read() or "0"), 0)
            except (ValueError, ProcessLookupError):
                os.unlink(path)
                continue
            except FileNotFoundError:
                continue
            raise RuntimeError(f"another writer holds {path}") from None
    raise RuntimeError(f"can't take {path}")
