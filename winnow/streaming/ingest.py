"""Ingest as a stream: files as they arrive are stored once, and their rows written once,
numbered without gaps, whatever fails on the way.

The sink writes each batch to a folder of its number, in place of what an attempt before
may have left there, and then adds a commit of that number. A batch that comes again
after its commit is passed over; one that failed before it is written anew. Readers see
committed batches only. Rows are numbered on from what the commits before hold for their
key.

Files come from a folder that the driver lists (`arriving`, `ingest`), or from a log that
names them (`logged`, `ingest_logged`). With a log the driver keeps only the log's own
files, and tasks read what these name, so that it is the way for millions of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from winnow.functions import media_types
from winnow.sources import store
from winnow.sources.shared import dropped


class Sink:
    """Rows of batches below a folder that driver and executors share, numbered for each `key` in `order` from 1."""

    def __init__(self, spark: SparkSession, top: str, key: str, order: list[str]) -> None:
        self.spark, self.top, self.key, self.order = spark, top.rstrip("/"), key, order
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.top).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Numbers of the committed batches."""
        place = self._hadoop(f"{self.top}/commits")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def _read(self, kind: str, batches: list[int]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.top}/{kind}/{n}" for n in batches]) if batches else None

    def rows(self) -> DataFrame | None:
        """The rows of committed batches with `seq`; None before the first."""
        return self._read("rows", self.batches())

    def write(self, batch: DataFrame, number: int) -> None:
        """The first half of a push: the rows, and the last number of each key in the batch."""
        ends = self._read("ends", [n for n in self.batches() if n < number])
        seq = F.row_number().over(Window.partitionBy(self.key).orderBy(*self.order)).cast("long")
        numbered = batch.withColumn("seq", seq)
        if ends is not None:
            before = ends.groupBy(self.key).agg(F.max("last").alias("_last"))
            numbered = numbered.join(before, self.key, "left").withColumn("seq", F.col("seq") + F.coalesce("_last", F.lit(0))).drop("_last")
        numbered.write.mode("overwrite").parquet(f"{self.top}/rows/{number}")
        # of what was written, so that both agree even if the batch can't be computed alike twice
        self.spark.read.parquet(f"{self.top}/rows/{number}").groupBy(self.key).agg(F.max("seq").alias("last")).write.mode("overwrite").parquet(f"{self.top}/ends/{number}")

    def commit(self, number: int) -> None:
        self._fs.create(self._hadoop(f"{self.top}/commits/{number:012d}"), True).close()

    def push(self, batch: DataFrame, number: int) -> None:
        if number not in self.batches():
            self.write(batch, number)
            self.commit(number)


FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Files below a folder as they arrive; the driver lists all of them for each batch."""
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)


def logged(spark: SparkSession, path: str, files_per_trigger: int = 50) -> DataFrame:
    """Paths that a log of arrivals names: a folder of Parquet files (path) that grows by files."""
    return spark.readStream.schema("path string").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _placed(files: DataFrame, trip: Column) -> DataFrame:
    """Files (path) of a supported kind with trip_id, original_filename, id and file_path.

    An id is the digest of the trip and the name: a file that comes again is the same media.
    """
    f = files.withColumns({"trip_id": trip, "original_filename": F.substring_index("path", "/", -1)})
    f = f.where(media_types.supported(F.lit(""), F.col("original_filename"))).withColumn("id", F.md5(F.concat_ws("/", "trip_id", "original_filename")))
    return f.withColumn("file_path", F.concat(F.col("trip_id"), F.lit("/originals/"), F.col("id"), media_types.file_extension(F.col("original_filename"), F.lit(""))))


def media_rows(files: DataFrame) -> DataFrame:
    """Rows of media for files of a supported kind, in the folder of their trip, with content."""
    f = _placed(files, F.element_at(F.split("path", "/"), -2))
    kind = media_types.classified(F.col("content"), F.col("original_filename"))
    return f.select("id", "trip_id", "file_path", kind["kind"].alias("media_type"), kind["mime"].alias("mime_type"), "original_filename", F.col("length").alias("file_size"), F.md5("content").alias("md5"), "content")


def _status() -> Column:
    return F.when(F.col("processing_error").isNull(), "pending").otherwise("failed")


def ingest(files: DataFrame, root: str, sink: Sink, checkpoint: str) -> StreamingQuery:
    """Stores what arrives below `root` and writes its rows: of what could not be stored, with the error."""

    def push(batch: DataFrame, number: int) -> None:
        if number in sink.batches():
            return
        rows = media_rows(batch)
        outcomes = store.save_files(rows.select(F.col("file_path").alias("path"), "content"), root)
        failed = outcomes.where("outcome = 'failed'").select(F.col("path").alias("file_path"), F.col("error").alias("processing_error"))
        rows = rows.drop("content").join(failed, "file_path", "left")
        sink.push(rows.withColumn("processing_status", _status()), number)

    return files.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_logged(log: DataFrame, source: str, root: str, sink: Sink, checkpoint: str) -> StreamingQuery:
    """The same for files below `source` that a log names, trip/name: tasks copy each to its place, reading it once.

    What could not be read or stored has neither size nor MD5.
    """
    trip = F.regexp_extract("path", "(?s)^(.*)/", 1)

    def push(batch: DataFrame, number: int) -> None:
        if number in sink.batches():
            return
        taken = store.take_files(_placed(batch, trip).withColumnRenamed("file_path", "place"), source, root)
        kind = media_types.classified(F.col("head"), F.col("original_filename"))
        rows = _placed(taken, trip).select("id", "trip_id", "file_path", kind["kind"].alias("media_type"), kind["mime"].alias("mime_type"), "original_filename", F.col("size").alias("file_size"), "md5", F.col("error").alias("processing_error"))
        sink.push(rows.withColumn("processing_status", _status()), number)
        dropped(taken)

    return log.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
