"""Job progress as streams: the tail of an event log, latest states, windowed counts, and exact duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 50) -> DataFrame:
    """Events from Parquet files as they come; the checkpoint of the query is the cursor."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by window of event time and type; rows later than the watermark are left out."""
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """Each combination of keys once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def latest_states(events: DataFrame) -> DataFrame:
    """The last type of event of each user, for output mode `complete` or `update`."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("events"))


def tail(events: DataFrame, checkpoint: str, push: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Pushes new events batch by batch; what was pushed before the last checkpoint isn't pushed again."""
    return events.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def after(events: DataFrame, seq: int) -> DataFrame:
    """Events of a log behind a cursor, in order."""
    return events.where(F.col("seq") > seq).orderBy("job_id", "seq")
