"""The driver's star-schema tables in the roles of the media library's tables.

orders are trips, lineitem rows are media, customers are users; documents are
media with content, embeddings their vectors, and events the log of jobs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnow.functions import hashing
from winnow.sources.packages import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as id",
        "c_name as username",
        "'x' as password_hash",
        "case c_mktsegment when 'MACHINERY' then 'admin' else 'regular' end as role",
        "case c_mktsegment when 'BUILDING' then 'pending' when 'HOUSEHOLD' then 'disabled' else 'active' end as status",
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id",
        "o_custkey as user_id",
        "concat('Trip ', o_orderkey) as title",
        "case when o_orderkey % 10 = 0 then null else repeat(concat(o_orderpriority, ' '), cast(1 + o_orderkey % 15 as int)) end as description",
        "case o_orderstatus when 'F' then 'public' when 'P' then 'unlisted' else 'private' end as visibility",
        "cast(o_orderdate as timestamp) as created_at",
    )


MEDIA_ID = (
    "md5(concat_ws('~', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(round(l_extendedprice * 100) as bigint), cast(l_quantity as bigint), "
    "cast(round(l_discount * 100) as bigint), cast(round(l_tax * 100) as bigint), l_returnflag, l_linestatus, cast(l_shipdate as date)))"
)


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").selectExpr(
        f"{MEDIA_ID} as id",
        "l_orderkey as trip_id",
        "case l_linestatus when 'O' then 'image' else 'video' end as media_type",
        "case l_returnflag when 'R' then 'trashed' else 'active' end as status",
        "case when l_discount < 0.02 then 'private' else 'public' end as visibility",
        "case l_linenumber % 6 when 0 then null when 1 then 'uploading' when 2 then 'cancelled' when 3 then '' else 'ready' end as processing_status",
        "case l_suppkey % 6 when 0 then 'people' when 1 then 'animal' when 2 then 'landscape' when 3 then 'other' when 4 then '' else null end as category",
        "cast(l_extendedprice as bigint) as file_size",
        "cast(l_quantity as int) * 100 as width",
        "cast(l_partkey % 40 as int) * 100 + 100 as height",
        "case when cast(round(l_tax * 100) as int) = 0 then null else round(l_tax * 10, 4) end as quality_score",
        "case when l_linenumber % 4 = 0 then concat('g', l_orderkey) end as duplicate_group_id",
        "concat('IMG_', l_partkey, case l_partkey % 7 when 0 then '' when 1 then '.' when 2 then '.JPG' when 3 then '.mp4' when 4 then '.tar.gz' when 5 then '.heic' else '.png' end) as original_filename",
        "case l_suppkey % 5 when 0 then 'image/jpeg' when 1 then 'video/mp4' when 2 then 'application/pdf' when 3 then 'image/png' else '' end as mime_type",
        "case when l_partkey % 9 = 0 then null else cast(l_partkey % 256 as double) end as avg_brightness",
        "case l_suppkey % 4 when 0 then 'clear' when 1 then 'suspect' when 2 then 'blurry' end as blur_status",
        "cast(l_shipdate as timestamp) as created_at",
    )
    return m.selectExpr(
        "*",
        "concat(trip_id, '/originals/', id) as file_path",
        "case when width % 300 = 0 then concat('uploads/', trip_id, '/thumbs/', id) end as thumbnail_path",
        "case when width % 500 = 0 then concat(trip_id, '/optimized/', id) end as optimized_path",
        "case when width % 700 = 0 then concat(trip_id, '/compiled/', id) when width % 200 = 0 then '' end as compiled_path",
        "case when width % 1100 = 0 then concat(trip_id, '/preview/', id) end as preview_proxy_path",
    )


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate groups: one in seven has no default image."""
    m = media(spark, sf_dir).where("duplicate_group_id is not null")
    g = m.groupBy("trip_id", F.col("duplicate_group_id").alias("id")).agg(F.min("id").alias("first"), F.count("*").alias("image_count"))
    return g.selectExpr("id", "trip_id", "case when trip_id % 7 = 0 then null else first end as default_image_id", "image_count")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of documents; a document can have one twice."""
    d = table(spark, sf_dir, "documents")
    return d.selectExpr("doc_id as media_id", "explode(array(source, upper(lang), concat('Lang ', lang), 'image', case when doc_id % 3 = 0 then 'Image' else 'video' end)) as raw").selectExpr("media_id", r"regexp_replace(lower(raw), '(?U)\\s+', '') as tag_name")


#: Images of a trip whose numbers lie in one stretch of so many are shots of one scene.
SCENE = 60


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of ten trips with a vector each, in order of seq.

    Odd ones are mixed with the first of their trip and scene, by shares of 60 to 90
    %, so that there are pairs of all degrees of likeness, as there are among shots.
    """
    e = table(spark, sf_dir, "embeddings").selectExpr("label as trip_id", "vec_id as seq", "transform(embedding, x -> cast(x as double)) as v", f"vec_id div {SCENE} as scene")
    first = e.groupBy("trip_id", "scene").agg(F.min_by("v", "seq").alias("w"))
    share = "case when seq % 2 = 0 then 0.0D else cast(60 + seq % 7 * 5 as double) / 100 end"
    return e.join(first, ["trip_id", "scene"]).selectExpr("trip_id", "seq", "v", "w", f"{share} as c").selectExpr("trip_id", "seq", "zip_with(v, w, (x, y) -> x * (1 - c) + y * c) as v")


def hashed(rows: DataFrame) -> DataFrame:
    """Images with hashes: those of a trip and scene have one of its own, with 0 to 8 (phash) and 0 to 5 (dhash) bits flipped."""
    base = lambda kind: hashing.parsed(F.substring(F.md5(F.concat(F.lit(kind), F.col("trip_id"), F.lit("~"), F.expr(f"seq div {SCENE}"))), 1, 16))
    flipped = lambda kind, n: base(kind).bitwiseXOR(F.expr(f"shiftleft(1L, cast({n} as int)) - 1"))
    return rows.withColumns({"phash": flipped("p", "seq * 7 % 9"), "dhash": flipped("d", "seq * 5 % 6")})


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of ten trips with vectors, hashes and the columns that best-of-group selection reads."""
    return hashed(vectors(spark, sf_dir)).selectExpr(
        "*",
        "case when seq % 11 = 0 then null else cast(seq * 37 % 200 as double) end as sharpness",
        "case seq % 5 when 0 then 'suspect' when 1 then null when 4 then 'blurry' else 'clear' end as blur_status",
        "cast(seq * 13 % 7 as int) * 100 as width",
        "cast(seq * 7 % 5 as int) * 100 as height",
        "seq * 101 % 1000 as file_size",
    )


#: Pictures of a task.
PICTURES = 1000


def pictures(spark: SparkSession, sf_dir: str, width: int, height: int, channels: int) -> DataFrame:
    """Decoded images of one size, one for each vector: a byte is made of the numbers of its row and of its column, turned by channel.

    Tasks, and so the batches of what measures them, are of some PICTURES however many there are.
    """
    ship(spark)

    @F.pandas_udf("binary")
    def drawn(v: pd.Series) -> pd.Series:
        i = np.arange(width * height * channels)
        down, across = i // (width * channels) + 21 * (i % channels), i % (width * channels) // channels

        def draw(x: np.ndarray) -> bytes | None:
            if x is None or not len(x):
                return None
            x = np.asarray(x, dtype=np.float64)
            return np.clip(np.floor(128 + 200 * (x[down % len(x)] + x[across % len(x)])), 0, 255).astype(np.uint8).tobytes()

        return v.map(draw)

    e = table(spark, sf_dir, "embeddings")
    tasks = max(spark.sparkContext.defaultParallelism, -(-e.count() // PICTURES))
    e = e.selectExpr("label as trip_id", "vec_id as seq", "transform(embedding, x -> cast(x as double)) as v").repartition(tasks)
    return e.select("trip_id", "seq", F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(channels).alias("channels"), drawn("v").alias("data"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames (media_id, t, pixels of 8 x 8) of a video for each label, half a second for each number: of
    each scene its first, with a tenth of each frame's own vector."""
    e = table(spark, sf_dir, "embeddings").selectExpr("label as media_id", "vec_id as seq", "transform(embedding, x -> cast(x as double)) as v", f"vec_id div {SCENE} as scene")
    first = e.groupBy("media_id", "scene").agg(F.min_by("v", "seq").alias("w"))
    pixel = "lpad(hex(cast(least(255, greatest(0, floor(128 + 600 * (x * 0.1D + y * 0.9D)))) as int)), 2, '0')"
    return e.join(first, ["media_id", "scene"]).selectExpr("media_id", "seq / 2.0D as t", f"unhex(array_join(zip_with(v, w, (x, y) -> {pixel}), '')) as pixels")


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of jobs, a job for each user of events."""
    return as_job_events(table(spark, sf_dir, "events"))


def as_job_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id as id",
        "user_id as job_id",
        "cast(ts as timestamp) as created_at",
        "case event_type when 'error' then 'error' when 'signup' then 'warn' else 'info' end as level",
        "case event_type when 'purchase' then 'completed' when 'error' then 'failed' when 'signup' then 'queued' else 'running' end as status",
        "event_type as step",
        "value",
    )


#: Events of a task.
VIDEO_ROWS = 100_000

#: Seconds of events that make one of video, by kind of video: short ones of few cuts and of many, middling and long ones.
SPEEDS = "case media_id % 4 when 2 then 4.0 when 3 then 1.0 else 32.0 end"


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene cuts of one video for each user of events, at seconds from its first: an event a day is
    a minute, or a part of it by the kind of video; the short ones of few cuts have them every 16 seconds.

    A video's events lie together from here on, in tasks of VIDEO_ROWS rows or so
    however large the log is. There is no join: the file is small enough for its size
    to have it broadcast, its rows are not.
    """
    e = table(spark, sf_dir, "events")
    tasks = max(spark.sparkContext.defaultParallelism, -(-e.count() // VIDEO_ROWS))
    e = e.where("user_id is not null").selectExpr("user_id as media_id", "floor(unix_timestamp(cast(ts as timestamp)) / 1440.0) as minute", "value", f"cast({SPEEDS} as double) as speed")
    w = Window.partitionBy("media_id")
    e = e.repartition(tasks, "media_id").withColumns({"first": F.min("minute").over(w), "last": F.max("minute").over(w)})
    t = "(minute - first) / speed"
    return e.withColumn("duration", (F.col("last") - F.col("first") + 5) / F.col("speed")).selectExpr("media_id", f"case when media_id % 4 = 0 then floor({t} / 16) * 16.0D else {t} end as t", "duration", "value")


def measured_segments(segments: DataFrame) -> DataFrame:
    """segments (media_id, segment_index) with measures made of their numbers: three in a row are alike, and every third video is good throughout."""
    m, k, i = F.col("media_id"), F.floor(F.col("segment_index") / 3), F.col("segment_index") % 3
    good = lambda low, x: F.when(m % 3 == 0, low + x % (100 - low)).otherwise(x).cast("double")
    return segments.withColumns({"sharpness": good(60, (m * 31 + k * 17 + i) % 120), "stability": good(60, (m * 7 + k * 29 + i * 2) % 101), "exposure": good(10, (m * 13 + k * 5 + i) % 101)})
