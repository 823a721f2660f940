"""Files as rows: manifests, blobs, images, parts of uploads, and copies between stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnow.functions import media_types, text

#: URI schemes of the kinds of store.
SCHEMES = {"local": "file", "s3": "s3a", "oss": "oss", "cos": "cosn"}
PATH_COLUMNS = ("file_path", "thumbnail_path", "optimized_path", "compiled_path")


def store_uri(kind: str, bucket: str = "", key: str = "") -> str:
    """The URI of a key in a store; raises ValueError for a kind there is none of."""
    if kind not in SCHEMES:
        raise ValueError(f"unknown kind of store: {kind}")
    key = key.removeprefix("uploads/").lstrip("/")
    return f"{SCHEMES[kind]}://{bucket.rstrip('/')}/{key}"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Paths listed one a line, trimmed; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def blobs(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files with path, name, size, md5, extension, MIME type, kind, and whether they are supported."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = media_types.classified(F.col("content"), F.col("name"))
    df = df.withColumn("name", name).withColumn("kind", kind)
    return df.select("path", "name", F.col("length").alias("size"), F.md5("content").alias("md5"), text.extension(F.col("name")).alias("extension"), "kind.mime", "kind.kind", media_types.supported(F.col("kind.mime"), F.col("name")).alias("supported"), "content")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images with path, width, height, channels and data; what can't be decoded is left out."""
    df = spark.read.format("image").option("dropInvalid", "true").load(path)
    return df.select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def part_list(parts: DataFrame) -> DataFrame:
    """Number, MD5 and size of the parts of uploads (upload_id, name `part_<n>`, content); other names are left out."""
    number = F.regexp_extract("name", r"part_(\d+)", 1)
    return parts.where(number != "").select("upload_id", number.cast("int").alias("part_no"), F.md5("content").alias("etag"), F.octet_length("content").cast("long").alias("size"))


def merged_parts(parts: DataFrame, content: str = "content") -> DataFrame:
    """The content of uploads from their parts (upload_id, part_no, content), in order of part_no.

    An upload is bounded by the plan of its parts; one object is one row.
    """
    all_ = F.sort_array(F.collect_list(F.struct("part_no", content)))
    return parts.groupBy("upload_id").agg(F.count("*").alias("parts"), F.array_join(F.transform(all_, lambda p: p[content]), "").alias("merged"))


def missing_parts(expected: DataFrame, parts: DataFrame) -> DataFrame:
    """Parts that uploads (upload_id, total_parts) should have, but don't."""
    wanted = expected.where("total_parts > 0").select("upload_id", F.explode(F.sequence(F.lit(1), "total_parts")).alias("part_no"))
    return wanted.join(parts, ["upload_id", "part_no"], "left_anti")


def distinct_paths(media: DataFrame) -> DataFrame:
    """All paths that rows of media have, each once, as keys in the store."""
    paths = media.select(F.explode(F.array(*PATH_COLUMNS)).alias("path"))
    return paths.where("path is not null and path <> ''").select(text.store_path(F.col("path")).alias("path")).distinct()


def copy_plan(paths: DataFrame, present: DataFrame) -> DataFrame:
    """What a migration does with each path: copied if the source has it, else failed."""
    there = present.select("path", F.lit(True).alias("there"))
    return paths.join(there, "path", "left").select("path", F.when(F.col("there"), "copied").otherwise("failed").alias("outcome"))


def migration_summary(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "copied").alias("success"), F.count_if(F.col("outcome") == "failed").alias("failed"))


def serve_path(media: DataFrame) -> DataFrame:
    """media with the best version there is: compiled, preview, optimised, original."""
    first = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("compiled_path", "preview_proxy_path", "optimized_path", "file_path")])
    return media.withColumn("serve_path", first)


def located(media: DataFrame, kind: str, bucket: str = "") -> DataFrame:
    """media with the URI of their file in a store of a kind."""
    prefix = store_uri(kind, bucket)
    return media.withColumn("uri", F.concat(F.lit(prefix), F.ltrim(text.store_path(F.col("file_path")), F.lit("/"))))


def ingested(uploads: DataFrame, trip_id: str) -> DataFrame:
    """Rows of media for uploads (id, name, mime, content) of a supported kind: path, kind, size, digest and state."""
    ok = uploads.where(media_types.supported(F.col("mime"), F.col("name")))
    kind = media_types.classified(F.col("content"), F.col("name"))
    path = F.concat(F.lit(trip_id + "/originals/"), F.col("id").cast("string"), media_types.file_extension(F.col("name"), F.col("mime")))
    return ok.select("id", path.alias("file_path"), kind["kind"].alias("media_type"), F.octet_length("content").cast("long").alias("file_size"), F.md5("content").alias("md5"), F.lit("active").alias("status"), F.lit("none").alias("processing_status"))


def read_once(reads: DataFrame, order: list[str]) -> DataFrame:
    """Reads (run, path, …) with `source`: the first of a path in a run downloads it, the others find it cached."""
    rn = F.row_number().over(Window.partitionBy("run", "path").orderBy(*order))
    return reads.withColumn("source", F.when(rn == 1, "download").otherwise("cache"))


def thumbnail_source(media: DataFrame) -> DataFrame:
    """media with where their thumbnail comes from: the stored one, else made of the optimised or original file; videos without one have none."""
    stored = F.nullif("thumbnail_path", F.lit(""))
    made = F.when(F.col("media_type") == "image", F.coalesce(F.nullif("optimized_path", F.lit("")), F.col("file_path")))
    return media.withColumns({"thumbnail_from": F.coalesce(stored, made), "made": stored.isNull() & made.isNotNull()})


#: Settings that each kind of store needs.
SETTINGS = {"local": (), "s3": ("BUCKET", "REGION"), "oss": ("BUCKET", "REGION", "KEY", "SECRET"), "cos": ("BUCKET", "REGION", "KEY", "SECRET")}


def missing_settings(settings: DataFrame) -> DataFrame:
    """Kinds of store with what they still need, of settings (kind, name, value): name and value may be missing or empty."""
    needed = settings.sparkSession.createDataFrame([(k, n) for k, names in SETTINGS.items() for n in names], "kind string, name string")
    have = settings.where("value is not null and value <> ''").select("kind", "name")
    return needed.join(have, ["kind", "name"], "left_anti")
