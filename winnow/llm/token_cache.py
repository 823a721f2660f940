"""Token counts by way of a digest cache (operator 6).

Stored counts are a Parquet table, partitioned by tokenizer version, with one row
for each digest of a content. A run joins the distinct digests of its texts to the
stored counts, fetches and encodes one text for each digest that is missing, and
appends what it encoded, so that a text is encoded once however often it occurs,
in this run or another. Digests are made distinct before the join, and copies
before texts are dealt, so that no text moves more than once a task, however many
rows have it; where few digests are missing only their texts move.

Cases: a null text counts as empty, which has no tokens. Null or repeated
doc_ids pass through, one row for each input row. An empty table gives an empty
result and leaves the cache as it was. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.shared import Scratch, written
from winnow.llm.tokens import counted, file_digest, tokenizer_path

CACHE_SCHEMA = "digest binary, n_tokens long, version string"
LIMIT = 1024
#: Missing digests, at most, that are sent to every task (some 50 bytes each); beyond that texts go to their digests.
FEW_MISSES = 100_000


def normalised(text: Column) -> Column:
    """The content that is counted: null becomes empty. Nothing else may change,
    as case, white space and code points all bear on the count."""
    return F.coalesce(text, F.lit(""))


def digest(text: Column) -> Column:
    """128 bits of the content's SHA-256."""
    return F.unhex(F.substring(F.sha2(normalised(text), 256), 1, 32))


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Counts of that tokenizer version in the cache; none if there is no cache yet.
    A digest that two runs appended at the same time counts once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    own = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)
    return own.groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))


def missing(docs: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """digest and text, one row for each digest of docs (text, digest) that isn't known."""
    misses = scratch.written(docs.select("digest").distinct().join(known, "digest", "left_anti"), "misses")
    if misses.count() <= FEW_MISSES:
        return docs.join(F.broadcast(misses), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    # copies meet within each task before they are dealt, and what is known is dropped after
    return docs.groupBy("digest").agg(F.first("text").alias("text")).hint("merge").join(misses, "digest", "left_semi")


def count_tokens(docs: DataFrame, cache: str, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Counts the tokens of every whole text.

    cache is the folder of the stored counts, in a store that driver and executors
    share; what is missing is appended to it. Returns doc_id, n_bytes, n_tokens
    and over_limit for each row.
    """
    spark, path = docs.sparkSession, path or tokenizer_path()
    version = file_digest(path)
    keyed = docs.select(normalised(F.col("text")).alias("text"), digest(F.col("text")).alias("digest"))
    scratch = Scratch()
    encoded = counted(missing(keyed, stored(spark, cache, version).select("digest"), scratch), "text", "n_tokens", path)
    encoded.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)
    scratch.drop()
    rows = docs.select("doc_id", F.octet_length(normalised(F.col("text"))).cast("long").alias("n_bytes"), digest(F.col("text")).alias("digest"))
    # a table of its own, so that a digest that many rows share can be dealt over tasks
    counts = written(stored(spark, cache, version), "counts")
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
