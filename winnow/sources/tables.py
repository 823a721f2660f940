"""Stored tables: atomic replacement of what changed, and lookups and joins by key without a shuffle.

`Versions` keeps a table's rows in parts by a hash of its key. A change writes the parts
that it touches aside and then adds one numbered commit, a small file that lists the
folder of each part; only one writer can create a number, where renaming a file to a name
that is taken fails, as in HDFS (a local folder is checked just before). A reader takes the last commit,
so it sees the table before a change or after it, and a change that ends midway leaves
the old one. Folders that no kept commit lists are removed by `vacuum`.

`save_bucketed` writes Spark's own bucketed tables, sorted within the buckets: a lookup
by key reads one bucket, and tables of as many buckets join on the key as they lie.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PARTS = 16
_PART = "_part"


class Conflict(Exception):
    """Another writer has changed the table since it was read."""


class Versions:
    """A table in a folder that driver and executors share; key: the columns that name a row's part."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: list[str], parts: int = PARTS) -> None:
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), key, parts
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")

    def _commits(self) -> list[str]:
        top = self._hadoop(f"{self.path}/_commits")
        return sorted(n for f in self._fs.listStatus(top) if (n := f.getPath().getName()).isdigit()) if self._fs.exists(top) else []

    def _listed(self, commit: str) -> dict[str, str]:
        at = self._fs.open(self._hadoop(f"{self.path}/_commits/{commit}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(at, "UTF-8"))
        finally:
            at.close()

    def snapshot(self) -> tuple[int, dict[str, str]]:
        """The number of the last commit, 0 if there is none, and the folder of each part that has rows."""
        commits = self._commits()
        return (int(commits[-1]), self._listed(commits[-1])) if commits else (0, {})

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in sorted(folders)])

    def read(self) -> DataFrame:
        """The table as of its last commit; commits that come later don't change what is read."""
        return self._rows(list(self.snapshot()[1].values()))

    def lookup(self, **key) -> DataFrame:
        """The rows of one key, from its part alone."""
        at = self.spark.range(1).select(*[F.lit(key[k]).cast(self.schema[k].dataType).alias(k) for k in self.key]).select(self.part()).first()[0]
        folder = self.snapshot()[1].get(str(at))
        rows = self._rows([folder] if folder else [])
        for k, v in key.items():
            rows = rows.where(F.col(k) == v)
        return rows

    def stage(self, df: DataFrame) -> dict[str, str]:
        """Writes rows aside, by part; returns the folder of each part that has any."""
        name = f"data-{uuid.uuid4().hex}"
        out = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).withColumn(_PART, self.part())
        out.repartition(_PART).write.partitionBy(_PART).parquet(f"{self.path}/{name}")
        found = [f.getPath().getName() for f in self._fs.listStatus(self._hadoop(f"{self.path}/{name}"))]
        return {n.removeprefix(f"{_PART}="): f"{name}/{n}" for n in found if n.startswith(f"{_PART}=")}

    def swap(self, seen: int, folders: dict[str, str]) -> int:
        """Makes the folders the table, if its last commit is still the one that was seen; else raises Conflict."""
        place = self._hadoop(f"{self.path}/_commits/{seen + 1:020d}")
        beside = self._hadoop(f"{self.path}/_commits/_{uuid.uuid4().hex}")
        at = self._fs.create(beside, False)
        try:
            at.write(bytearray(json.dumps(folders).encode()))
        finally:
            at.close()
        # a whole file under its number or none: a rename to a name that is taken fails
        done = not self._fs.exists(place) and self._fs.rename(beside, place)
        if not done:
            self._fs.delete(beside, False)
            raise Conflict(f"{self.path} is no longer at {seen}")
        return seen + 1

    def replace(self, df: DataFrame) -> int:
        """The rows of df become the table."""
        seen, _ = self.snapshot()
        return self.swap(seen, self.stage(df))

    def change(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Replaces the parts that rows of `new` fall in by merge(old, new) of those parts; the others stay as they lie.

        new has the key's columns, and is read twice.
        """
        seen, folders = self.snapshot()
        touched = {str(r[0]) for r in new.select(self.part()).distinct().collect()}  # at most as many as there are parts
        old = self._rows([folders[p] for p in touched if p in folders])
        kept = {p: f for p, f in folders.items() if p not in touched}
        return self.swap(seen, kept | self.stage(merge(old, new)))

    def vacuum(self, keep: int = 2) -> int:
        """Removes folders that none of the last `keep` commits lists; returns how many. No writer may be at work."""
        commits = self._commits()
        used = {f.split("/")[0] for c in commits[-keep:] for f in self._listed(c).values()}
        gone = [f.getPath() for f in self._fs.listStatus(self._hadoop(self.path)) if f.getPath().getName().startswith("data-") and f.getPath().getName() not in used]
        for f in gone:
            self._fs.delete(f, True)
        for c in commits[:-keep]:
            self._fs.delete(self._hadoop(f"{self.path}/_commits/{c}"), False)
        return len(gone)


@contextmanager
def bucket_reads(spark: SparkSession) -> Iterator[None]:
    """Within it, scans of bucketed tables keep to their buckets, and a lookup by key reads one."""
    setting = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int = PARTS, path: str | None = None) -> DataFrame:
    """df as a table in so many buckets by key, sorted by it; one file for each bucket."""
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)
