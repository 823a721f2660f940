"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, and all runs on one
    machine, one in the warehouse. Raises RuntimeError on a cluster without it."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return top.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; removed when its driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _cleaned:
        _cleaned.add(app)
        atexit.register(_clean_at_exit, spark)
    return f"{shared_dir(spark)}/winnow/{app}"


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Removes all that this application wrote for its own use; results not yet read may rest on it."""
    _remove(spark, run_dir(spark))


def _clean_at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the driver is ending, perhaps without its JVM
            clean(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage, and what was
    computed isn't computed again if an executor is lost."""
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._winnow_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables of `written` that nothing still to be computed reads."""
    for t in tables:
        _remove(t.sparkSession, t._winnow_path)


class Scratch:
    """Tables that one operator writes on its way; `drop` removes those that its result doesn't read."""

    def __init__(self) -> None:
        self._tables: list[DataFrame] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        return self.own(written(df, name))

    def own(self, table: DataFrame) -> DataFrame:
        """Takes over a table of `written`."""
        self._tables.append(table)
        return table

    def drop(self) -> None:
        dropped(*self._tables)
        self._tables.clear()
