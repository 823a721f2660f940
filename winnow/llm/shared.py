"""What the operators of this subpackage share: tables in the folder that all
executors see, exact ranks and running sums over skewed keys, and components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnow.operators.graph import components
from winnow.sources.packages import ship
from winnow.sources.shared import Scratch, dropped, run_dir, written

__all__ = ["Scratch", "bucket_of", "components", "dropped", "free_name", "run_dir", "ship", "with_starts", "written"]

#: Rows of one key are dealt over so many buckets for ranks and running sums.
BUCKETS = 1024


def free_name(df: DataFrame, name: str) -> str:
    """name, or it with underscores before it, so that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bucket_of(*columns: Column, buckets: int = BUCKETS) -> Column:
    """Which of the buckets a row belongs to, by a hash of the columns."""
    return F.pmod(F.xxhash64(*columns, F.lit("bucket")), F.lit(buckets)).cast("int")


def with_starts(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], starts: dict[str, tuple]) -> DataFrame:
    """df with, for each name in starts, an aggregate over the rows of the same key
    that come before: buckets in order, and within a bucket by `order`.

    starts maps a name to (aggregate function, column, value before the first
    row); the function must give the same over parts of parts (sum, bit_xor).
    keys and bucket hold no nulls. A key may hold most of the rows: each (key,
    bucket) is taken apart, and one row for each of them is taken again.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, bucket).agg(*[f(c).alias(f"_t_{n}") for n, (f, c, _) in starts.items()])
    totals = totals.select(*keys, bucket, *[F.coalesce(f(f"_t_{n}").over(before), F.lit(zero)).alias(f"_b_{n}") for n, (f, _, zero) in starts.items()])
    out = df.withColumns({f"_i_{n}": F.coalesce(f(c).over(inside), F.lit(zero)) for n, (f, c, zero) in starts.items()})
    out = out.join(totals, [*keys, bucket])
    both = {n: F.col(f"_i_{n}").bitwiseXOR(F.col(f"_b_{n}")) if f is F.bit_xor else F.col(f"_i_{n}") + F.col(f"_b_{n}") for n, (f, _, _) in starts.items()}
    return out.withColumns(both).drop(*[f"_i_{n}" for n in starts], *[f"_b_{n}" for n in starts])
