"""What the operators on embeddings share: usable vectors and bounded samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(vector: str = "embedding") -> Column:
    """Whether a vector is not null or empty, and its components are finite numbers and not all zero."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~F.coalesce(bad, F.lit(False)) & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length, without nulls, as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def sample_vectors(df: DataFrame, key: str, vector: str, size: int) -> dict[int, np.ndarray]:
    """About `size` vectors of each length at most, by a hash of the key: alike for each run.

    A share of the rows is drawn that holds twice as many, and of these the `size`
    with the least hashes are kept.
    """
    n = df.count()
    draw = F.pmod(F.xxhash64(key, vector, F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    rows = df.select(F.col(vector).cast("array<double>").alias("v"), draw.alias("draw"))
    drawn = rows.where(F.col("draw") < min(1.0, 2 * size / max(n, 1))).orderBy("draw", "v").limit(size).select("v").toArrow()
    column = drawn.column("v").combine_chunks()
    lengths = np.asarray(column.value_lengths())
    return {int(k): matrix(column.take(pa.array(np.flatnonzero(lengths == k)))) for k in np.unique(lengths)}


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1."""
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centroids of the rows of x, which are of length 1."""
    rng = np.random.Generator(np.random.PCG64(seed))
    c = x[np.sort(rng.choice(len(x), size=min(k, len(x)), replace=False))]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 1e-12, sums / np.where(length > 1e-12, length, 1), c)
    return c
