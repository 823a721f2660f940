"""Perceptual hashes as 64-bit numbers, and their distances."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _packed(bits: Column) -> Column:
    """64 bits (booleans, the first is the highest) as one number."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("long")))


def mean_hash(values: Column) -> Column:
    """A bit for each of 64 values: whether it is over their mean."""
    v = values.cast("array<double>")
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    # bound once, as a lambda's body is computed anew for each element
    both = F.transform(F.array(F.struct(v.alias("v"), mean.alias("mean"))), lambda s: _packed(F.transform(s["v"], lambda x: x > s["mean"])))
    return F.get(both, F.lit(0))


def gradient_hash(values: Column, rows: int = 8, columns: int = 8) -> Column:
    """A bit for each of rows x columns: whether a value is over that to its right, in rows of columns + 1."""
    v = values.cast("array<double>")
    at = lambda i: F.floor(i / columns).cast("int") * (columns + 1) + i % columns
    return _packed(F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), lambda i: F.get(v, at(i)) > F.get(v, at(i) + 1)))


def sequence_hash(values: Column) -> Column:
    """A bit for each of 64 values: whether it is over the next; the last has none."""
    v = values.cast("array<double>")
    return _packed(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.get(v, i) > F.get(v, i + 1), F.lit(False))))


def corner_hash(values: Column, width: int = 32, side: int = 8) -> Column:
    """A bit for each value of the upper left corner of a picture of so many columns: whether it is over the mean of all."""
    v = values.cast("array<double>")
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    at = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.floor(i / side).cast("int") * width + i % side)
    both = F.transform(F.array(F.struct(v.alias("v"), mean.alias("mean"))), lambda s: _packed(F.transform(at, lambda i: F.get(s["v"], i) > s["mean"])))
    return F.get(both, F.lit(0))


def digits(hash_: Column) -> Column:
    """A hash as 16 hexadecimal digits."""
    return F.lower(F.lpad(F.hex(hash_), 16, "0"))


def parsed(text: Column) -> Column:
    """A hash from 16 hexadecimal digits; null from anything else."""
    half = lambda at: F.conv(F.substring(text, at, 8), 16, 10).cast("long")
    return F.when(text.rlike("^[0-9a-fA-F]{16}$"), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hashes differ; null if either is null."""
    return F.bit_count(a.bitwiseXOR(b))


def bands(hash_: Column, count: int, together: int = 1) -> Column:
    """A number for each choice of `together` of `count` disjoint parts of a hash's 64 bits:
    two hashes with fewer differences than count - together + 1 share one."""
    cuts = [64 * i // count for i in range(count + 1)]
    parts = [F.shiftrightunsigned(F.shiftleft(hash_, a), 64 - b + a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return F.array(*[F.xxhash64(F.lit(n), *[parts[i] for i in chosen]) for n, chosen in enumerate(combinations(range(count), together))])
