"""Sharding by vector bin packing (operator 10).

Every group of documents with equal texts is a load of three sizes, bytes, tokens
and rows. A group too large for a share of one shard is dealt in pieces; small
groups are gathered by hash into cells. What is left are a bounded number of
units, at most (cells + 3 x heavy) for each shard whatever the input, and these
are placed one by one, largest first, where the dot product of the unit's load
with what the shard has left is highest. Then units are moved and swapped to bring
bytes nearer, the law that holds, but only as far as tokens and rows stay balanced.

Cases: a null text has no bytes and no tokens, and null texts are one group. Null
and repeated doc_ids are rows like others; those of null are dealt by their place in
the table. An empty table gives an empty result.
Columns beside doc_id and text aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.shared import bucket_of, with_starts, written
from winnow.llm.tokens import counted, tokenizer_path

SHARDS = 24
#: Cells of small groups for each shard, and the share of a shard from which a group is a unit of its own.
CELLS, HEAVY = 192, 96
#: Bytes that each document takes besides its text.
OVERHEAD = 8


#: How far from equal, of a shard's share, moves for the sake of bytes may bring tokens and rows, and how equal bytes have to be.
TOLERANCE, EQUAL = 0.01, 0.0005


def greedy(part: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit (rows: loads as shares of a shard in each measure):
    largest first, where the dot product with residual capacity is highest."""
    left = np.ones((shards, part.shape[1]))
    out = np.zeros(len(part), dtype=np.int64)
    for u in np.lexsort((np.arange(len(part)), -part.max(axis=1))):
        out[u] = b = int(np.argmax(left @ part[u]))
        left[b] -= part[u]
    return out


def place(loads: np.ndarray, shards: int, rounds: int = 4000, tolerance: float = TOLERANCE, equal: float = EQUAL) -> np.ndarray:
    """The shard of each unit (rows: loads in each measure, the first of which is to be equal).

    Greedy by dot product with residual capacity; then moves and swaps between the
    shards with the most and the least of the first measure, as long as that brings
    them nearer and leaves no other measure farther from equal than the tolerance,
    or two units, or than it was. Only where the first measure is not equal enough
    after that, the tolerance is doubled.
    """
    total = loads.sum(axis=0)
    part = loads / np.where(total > 0, total, 1) * shards
    out = greedy(part, shards)
    if not len(loads):
        return out
    free = np.maximum(tolerance, 2 * np.median(part[:, 1:], axis=0))
    part = np.vstack([part, np.zeros(part.shape[1])])  # the last is no unit: a move, not a swap
    none, near = len(loads), np.arange(-6, 6)
    used = np.stack([np.bincount(out, weights=c, minlength=shards) for c in part[:-1].T], axis=1)
    for _ in range(rounds):
        hi, lo = int(np.argmax(used[:, 0])), int(np.argmin(used[:, 0]))
        gap = used[hi, 0] - used[lo, 0]
        a, b = np.flatnonzero(out == hi), np.append(np.flatnonzero(out == lo), none)
        if not len(a) or gap * total[0] / shards <= 1:
            break
        # each unit of the fuller shard against some of the other whose difference is about half the gap
        b = b[np.argsort(part[b, 0], kind="stable")]
        at = np.searchsorted(part[b, 0], part[a, 0] - gap / 2)[:, None] + near
        x, y = np.repeat(a, len(near)), b[np.clip(at, 0, len(b) - 1)].ravel()
        moved = part[x] - part[y]
        room = np.maximum(free, np.abs(used[[hi, lo], 1:] - 1).max(axis=0))
        fits = (np.abs(used[hi, 1:] - moved[:, 1:] - 1) <= room).all(axis=1) & (np.abs(used[lo, 1:] + moved[:, 1:] - 1) <= room).all(axis=1)
        fits &= (moved[:, 0] > 0) & (moved[:, 0] < gap)
        if not fits.any():
            if gap <= equal or free.min() > shards:
                break
            free = 2 * free
            continue
        best = int(np.argmin(np.where(fits, np.abs(moved[:, 0] - gap / 2), np.inf)))
        out[x[best]] = lo
        if y[best] != none:
            out[y[best]] = hi
        used[hi] -= moved[best]
        used[lo] += moved[best]
    return out


def shard(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS, heavy: int = HEAVY, path: str | None = None) -> DataFrame:
    """Puts all documents into shards: doc_id, size, text_crc32, law, shard, slot
    (without gaps from 0) and grown_shard, which is null as the law isn't `key`.
    path: the tokenizer file that tokens are counted by.

    Groups of equal texts stay in one shard, but for those that outweigh a shard's
    share in a measure: these are dealt by doc_id to as few pieces as fit.
    """
    spark, text = docs.sparkSession, F.col("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
        F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text)).alias("same"),
        "text",
    )
    rows = counted(rows, "text", "tokens", path or tokenizer_path())
    nameless = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    rows = written(rows.withColumn("bucket", bucket_of(F.col("doc_id"), F.col("same"), nameless)), "sizes")
    sums = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    share = [max(float(x or 0), 1.0) / shards for x in sums]
    groups = rows.groupBy("same", "text_crc32", F.col("size").alias("one")).agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    weight = F.greatest(F.col("bytes") / share[0], F.col("tokens") / share[1], F.col("n") / share[2])
    # each holds 1 / heavy of a shard in some measure: no more than 3 x heavy x shards rows
    large = groups.where(weight * heavy >= 1).select("same", "text_crc32", "one", F.ceil(weight).cast("int").alias("parts"))
    large = F.broadcast(written(large, "large").withColumnsRenamed({"same": "g", "text_crc32": "g_crc"}))
    known = rows.join(large, (F.col("same") == F.col("g")) & (F.col("text_crc32") == F.col("g_crc")) & (F.col("size") == F.col("one")), "left")
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id", "bucket", F.lit("part")), F.col("parts"))).otherwise(F.lit(0))
    cell = F.pmod(F.xxhash64("same", "text_crc32", F.lit("cell")), F.lit(cells * shards))
    unit = F.when(F.col("g").isNull(), F.struct(cell.alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(-1).cast("long").alias("c")))
    unit = unit.otherwise(F.struct(F.col("same").alias("a"), F.col("text_crc32").alias("b"), (part * 2**34 + F.col("size")).cast("long").alias("c")))
    known = known.withColumn("unit", unit).select("doc_id", "size", "tokens", "text_crc32", "same", "bucket", "unit.*")
    units = known.groupBy("a", "b", "c").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()
    units.sort(key=lambda u: (u["a"], u["b"], u["c"]))
    where = place(np.array([(u["size"], u["tokens"], u["n"]) for u in units], dtype=np.float64).reshape(-1, 3), shards)
    placed = [(u["a"], u["b"], u["c"], int(s)) for u, s in zip(units, where, strict=True)]
    placed = F.broadcast(spark.createDataFrame(placed, "a long, b long, c long, shard int"))
    out = known.join(placed, ["a", "b", "c"]).select("doc_id", "size", "text_crc32", "same", "bucket", "shard")
    out = with_starts(out, ["shard"], "bucket", ["doc_id", "same", "text_crc32", "size"], {"slot": (F.sum, F.lit(1), 0)})
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
