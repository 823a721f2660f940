"""Harmonic packing of token sequences (operator 1).

Documents are cut into pieces that fill the slots of reciprocal-capacity
classes: class k has slots of floor(capacity / k) tokens, and each of its
sequences takes exactly k pieces. The encoding tasks deal pieces to classes and
number them on their own; a table of counts, one row for each task and class,
turns those numbers into sequences. Only the last, unfilled sequence of each
class (at most k - 1 pieces, some 5,000 in all whatever the input) is packed
anew by first fit.

Cases: a null text counts as empty, and is one piece that holds the end id. Null
and repeated doc_ids pass through, each row a document of its own. An empty
table gives an empty result. Columns beside doc_id and text aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnow.llm.shared import ship, written
from winnow.llm.tokens import encoder, tokenizer_path

CAPACITY = 2048
END_ID = 1
#: A piece may leave this share of its slot empty; else it is cut at the next smaller slot.
SLACK = 1 / 32


def class_sizes(capacity: int) -> dict[int, int]:
    """Slots of the classes: pieces in a sequence -> tokens of a slot, largest slots first."""
    counts = list(range(1, 33)) + [40, 48, 64, 80, 96, 128, 192, 256, 512, 1024]
    return {k: capacity // k for k in [*[c for c in counts if c < capacity], capacity]}


def cut(n_tokens: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[tuple[int, int]]:
    """Pieces (class, length) of a document, in order; lengths add up to n_tokens."""
    sizes = class_sizes(capacity)
    counts = list(sizes)
    out = [(1, capacity)] * (n_tokens // capacity)
    rest = n_tokens % capacity
    while rest:
        at = max(i for i, k in enumerate(counts) if sizes[k] >= rest)
        slot = sizes[counts[at]]
        if slot - rest <= max(slot * slack, 2) or at + 1 == len(counts):
            out.append((counts[at], rest))
            break
        take = sizes[counts[at + 1]]
        out.append((counts[at + 1], take))
        rest -= take
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int | None = END_ID, slack: float = SLACK) -> DataFrame:
    """The pieces of each document, with the class, the task that cut it and its
    number among that task's pieces of the class."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, known = TaskContext.get().partitionId(), {}, {}
        for batch in batches:
            at, rows = [], []
            for i in range(0, batch.num_rows, 256):
                for j, ids in enumerate(encoder(path).encode(batch.column(1).slice(i, 256).to_pylist()), i):
                    if end_id is not None:
                        ids = np.append(ids, end_id)
                    raw, n, start = ids.astype("<u4").tobytes(), len(ids), 0
                    if n not in known:
                        known[n] = cut(n, capacity, slack)
                    for k, length in known[n]:
                        rank = seen.get(k, 0)
                        seen[k] = rank + 1
                        at.append(j)
                        rows.append((start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n, k, part, rank))
                        start += length
            names = ["start", "length", "ids_crc32", "doc_tokens", "klass", "part", "rank"]
            columns = np.array(rows, dtype=np.int64).reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *map(pa.array, columns)], names=["doc_id", *names])

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, klass long, part long, rank long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, longest first; for the few unfilled sequences."""
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    used: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        b = next((b for b, u in enumerate(used) if u + lengths[i] <= capacity), len(used))
        if b == len(used):
            used.append(0)
        out[i] = (b, used[b])
        used[b] += lengths[i]
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int | None = END_ID, slack: float = SLACK) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens.

    Returns a row for each piece: doc_id, start (ids of its document before it),
    length, ids_crc32, doc_tokens, sequence_id and offset (where it starts in its
    sequence, without gaps from 0). Sequences are numbered without gaps from 0.
    """
    spark = docs.sparkSession
    ship(spark)
    cutted = written(pieces(docs, path or tokenizer_path(), capacity, end_id, slack), "pieces")
    by_task = Window.partitionBy("klass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cutted.groupBy("klass", "part").agg(F.count("*").alias("n"))
    firsts = counts.select("klass", "part", F.coalesce(F.sum("n").over(by_task), F.lit(0)).alias("first"))
    # one row for each class: no more than there are classes
    full, base = {}, 0
    for k, n in sorted((r["klass"], r["n"]) for r in cutted.groupBy("klass").agg(F.count("*").alias("n")).collect()):
        full[k] = (base, n // k)
        base += n // k
    classes = spark.createDataFrame([(k, b, n) for k, (b, n) in full.items()], "klass long, base long, bins long")
    placed = cutted.join(firsts, ["klass", "part"]).join(F.broadcast(classes), "klass").withColumn("place", F.col("first") + F.col("rank"))
    placed = placed.withColumn("bin", F.floor(F.col("place") / F.col("klass"))).drop("first", "rank", "part")
    tail = placed.where("bin >= bins").select("klass", "place", "length").collect()  # fewer than the classes' counts added up
    tail.sort(key=lambda r: (r["klass"], r["place"]))
    fitted = first_fit([r["length"] for r in tail], capacity)
    rows = [(r["klass"], r["place"], base + b, o) for r, (b, o) in zip(tail, fitted, strict=True)]
    tails = F.broadcast(spark.createDataFrame(rows, "klass long, place long, sequence_id long, offset long"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    in_order = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    filled = placed.where("bin < bins").withColumn("sequence_id", F.col("base") + F.col("bin"))
    filled = filled.withColumn("offset", F.coalesce(F.sum("length").over(in_order), F.lit(0)))
    return filled.select(*names).union(placed.where("bin >= bins").join(tails, ["klass", "place"]).select(*names))
