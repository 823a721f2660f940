"""Audit of how filters interact, by the product of an incidence matrix (operator 13).

Each document has a mask of the filters that it fails. A part's documents are counted
by mask, which gives a row of the incidence matrix: all documents, those labelled good
and those labelled toxic, a row each. What becomes of a mask at each step of each order
of the filters (kept, removed, redundant, failed alone) is a matrix of whole numbers,
masks by orders and steps; rows times matrices are the audit. Documents are therefore
read once, however many orders there are, and only the counts meet the matrices.

Filters: A: under 200 words; B: under half of the words distinct; C: over 2 % of the
code points in A-Z; D: any of #$%&*|; E: the text of a smaller doc_id, table-wide.

Cases: null texts count as empty, null sources as ''. Rows are documents of their own:
of rows that repeat a doc_id each counts, and none is a copy of another with that
doc_id. A null doc_id is no document's smaller one, has none, and has no labels. If
`labels` repeats a doc_id, one good (toxic) row makes it good (toxic). An empty table
gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.shared import ship, written

LETTERS = "ABCDE"
ORDERS = ["".join(o) for o in permutations(LETTERS)]
MASKS = 1 << len(LETTERS)
LEAST_WORDS = 200
_UPPER = bytes(range(65, 91))
_CONTINUING = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#$%&*|"


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails."""
    words = text.split()  # bytes are split at blanks and \x09-\x0D alone
    n = len(text)
    upper = n - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _CONTINUING))
    failed = (len(words) < LEAST_WORDS, 100 * len(set(words)) < 50 * len(words), 100 * upper > 2 * points, len(text.translate(None, _SYMBOLS)) < n)
    return sum(1 << i for i, f in enumerate(failed) if f)


def outcomes() -> dict[str, np.ndarray]:
    """For each outcome, a matrix of masks by orders and steps: 1 if a document with
    that mask has the outcome at that step."""
    mask = np.arange(MASKS)
    out = {name: np.zeros((MASKS, len(ORDERS) * len(LETTERS)), dtype=np.int64) for name in ("kept", "removed", "redundant", "unique_fails")}
    for at, order in enumerate(ORDERS):
        before = np.zeros(MASKS, dtype=bool)  # failed at an earlier step
        for step, letter in enumerate(order):
            bit = 1 << LETTERS.index(letter)
            fails, column = (mask & bit) > 0, at * len(LETTERS) + step
            out["removed"][:, column] = fails & ~before
            out["redundant"][:, column] = fails & before
            out["unique_fails"][:, column] = mask == bit
            before |= fails
            out["kept"][:, column] = ~before
    return out


def _letter_sums() -> np.ndarray:
    """Orders and steps by orders and steps: 1 where both have the same filter."""
    letter = np.array([LETTERS.index(x) for o in ORDERS for x in o])
    return (letter[:, None] == letter[None, :]).astype(np.int64)


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (of A to D) and digest (SHA-256 of the text) of each document."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(2)]
            more = [pa.array(map(text_mask, texts), pa.int32()), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more], names=["doc_id", "part", "mask", "digest"])

    part, text = F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", part.alias("part"), text.cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, part string, mask int, digest binary")


def incidence(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (of A to E), n, good and toxic: documents by part and mask.

    A text's first document is found by a partial minimum for each digest, and met by
    digest and doc_id, so copies of one text are never together in a task.
    """
    rows = written(masked(docs), "masks")
    named = rows.where("doc_id is not null")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    one = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long")
    met = named.join(first, ["digest", "doc_id"], "left").join(told, "doc_id", "left")
    met = met.select("part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << LETTERS.index("E"))).alias("mask"), one("good").alias("good"), one("bad").alias("toxic"))
    nameless = rows.where("doc_id is null").select("part", "mask", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return met.union(nameless).groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step; columns as in SCHEMA."""
    counts = incidence(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # 32 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices, sums = outcomes(), _letter_sums()
        columns = len(sums)
        orders, steps = pa.array([o for o in ORDERS for _ in o]), pa.array(np.tile(np.arange(1, len(LETTERS) + 1, dtype=np.int32), len(ORDERS)))
        for batch in batches:
            for part, own in zip(batch.column(0), batch.column(1), strict=True):
                rows = np.zeros((3, MASKS), dtype=np.int64)
                for x in own.as_py():
                    rows[:, x["mask"]] = x["n"], x["good"], x["toxic"]
                (kept, _, _), (removed, good, toxic) = rows @ matrices["kept"], rows @ matrices["removed"]
                values = [kept, removed, rows[0] @ matrices["redundant"], rows[0] @ matrices["unique_fails"], good, toxic, removed @ sums]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * columns, pa.string()), orders, steps, *map(pa.array, values)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return counts.mapInArrow(run, SCHEMA)
