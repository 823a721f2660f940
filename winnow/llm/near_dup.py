"""MinHash near-duplicates with odd sketches (operator 9).

Documents with equal shingle sets are one class. Each class has k MinHash
samples; their bands give candidates, and their parity bitmap (odd sketch), by
the population count of the XOR of two, an estimate of the similarity that is
precise where it is high. What it lets pass is confirmed on the full sets.

The pairs within a bucket are never listed: each class is first compared with the
smallest class it shares a bucket with. Buckets whose classes aren't in one
component after that are gathered by their most frequent component; there the
classes of different components are compared block by block, by sketches and then
by exact intersections of the full sets as products of matrices. Blocks are cut
by the size of sets, and those whose sizes rule out a link aren't compared. So
every candidate pair is either within a component or confirmed or refuted on the
full sets, and links between different texts are not lost.

Cases: texts without words, and null texts, have an empty set and link with
nothing. A text with fewer words than a shingle has its whole sequence as its
one shingle. Rows with a null doc_id link with nothing, have a null component_id
and are kept. Rows with the same doc_id are told apart by their sets, and each is
given the component of its own set. An empty table gives an empty result. Columns
beside doc_id and text aren't read by `near_duplicates`, and pass through
`distinct_documents`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.shared import Scratch, components, dropped, free_name, ship, written

#: Bands and rows of a band: a pair of similarity 0.8 shares none with a chance of 7e-6.
BANDS, ROWS = 30, 5
#: Bits of an odd sketch.
BITS = 512
#: The sketch lets pass what it puts at this much below the threshold, over five standard deviations of k samples.
MARGIN = 0.18
#: Classes and shingles of a block, and rows of a tile, where classes of different components are compared.
BLOCK, BLOCK_SHINGLES, TILE = 2048, 1_000_000, 256
#: Bytes of text taken at a time.
_CHUNK = 1 << 20

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, dtype=_U), np.ones(1, dtype=_U)
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits spread over 64 bits, one to one."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 ** 64."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]))
        both = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(n, base, dtype=_U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers = tuple(both)
    return _powers


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word in a run of bytes, A-Z as a-z, and where it starts."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _WORD[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return _mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U)), starts


def _chained(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words."""
    n = len(words) - width + 1
    h = np.full(n, width, dtype=_U)
    for j in range(width):
        h = _mixed(h * _U(0xA24BAED4963EE407) + words[j : j + n])
    return h


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text of an Arrow column, in order of size."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, side="right")) - 1)
        to = min(to, n)
        begin = offsets[at]
        # a blank between texts, so that no word spans two
        lengths = np.diff(offsets[at : to + 1])
        part = np.insert(data[begin : offsets[to]], (offsets[at + 1 : to] - begin), 0x20) if to - at > 1 else data[begin : offsets[to]]
        words, starts = word_hashes(part)
        first = np.searchsorted(starts, np.cumsum(np.append(0, lengths[:-1] + 1)))
        bounds = np.append(first, len(words))
        runs = _chained(words, width) if len(words) >= width else np.zeros(0, dtype=_U)
        for i in range(to - at):
            a, b = bounds[i], bounds[i + 1]
            if not valid[at + i] or a == b:
                yield np.zeros(0, dtype=_U)
            elif b - a < width:
                yield _chained(words[a:b], int(b - a))
            else:
                yield np.unique(runs[a : b - width + 1])
        at = to


def samples(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of `count` hash functions."""
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.integers(0, 2**63, count, dtype=_U) * _U(2) + _U(1), rng.integers(0, 2**63, count, dtype=_U)


def min_hash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that isn't empty."""
    out = np.full(len(a), 2**64 - 1, dtype=_U)
    for i in range(0, len(shingles), 2048):
        np.minimum(out, (a[:, None] * shingles[None, i : i + 2048] + b[:, None]).min(axis=1), out=out)
    return out


def odd_sketch(mins: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity bitmap of the samples, each with its place, as signed 64-bit numbers."""
    at = _mixed(mins + np.arange(len(mins), dtype=_U) * _U(_BASE)) % _U(bits)
    odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch_bound(similarity: float, count: int = BANDS * ROWS, bits: int = BITS, margin: float = MARGIN) -> int:
    """Bits in which two sketches may differ: as many as are expected at that much less than the similarity."""
    apart = 2 * count * (1 - max(similarity - margin, 0))
    return int(np.ceil(bits / 2 * (1 - (1 - 2 / bits) ** apart)))


def text_digest(text: Column) -> Column:
    """Tells texts apart; that of a null text is empty, not null."""
    return F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b""))


def features(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, who (digest of the text), n, digest of the set (d1, d2), keys of the bands, and odd sketch of each text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = samples(bands * rows)
        no = np.arange(bands, dtype=_U) * _U(_BASE)
        for batch in batches:
            n, digests, keys, sketches = [], [], [], []
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                digests.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64))
                if not len(s):
                    keys.append(None)
                    sketches.append(None)
                    continue
                mins = min_hash(s, a, b)
                h = no
                for j in range(rows):
                    h = _mixed(h * _U(0xA24BAED4963EE407) + mins.reshape(bands, rows)[:, j])
                keys.append(h.view(np.int64))
                sketches.append(odd_sketch(mins))
            d = np.array(digests, dtype=np.int64).reshape(-1, 2).T
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, sketches)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), *map(pa.array, np.ascontiguousarray(d)), *lists], names=["doc_id", "who", "n", "d1", "d2", "bands", "sketch"])

    return docs.select("doc_id", "text", text_digest(F.col("text")).alias("who")).mapInArrow(run, f"doc_id {kind}, who binary, n long, d1 long, d2 long, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """cls, d1, d2 and the full set of rows with cls and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), width))
            d = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64) for s in sets], dtype=np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, np.ascontiguousarray(d)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["cls", "d1", "d2", "shingles"])

    return docs.select("cls", "text").mapInArrow(run, "cls long, d1 long, d2 long, shingles array<long>")


def _apart(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    words = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)]
    return sum(words[1:], words[0])


def _near(percent: int) -> Column:
    """Whether sizes (an, bn) and sketches (ask, bsk) allow the similarity."""
    return (100 * F.least("an", "bn") >= percent * F.greatest("an", "bn")) & (_apart("ask", "bsk") <= sketch_bound(percent / 100))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as is asked."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    all_ = F.size("sa") + F.size("sb") - F.col("both")
    return pairs.join(right, "b").join(left, "a").withColumn("both", both).where(100 * F.col("both") >= percent * all_).select("a", "b")


def _blocked(anchored: DataFrame, about: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Rows (anchor, cls, label) with size, sketch and full set, dealt to pairs of blocks (i, j).

    Blocks of classes that bear the anchor's label are set against blocks of
    others, and these against each other. A block is bounded in rows and shingles.
    Where there are several, each holds sets of one class of sizes; the classes are
    so wide that sets two classes apart can't be as similar as is asked.
    """
    rows = anchored.join(about.select(F.col("a").alias("cls"), F.col("an").alias("n"), F.col("ask").alias("sketch")), "cls")
    kind = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("long") if percent < 100 else F.col("n")
    rows = rows.withColumns({"own": F.col("label") == F.col("anchor"), "kind": kind})
    many = lambda own: F.greatest(F.ceil(F.count_if(own) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)) / BLOCK_SHINGLES)).cast("int")
    large = rows.groupBy("anchor").agg(many(F.col("own")).alias("own_blocks"), many(~F.col("own")).alias("other_blocks")).where("own_blocks > 1 or other_blocks > 1")
    rows = rows.join(scratch.written(large.select("anchor", F.lit(True).alias("large")), "large"), "anchor", "left").withColumn("kind", F.when(F.col("large"), F.col("kind")))
    rows = scratch.written(rows.withColumn("kind", F.coalesce("kind", F.lit(-9).cast("long"))).drop("large"), "sized")
    blocks = rows.groupBy("anchor", "kind").agg(many(F.col("own")).alias("own_blocks"), many(~F.col("own")).alias("other_blocks"))
    blocks = scratch.written(blocks, "blocks")
    rows = rows.join(blocks, ["anchor", "kind"])
    # own blocks have negative numbers, others those from 0
    at = F.pmod(F.xxhash64("cls", F.lit("block")), F.when(F.col("own"), F.col("own_blocks")).otherwise(F.col("other_blocks"))).cast("int")
    rows = rows.withColumn("at", F.when(F.col("own"), -1 - at).otherwise(at)).drop("own_blocks", "other_blocks")
    rows = rows.withColumn("near", F.explode(F.when(F.col("kind") < 0, F.array("kind")).otherwise(F.array(*[F.col("kind") + k for k in ((-1, 0, 1) if percent < 100 else (0,))]))))
    rows = rows.join(blocks.withColumnRenamed("kind", "near"), ["anchor", "near"])
    counted = lambda n, first, last, step: F.when(F.col(n) > 0, F.sequence(F.lit(first), last(F.col(n)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    others = counted("other_blocks", 0, lambda n: n - 1, 1)
    to = F.when(F.col("own"), others).otherwise(F.concat(counted("own_blocks", -1, lambda n: -n, -1), others))
    number = lambda kind, block: F.col(kind) * 2**33 + F.col(block) + 2**32
    rows = rows.withColumn("to", F.explode(to)).withColumns({"block": number("kind", "at"), "to": number("near", "to")}).join(sets, "cls")
    return rows.select("anchor", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"), "block", "cls", "label", "n", "sketch", "shingles")


def common(a: list[np.ndarray], b: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of a and b, exactly; only where wanted."""
    out = np.zeros(wanted.shape, dtype=np.int64)
    if wanted.sum() <= 4 * sum(wanted.shape):
        for r, c in zip(*np.nonzero(wanted), strict=True):
            x, y = (a[r], b[c]) if len(a[r]) <= len(b[c]) else (b[c], a[r])
            out[r, c] = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
        return out
    both = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    for at in range(0, len(both), 16_384):
        part = both[at : at + 16_384]

        def incidence(sets: list[np.ndarray], part: np.ndarray = part) -> np.ndarray:
            m = np.zeros((len(sets), len(part)), dtype=np.float32)
            for k, s in enumerate(sets):
                place = np.minimum(np.searchsorted(part, s), len(part) - 1)
                m[k, place[part[place] == s]] = 1
            return m

        out += (incidence(a) @ incidence(b).T).astype(np.int64)
    return out


def _cross_links(anchored: DataFrame, about: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between classes of different labels under one anchor: of each pair of
    blocks as many as join what its links join, never all of them."""
    bound = sketch_bound(percent / 100)

    def run(table: pa.Table) -> pa.Table:
        cls, label, n, block = (table.column(c).to_numpy() for c in ("cls", "label", "n", "block"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(cls), -1).view(_U)
        lists = table.column("shingles").combine_chunks()
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(_U)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        root = {x: x for x in label.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        edges = []
        for p in range(0, len(left), TILE):
            for q in range(0, len(right), TILE):
                if i == j and q < p:
                    continue
                r, c = left[p : p + TILE], right[q : q + TILE]
                apart = np.bitwise_count(sketch[r][:, None, :] ^ sketch[c][None, :, :]).sum(axis=2, dtype=np.int64)
                wanted = (apart <= bound) & (label[r][:, None] != label[c][None, :])
                wanted &= 100 * np.minimum(n[r][:, None], n[c][None, :]) >= percent * np.maximum(n[r][:, None], n[c][None, :])
                if not wanted.any():
                    continue
                r, c = r[wanted.any(axis=1)], c[wanted.any(axis=0)]
                wanted = wanted[np.ix_(wanted.any(axis=1), wanted.any(axis=0))]
                shared = common([flat[offsets[k] : offsets[k + 1]] for k in r], [flat[offsets[k] : offsets[k + 1]] for k in c], wanted)
                linked = wanted & (100 * shared >= percent * (n[r][:, None] + n[c][None, :] - shared))
                for x, y in zip(*np.nonzero(linked), strict=True):
                    u, v = find(int(label[r[x]])), find(int(label[c[y]]))
                    if u != v:
                        root[u] = v
                        edges.append((int(cls[r[x]]), int(cls[c[y]])))
        e = np.array(edges, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": e[:, 0], "b": e[:, 1]})

    return _blocked(anchored, about, sets, percent, scratch).groupBy("anchor", "i", "j").applyInArrow(run, "a long, b long")


def _labelled(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The features of each row, and for each set (d1, d2, n) the label of its component and the component's smallest doc_id."""
    ship(docs.sparkSession)
    scratch = Scratch()
    shingled = written(features(docs, width), "features")
    named = shingled.where("n > 0 and doc_id is not null")
    classes = named.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = scratch.written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    banded = scratch.written(classes.select("cls", F.explode("bands").alias("key")), "banded")
    buckets = banded.groupBy("key").agg(F.min("cls").alias("hub"), F.count("*").alias("size")).where("size > 1")
    # a table of its own, so that a bucket that many classes share can be dealt over tasks
    members = scratch.written(banded.join(scratch.written(buckets, "buckets"), "key").select("key", "cls", "hub"), "members")
    about = classes.select(F.col("cls").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("ask"))
    about_b = about.withColumnsRenamed({"a": "b", "an": "bn", "ask": "bsk"})
    # first, each class with the smallest that it shares a bucket with and may be like
    stars = members.where("cls > hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
    stars = stars.join(about, "a").join(about_b, "b").where(_near(percent)).groupBy("b").agg(F.min("a").alias("a"))
    stars = scratch.written(stars.select("a", "b"), "stars")
    # the full sets of all classes that share a bucket with another
    wanted = members.select("cls").distinct().join(classes.select("cls", "least", F.col("d1").alias("w1"), F.col("d2").alias("w2")), "cls")
    wanted = scratch.written(wanted, "wanted")
    # there is no bound on how many these are: joined alike at every size, never by broadcast
    texts = docs.select(F.col("doc_id").alias("least"), "text").hint("merge").join(wanted.select("least", "cls"), "least")
    sets = full_sets(texts, width).join(wanted.select("cls", "w1", "w2"), "cls").where("d1 = w1 and d2 = w2").dropDuplicates(["cls"])
    sets = scratch.written(sets.select("cls", "shingles"), "sets")
    linked = scratch.written(_confirmed(stars, sets, percent), "linked")
    labels = scratch.own(components(linked))
    # then, in buckets that hold more than one component, the classes of different ones
    held = members.select("key", "cls").join(labels, members.cls == labels.node, "left").select("key", "cls", F.coalesce("label", "cls").alias("label"))
    held = scratch.written(held, "held")
    counts = held.groupBy("key", "label").agg(F.count("*").alias("times")).groupBy("key")
    counts = counts.agg(F.max_by("label", F.struct("times", -F.col("label"))).alias("anchor"), F.count("*").alias("labels")).where("labels > 1")
    anchored = held.join(scratch.written(counts.select("key", "anchor"), "anchors"), "key").select("anchor", "cls", "label").distinct()
    more = scratch.written(_cross_links(scratch.written(anchored, "anchored"), about, sets, percent, scratch), "more")
    if not more.isEmpty():
        labels = scratch.own(components(linked.union(more)))
    placed = classes.select("d1", "d2", "n", "cls", "least").join(labels, F.col("cls") == F.col("node"), "left")
    placed = scratch.written(placed.select("d1", "d2", "n", "least", F.coalesce("label", "cls").alias("label")), "labelled")
    lowest = scratch.written(placed.groupBy("label").agg(F.min("least").alias("component_id")), "lowest")
    placed = written(placed.join(lowest, "label").select("d1", "d2", "n", "label", "component_id"), "placed")
    scratch.drop()
    return shingled, placed


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach, itself
    included) and kept (whether that is its own) for each row.

    Links have 100 x intersection >= percent x union of the sets of distinct
    `width`-word shingles; words are lower-cased (A-Z) and end at ASCII white space.
    """
    shingled, placed = _labelled(docs, width, percent)
    out = shingled.select("doc_id", "n", "d1", "d2").join(placed.drop("label"), ["d1", "d2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def distinct_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, as they came, but of each component one row alone: that of
    the smallest doc_id, and of the smallest digest of its text among those.

    Rows are told apart by doc_id and text, so that a doc_id that occurs with
    several texts loses only those that are in a component with another. Of rows
    equal in both one stays. Rows that link with nothing all stay.
    """
    shingled, placed = _labelled(docs, width, percent)
    rows = shingled.where("n > 0 and doc_id is not null").select("doc_id", "who", "n", "d1", "d2").join(placed.drop("component_id"), ["d1", "d2", "n"])
    rows = written(rows.groupBy("doc_id", "who", "label").agg(F.count("*").alias("times")), "rows")
    first = written(rows.groupBy("label").agg(F.min(F.struct("doc_id", "who")).alias("first")), "first")
    judged = rows.join(first, "label").select("doc_id", "who", "times", (F.struct("doc_id", "who") == F.col("first")).alias("stays"))
    i, w = free_name(docs, "_id"), free_name(docs, "_who")
    told = judged.where("not stays or times > 1").select(F.col("doc_id").alias(i), F.col("who").alias(w), "stays")
    told = written(told, "told")
    gone, again = (told.where(x).select(i, w) for x in ("not stays", "stays"))
    # there is no bound on how many are told: joined alike at every size, never by broadcast
    by = lambda t: (docs["doc_id"] == t[i]) & (text_digest(docs["text"]) == t[w])
    one = None
    if not again.isEmpty():
        one = docs.hint("merge").join(again, by(again), "left_semi").dropDuplicates(["doc_id", "text"])
        gone = told.select(i, w)
    dropped(shingled, placed, rows, first)
    kept = docs.hint("merge").join(gone, by(gone), "left_anti")
    return kept if one is None else kept.unionByName(one)
