"""Mixing sources to target weights by Sainte-Lague apportionment (operator 8).

Built-in DataFrame functions only. Each source's documents form a stream in a
seeded order, cut into blocks of equal words: as many words as give the source of
the least target some thousand blocks, or one. Blocks are dealt to sources by highest
quotients target / (2 n + 1), for each shard of the mix, which gives whole quotas. A
source's blocks are chosen by whole passes over its stream and, for what remains, by
an even spread from a seeded start; the first shard gets as many of them, in that
order, as its quota says, the second the next, and so on.

Quotas and targets are worked out over one row for each source, in one task: for
millions of sources, not for as many as there are documents.

Cases: a null text has size 0 and is taken 0 words. Null is a source of its own,
last in order. Rows are documents of their own, whatever ids they repeat; those
with a null doc_id are drawn by text. Rows equal in doc_id, source and size that
are drawn alike lie side by side in the stream, and it is all one which is which; so
reruns agree, however the table is cut into files and tasks. Sources without words get the target 0. An
empty table gives an empty result. Columns beside doc_id, text and source aren't
read by `mix`, and pass through `mixed`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnow.llm.shared import dropped, with_starts, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
SHARDS = 8
#: Blocks that the least target makes, unless it has fewer words: every source's quota is exact to one block.
BLOCKS_A_SOURCE = 1000
#: Rows that are drawn alike are dealt over so many windows.
_SALTS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null: null comes last by code point, as no other key starts with it."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The words each source is to give: key, source_size, target.

    sizes has one row for each source (key, source_size). Sources by code point
    weigh `weights` in turn and share `share` times all words; no target exceeds
    `most` times its source's size, and what is over goes to the others by weight,
    until none is above. In closed form: least(weight x level, cap), the level
    being the first, with sources by cap / weight, at which all after are below
    their caps.
    """
    rank = F.row_number().over(Window.orderBy("key"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double"))
    s = s.withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = share * F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weighs = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("at", left / weighs).withColumn("at", F.when(F.col("at") <= F.col("ratio"), F.col("at")))
    first = F.min_by("at", F.when(F.col("at").isNotNull(), F.struct("ratio", "key"))).over(everything)
    level = F.coalesce(first, F.lit(float("inf")))
    return s.select("key", "source_size", F.round(F.least(F.col("w") * level, "cap"), 6).alias("target"))


def quotas(wanted: DataFrame, shards: int = SHARDS, blocks_a_source: int = BLOCKS_A_SOURCE) -> DataFrame:
    """Sainte-Lague: key, shard, quota (blocks), block (words of a block, the same for all).

    The blocks of the first s shards are apportioned together, and a shard gets
    what they have more than the first s - 1; as no source loses by a larger
    house, that is never negative, and the quotas add up to one apportionment of
    the whole mix. Quotients that are surely among the highest are taken at once;
    the rest, at most two for each source, are ranked.
    """
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = wanted.withColumn("total", F.sum("target").over(everything)).withColumn("n", F.count("*").over(everything))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    s = s.withColumn("block", F.greatest(F.lit(1), F.coalesce(F.floor(least / blocks_a_source), F.lit(1))))
    s = s.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    s = s.withColumn("house", F.floor(F.floor(F.col("total") / F.col("block")) * F.col("shard") / shards))
    part = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(0.0)
    s = s.withColumn("sure", F.floor(part * F.greatest(F.col("house") - F.col("n") / 2, F.lit(0)) + 0.5))
    s = s.withColumn("upper", F.floor(part * (F.col("house") + F.col("n") / 2) + 0.5))
    more = s.where("upper > sure").withColumn("seat", F.explode(F.sequence(F.col("sure") + 1, F.col("upper"))))
    more = more.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("seat") - 1)).desc(), "key")))
    sure = s.groupBy("shard").agg(F.sum("sure").alias("all_sure"))
    more = more.join(sure, "shard").where(F.col("place") <= F.col("house") - F.col("all_sure"))
    seats = s.select("key", "shard", "block", F.col("sure").alias("seats")).union(more.select("key", "shard", "block", F.lit(1).cast("bigint")))
    seats = seats.groupBy("key", "shard").agg(F.sum("seats").alias("seats"), F.first("block").alias("block"))
    less = F.coalesce(F.lag("seats").over(Window.partitionBy("key").orderBy("shard")), F.lit(0))
    return seats.select("key", (F.col("shard") - 1).alias("shard"), (F.col("seats") - less).alias("quota"), "block")


def _phase(seed: str) -> Column:
    """Where in its stream a source's even spread starts: 0 to 1, by seed and source."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("key"))), 1, 8), 16, 10).cast("long") / float(2**32)


def _placed(rows: DataFrame) -> DataFrame:
    """rows (key, draw, size, bucket, salt and others) with `first`, where each starts in its source's stream.

    Rows alike in key, draw and size are counted by salt, so that they are placed
    together and numbered apart; which of them is which doesn't matter.
    """
    alike = ["key", "draw", "size"]
    before = Window.partitionBy(*alike).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*alike, "bucket", "salt").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    places = with_starts(counts.withColumn("words", F.col("n") * F.col("size")), ["key"], "bucket", ["draw", "size", "salt"], {"start": (F.sum, F.col("words"), 0)})
    own = F.row_number().over(Window.partitionBy(*alike, "salt").orderBy("bucket")) - 1
    numbered = rows.withColumn("own", own).join(places.select(*alike, "salt", "start"), [*alike, "salt"])
    return numbered.withColumn("first", F.col("start") + F.col("own") * F.col("size")).drop("own", "start")


def _plan(wanted: DataFrame, shards: int, most: float, seed: str, blocks_a_source: int) -> DataFrame:
    """For each source: target, how its blocks are chosen (passes, rate, phase), and `ends`,
    up to which of the chosen blocks each shard gets them."""
    quota = quotas(wanted, shards, blocks_a_source)
    upto = quota.withColumn("end", F.sum("quota").over(Window.partitionBy("key").orderBy("shard")))
    ends = F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"])
    plan = wanted.join(upto.groupBy("key").agg(ends.alias("ends"), F.first("block").alias("block")), "key")
    plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block"))).withColumn("at_most", F.floor(F.col("blocks") * most))
    plan = plan.withColumn("ends", F.transform("ends", lambda e: F.least(e, F.col("at_most")))).withColumn("quota", F.element_at("ends", -1))
    some = F.col("blocks") > 0
    plan = plan.withColumn("passes", F.when(some, F.floor(F.col("quota") / F.col("blocks"))).otherwise(F.lit(0)))
    plan = plan.withColumn("rate", F.when(some, (F.col("quota") - F.col("passes") * F.col("blocks")) / F.col("blocks")).otherwise(F.lit(0.0)))
    return plan.withColumn("phase", _phase(seed)).select("key", "source_size", "target", "block", "blocks", "passes", "rate", "phase", "ends")


def _mix(docs: DataFrame, carried: list[Column], weights: Sequence[float], share: float, most: float, seed: str, shards: int, blocks_a_source: int) -> DataFrame:
    """The columns of `mix`, and those carried."""
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))))
    rows = docs.select(*carried, source_key(F.col("source")).alias("key"), n_words(F.col("text")).alias("size"), draw.alias("draw"), (F.spark_partition_id() % _SALTS).alias("salt"))
    rows = written(rows.withColumn("bucket", F.conv(F.substring("draw", 1, 3), 16, 10).cast("int")), "sizes")
    wanted = written(targets(rows.groupBy("key").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    plan = written(_plan(wanted, shards, most, seed, blocks_a_source), "plan")
    dropped(wanted)
    placed = _placed(rows).join(plan, "key")

    def chosen(b: Column) -> Column:
        """How many of the blocks before the b-th are chosen, besides the passes."""
        return F.floor(b * F.col("rate") + F.col("phase"))

    def words(x: Column) -> Column:
        """How many of the stream's words before x are in chosen blocks."""
        b = F.floor(x / F.col("block"))
        return F.col("block") * chosen(b) + (x - b * F.col("block")) * (chosen(b + 1) - chosen(b))

    # where the document is among its source's chosen words, pass by pass
    last, a_pass = F.col("first") + F.col("size"), F.col("blocks") * F.col("block")
    spread = F.struct((F.col("passes") * a_pass + words(F.col("first"))).alias("a"), (F.col("passes") * a_pass + words(last)).alias("b"))
    whole = F.transform(F.sequence(F.lit(1), F.col("passes").cast("int")), lambda p: F.struct(((p - 1) * a_pass + F.col("first")).alias("a"), ((p - 1) * a_pass + last).alias("b")))
    placed = placed.withColumn("runs", F.concat(F.when(F.col("passes") > 0, whole).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>")), F.array(spread)))

    def of_shard(k: Column) -> Column:
        """How many of the document's chosen words are the k-th shard's."""
        low, high = F.when(k > 0, F.col("ends")[k - 1]).otherwise(F.lit(0)) * F.col("block"), F.col("ends")[k] * F.col("block")
        return F.aggregate("runs", F.lit(0).cast("long"), lambda sum_, r: sum_ + F.greatest(F.least(r["b"], high) - F.greatest(r["a"], low), F.lit(0)))

    by_shard = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), of_shard)
    at = F.floor(F.col("first") / F.col("block"))
    copies = F.col("passes") + chosen(at + 1) - chosen(at)
    placed = placed.withColumns({"by_shard": by_shard, "copies": copies.cast("int")})
    return placed.withColumn("taken", F.aggregate("by_shard", F.lit(0).cast("long"), lambda a, b: a + b))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, shards: int = SHARDS, blocks_a_source: int = BLOCKS_A_SOURCE) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), by_shard (words
    that each shard takes), first (where the document starts in its source's stream) and
    copies: how often the mix takes it if it takes documents whole."""
    out = _mix(docs, [F.col("doc_id")], weights, share, most, seed, shards, blocks_a_source)
    return out.select("doc_id", "size", "source_size", "target", "taken", "by_shard", "first", "copies")


def first_shard(by_shard: Column) -> Column:
    """The first shard that takes words of a document; null if none does."""
    return F.nullif(F.array_position(F.transform(by_shard, lambda n: n > 0), F.lit(True)), F.lit(0)).cast("int") - 1


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, shards: int = SHARDS, blocks_a_source: int = BLOCKS_A_SOURCE) -> DataFrame:
    """The rows of docs, each as often as the mix takes it if it takes documents whole."""
    out = _mix(docs, [F.struct("*").alias("row")], weights, share, most, seed, shards, blocks_a_source).where("copies > 0")
    return out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
