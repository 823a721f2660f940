"""Reviews by outer services: which ones there are, whose answer counts, and what holds if none answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnow.config import DedupThresholds
from winnow.functions import text


def provider_order(configured: dict[str, Column], preferred: Column, enabled: Column) -> Column:
    """The providers that are configured, in order, the preferred one first if it is
    among them (in any case); none where reviews are switched off."""
    there = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in configured.items()]), lambda x: x.isNotNull())
    first = F.lower(F.coalesce(preferred, F.lit("")))
    order = F.when(F.array_contains(there, first), F.concat(F.array(first), F.array_remove(there, first))).otherwise(there)
    return F.when(F.lower(F.coalesce(enabled, F.lit("true"))) == "false", F.array().cast("array<string>")).otherwise(order)


def reviewed(pairs: DataFrame, replies: DataFrame, order: Sequence[str], t: DedupThresholds = DedupThresholds()) -> DataFrame:
    """Gray pairs (trip_id, i, j, sim) with is_duplicate, confidence, provider and fell_back.

    replies: trip_id, i, j, provider, reply (text). The first provider in order with
    a sound verdict counts; where none has, the strict threshold does.
    """
    place = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("provider"))
    sound = replies.select("trip_id", "i", "j", "provider", place.alias("place"), text.pair_verdict(F.col("reply")).alias("v")).where("v is not null and place > 0")
    first = sound.groupBy("trip_id", "i", "j").agg(F.min_by(F.struct("provider", "v"), "place").alias("r"))
    strict = F.col("sim") >= t.strict
    out = pairs.join(first, ["trip_id", "i", "j"], "left")
    return out.withColumns(
        {
            "is_duplicate": F.coalesce("r.v.is_duplicate", strict),
            "confidence": F.coalesce("r.v.confidence", F.when(strict, t.strict).otherwise(0.0)),
            "provider": F.col("r.provider"),
            "fell_back": F.col("r").isNull(),
        }
    ).drop("r")


def sticky(calls: DataFrame, models: Sequence[str]) -> DataFrame:
    """Calls (session, place, one boolean column for each model that says whether it
    would answer) with `used`: until a model has answered all are tried in order,
    and from then on that one alone; null if none answers."""
    first = F.coalesce(*[F.when(F.col(m), F.lit(m)) for m in models])
    so_far = Window.partitionBy("session").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    pinned = calls.withColumn("_pin", F.first(first, ignorenulls=True).over(so_far))
    used = F.coalesce(*[F.when((F.col("_pin") == m) & F.col(m), F.lit(m)) for m in models])
    return pinned.withColumn("used", used).drop("_pin")


def merged_windows(reviews: DataFrame) -> DataFrame:
    """Pairs (a, b) of neighbours that a review of a window (window, place, id, duplicate) puts together:
    a member that is a duplicate goes with the one before it."""
    before = F.lag("id").over(Window.partitionBy("window").orderBy("place"))
    return reviews.withColumn("a", before).where("duplicate and a is not null").select("a", F.col("id").alias("b"))


def marks(technical: Column, aesthetic: Column, technical_error: Column, aesthetic_error: Column) -> Column:
    """Two models' marks, rounded to two places half to even, with what failed: null where it did."""
    errors = F.array(*[F.when(e.isNotNull(), F.concat(F.lit(f"{n}: "), e)) for n, e in (("technical", technical_error), ("aesthetic", aesthetic_error))])
    return F.struct(
        F.when(technical_error.isNull(), F.bround(technical, 2)).alias("technical"),
        F.when(aesthetic_error.isNull(), F.bround(aesthetic, 2)).alias("aesthetic"),
        text.joined_errors(errors).alias("error"),
    )
