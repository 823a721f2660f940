"""The curation pipeline of a trip as one plan: classify, gate by blur, assess duplicates, reduce, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.config import DedupThresholds
from winnow.operators import selection
from winnow.operators.relational import CATEGORIES, covers, not_blurry
from winnow.plans import dedup


def curate(images: DataFrame, t: DedupThresholds = DedupThresholds(), mode: str = "tiered") -> DataFrame:
    """A decision for each image (trip_id, seq, v, category, sharpness, blur_status, width, height, file_size).

    Blurry images take no part in the search for duplicates; those with no blur
    status do.
    """
    gate = images.where(not_blurry())
    assessed = dedup.assess(gate.drop("category"), t, mode)
    removed = assessed.images.where(~F.col("kept"))
    return images.select("seq", "trip_id").join(selection.reduced(images, removed), "seq")


def summary(decisions: DataFrame) -> DataFrame:
    """Counts for each trip: images, active and trashed ones by reason, and active ones by category."""
    active = F.col("final_status") == "active"
    return decisions.groupBy("trip_id").agg(
        F.count("*").alias("total"),
        F.count_if(active).alias("active"),
        F.count_if(F.col("trashed_reason") == "blur").alias("blurred"),
        F.count_if(F.col("trashed_reason") == "duplicate").alias("duplicates"),
        *[F.count_if(active & (F.col("final_category") == c)).alias(c) for c in CATEGORIES],
    )


def trip_results(media: DataFrame, decisions: DataFrame) -> DataFrame:
    """What processing a trip reports, one row for each trip of media: images (whatever
    their status) and videos, images trashed for blur and as duplicates, analysed,
    optimised and classified ones, active ones by category, compiled videos, failures
    and the cover.

    decisions: id, final_status, trashed_reasons (a comma list), final_category.
    """
    image, video, active = F.col("media_type") == "image", F.col("media_type") == "video", F.col("final_status") == "active"
    reasons = F.split(F.coalesce("trashed_reasons", F.lit("")), ",")
    lost = lambda r: (F.col("final_status") == "trashed") & F.array_contains(reasons, r)
    known = F.when(F.col("final_category").isin(*CATEGORIES), F.col("final_category")).otherwise("other")
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    out = media.join(decisions, "id", "left").groupBy("trip_id").agg(
        F.count_if(image).alias("total_images"),
        F.count_if(video).alias("total_videos"),
        F.count_if(lost("blur")).alias("blurry_deleted"),
        F.count_if(lost("duplicate")).alias("dedup_deleted"),
        F.count_if(image & (F.col("status") == "active") & F.col("avg_brightness").isNotNull()).alias("analyzed"),
        F.count_if(image & has("optimized_path")).alias("optimized"),
        F.count_if(F.col("final_category").isNotNull()).alias("classified"),
        *[F.count_if(active & (known == c)).alias(c) for c in CATEGORIES],
        F.count_if(video & has("compiled_path")).alias("compiled"),
        F.count_if(F.col("processing_status") == "cancelled").alias("failed"),
    )
    return out.join(covers(media), "trip_id", "left").withColumn("cover_id", F.coalesce("cover_id", F.lit("")))
