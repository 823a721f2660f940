"""Which of a group of duplicates is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnow.functions import text

_FIELDS = ("seq", "sharpness", "pixels", "file_size", "blur_status")


def _members(rows: DataFrame, group: str) -> DataFrame:
    """Members of each group in order; a group is one array of narrow structs, as the rules below read it in turn."""
    m = F.struct("seq", F.coalesce(F.col("sharpness").cast("double"), F.lit(0.0)).alias("sharpness"), (F.coalesce("width", F.lit(0)).cast("long") * F.coalesce("height", F.lit(0))).alias("pixels"), F.col("file_size").cast("long").alias("file_size"), "blur_status")
    return rows.groupBy(group).agg(F.sort_array(F.collect_list(m)).alias("m"))


def _fold(m: Column, better) -> Column:
    """The member left when each in turn is set against the best so far."""
    return F.aggregate(F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(1))), F.element_at(m, 1), lambda best, cur: F.when(better(best, cur), cur).otherwise(best))


def keep_best(rows: DataFrame, group: str = "label") -> DataFrame:
    """seq kept of each group: suspects give way to clear members; in order, a member over 1.2 times
    as sharp as the best so far replaces it, one under 0.8 times doesn't, and between that the larger
    image or file does. The outcome depends on the order, so no ranking can give it.
    """
    clear = F.exists("m", lambda x: F.coalesce(x["blur_status"] == "clear", F.lit(False)))
    pool = F.when(clear, F.filter("m", lambda x: ~x["blur_status"].eqNullSafe(F.lit("suspect")))).otherwise(F.col("m"))

    def better(best: Column, cur: Column) -> Column:
        larger = (cur["pixels"] > best["pixels"]) | ((cur["pixels"] == best["pixels"]) & (cur["file_size"] > best["file_size"]))
        return (cur["sharpness"] > best["sharpness"] * 1.2) | ((cur["sharpness"] >= best["sharpness"] * 0.8) & larger)

    return _members(rows, group).withColumn("m", pool).select(group, _fold(F.col("m"), better)["seq"].alias("keep"))


def keep_by_rank(rows: DataFrame, score: str, group: str = "label") -> DataFrame:
    """seq kept of each group: best score, then most pixels, then largest file, then first."""
    pixels = F.coalesce("width", F.lit(0)).cast("long") * F.coalesce("height", F.lit(0))
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), pixels.desc(), F.desc("file_size"), "seq")
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").select(group, F.col("seq").alias("keep"))


def keep_by_key(rows: DataFrame, group: str = "label") -> DataFrame:
    """seq kept of each group: the greatest (sharpness, pixels, size), the first of equal ones."""
    key = F.struct(F.coalesce("sharpness", F.lit(0.0)), F.coalesce("width", F.lit(0)).cast("long") * F.coalesce("height", F.lit(0)), F.col("file_size"), -F.col("seq"))
    return rows.groupBy(group).agg(F.max_by("seq", key).alias("keep"))


def keep_by_pairs(rows: DataFrame, group: str = "label", apart: float = 10.0) -> DataFrame:
    """seq kept of each group when its members meet in turn: sharpness decides if it differs by `apart`, else pixels, else the earlier."""

    def better(best: Column, cur: Column) -> Column:
        far = F.abs(cur["sharpness"] - best["sharpness"]) >= apart
        return F.when(far, cur["sharpness"] > best["sharpness"]).otherwise(cur["pixels"] > best["pixels"])

    return _members(rows, group).select(group, _fold(F.col("m"), better)["seq"].alias("keep"))


def flagged(images: DataFrame, removed: DataFrame) -> DataFrame:
    """Images with `gone`, whether they are among those removed."""
    gone = removed.select("seq", F.lit(True).alias("gone")).distinct()
    return images.join(gone, "seq", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))


def reduced(images: DataFrame, removed: DataFrame) -> DataFrame:
    """One decision for each image: trashed for blur, else as a duplicate, else active; what is missing takes its default."""
    blurry = F.coalesce(F.col("blur_status") == "blurry", F.lit(False))
    reason = F.when(blurry, "blur").when(F.col("gone"), "duplicate")
    return flagged(images, removed).select(
        "seq",
        F.coalesce("blur_status", F.lit("suspect")).alias("final_blur_status"),
        F.coalesce("category", F.lit("other")).alias("final_category"),
        F.when(F.col("category").isNull(), "fallback").otherwise("model").alias("category_source"),
        F.when(reason.isNull(), "active").otherwise("trashed").alias("final_status"),
        F.coalesce(reason, F.lit("")).alias("trashed_reason"),
    )


def best_among_active(rows: DataFrame, score: str, group: str = "label") -> DataFrame:
    """seq kept of each group: its one active member, whatever the scores; else, of active
    members if there are any and of all if not, the best by score, pixels, file and order."""
    alive = F.col("status") == "active"
    counted = rows.withColumn("_active", F.count_if(alive).over(Window.partitionBy(group)))
    pool = counted.where((F.col("_active") == 0) | alive).withColumn(score, F.coalesce(score, F.lit(0.0)))
    return keep_by_rank(pool.drop("_active"), score, group)


def written_best(rows: DataFrame, kept: DataFrame, group: str = "label") -> DataFrame:
    """rows of groups after the choice (group, keep): the others are trashed as duplicates; those
    that were trashed before have that added to their reasons."""
    out = rows.join(kept, group, "left")
    lost = F.coalesce(F.col("keep") != F.col("seq"), F.lit(False))
    reason = F.when(F.col("status") == "trashed", text.append_reason(F.col("trashed_reason"), "duplicate")).otherwise("duplicate")
    return out.withColumns({"trashed_reason": F.when(lost, reason).otherwise(F.col("trashed_reason")), "status": F.when(lost, "trashed").otherwise(F.col("status"))}).drop("keep")


def best_listed(lists: DataFrame, scores: DataFrame) -> DataFrame:
    """The best of each list (list, pos, id) by score (id, score); one that has none counts as 0, and the first of equal ones wins."""
    s = lists.join(scores, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return s.groupBy("list").agg(F.max_by("id", F.struct("score", -F.col("pos"))).alias("best"), F.max("score").alias("score"))
