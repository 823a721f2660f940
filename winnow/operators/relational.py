"""Listings, galleries, tags and access: declarative reads of the media library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnow.functions import text

CATEGORIES = ("people", "animal", "landscape", "other")
HIDDEN = ("uploading", "cancelled")


def displayable() -> Column:
    """Not being uploaded or cancelled; a missing status counts as displayable."""
    return F.col("processing_status").isNull() | ~F.col("processing_status").isin(*HIDDEN)


def not_blurry() -> Column:
    """A missing blur status counts as not blurry."""
    return ~F.col("blur_status").eqNullSafe(F.lit("blurry"))


def trip_listing(trips: DataFrame, media: DataFrame, viewer: int | None = None, admin: bool = False, active_only: bool = False) -> DataFrame:
    """Trips with their number of media, newest first: public ones; or a viewer's own; or, for an admin, all.

    Media are counted before the join, so that trips without any have 0.
    """
    own = trips if admin else trips.where(F.col("user_id") == viewer) if viewer is not None else trips.where("visibility = 'public'")
    counted = media.where("status = 'active'") if active_only else media
    counts = counted.groupBy("trip_id").agg(F.count("*").alias("n"))
    out = own.join(counts, own.id == counts.trip_id, "left")
    return out.select("id", "title", text.excerpt(F.col("description")).alias("excerpt"), "visibility", F.coalesce("n", F.lit(0)).alias("media_count"), "created_at").orderBy(F.desc("created_at"), "id")


def media_item(media: DataFrame) -> DataFrame:
    """Media as clients see them: empty and missing states take their defaults."""
    defaults = {"status": "active", "visibility": "public", "processing_status": "none"}
    return media.withColumns({c: text.default(F.col(c), d) for c, d in defaults.items()}).withColumns({"thumbnail_url": text.thumbnail_url(F.col("id")), "original_url": text.original_url(F.col("id"))})


def visible(owner: bool) -> Column:
    return F.lit(True) if owner else F.col("visibility") == "public"


def category_filter(category: str | None) -> Column:
    """Media of a category; a name that is none is passed over."""
    return F.col("category") == category if category in CATEGORIES else F.lit(True)


def gallery_images(media: DataFrame, groups: DataFrame, owner: bool = False, category: str | None = None, tags: DataFrame | None = None, tag: str | None = None) -> DataFrame:
    """Images of galleries: the default image of each duplicate group, and images in no group."""
    shown = media.where((F.col("status") == "active") & (F.col("media_type") == "image") & visible(owner) & category_filter(category))
    if tags is not None and tag:
        shown = with_tag(shown, tags, tag)
    defaults = groups.where("default_image_id is not null").select(F.col("trip_id").alias("trip"), F.col("default_image_id"), "image_count")
    grouped = defaults.join(shown, F.col("default_image_id") == F.col("id")).select(F.col("trip").alias("trip_id"), "id", "image_count")
    alone = shown.where("duplicate_group_id is null").select("trip_id", "id", F.lit(1).cast("long").alias("image_count"))
    return grouped.unionByName(alone)


def gallery_videos(media: DataFrame, owner: bool = False, with_hidden: bool = False) -> DataFrame:
    """Videos of galleries; the older listing also shows those being uploaded or cancelled."""
    shown = media.where((F.col("status") == "active") & (F.col("media_type") == "video") & visible(owner))
    return shown if with_hidden else shown.where(displayable())


def with_tag(media: DataFrame, tags: DataFrame, tag: str, key: str = "id") -> DataFrame:
    """Media that have a tag, each once."""
    has = tags.where(F.col("tag_name") == text.normalise_tag(F.lit(tag))).select(F.col("media_id").alias(key))
    return media.join(has, key, "left_semi")


def generated_tags(media: DataFrame, title: Column, kind: Column, name: Column, day: Column, key: str) -> DataFrame:
    """The tags that uploading gives: trip title, kind, extension and month, normalised; empty ones are left out."""
    all_ = F.array(title, kind, text.extension(name), text.year_month(day))
    return media.select(F.col(key).alias("media_id"), F.explode(all_).alias("raw")).select("media_id", text.normalise_tag(F.col("raw")).alias("tag_name")).where("tag_name <> ''")


def orphans(media: DataFrame, groups: DataFrame) -> DataFrame:
    """Media that refer to a group that isn't there."""
    named = media.where("duplicate_group_id is not null")
    return named.join(groups.select(F.col("id").alias("duplicate_group_id")), "duplicate_group_id", "left_anti")


def covers(media: DataFrame) -> DataFrame:
    """The cover of each trip: its best image (by score, nulls last, then oldest), else its first video."""
    best = Window.partitionBy("trip_id", "media_type").orderBy(F.desc_nulls_last(F.when(F.col("media_type") == "image", F.col("quality_score"))), "created_at", "id")
    top = media.where("media_type in ('image', 'video')").withColumn("rn", F.row_number().over(best)).where("rn = 1")
    return top.groupBy("trip_id").agg(F.coalesce(F.max(F.when(F.col("media_type") == "image", F.col("id"))), F.max(F.when(F.col("media_type") == "video", F.col("id")))).alias("cover_id"))


def category_stats(media: DataFrame) -> DataFrame:
    """Active media of each trip by category; unknown and missing ones are other."""
    known = F.when(F.col("category").isin(*CATEGORIES[:3]), F.col("category")).otherwise("other")
    return media.where("status = 'active'").groupBy("trip_id").agg(*[F.count_if(known == c).alias(c) for c in CATEGORIES])


def category_counts(media: DataFrame) -> DataFrame:
    """Counts for the tabs of a gallery: each category, and all."""
    known = F.when(F.col("category").isin(*CATEGORIES[:3]), F.col("category")).otherwise("other")
    return media.select(known.alias("category")).rollup("category").agg(F.count("*").alias("n")).select(F.coalesce("category", F.lit("all")).alias("category"), "n")


def may_manage(viewer: int, role: str) -> Column:
    """Owner of the media, owner of the trip, or admin; a missing owner is nobody."""
    own = (F.col("media_user_id") == viewer) | (F.col("trip_user_id") == viewer)
    return F.coalesce(own, F.lit(False)) | F.lit(role == "admin")


def login_outcome(password_ok: Column) -> Column:
    return F.when(F.col("status").isNull() | ~F.coalesce(password_ok, F.lit(False)), "invalid").when(F.col("status") == "pending", "pending").when(F.col("status") == "rejected", "rejected").when(F.col("status") == "disabled", "disabled").otherwise("ok")


def in_order(ids: DataFrame, rows: DataFrame, key: str, missing: dict) -> DataFrame:
    """Rows of a list of ids (pos, key) in its order; what isn't there takes the values of `missing`."""
    out = ids.join(rows, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in missing.items()}).orderBy("pos")


def trip_object(trips: DataFrame) -> DataFrame:
    """Trips as clients see them: a missing description is empty."""
    return trips.withColumn("description", F.coalesce("description", F.lit("")))


def group_object(groups: DataFrame) -> DataFrame:
    """Duplicate groups as clients see them: a missing default image is empty."""
    return groups.withColumn("default_image_id", F.coalesce("default_image_id", F.lit("")))


def event_object(events: DataFrame) -> DataFrame:
    """Job events as clients see them: info unless they say otherwise, and without a step an empty one."""
    return events.withColumns({"level": text.default(F.col("level"), "info"), "step": F.coalesce("step", F.lit(""))})


def cover_urls(trips: DataFrame, media: DataFrame) -> DataFrame:
    """Trips with the address of their cover, empty if they have none."""
    c = covers(media)
    return trips.join(c, trips.id == c.trip_id, "left").withColumn("cover_url", F.coalesce(text.thumbnail_url(F.col("cover_id")), F.lit("")))


def members(groups: DataFrame, media: DataFrame) -> DataFrame:
    """Media of duplicate groups, with group_id and whether they are its default image."""
    g = groups.select(F.col("id").alias("group_id"), F.col("trip_id").alias("group_trip"), "default_image_id")
    out = media.join(g, (media.duplicate_group_id == g.group_id) & (media.trip_id == g.group_trip))
    return out.withColumn("is_default", F.coalesce(F.col("id") == F.col("default_image_id"), F.lit(False))).drop("group_trip", "default_image_id")


def classified(media: DataFrame, answers: DataFrame) -> DataFrame:
    """Media (id) with category and source, by a local model's answers (media_id, local), which may lack some."""
    out = media.join(answers, media.id == answers.media_id, "left")
    return out.select("id", F.coalesce("local", F.lit("other")).alias("category"), F.when(F.col("local").isNull(), "fallback").otherwise("local").alias("source"))


def indexed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with seq, from 0 for each key, in order."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def batched(rows: DataFrame, size: int) -> DataFrame:
    """Rows with seq, with the number of the batch of `size` that they are in."""
    return rows.withColumn("batch", F.floor(F.col("seq") / size))


def viewers(requests: DataFrame, users: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Requests (event_id, viewer_id) with the role of their viewer; nobody known is anonymous."""
    u = users.select(F.col("id").alias("viewer_id"), "role")
    return requests.join(u, "viewer_id", "left").select("event_id", "viewer_id", F.coalesce("role", F.lit("anonymous")).alias("viewer"), *(keep or []))


def guarded(needs: Column) -> Column:
    """The status of a request by a viewer: who is needed is anonymous (anyone), regular (anyone known) or admin."""
    unknown = (needs != "anonymous") & (F.col("viewer") == "anonymous")
    return F.when(unknown, 401).when((needs == "admin") & (F.col("viewer") != "admin"), 403).otherwise(200)


def gallery(media: DataFrame, groups: DataFrame, owner: bool = False) -> DataFrame:
    """What the galleries of all trips show: images, a group by its default image alone, and videos."""
    images = gallery_images(media, groups, owner).select("trip_id", "id", F.lit("image").alias("kind"))
    return images.unionByName(gallery_videos(media, owner).select("trip_id", "id", F.lit("video").alias("kind")))
