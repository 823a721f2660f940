"""Queries on listings, galleries, tags, filters, joins, counts and access."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions import text
from winnow.operators import relational as rel
from winnow.operators import state
from winnow.plans.prelude import sql
from winnow.plans.registry import query
from winnow.sources import adapters as src
from winnow.sources import files

_LISTING = """select t.id, case when length(description) > 100 then substr(description, 1, 100) || '...' else coalesce(description, '') end as excerpt, visibility,
coalesce(n, 0) as media_count from trips t left join (select trip_id, count(*) as n from media {where} group by trip_id) m on t.id = m.trip_id {own}"""


def _listed(df):
    return df.select("id", "excerpt", "visibility", "media_count")


@query("d1_trip_listing_public", sql("trips media", _LISTING.format(where="", own="where visibility = 'public'")))
def trip_listing_public(spark, d):
    return _listed(rel.trip_listing(src.trips(spark, d), src.media(spark, d)))


@query("d2_trip_listing_owner_active", sql("trips media", _LISTING.format(where="where status = 'active'", own="where user_id = 100")))
def trip_listing_owner(spark, d):
    return _listed(rel.trip_listing(src.trips(spark, d), src.media(spark, d), viewer=100, active_only=True))


@query("r6_trip_listing_admin", sql("trips media", _LISTING.format(where="where status = 'active'", own="")))
def trip_listing_admin(spark, d):
    return _listed(rel.trip_listing(src.trips(spark, d), src.media(spark, d), admin=True, active_only=True))


_SHOWN = "status = 'active' and media_type = 'image'"


@query("d4_gallery_default_images", sql("media grps", f"select g.trip_id, m.id, g.image_count from grps g join media m on g.default_image_id = m.id where {_SHOWN} and visibility = 'public'"))
def gallery_default_images(spark, d):
    m, g = src.media(spark, d), src.groups(spark, d)
    return rel.gallery_images(m.where("duplicate_group_id is not null"), g)


_UNION = """select g.trip_id, m.id, g.image_count from grps g join media m on g.default_image_id = m.id where {w}
union all select trip_id, id, 1::bigint from media where duplicate_group_id is null and {w}"""


@query("h4_gallery_images_public", sql("media grps", _UNION.format(w=f"{_SHOWN} and visibility = 'public'")))
def gallery_images(spark, d):
    return rel.gallery_images(src.media(spark, d), src.groups(spark, d))


@query("c4_gallery_images_owner", sql("media grps", _UNION.format(w=_SHOWN)))
def gallery_images_owner(spark, d):
    return rel.gallery_images(src.media(spark, d), src.groups(spark, d), owner=True)


@query("c6_gallery_images_category", sql("media grps", _UNION.format(w=f"{_SHOWN} and visibility = 'public' and category = 'people'")))
def gallery_images_category(spark, d):
    return rel.gallery_images(src.media(spark, d), src.groups(spark, d), category="people")


_VIDEOS = "select trip_id, id from media where status = 'active' and media_type = 'video' and visibility = 'public'"


@query("c7_gallery_videos", sql("media", _VIDEOS + " and (processing_status is null or processing_status not in ('uploading', 'cancelled'))"))
def gallery_videos(spark, d):
    return rel.gallery_videos(src.media(spark, d)).select("trip_id", "id")


@query("c8_gallery_videos_older", sql("media", _VIDEOS))
def gallery_videos_older(spark, d):
    return rel.gallery_videos(src.media(spark, d), with_hidden=True).select("trip_id", "id")


@query(
    "h8_gallery_partition",
    sql(
        "media",
        """select trip_id, count(*) filter (where media_type = 'image') as images, count(*) filter (where media_type = 'video') as videos, count(*) as total
        from media where status = 'active' and visibility = 'public' group by trip_id""",
    ),
)
def gallery_partition(spark, d):
    m = src.media(spark, d).where("status = 'active' and visibility = 'public'")
    kind = F.col("media_type")
    return m.groupBy("trip_id").agg(F.count_if(kind == "image").alias("images"), F.count_if(kind == "video").alias("videos"), F.count("*").alias("total"))


@query("d3_media_by_tag", sql("tags", "select doc_id, source from documents where doc_id in (select media_id from tags where tag_name = 'langen')"))
def media_by_tag(spark, d):
    docs = src.table(spark, d, "documents").select("doc_id", "source")
    return rel.with_tag(docs, src.tags(spark, d), " Lang EN ", "doc_id")


@query("d3_tag_join_repeats", sql("tags", "select media_id, count(*) as n from tags where tag_name = 'image' group by media_id"))
def tag_join_repeats(spark, d):
    """The plain join gives a document twice that has a tag twice."""
    docs = src.table(spark, d, "documents").select(F.col("doc_id").alias("media_id"))
    return docs.join(src.tags(spark, d).where("tag_name = 'image'"), "media_id").groupBy("media_id").agg(F.count("*").alias("n"))


@query("i1_tag_counts", sql("tags", "select tag_name, count(*) as n, count(distinct media_id) as media from tags group by tag_name"))
def tag_counts(spark, d):
    return src.tags(spark, d).groupBy("tag_name").agg(F.count("*").alias("n"), F.countDistinct("media_id").alias("media"))


@query(
    "i4_generated_tags",
    sql(
        "media trips",
        r"""select tag_name, count(*) as n from (select regexp_replace(lower(unnest([title, media_type, case when regexp_matches(original_filename, '\.[^.]+$') then regexp_extract(original_filename, '\.([^.]+)$', 1) else '' end,
        strftime(m.created_at, '%Y-%m')])), '\s+', '', 'g') as tag_name from media m join trips t on t.id = m.trip_id) where tag_name <> '' group by tag_name""",
    ),
)
def generated_tags(spark, d):
    t = src.trips(spark, d).select(F.col("id").alias("trip_id"), "title")
    m = src.media(spark, d).join(t, "trip_id")
    tags = rel.generated_tags(m, F.col("title"), F.col("media_type"), F.col("original_filename"), F.col("created_at"), "id")
    return tags.groupBy("tag_name").agg(F.count("*").alias("n"))


@query("d6_orphan_group_refs", sql("media grps", "select id, trip_id from media where duplicate_group_id is not null and not exists (select 1 from grps g where g.id = duplicate_group_id and g.image_count > 1)"))
def orphan_groups(spark, d):
    return rel.orphans(src.media(spark, d), src.groups(spark, d).where("image_count > 1")).select("id", "trip_id")


@query("d7_job_trip_lookup", sql("users trips", "select u.id as job_id, t.id as trip_id, t.visibility from users u join trips t on t.user_id = u.id where u.role = 'admin'"))
def job_trips(spark, d):
    u = src.users(spark, d).where("role = 'admin'").select(F.col("id").alias("user_id"))
    return u.join(src.trips(spark, d), "user_id").select(F.col("user_id").alias("job_id"), F.col("id").alias("trip_id"), "visibility")


@query("r2_media_access", sql("media trips", "select m.id, coalesce(t.user_id = 100, false) or coalesce(m.trip_id % 50 = 0, false) as may from media m left join trips t on t.id = m.trip_id and t.id % 3 <> 0"))
def media_access(spark, d):
    """Who may manage media: the owner of the trip, where there is one, or of the media."""
    t = src.trips(spark, d).where("id % 3 <> 0").select(F.col("id").alias("trip_id"), F.col("user_id").alias("trip_user_id"))
    m = src.media(spark, d).select("id", "trip_id", F.when(F.col("trip_id") % 50 == 0, 100).alias("media_user_id"))
    return m.join(t, "trip_id", "left").select("id", rel.may_manage(100, "regular").alias("may"))


@query("r5_login_outcomes", sql("users", "select id, case when id % 4 = 0 then 'invalid' when status = 'pending' then 'pending' when status = 'disabled' then 'disabled' else 'ok' end as outcome from users"))
def login_outcomes(spark, d):
    return src.users(spark, d).select("id", rel.login_outcome(F.col("id") % 4 != 0).alias("outcome"))


@query("b5_users_without_secrets", sql("users", "select * from users"))
def users(spark, d):
    return src.users(spark, d).drop("password_hash")


@query(
    "b1_media_items",
    sql(
        "media",
        """select id, coalesce(nullif(status, ''), 'active') as status, coalesce(nullif(visibility, ''), 'public') as visibility, coalesce(nullif(processing_status, ''), 'none') as processing_status,
        '/api/media/' || id || '/thumbnail' as thumbnail_url, '/api/media/' || id || '/original' as original_url from media""",
    ),
)
def media_items(spark, d):
    return rel.media_item(src.media(spark, d)).select("id", "status", "visibility", "processing_status", "thumbnail_url", "original_url")


@query("b6_segment_rows_defaults", sql("segs", "select media_id, segment_index, case when segment_index % 3 = 0 then 0.0 else sharpness end as sharpness from segs"))
def segment_rows(spark, d):
    from winnow.plans.queries_video import segments

    s = segments(spark, d).withColumn("sharpness", F.when(F.col("segment_index") % 3 != 0, F.col("sharpness")))
    return s.select("media_id", "segment_index", "sharpness").na.fill(0.0, ["sharpness"])


_PREDICATES = {
    "c2_active_images": "status = 'active' and media_type = 'image'",
    "c3_active_or_trashed": "status in ('active', 'trashed')",
    "c7_displayable": "processing_status is null or processing_status not in ('uploading', 'cancelled')",
    "c9_trash": "status = 'trashed'",
    "c15_not_blurry": "blur_status is distinct from 'blurry'",
    "c16_unprocessed_videos": "media_type = 'video' and coalesce(compiled_path, '') = ''",
    "c17_analysed": "avg_brightness is not null",
    "c21_other_tab": "coalesce(nullif(category, ''), 'other') = 'other'",
    "c22_unprocessed_banner": "category is null and avg_brightness is null",
}


@query("c_predicate_counts", sql("media", " union all ".join(f"select '{k}' as predicate, count(*) filter (where {v}) as n from media" for k, v in _PREDICATES.items())))
def predicate_counts(spark, d):
    """All predicates in one pass over the media."""
    m = src.media(spark, d)
    tests = {k: F.expr(v) for k, v in _PREDICATES.items() if k != "c15_not_blurry"} | {"c15_not_blurry": rel.not_blurry(), "c7_displayable": rel.displayable()}
    counts = m.agg(*[F.count_if(c).alias(k) for k, c in tests.items()])
    return counts.unpivot([], list(tests), "predicate", "n")


@query("c18_tag_prefix", sql("tags", "select media_id, tag_name from tags where tag_name ilike 'LANG%'"))
def tag_prefix(spark, d):
    return src.tags(spark, d).where(F.col("tag_name").ilike("LANG%"))


@query("c23_pending_users", sql("users", "select id, username from users where status = 'pending'"))
def pending_users(spark, d):
    return src.users(spark, d).where("status = 'pending'").select("id", "username")


@query("e4_category_stats", sql("media", """select trip_id, count(*) filter (where c = 'people') as people, count(*) filter (where c = 'animal') as animal,
count(*) filter (where c = 'landscape') as landscape, count(*) filter (where c = 'other') as other from (select trip_id,
case when category in ('people', 'animal', 'landscape') then category else 'other' end as c from media where status = 'active') group by trip_id"""))
def category_stats(spark, d):
    return rel.category_stats(src.media(spark, d))


@query("e7_category_counts", sql("media", """with c as (select case when category in ('people', 'animal', 'landscape') then category else 'other' end as category from media)
select category, count(*) as n from c group by category union all select 'all', count(*) from c"""))
def category_counts(spark, d):
    return rel.category_counts(src.media(spark, d))


@query("e3_next_sequence", sql("jobev", "select u.c_custkey as job_id, coalesce(max(seq), 0) + 1 as next_seq from customer u left join (select job_id, row_number() over (partition by job_id order by created_at, id) as seq from jobev) e on e.job_id = u.c_custkey group by u.c_custkey"))
def next_sequence(spark, d):
    e = state.sequenced(src.job_events(spark, d)).groupBy("job_id").agg(F.max("seq").alias("seq"))
    u = src.table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"))
    return u.join(e, "job_id", "left").select("job_id", (F.coalesce("seq", F.lit(0)) + 1).alias("next_seq"))


@query("g2_cover_selection", sql("media", """with r as (select *, row_number() over (partition by trip_id, media_type order by case when media_type = 'image' then quality_score end desc nulls last, created_at, id) as rn from media)
select trip_id, coalesce(max(case when media_type = 'image' then id end), max(case when media_type = 'video' then id end)) as cover_id from r where rn = 1 group by trip_id"""))
def covers(spark, d):
    return rel.covers(src.media(spark, d))


@query("g3_first_video", sql("media", "select trip_id, id from (select trip_id, id, row_number() over (partition by trip_id order by created_at, id) as rn from media where media_type = 'video') where rn = 1"))
def first_video(spark, d):
    return src.media(spark, d).where("media_type = 'video'").groupBy("trip_id").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))


@query("e14_distinct_paths", sql("media", """select distinct regexp_replace(p, '^uploads/', '') as path from (select unnest([file_path, thumbnail_path, optimized_path, compiled_path]) as p from media) where p is not null and p <> ''"""))
def distinct_paths(spark, d):
    return files.distinct_paths(src.media(spark, d))


@query("e15_migration_summary", sql("media", """with p as (select distinct regexp_replace(p, '^uploads/', '') as path from (select unnest([file_path, thumbnail_path, optimized_path, compiled_path]) as p from media) where p is not null and p <> '')
select count(*) as total, count(*) filter (where path like '%originals%') as success, count(*) filter (where path not like '%originals%') as failed from p"""))
def migration_summary(spark, d):
    paths = files.distinct_paths(src.media(spark, d))
    return files.migration_summary(files.copy_plan(paths, paths.where("path like '%originals%'")))


@query("a25_serve_path", sql("media", "select id, coalesce(nullif(compiled_path, ''), nullif(preview_proxy_path, ''), nullif(optimized_path, ''), file_path) as serve_path from media"))
def serve_path(spark, d):
    return files.serve_path(src.media(spark, d)).select("id", "serve_path")


@query("a27_download_names", sql("media", r"select id, regexp_replace(original_filename, '\.[^.]+$', '') || '_compiled.mp4' as name from media where compiled_path <> ''"))
def download_names(spark, d):
    m = src.media(spark, d).where("compiled_path <> ''")
    return m.select("id", F.concat(text.stem(F.col("original_filename")), F.lit("_compiled.mp4")).alias("name"))


@query("d9_scores_in_list_order", sql("media", """with l as (select pos, case when pos % 3 = 0 then 'none' || pos else id end as id from (select id, row_number() over (order by id) as pos from media where width = 2500))
select l.pos, l.id, coalesce(m.quality_score, 0.5) as score from l left join media m on m.id = l.id"""))
def in_list_order(spark, d):
    from pyspark.sql.window import Window

    m = src.media(spark, d)
    ids = m.where("width = 2500").select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id")).cast("long").alias("pos"), "id")
    ids = ids.withColumn("id", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("none"), F.col("pos"))).otherwise(F.col("id")))
    return rel.in_order(ids, m.select("id", F.col("quality_score").alias("score")), "id", {"score": 0.5}).select("pos", "id", "score")
