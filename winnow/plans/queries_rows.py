"""Queries on rows as clients see them: objects, filters, orders, counts and guards."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnow.functions import text
from winnow.operators import relational as rel
from winnow.operators import state
from winnow.plans.prelude import sql
from winnow.plans.queries_relational import _PREDICATES
from winnow.plans.queries_state import _JOBS, _jobs
from winnow.plans.registry import query
from winnow.sources import adapters as src

# ---- objects ---------------------------------------------------------------


@query("b2_trip_objects", sql("trips", "select id, title, coalesce(description, '') as description, visibility, user_id from trips"))
def trip_objects(spark, d):
    return rel.trip_object(src.trips(spark, d)).select("id", "title", "description", "visibility", "user_id")


@query("b3_group_objects", sql("grps", "select id, trip_id, coalesce(default_image_id, '') as default_image_id, image_count from grps"))
def group_objects(spark, d):
    return rel.group_object(src.groups(spark, d))


@query("b4_job_event_objects", sql("jobev", "select id, job_id, case when id % 6 = 0 then 'info' else level end as level, case when id % 5 = 0 then '' else step end as step from jobev"))
def job_event_objects(spark, d):
    e = src.job_events(spark, d)
    e = e.withColumns({"level": F.when(F.col("id") % 6 != 0, F.col("level")), "step": F.when(F.col("id") % 5 != 0, F.col("step"))})
    return rel.event_object(e).select("id", "job_id", "level", "step")


@query("b7_trip_summaries", sql("trips media", """with c as (select trip_id, arg_min(id, [quality_score is null, -coalesce(quality_score, 0), epoch(created_at)]) as cover from media where media_type = 'image' group by trip_id)
select t.id, case when length(description) > 100 then substr(description, 1, 100) || '...' else coalesce(description, '') end as excerpt, (select count(*) from media m where m.trip_id = t.id) as media_count from trips t"""))
def trip_summaries(spark, d):
    return rel.trip_listing(src.trips(spark, d), src.media(spark, d), admin=True).select("id", "excerpt", "media_count")


@query("b7_trip_cover_urls", sql("trips media", """with r as (select *, row_number() over (partition by trip_id, media_type order by case when media_type = 'image' then quality_score end desc nulls last, created_at, id) as rn from media),
c as (select trip_id, coalesce(max(case when media_type = 'image' then id end), max(case when media_type = 'video' then id end)) as cover_id from r where rn = 1 group by trip_id)
select t.id, case when cover_id is null then '' else '/api/media/' || cover_id || '/thumbnail' end as cover_url from trips t left join c on c.trip_id = t.id"""))
def trip_cover_urls(spark, d):
    return rel.cover_urls(src.trips(spark, d), src.media(spark, d)).select("id", "cover_url")


@query("b8_media_urls", sql("media", "select id, '/api/media/' || id || '/thumbnail' as thumbnail_url, '/api/media/' || id || '/original' as original_url from media"))
def media_urls(spark, d):
    return src.media(spark, d).select("id", text.thumbnail_url(F.col("id")).alias("thumbnail_url"), text.original_url(F.col("id")).alias("original_url"))


# ---- filters ---------------------------------------------------------------


@query("c1_public_trips", sql("trips", "select id from trips where visibility = 'public'"))
def public_trips(spark, d):
    return src.trips(spark, d).where("visibility = 'public'").select("id")


def _filtered(name, predicate, condition=None):
    """A query of the media that a predicate lets through."""

    @query(name, sql("media", f"select id, trip_id from media where {predicate}"))
    def filtered(spark, d):
        return src.media(spark, d).where(condition() if condition else F.expr(predicate)).select("id", "trip_id")


_filtered("c2_active_images", _PREDICATES["c2_active_images"])
_filtered("c3_active_or_trashed_images", "media_type = 'image' and status in ('active', 'trashed')")
_filtered("c9_trash", _PREDICATES["c9_trash"])
_filtered("c15_blur_gate", _PREDICATES["c15_not_blurry"], rel.not_blurry)
_filtered("c16_unprocessed_videos", _PREDICATES["c16_unprocessed_videos"])
_filtered("c17_analysed_images", _PREDICATES["c17_analysed"])
_filtered("c22_unprocessed_images", _PREDICATES["c22_unprocessed_banner"])


@query("c5_gallery_by_tag", sql("tags", "select doc_id from documents where doc_id in (select media_id from tags where tag_name = 'langde') and doc_id % 2 = 0"))
def gallery_by_tag(spark, d):
    docs = src.table(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id")
    return rel.with_tag(docs, src.tags(spark, d), "lang DE", "doc_id")


_REASONS = "case width % 400 when 0 then 'duplicate' when 100 then 'blur,duplicate' when 200 then 'blur' end"


@query("c10_trashed_duplicates", sql("media", f"select trip_id, count(*) as n from media where status = 'trashed' and {_REASONS} = 'duplicate' group by trip_id"))
def trashed_duplicates(spark, d):
    """Only those with this reason alone: a list with another doesn't count."""
    m = src.media(spark, d).withColumn("trashed_reason", F.expr(_REASONS))
    return m.where("status = 'trashed' and trashed_reason = 'duplicate'").groupBy("trip_id").agg(F.count("*").alias("n"))


@query("c11_active_jobs", f"select id, trip_id, status from ({_JOBS}) where status in ('queued', 'running')")
def active_jobs(spark, d):
    return state.active(_jobs(spark, d)).select("id", "trip_id", "status")


@query("a4_rows_by_key", sql("media", "select id, trip_id, status from media where trip_id = 1000"))
def rows_by_key(spark, d):
    return src.media(spark, d).where("trip_id = 1000").select("id", "trip_id", "status")


@query("a4_affected_rows", sql("media", "select trip_id, count(*) filter (where status = 'trashed' and width % 200 = 0) as affected from media group by trip_id"))
def affected_rows(spark, d):
    """How many rows an update changed, for each trip."""
    out = state.restore(src.media(spark, d), F.col("width") % 200 == 0)
    return out.groupBy("trip_id").agg(F.count_if("changed").alias("affected"))


# ---- joins -----------------------------------------------------------------


@query("d5_group_members", sql("media grps", "select g.id as group_id, m.id, coalesce(m.id = g.default_image_id, false) as is_default from grps g join media m on m.duplicate_group_id = g.id and m.trip_id = g.trip_id"))
def group_members(spark, d):
    out = rel.members(src.groups(spark, d), src.media(spark, d))
    return out.select("group_id", "id", "is_default")


@query("d20_classified_media", sql("media", """with p as (select id as media_id, case when width % 300 = 0 then null else category end as category from media where height % 300 <> 0)
select m.id, coalesce(nullif(p.category, ''), 'other') as category, case when nullif(p.category, '') is null then 'fallback' else 'local' end as source from media m left join p on p.media_id = m.id"""))
def classified_media(spark, d):
    """Media with the local model's answers, where it gave any."""
    m = src.media(spark, d)
    answers = m.where("height % 300 <> 0").select(F.col("id").alias("media_id"), F.when(F.col("width") % 300 != 0, F.nullif("category", F.lit(""))).alias("local"))
    return rel.classified(m.select("id"), answers)


# ---- orders ----------------------------------------------------------------


def _place(*order, by):
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


@query("g1_trips_newest_first", sql("trips", "select id, user_id, row_number() over (partition by user_id order by created_at desc, id) as place from trips"))
def trips_newest_first(spark, d):
    return src.trips(spark, d).select("id", "user_id", _place(F.desc("created_at"), "id", by=["user_id"]).alias("place"))


@query("g4_latest_active_job", f"with j as ({_JOBS}) select trip_id, max(id) as id from j where status in ('queued', 'running') group by trip_id")
def latest_active_job(spark, d):
    """The job created last of those that are active, for each trip; ids are in order of creation."""
    return state.latest_active(_jobs(spark, d), "id")


@query("g5_events_in_order", sql("jobev", "select job_id, seq, level, lag(level) over (partition by job_id order by seq) as before from (select *, row_number() over (partition by job_id order by created_at, id) as seq from jobev)"))
def events_in_order(spark, d):
    e = state.sequenced(src.job_events(spark, d))
    return e.select("job_id", "seq", "level", F.lag("level").over(Window.partitionBy("job_id").orderBy("seq")).alias("before"))


@query("g7_parts_in_order", "select conv_id as upload_id, row_number() over (partition by conv_id order by turn) as place, turn as part_no from conversations")
def parts_in_order(spark, d):
    return src.table(spark, d, "conversations").select(F.col("conv_id").alias("upload_id"), _place("turn", by=["conv_id"]).alias("place"), F.col("turn").alias("part_no"))


@query("g9_first_of_the_best", sql("curated", "with r as (select trip_id, seq, seq % 7 as score, row_number() over (partition by trip_id order by seq % 7 desc, seq) as rn from curated) select trip_id, seq, score from r where rn = 1"))
def first_of_the_best(spark, d):
    """The member of the highest score, the first of equal ones."""
    c = src.curated(spark, d).withColumn("score", F.col("seq") % 7)
    best = c.groupBy("trip_id").agg(F.max_by(F.struct("seq", "score"), F.struct("score", -F.col("seq"))).alias("b"))
    return best.select("trip_id", "b.seq", "b.score")


@query("g12_listing_without_order", sql("media", "select trip_id, id from media where status = 'trashed' and media_type = 'image'"))
def listing_without_order(spark, d):
    return src.media(spark, d).where("status = 'trashed' and media_type = 'image'").select("trip_id", "id")


# ---- counts ----------------------------------------------------------------


@query("e1_media_counts", sql("trips media", "select t.id, count(m.id) as n from trips t left join media m on m.trip_id = t.id group by t.id"))
def media_counts(spark, d):
    return rel.trip_listing(src.trips(spark, d), src.media(spark, d), admin=True).select("id", F.col("media_count").alias("n"))


@query("e2_scalar_counts", sql("media", "select count(*) as n, count(*) filter (where status = 'active') as active, count(distinct trip_id) as trips from media"))
def scalar_counts(spark, d):
    return src.media(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "active").alias("active"), F.countDistinct("trip_id").alias("trips"))


@query("e11_most_similar", sql("dist", "select seq, round(max(sim), 6) as most from (select i as seq, sim from dist union all select j, sim from dist) group by seq having max(sim) >= 0.8"))
def most_similar(spark, d):
    from winnow.operators import similarity

    p = similarity.cosine_pairs(src.vectors(spark, d), 0.8)
    ends = p.select(F.col("i").alias("seq"), "sim").union(p.select("j", "sim"))
    return ends.groupBy("seq").agg(F.round(F.max("sim"), 6).alias("most"))


@query("e17_weighted_means", sql("curated", """select seq, round((coalesce(sharpness * 0.5, 0) + coalesce(width::double * 0.3, 0) + case when seq % 3 = 0 then 0 else height::double * 0.2 end)
/ (case when sharpness is null then 0 else 0.5::double end + 0.3 + case when seq % 3 = 0 then 0 else 0.2::double end), 6) as mean from curated"""))
def weighted_means(spark, d):
    from winnow.functions import scores

    parts = [(F.col("sharpness"), 0.5), (F.col("width").cast("double"), 0.3), (F.when(F.col("seq") % 3 != 0, F.col("height").cast("double")), 0.2)]
    return src.curated(spark, d).select("seq", F.round(scores.weighted_mean(parts), 6).alias("mean"))


@query("e18_swept_jobs", f"with j as ({_JOBS}) select trip_id, count(*) filter (where status in ('queued', 'running')) as zombies from j group by trip_id")
def swept_jobs(spark, d):
    swept = state.failed_jobs(_jobs(spark, d), F.lit(True), "interrupted")
    return swept.groupBy("trip_id").agg(F.count_if("changed").alias("zombies"))


@query("e19_any_media", sql("trips media", "select id, exists (select 1 from media m where m.trip_id = t.id and m.media_type = 'video') as any_video from trips t"))
def any_media(spark, d):
    has = src.media(spark, d).where("media_type = 'video'").select(F.col("trip_id").alias("id"), F.lit(True).alias("any_video")).distinct()
    return src.trips(spark, d).select("id").join(has, "id", "left").withColumn("any_video", F.coalesce("any_video", F.lit(False)))


@query("f1_sequence_index", sql("media", "select trip_id, id, row_number() over (partition by trip_id order by created_at, id) - 1 as seq from media where status = 'active' and media_type = 'image'"))
def sequence_index(spark, d):
    m = src.media(spark, d).where("status = 'active' and media_type = 'image'")
    return rel.indexed(m, "trip_id", ["created_at", "id"]).select("trip_id", "id", "seq")


@query("f11_batches", "with e as (select user_id, event_id, (row_number() over (partition by user_id order by ts, event_id) - 1) // 7 as batch from events) select user_id, batch, count(*) as n, min(event_id) as least from e group by user_id, batch")
def batches(spark, d):
    """Batches of seven without overlap; the last may be smaller."""
    e = rel.indexed(src.table(spark, d, "events"), "user_id", ["ts", "event_id"])
    return rel.batched(e, 7).groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("least"))


# ---- guards ----------------------------------------------------------------


@query("r1_trip_access", sql("trips", "select id, coalesce(user_id = 100, false) as owner_may, true as admin_may from trips"))
def trip_access(spark, d):
    t = src.trips(spark, d).select("id", F.col("user_id").alias("trip_user_id"), F.lit(None).cast("long").alias("media_user_id"))
    return t.select("id", rel.may_manage(100, "regular").alias("owner_may"), rel.may_manage(100, "admin").alias("admin_may"))


@query("r3_viewers", "select event_id, case when event_id % 4 = 0 then 0 else user_id end as viewer_id, case when event_id % 4 = 0 or c_custkey is null then 'anonymous' when c_mktsegment = 'MACHINERY' then 'admin' else 'regular' end as viewer from events left join customer on c_custkey = user_id")
def viewers(spark, d):
    """Requests with their viewer; one without a token, or with that of nobody, is anonymous."""
    e = src.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("viewer_id"))
    return rel.viewers(e, src.users(spark, d).select("id", "role")).withColumn("viewer_id", F.coalesce("viewer_id", F.lit(0)))


@query("r4_guards", "with v as (select event_id, case when event_id % 4 = 0 or c_custkey is null then 'anonymous' when c_mktsegment = 'MACHINERY' then 'admin' else 'regular' end as viewer, event_type from events left join customer on c_custkey = user_id) select event_id, case when event_type = 'view' then 200 when viewer = 'anonymous' then 401 when event_type = 'purchase' and viewer <> 'admin' then 403 else 200 end as status from v")
def guards(spark, d):
    """Views are for all, purchases for admins, the rest for anyone known."""
    e = src.table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("viewer_id"))
    needs = F.when(F.col("event_type") == "view", "anonymous").when(F.col("event_type") == "purchase", "admin").otherwise("regular")
    return rel.viewers(e, src.users(spark, d).select("id", "role"), keep=["event_type"]).select("event_id", rel.guarded(needs).alias("status"))


# ---- whole listings --------------------------------------------------------

_SHOWN = "status = 'active' and visibility = 'public'"


@query("s3_public_galleries", sql("media grps", f"""select g.trip_id, m.id, 'image' as kind from grps g join media m on g.default_image_id = m.id where {_SHOWN} and media_type = 'image'
union all select trip_id, id, 'image' from media where duplicate_group_id is null and media_type = 'image' and {_SHOWN}
union all select trip_id, id, 'video' from media where media_type = 'video' and {_SHOWN} and (processing_status is null or processing_status not in ('uploading', 'cancelled'))"""))
def public_galleries(spark, d):
    return rel.gallery(src.media(spark, d), src.groups(spark, d))


@query("s4_trip_lists", sql("trips media", """with c as (select t.*, (select count(*) from media m where m.trip_id = t.id) as n, (select count(*) from media m where m.trip_id = t.id and m.status = 'active') as a from trips t)
select 'public' as list, id, n as media_count from c where visibility = 'public' union all select 'mine', id, a from c where user_id = 100 union all select 'admin', id, a from c"""))
def trip_lists(spark, d):
    """The three lists of trips: public ones, a viewer's own, and an admin's."""
    t, m = src.trips(spark, d), src.media(spark, d)
    lists = {"public": rel.trip_listing(t, m), "mine": rel.trip_listing(t, m, viewer=100, active_only=True), "admin": rel.trip_listing(t, m, admin=True, active_only=True)}
    outs = [x.select(F.lit(n).alias("list"), "id", "media_count") for n, x in lists.items()]
    return outs[0].union(outs[1]).union(outs[2])
