"""Queries on segments of videos: boundaries, labels, targets, selection, plans."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnow.config import VideoThresholds
from winnow.functions import scores
from winnow.operators import video
from winnow.plans import commands
from winnow.plans.prelude import sql
from winnow.plans.registry import query
from winnow.sources import adapters as src


def segments(spark, d):
    """Segments between the cuts of each user's video, with measures derived from their numbers."""
    c = src.cuts(spark, d)
    videos = c.select("media_id", "duration").distinct()
    s = video.indexed(video.boundaries(videos, c))
    return video.scored(src.measured_segments(s))


def _targets(spark, d):
    return src.cuts(spark, d).select("media_id", "duration").distinct().select("media_id", scores.target_duration(F.col("duration")).alias("target"))


def _no_targets(spark, d):
    return src.cuts(spark, d).select("media_id").distinct().withColumn("target", F.lit(None).cast("double"))


@query("n1_frame_scores", sql("scores", "select media_id, t, round(coalesce(change, -1), 9) as change, round(score, 9) as score from scores"))
def frame_scores(spark, d):
    """How much each frame differs from the one before it, and starts a new scene."""
    s = video.frame_scores(src.frames(spark, d))
    return s.select("media_id", "t", F.round(F.coalesce("change", F.lit(-1.0)), 9).alias("change"), F.round("score", 9).alias("score"))


@query("n1_segments_from_frames", sql("scores", """with d as (select media_id, max(t) + 0.5 as duration from scores group by media_id), p as (select media_id, t from scores where score > 0.3 union select media_id, 0.0 from d union select media_id, duration from d),
b as (select *, lead(t) over w as next, row_number() over w as rn, lead(t, 2) over w is null as last from p window w as (partition by media_id order by t)),
s as (select media_id, case when rn = 1 then t else least(t + 0.5, next) end as s, next, last from b where next is not null), e as (select media_id, s as start, case when last then next else greatest(next - 0.5, s) end as "end" from s)
select media_id, start, "end", (row_number() over (partition by media_id order by start) - 1)::int as segment_index from e where "end" > start"""))
def segments_from_frames(spark, d):
    """From frames to scene cuts to segments."""
    f = src.frames(spark, d)
    videos = f.groupBy("media_id").agg((F.max("t") + 0.5).alias("duration"))
    return video.indexed(video.boundaries(videos, video.scene_cuts(f))).select("media_id", "start", "end", "segment_index")


@query("n2_segment_boundaries", sql("segs1", 'select media_id, start, end_ as "end", segment_index from segs1'))
def segment_boundaries(spark, d):
    return segments(spark, d).select("media_id", "start", "end", "segment_index")


@query("f7_fixed_segments", """select c_custkey as media_id, i * 2.0::double as start, least((i + 1) * 2.0, (c_custkey % 37) / 2.0)::double as "end" from customer, lateral (select unnest(range(0, ceil((c_custkey % 37) / 4.0)::bigint)) as i) where c_custkey % 37 > 0""")
def fixed_segments(spark, d):
    videos = src.table(spark, d, "customer").select(F.col("c_custkey").alias("media_id"), (F.col("c_custkey") % 37 / 2).alias("duration"))
    return video.boundaries(videos, src.cuts(spark, d).where("false"))


_LABEL = """case when sharpness < 20 then 'severely_blurry' when stability < 15 then 'severely_shaky' when exposure < 10 or exposure > 100 then 'severely_exposed' when sharpness < 50 then 'blurry'
when stability < 30 then 'shaky' when stability < 60 then 'slightly_shaky' else 'good' end"""


@query("n3_segment_labels", sql("segs", f"select media_id, segment_index, round(0.4 * sharpness + 0.3 * stability + 0.3 * exposure, 6) as overall, {_LABEL} as label from segs"))
def segment_labels(spark, d):
    return segments(spark, d).select("media_id", "segment_index", F.round("overall", 6).alias("overall"), "label")


@query("n5_target_durations", sql("targets", "select media_id, coalesce(target, 0.0) as target from targets"))
def target_durations(spark, d):
    return _targets(spark, d).withColumn("target", F.coalesce("target", F.lit(0.0)))


@query("n6_segment_selection", sql("chosen", "select media_id, segment_index from chosen"))
def segment_selection(spark, d):
    """A greedy choice that depends on what was taken before; the SQL takes a step for each segment that is offered."""
    return video.select_segments(segments(spark, d), _targets(spark, d))


@query("n6_segment_candidates", sql("segs", f"select media_id, segment_index from (select *, {_LABEL} as label from segs) where label in ('good', 'slightly_shaky') and duration >= 2"))
def segment_candidates(spark, d):
    return video.candidates(segments(spark, d)).select("media_id", "segment_index")


_PLANS = """select media_id, segments, coalesce(selected, 0) as selected, case when target is null and coalesce(selected, 0) = segments then 'keep' when coalesce(selected, 0) = 0 then 'error' else 'compile' end as plan{more}
from (select media_id, count(*) as segments from segs group by media_id) join targets using (media_id)
left join (select media_id, count(*) as selected, sum(end_ - start) as seconds from chosen join segs using (media_id, segment_index) group by media_id) using (media_id)"""


@query("n7_edit_plans", sql("segs targets chosen", _PLANS.format(more="")))
def edit_plans(spark, d):
    s, t = segments(spark, d), _targets(spark, d)
    return video.edit_plans(s, video.select_segments(s, t), t)


@query("n10_reselected_all", sql("segs", f"select media_id, segment_index from (select *, {_LABEL} as label from segs) where label in ('good', 'slightly_shaky') and duration >= 2 and segment_index not in (1, 3)"))
def reselected(spark, d):
    """With no target all that is left after the exclusions stays."""
    return video.select_segments(segments(spark, d), _no_targets(spark, d), excluded=[1, 3])


_CHOSEN = "p as (select media_id, segment_index as pos, duration from segs where {l} in ('good', 'slightly_shaky'))".format(l=_LABEL)


def _chosen(spark, d):
    """The segments that are chosen without any summary."""
    return segments(spark, d).where("label in ('good', 'slightly_shaky')").select("media_id", F.col("segment_index").alias("pos"), "duration")


@query("n8_fade_transitions", sql("segs", f"with {_CHOSEN} select media_id, pos, case when duration >= 10 then 'fade' else 'none' end as transition, coalesce(case when duration >= 10 then duration - 5 end, -1)::double as \"offset\" from p"))
def fade_transitions(spark, d):
    return video.transitions(_chosen(spark, d), "fade", 5.0).withColumn("offset", F.coalesce("offset", F.lit(-1.0)))


@query("n8_crossfade_transitions", sql("segs", f"with {_CHOSEN}, q as (select *, lag(duration) over (partition by media_id order by pos) as b from p) select media_id, pos, case when b is null then 'start' when duration >= 10 and b >= 10 then 'crossfade' else 'concat' end as transition, coalesce(case when duration >= 10 and b >= 10 then b - 5 end, -1)::double as \"offset\" from q"))
def crossfade_transitions(spark, d):
    return video.transitions(_chosen(spark, d), "crossfade", 5.0).withColumn("offset", F.coalesce("offset", F.lit(-1.0)))


def _whole(spark, d):
    return segments(spark, d).select("media_id", F.col("segment_index").alias("pos"), "duration")


_ALL = "p as (select media_id, segment_index as pos, duration from segs1)"


@query("n8_fade_transitions_whole", sql("segs1", f"with {_ALL} select media_id, pos, case when duration >= 10 then 'fade' else 'none' end as transition, coalesce(case when duration >= 10 then duration - 5 end, -1)::double as \"offset\" from p"))
def fade_transitions_whole(spark, d):
    """All segments; n8_fade_transitions has those that are chosen."""
    return video.transitions(_whole(spark, d), "fade", 5.0).withColumn("offset", F.coalesce("offset", F.lit(-1.0)))


@query("n8_crossfade_transitions_whole", sql("segs1", f"with {_ALL}, q as (select *, lag(duration) over (partition by media_id order by pos) as b from p) select media_id, pos, case when b is null then 'start' when duration >= 10 and b >= 10 then 'crossfade' else 'concat' end as transition, coalesce(case when duration >= 10 and b >= 10 then b - 5 end, -1)::double as \"offset\" from q"))
def crossfade_transitions_whole(spark, d):
    return video.transitions(_whole(spark, d), "crossfade", 5.0).withColumn("offset", F.coalesce("offset", F.lit(-1.0)))


@query("n9_requested_order", sql("segs1", "with o as (select media_id, unnest([3, 0, 5000]) as segment_index, unnest([0, 1, 2]) as pos from (select distinct media_id from segs1)) select o.media_id, o.pos, o.segment_index, s.media_id is not null as there from o left join segs1 s on s.media_id = o.media_id and s.segment_index = o.segment_index"))
def requested_order(spark, d):
    s = segments(spark, d)
    order = s.select("media_id").distinct().select("media_id", F.posexplode(F.array(F.lit(3), F.lit(0), F.lit(5000))).alias("pos", "segment_index"))
    return video.requested(order, s).select("media_id", "pos", "segment_index", "there")


@query("n11_upserted_segments", sql("segs1", """with o as (select media_id, segment_index, 'old' || segment_index as id, segment_index % 2 = 0 as selected from segs1 where segment_index % 5 <> 4), n as (select media_id, segment_index, 'new' || segment_index as id, true as selected from segs1 where segment_index % 3 <> 1 and media_id % 2 = 0)
select n.media_id, n.segment_index, coalesce(o.id, n.id) as id, coalesce(o.selected, n.selected) as selected from n left join o using (media_id, segment_index) union all select media_id, segment_index, id, selected from o where media_id % 2 <> 0"""))
def upserted_segments(spark, d):
    """Two analyses of whole videos that found different segments, the second of even ones."""
    s = segments(spark, d).select("media_id", "segment_index")
    i = F.col("segment_index")
    old = s.where("segment_index % 5 <> 4").select("media_id", "segment_index", F.concat(F.lit("old"), i).alias("id"), (i % 2 == 0).alias("selected"))
    new = s.where("segment_index % 3 <> 1 and media_id % 2 = 0").select("media_id", "segment_index", F.concat(F.lit("new"), i).alias("id"), F.lit(True).alias("selected"))
    return video.upserted(old, new).select("media_id", "segment_index", "id", "selected")


@query("n13_default_choice", sql("segs", f"select media_id, segment_index, {_LABEL} in ('good', 'slightly_shaky') as selected from segs"))
def default_choice(spark, d):
    return segments(spark, d).select("media_id", "segment_index", F.col("label").isin("good", "slightly_shaky").alias("selected"))


@query("i22_parsed_cuts", "select user_id as media_id, count(*) as cuts, round(sum(value), 3) as t from events where event_id % 3 <> 0 group by user_id")
def parsed_cuts(spark, d):
    e = src.table(spark, d, "events")
    line = F.when(F.col("event_id") % 3 == 0, F.lit("frame done")).otherwise(F.concat(F.lit("[showinfo] n:0 pts_time:"), F.col("value"), F.lit(" scene_score=0.4")))
    logs = e.groupBy(F.col("user_id").alias("media_id")).agg(F.array_join(F.collect_list(line), "\n").alias("log"))
    return video.parse_cuts(logs).groupBy("media_id").agg(F.count("*").alias("cuts"), F.round(F.sum("t"), 3).alias("t"))


@query("f8_count_windows", "with e as (select user_id, event_id, (row_number() over (partition by user_id order by ts, event_id) - 1) // 10 as win from events) select user_id, win, count(*) as n, min(event_id) as first from e group by user_id, win having count(*) > 1")
def count_windows(spark, d):
    """Windows of ten events each; a single one that is left over is passed over."""
    e = src.table(spark, d, "events")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("user_id", "event_id", F.floor((rn - 1) / 10).alias("win")).groupBy("user_id", "win").agg(F.count("*").alias("n"), F.min("event_id").alias("first")).where("n > 1")


@query("d18_adjacent_segments", sql("segs", f"""with c as (select *, 0.4 * sharpness + 0.3 * stability + 0.3 * exposure as overall, {_LABEL} as label from segs)
select a.media_id, a.segment_index as i, b.segment_index as j from c a join c b on a.media_id = b.media_id and a.segment_index < b.segment_index
and least(abs(b.start - a.end_), abs(a.start - b.end_)) <= 2 and (greatest(a.overall, b.overall) <= 0 or abs(a.overall - b.overall) / greatest(a.overall, b.overall) <= 0.1)
where a.label in ('good', 'slightly_shaky') and b.label in ('good', 'slightly_shaky') and a.duration >= 2 and b.duration >= 2"""))
def adjacent_segments(spark, d):
    return video.adjacent(video.candidates(segments(spark, d)))


@query("b10_segment_details", sql("segs", f"select media_id, segment_index, start as start_time, end_ as end_time, duration, round(0.4 * sharpness + 0.3 * stability + 0.3 * exposure, 6) as overall_score, {_LABEL} as label from segs"))
def segment_details(spark, d):
    return segments(spark, d).select("media_id", "segment_index", F.col("start").alias("start_time"), F.col("end").alias("end_time"), "duration", F.round("overall", 6).alias("overall_score"), "label")


@query("g6_segment_orders", sql("segs", """select media_id, segment_index, row_number() over (partition by media_id order by start) as by_start,
row_number() over (partition by media_id order by 0.4 * sharpness + 0.3 * stability + 0.3 * exposure desc, segment_index) as by_score from segs"""))
def segment_orders(spark, d):
    w = Window.partitionBy("media_id")
    return segments(spark, d).select("media_id", "segment_index", F.row_number().over(w.orderBy("start")).alias("by_start"), F.row_number().over(w.orderBy(F.desc("overall"), "segment_index")).alias("by_score"))


@query("g10_cut_points", sql("points", "select media_id, row_number() over (partition by media_id order by t) - 1 as pos, t from points"))
def cut_points(spark, d):
    c = src.cuts(spark, d)
    return video.cut_points(c.select("media_id", "duration").distinct(), c)


@query("n12_selected_flags", sql("segs1", "select media_id, segment_index, case when segment_index % 3 = 0 then media_id % 2 = 0 else true end as selected from segs1"))
def selected_flags(spark, d):
    s = segments(spark, d).select("media_id", "segment_index", F.lit(True).alias("selected"))
    choice = s.where("segment_index % 3 = 0").select("media_id", "segment_index", (F.col("media_id") % 2 == 0).alias("selected"))
    return video.with_choice(s, choice)


@query("n14_probed_videos", sql("cuts", "select distinct media_id, case when media_id % 4 = 0 then 0.0 else duration end as duration, case when media_id % 4 = 0 then 0 else 1920 end as width, case when media_id % 4 = 0 then 0 else 1080 end as height, case when media_id % 4 = 0 then 'unknown' else 'h264' end as codec from cuts"))
def probed_videos(spark, d):
    v = src.cuts(spark, d).select("media_id", "duration").distinct()
    ok = F.col("media_id") % 4 != 0
    return video.probed(v.select("media_id", *[F.when(ok, c).alias(n) for n, c in (("duration", F.col("duration")), ("width", F.lit(1920)), ("height", F.lit(1080)), ("codec", F.lit("h264")))]))


@query("n15_videos_after_proxy", sql("segs targets chosen", _PLANS.format(more=", round(coalesce(seconds, 0.0), 3) as seconds")))
def videos_after_proxy(spark, d):
    """From cuts to plans in one go, with summaries of their targets."""
    return video.processed(segments(spark, d), _targets(spark, d)).withColumn("seconds", F.round("seconds", 3))


@query("n16_videos_kept_whole", sql("segs", f"""with l as (select *, {_LABEL} in ('good', 'slightly_shaky') and duration >= 2 as ok from segs)
select media_id, count(*) as segments, count(*) filter (where ok) as selected, case when count(*) filter (where ok) = count(*) then 'keep' when count(*) filter (where ok) = 0 then 'error' else 'compile' end as plan,
round(coalesce(sum(end_ - start) filter (where ok), 0.0), 3) as seconds from l group by media_id"""))
def videos_kept_whole(spark, d):
    """Videos that are processed without a target keep all candidates."""
    return video.processed(segments(spark, d), _no_targets(spark, d)).select("media_id", "segments", "selected", "plan", F.round("seconds", 3).alias("seconds"))


@query("f9_seconds_before", sql("segs", "select media_id, segment_index, round(coalesce(sum(duration) over (partition by media_id order by 0.4 * sharpness + 0.3 * stability + 0.3 * exposure desc, segment_index rows between unbounded preceding and 1 preceding), 0.0), 6) as before from segs"))
def seconds_before(spark, d):
    """The running total that the greedy choice starts from, best segments first."""
    w = Window.partitionBy("media_id").orderBy(F.desc("overall"), "segment_index").rowsBetween(Window.unboundedPreceding, -1)
    return segments(spark, d).select("media_id", "segment_index", F.round(F.coalesce(F.sum("duration").over(w), F.lit(0.0)), 6).alias("before"))


@query("s7_segments_by_sql", sql("chosen", "select media_id, segment_index from chosen"))
def segments_by_sql(spark, d):
    """The choice of n6 from SQL text."""
    commands.register(spark)
    segments(spark, d).createOrReplaceTempView("segments")
    _targets(spark, d).createOrReplaceTempView("targets")
    return spark.sql("""select media_id, segment_index from choose_segments(TABLE(select /*+ MERGE(targets) */ media_id, segment_index, start, `end`, overall, target from segments join targets using (media_id)
where label in ('good', 'slightly_shaky') and duration >= 2) PARTITION BY media_id ORDER BY (start, segment_index))""")


@query("f9_filled_to_target", sql("cands", """with recursive f as (select distinct media_id, 0::bigint as n, []::integer[] as taken, 0.0::double as used from cands where target is not null
union all select media_id, n, case when ok then list_append(taken, segment_index) else taken end, case when ok then used + duration else used end from (
select c.media_id, f.n + 1 as n, f.taken, f.used, c.segment_index, c.duration, f.used < c.target and (len(f.taken) = 0 or f.used + c.duration <= c.target * 1.1) as ok from f join cands c on c.media_id = f.media_id and c.rk = f.n + 1))
select media_id, unnest(taken) as segment_index from (select media_id, arg_max(taken, n) as taken from f group by media_id)"""))
def filled_to_target(spark, d):
    """The best segments until the target is met, passing over what would exceed it by over a tenth; neighbours in time aren't drawn in."""
    apart = replace(VideoThresholds(), adjacency_gap=-1.0)
    return video.select_segments(segments(spark, d), _targets(spark, d).where("target is not null"), apart)


@query("s6_edited_to_target", sql("segs chosen", """with c as (select *, row_number() over (partition by media_id order by start, segment_index) - 1 as pos from segs join chosen using (media_id, segment_index))
select media_id, pos, segment_index, start, end_ as "end", case when duration >= 1 then 'fade' else 'none' end as transition, duration - 0.5 as "offset" from c"""))
def edited_to_target(spark, d):
    """From segments to what is rendered, of every video to its target."""
    return video.edited(segments(spark, d), _targets(spark, d))


@query("f6_between_cuts", sql("between0", "select media_id, a, b from between0 where b is not null"))
def between_cuts(spark, d):
    """Each cut point with the next."""
    c = src.cuts(spark, d)
    p = video.cut_points(c.select("media_id", "duration").distinct(), c)
    return p.select("media_id", F.col("t").alias("a"), F.lead("t").over(Window.partitionBy("media_id").orderBy("pos")).alias("b")).where("b is not null")


@query("n4_label_counts", sql("segs", f"select media_id, {_LABEL} as label, count(*) as n, round(sum(duration), 3) as seconds from segs group by all"))
def label_counts(spark, d):
    return segments(spark, d).groupBy("media_id", "label").agg(F.count("*").alias("n"), F.round(F.sum("duration"), 3).alias("seconds"))


@query("s6_edited_videos", sql("segs", f"""with c as (select *, row_number() over (partition by media_id order by start, segment_index) - 1 as pos from segs where {_LABEL} in ('good', 'slightly_shaky') and duration >= 2)
select media_id, pos, segment_index, start, end_ as "end", case when duration >= 1 then 'fade' else 'none' end as transition, duration - 0.5 as "offset" from c"""))
def edited_videos(spark, d):
    """From segments to what is rendered, of videos without a target."""
    return video.edited(segments(spark, d), _no_targets(spark, d))
