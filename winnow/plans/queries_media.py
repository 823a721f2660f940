"""Queries on file kinds, uploads, scalar functions, hashes of values, image measures, scores and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions import media_types, scores, text, vectors
from winnow.operators import classify
from winnow.plans.prelude import sql
from winnow.plans.registry import query
from winnow.sources import adapters as src
from winnow.sources import files

_EXT = r"lower(regexp_extract(original_filename, '[^/.](\.[^./]*)$', 1))"
_KNOWN = "('.jpg', '.jpeg', '.png', '.webp', '.heic', '.mp4', '.mov', '.avi', '.mkv')"
_MIMES = "('image/jpeg', 'image/png', 'image/webp', 'image/heic', 'video/mp4', 'video/quicktime', 'video/x-msvideo', 'video/x-matroska')"


@query("a13_supported_files", sql("media", f"select id, mime_type in {_MIMES} or {_EXT} in {_KNOWN} as supported from media"))
def supported(spark, d):
    return src.media(spark, d).select("id", media_types.supported(F.col("mime_type"), F.col("original_filename")).alias("supported"))


@query(
    "a14_file_extensions",
    sql(
        "media",
        f"""select id, case when {_EXT} in {_KNOWN} then {_EXT} else coalesce(case mime_type when 'image/jpeg' then '.jpg' when 'image/png' then '.png' when 'video/mp4' then '.mp4' end, nullif({_EXT}, ''), '.bin') end as extension from media""",
    ),
)
def file_extensions(spark, d):
    return src.media(spark, d).select("id", media_types.file_extension(F.col("original_filename"), F.col("mime_type")).alias("extension"))


@query(
    "i7_media_kinds",
    sql("media", "select id, case when mime_type in ('image/jpeg', 'image/png') then 'image' when mime_type = 'video/mp4' then 'video' else 'unknown' end as kind from media"),
)
def media_kinds(spark, d):
    return src.media(spark, d).select("id", media_types.media_type(F.col("mime_type")).alias("kind"))


_SIZE = "cast(o_totalprice as bigint) * 50000"


@query(
    "a15_upload_plan",
    f"""with o as (select o_orderkey as id, cast(floor(o_totalprice) as bigint) * 50000 as size from orders),
    p as (select *, case when size > 10240::bigint * 1048576 then 134217728 when size > 1024::bigint * 1048576 then 67108864 when size > 500::bigint * 1048576 then 33554432 else 16777216 end as ps from o)
    select id, case when size > 104857600 then 'multipart' else 'simple' end as mode, case when size > 104857600 then ps else 0 end::bigint as part_size,
    case when size > 104857600 then ceil(size / ps) else 1 end::bigint as parts from p""",
)
def upload_plan(spark, d):
    o = src.table(spark, d, "orders").selectExpr("o_orderkey as id", f"{_SIZE} as size")
    return o.select("id", media_types.upload_plan(F.col("size")).alias("p")).select("id", "p.mode", F.coalesce("p.part_size", F.lit(0)).alias("part_size"), F.coalesce("p.parts", F.lit(1)).alias("parts"))


@query("a18_merged_parts", "select conv_id as upload_id, count(*) as parts, md5(string_agg(text, '' order by turn)) as md5 from conversations group by conv_id")
def merged_parts(spark, d):
    parts = src.table(spark, d, "conversations").selectExpr("conv_id as upload_id", "turn as part_no", "text as content")
    return files.merged_parts(parts).select("upload_id", "parts", F.md5("merged").alias("md5"))


@query("a18_missing_parts", "select c.conv_id as upload_id, g.i as part_no from (select conv_id, max(turn) + 1 as n from conversations group by conv_id) c, lateral (select unnest(range(1, n + 1)) as i) g where not exists (select 1 from conversations t where t.conv_id = c.conv_id and t.turn = g.i)")
def missing_parts(spark, d):
    c = src.table(spark, d, "conversations")
    wanted = c.groupBy(F.col("conv_id").alias("upload_id")).agg((F.max("turn") + 1).alias("total_parts"))
    return files.missing_parts(wanted, c.selectExpr("conv_id as upload_id", "turn as part_no"))


@query("a19_part_list", "select conv_id as upload_id, turn::int as part_no, md5(text) as etag, strlen(text)::bigint as size from conversations")
def part_list(spark, d):
    parts = src.table(spark, d, "conversations").selectExpr("conv_id as upload_id", "concat('part_', turn) as name", "cast(text as binary) as content")
    return files.part_list(parts)


@query("a28_log_lines", "select event_id, '{\"level\":\"' || event_type || '\",\"user\":' || user_id || '}' as line from events")
def log_lines(spark, d):
    e = src.table(spark, d, "events")
    return e.select("event_id", F.to_json(F.struct(F.col("event_type").alias("level"), F.col("user_id").alias("user"))).alias("line"))


@query(
    "i_document_scalars",
    r"""select doc_id, regexp_replace(lower(source || ' ' || lang), '\s+', '', 'g') as tag, case when length(text) > 100 then substr(text, 1, 100) || '...' else text end as excerpt,
    md5(text) as md5, sha256(text) as sha256, length(trim(text)) > 0 as non_blank from documents""",
)
def document_scalars(spark, d):
    t = F.col("text")
    return src.table(spark, d, "documents").select(
        "doc_id", text.normalise_tag(F.concat_ws(" ", "source", "lang")).alias("tag"), text.excerpt(t).alias("excerpt"), F.md5(t).alias("md5"), F.sha2(t, 256).alias("sha256"), text.non_blank(t).alias("non_blank")
    )


@query("i2_year_months", "select strftime(l_shipdate, '%Y-%m') as month, count(*) as n from lineitem group by 1")
def year_months(spark, d):
    return src.table(spark, d, "lineitem").groupBy(text.year_month(F.col("l_shipdate")).alias("month")).agg(F.count("*").alias("n"))


@query("i3_name_extensions", sql("media", r"select id, coalesce(regexp_extract(original_filename, '\.([^.]+)$', 1), '') as extension, regexp_replace(original_filename, '\.[^.]+$', '') as stem from media"))
def name_extensions(spark, d):
    n = F.col("original_filename")
    return src.media(spark, d).select("id", text.extension(n).alias("extension"), text.stem(n).alias("stem"))


@query(
    "i12_reason_lists",
    sql(
        "media",
        """select id, case when coalesce(blur_status, '') = '' then 'duplicate' else blur_status || ',duplicate' end as reasons,
        nullif(concat_ws(chr(10), nullif(coalesce(category, ''), ''), nullif(coalesce(blur_status, ''), '')), '') as log from media""",
    ),
)
def reason_lists(spark, d):
    return src.media(spark, d).select("id", text.append_reason(F.col("blur_status"), "duplicate").alias("reasons"), text.append_line(F.col("category"), F.col("blur_status")).alias("log"))


@query(
    "i19_embedded_json",
    """with r as (select event_id, case event_id % 5 when 0 then props when 1 then 'Sure: ' || props || ' done' when 2 then 'text' when 3 then '```json' || chr(10) || props || chr(10) || '```' else '[' || props || ']' end as reply, props from events)
    select event_id, case event_id % 5 when 2 then null when 4 then '[' || props || ']' else props end as json from r""",
)
def embedded_json(spark, d):
    e = src.table(spark, d, "events")
    reply = F.expr("case event_id % 5 when 0 then props when 1 then concat('Sure: ', props, ' done') when 2 then 'text' when 3 then concat('```json\\n', props, '\\n```') else concat('[', props, ']') end")
    return e.select("event_id", text.embedded_json(reply).alias("json"))


@query(
    "i20_pair_verdicts",
    """select event_id, case when event_id % 3 <> 0 then 'none' when value > 20 then 'yes' else 'no' end as verdict, case when event_id % 3 = 0 then round(least(greatest(value / 100, 0), 1), 6) end as confidence from events""",
)
def pair_verdicts(spark, d):
    e = src.table(spark, d, "events")
    reply = F.expr("case event_id % 3 when 0 then concat('{\"is_duplicate\": ', value > 20, ', \"confidence\": ', value / 100, '}') when 1 then '{\"is_duplicate\": true}' else 'no' end")
    v = e.select("event_id", text.pair_verdict(reply).alias("v"))
    verdict = F.when(F.col("v").isNull(), "none").when(F.col("v.is_duplicate"), "yes").otherwise("no").alias("verdict")
    return v.select("event_id", verdict, F.round("v.confidence", 6).alias("confidence"))


@query("i15_softmax", sql("vecs", """with e as (select seq, list_transform(v[1:4], lambda x: exp(x - list_max(v[1:4]))) as e from vecs)
select seq, round(e[1] / list_sum(e), 6) as p1, round(e[2] / list_sum(e), 6) as p2, round(e[3] / list_sum(e), 6) as p3, round(e[4] / list_sum(e), 6) as p4 from e"""))
def softmax(spark, d):
    s = src.vectors(spark, d).select("seq", vectors.softmax(F.slice("v", 1, 4)).alias("p"))
    return s.select("seq", *[F.round(F.col("p")[i], 6).alias(f"p{i + 1}") for i in range(4)])


@query("i16_norms", sql("vecs", "select seq, round(sqrt(list_dot_product(v, v)), 6) as norm, round(list_avg(v), 6) as mean from vecs"))
def norms(spark, d):
    return src.vectors(spark, d).select("seq", F.round(vectors.norm(F.col("v")), 6).alias("norm"), F.round(vectors.mean(F.col("v")), 6).alias("mean"))


@query("e8_population_variance", sql("vecs", "select trip_id, round(avg(x * x) - avg(x) * avg(x), 6) as variance, round(stddev_pop(x), 6) as stddev from (select trip_id, unnest(v) as x from vecs) group by trip_id"))
def population_variance(spark, d):
    x = src.vectors(spark, d).select("trip_id", F.explode("v").alias("x"))
    return x.groupBy("trip_id").agg(F.round(F.var_pop("x"), 6).alias("variance"), F.round(F.stddev_pop("x"), 6).alias("stddev"))


@query("e9_histogram_exposure", """with b as (select l_suppkey as frame, (l_partkey % 256)::int as v, count(*) as n from lineitem group by 1, 2),
s as (select frame, sum(v * n)::double / sum(n) as mean, sqrt(greatest(0, sum(v * v * n)::double / sum(n) - pow(sum(v * n)::double / sum(n), 2))) as sd from b group by frame)
select frame, round(mean, 6) as mean, round(sd, 6) as stddev, round(case when mean < 30 then mean / 30 * 10 when mean > 230 then (255 - mean) / 25 * 10 else
(case when mean < 60 then 0.3 + 0.7 * (mean - 30) / 30 when mean > 200 then 1 - 0.7 * (mean - 200) / 30 else 1 end) * (case when sd > 30 then 1 else 0.5 + 0.5 * sd / 30 end) * 100 end, 6) as exposure from s""")
def histogram_exposure(spark, d):
    """Frames as histograms of 256 bins: mean, spread and exposure score."""
    bins = src.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("frame"), (F.col("l_partkey") % 256).alias("v")).agg(F.count("*").alias("n"))
    n, v = F.col("n"), F.col("v")
    s = bins.groupBy("frame").agg((F.sum(v * n) / F.sum(n)).alias("mean"), (F.sum(v * v * n) / F.sum(n)).alias("square"))
    s = s.withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.pow("mean", F.lit(2)))))
    return s.select("frame", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("stddev"), F.round(scores.exposure_score(F.col("mean"), F.col("sd")), 6).alias("exposure"))


_FRAME = "select event_id as id, value / 490 * 255 as m, (event_id % 80)::double as s from events"


@query("l8_exposure_scores", f"""with f as ({_FRAME}) select id, round(case when m < 30 then m / 30 * 10 when m > 230 then (255 - m) / 25 * 10 else
(case when m < 60 then 0.3 + 0.7 * (m - 30) / 30 when m > 200 then 1 - 0.7 * (m - 200) / 30 else 1 end) * (case when s > 30 then 1 else 0.5 + 0.5 * s / 30 end) * 100 end, 6) as score from f""")
def exposure_scores(spark, d):
    f = src.table(spark, d, "events").selectExpr("event_id as id", "value / 490 * 255 as m", "cast(event_id % 80 as double) as s")
    return f.select("id", F.round(scores.exposure_score(F.col("m"), F.col("s")), 6).alias("score"))


@query("l10_stability_scores", """with f as (select event_id as id, value / 8 as d from events) select id, round(case when d < 5 then 100 when d <= 15 then 100 - (d - 5) / 10 * 50 else greatest(0, 50 - (d - 15) / 30 * 50) end, 6) as score from f""")
def stability_scores(spark, d):
    f = src.table(spark, d, "events").selectExpr("event_id as id", "value / 8 as d")
    return f.select("id", F.round(scores.stability_score(F.col("d")), 6).alias("score"))


@query("l10_frame_differences", sql("vecs", "select a.seq, round(list_sum(list_transform(list_zip(a.v, b.v), lambda x: abs(x[1] - x[2]))) / 64, 6) as difference from vecs a join vecs b on b.seq = a.seq + 1"))
def frame_differences(spark, d):
    a = src.vectors(spark, d)
    b = a.select((F.col("seq") - 1).alias("seq"), F.col("v").alias("w"))
    return a.join(b, "seq").select("seq", F.round(vectors.mean_difference(F.col("v"), F.col("w")), 6).alias("difference"))


@query("l3_blur_status", """with f as (select event_id as id, case when event_id % 9 = 0 then null else value / 4 end as a, (event_id % 100)::double as b from events)
select id, case when a is null then 'suspect' when least(a, b) < 15 then 'blurry' when least(a, b) < 50 then 'suspect' else 'clear' end as blur_status,
case when b >= 50 then 'clear' when b < 15 then case when a >= 25 then 'suspect' else 'blurry' end else 'suspect' end as dual from f""")
def blur_status(spark, d):
    f = src.table(spark, d, "events").selectExpr("event_id as id", "case when event_id % 9 = 0 then null else value / 4 end as a", "cast(event_id % 100 as double) as b")
    return f.select("id", scores.blur_status(F.col("a"), F.col("b")).alias("blur_status"), scores.blur_status_dual(F.col("b"), F.col("a")).alias("dual"))


@query("l11_optimise_parameters", """select event_id as id, case when value < 80 then 1.08 when value > 180 then 0.92 else 1.0 end::double as gamma, case when (event_id % 10) / 10.0 >= 0.4 then 3 else 0 end as median,
case when (event_id % 10) / 10.0 >= 0.6 then null when (event_id % 10) / 10.0 >= 0.4 then 0.2 else 0.25 end::double as sharpen from events""")
def optimise_parameters(spark, d):
    e = src.table(spark, d, "events")
    p = scores.optimise_parameters(F.col("value"), F.col("event_id") % 10 / 10)
    return e.select(F.col("event_id").alias("id"), p.alias("p")).select("id", "p.*")


@query("l13_edit_parameters", """with p as (select event_id as id, (event_id % 201 - 100)::double as x, (event_id % 101)::double as y from events), q as (select *, greatest(0.1, 1 + x / 100) as a from p)
select id, round(a, 6) as a, round(128 * (1 - a) + 128 * y / 100, 6) as b, round(greatest(0, 1 + x / 100), 6) as saturation, round(0.3 + 1.7 * y / 100, 6) as sigma from q""")
def edit_parameters(spark, d):
    e = src.table(spark, d, "events").selectExpr("event_id as id", "cast(event_id % 201 - 100 as double) as x", "cast(event_id % 101 as double) as y")
    p = e.select("id", scores.edit_parameters(F.col("y"), F.col("x"), F.col("x"), F.col("y")).alias("p")).select("id", "p.*")
    return p.select("id", *[F.round(c, 6).alias(c) for c in ("a", "b", "saturation", "sigma")])


@query("l14_thumbnail_sizes", sql("media", """with s as (select id, width, height, least(400.0::double / width, 400.0::double / height, 1.0) as k from media)
select id, greatest(1, round(width * k))::int as width, greatest(1, round(height * k))::int as height from s"""))
def thumbnail_sizes(spark, d):
    return src.media(spark, d).select("id", scores.fit_inside(F.col("width"), F.col("height"), 400).alias("s")).select("id", "s.*")


_DIMS = """d as (select seq, least((case when seq % 11 = 0 then null else seq * 37 % 200 end) * 4 / 500.0::double, 1.0) as sh, 1 - abs(seq % 256 - 128) / 128.0::double as ex, exp(-0.5 * pow((seq % 100 - 60) / 20.0::double, 2)) as co,
case when width * height = 0 then null else least(width::double * height / 12000000, 1.0) end as re, 1 - least((seq % 15) / 10.0::double, 1.0) as no, least(file_size * 6000 / 5000000.0::double, 1.0) as si, (seq % 37 * 3)::double as mu, case when seq % 4 = 0 then null else (seq % 11)::double end as ae from curated)"""


def _dimensions(spark, d):
    c = src.curated(spark, d)
    return c.select(
        "seq",
        scores.sharpness_score(F.col("sharpness") * 4).alias("sh"),
        scores.exposure_norm(F.col("seq") % 256).alias("ex"),
        scores.contrast_score(F.col("seq") % 100).alias("co"),
        F.when(F.col("width") * F.col("height") != 0, scores.resolution_score(F.col("width") * F.col("height"))).alias("re"),
        scores.noise_score(F.col("seq") % 15 / 10).alias("no"),
        scores.file_size_score(F.col("file_size") * 6000).alias("si"),
        (F.col("seq") % 37 * 3).cast("double").alias("mu"),
        F.when(F.col("seq") % 4 != 0, (F.col("seq") % 11).cast("double")).alias("ae"),
    )


@query("m1_normalised_dimensions", sql("curated", f"with {_DIMS} select seq, round(sh, 6) as sh, round(ex, 6) as ex, round(co, 6) as co, round(re, 6) as re, round(no, 6) as no, round(si, 6) as si from d"))
def normalised_dimensions(spark, d):
    return _dimensions(spark, d).select("seq", *[F.round(c, 6).alias(c) for c in ("sh", "ex", "co", "re", "no", "si")])




def _weighted_sql(parts):
    top = " + ".join(f"coalesce({c} * {w}::double, 0)" for c, w in parts)
    bottom = " + ".join(f"case when {c} is null then 0 else {w}::double end" for c, w in parts)
    return f"coalesce(({top}) / nullif({bottom}, 0), 0)"


_M3 = _weighted_sql([("sh", 0.45), ("ex", 0.10), ("co", 0.10), ("re", 0.15), ("no", 0.10), ("si", 0.10)])
_M4 = _weighted_sql([("sh", 0.30), ("mu / 100", 0.25), ("ae / 10", 0.20), ("re", 0.10), ("ex", 0.10), ("si", 0.05)])


@query("m3_quality_overall", sql("curated", f"with {_DIMS} select seq, round(case when sh < 0.15 then least({_M3}, 0.2) else {_M3} end, 6) as quality from d"))
def quality_overall(spark, d):
    q = scores.overall(*[F.col(c) for c in ("sh", "ex", "co", "re", "no", "si")])
    return _dimensions(spark, d).select("seq", F.round(q, 6).alias("quality"))


@query("m4_quality_with_models", sql("curated", f"with {_DIMS} select seq, round(case when mu < 15 then least({_M4}, 0.1) when mu < 20 then least({_M4}, 0.25) else {_M4} end, 9) as quality from d"))
def quality_with_models(spark, d):
    q = scores.model_overall(*[F.col(c) for c in ("sh", "mu", "ae", "re", "ex", "si")])
    return _dimensions(spark, d).select("seq", F.round(q, 9).alias("quality"))


@query("q4_category_by_scores", sql("vecs", """with e as (select seq, list_transform(v[1:4], lambda x: exp(4 * x - list_max(v[1:4]) * 4)) as e from vecs), p as (select seq, e[1] / list_sum(e) as p, e[2] / list_sum(e) as a, e[3] / list_sum(e) as l, e[4] / list_sum(e) as o from e)
select seq, case when p >= 0.30 and p >= a - 0.03 then 'people' when a >= 0.38 and a - p >= 0.05 then 'animal' when l >= 0.35 then 'landscape' when p = greatest(p, a, l, o) then 'people'
when a = greatest(p, a, l, o) then 'animal' when l = greatest(p, a, l, o) then 'landscape' else 'other' end as category from p"""))
def category_by_scores(spark, d):
    s = src.vectors(spark, d).select("seq", vectors.softmax(F.transform(F.slice("v", 1, 4), lambda x: 4 * x)).alias("p"))
    return s.select("seq", classify.by_scores(*[F.col("p")[i] for i in range(4)]).alias("category"))


_LABELS = "element_at(array('Person', 'dog', 'SKY', 'Lake', 'table', 'Cat', 'child', 'Tree'), cast(l_partkey % 8 + 1 as int))"


@query("q5_category_by_labels", """with l as (select l_orderkey as id, ['Person', 'dog', 'SKY', 'Lake', 'table', 'Cat', 'child', 'Tree'][(l_partkey % 8 + 1)::int] as label, (l_suppkey % 40 + 60)::double as confidence from lineitem),
f as (select *, case when lower(label) in ('person', 'child') then 'p' when lower(label) in ('dog', 'cat') then 'a' when lower(label) in ('sky', 'lake') then 'l' end as f from l),
g as (select id, count(*) filter (where f = 'p') as pn, count(*) filter (where f = 'a') as an, count(*) filter (where f = 'l') as ln, coalesce(max(confidence) filter (where f = 'p'), 0) as ptop, coalesce(max(confidence) filter (where f = 'a'), 0) as atop from f group by id)
select id, case when pn > 0 and an > 0 then case when an >= pn + 2 or atop >= ptop + 8 then 'animal' else 'people' end when pn > 0 then 'people'
when an > 0 then case when ln > 0 and not (an >= 2 or atop >= 85) then 'landscape' else 'animal' end when ln > 0 then 'landscape' else 'other' end as category from g""")
def category_by_labels(spark, d):
    labels = src.table(spark, d, "lineitem").selectExpr("l_orderkey as id", f"{_LABELS} as label", "cast(l_suppkey % 40 + 60 as double) as confidence")
    return classify.by_labels(labels, "id")


@query("q10_repaired_answers", sql("media", "select id, case when lower(trim(category)) in ('people', 'animal') then lower(trim(category)) else 'other' end as category from media"))
def repaired_answers(spark, d):
    return src.media(spark, d).select("id", classify.repaired(F.col("category"), ["people", "animal"], "other").alias("category"))


@query("q12_classification_chain", sql("media", "select id, coalesce(nullif(category, ''), blur_status, 'other') as category, case when nullif(category, '') is not null then 'local' when blur_status is not null then 'remote' else 'fallback' end as source from media"))
def classification_chain(spark, d):
    return src.media(spark, d).select("id", classify.chain(F.nullif("category", F.lit("")), F.col("blur_status")).alias("c")).select("id", "c.*")
