"""Queries on measures of decoded images: sharpness, noise, exposure, casts and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions import hashing, pixels, scores, vectors
from winnow.plans.registry import query
from winnow.sources import adapters as src


def _pixels(width: int, height: int, channels: int = 1) -> str:
    """DuckDB SQL for the bytes of the pictures: px (trip_id, seq, r, c, ch, p)."""
    n, row = width * height * channels, width * channels
    return f"""k as (select i, i // {row} as r, i % {row} // {channels} as c, i % {channels} as ch from (select unnest(range(0, {n})) as i)), vs as (select label as trip_id, vec_id as seq, list_transform(embedding, lambda x: x::double) as v from embeddings),
px as (select trip_id, seq, r, c, ch, least(255, greatest(0, floor(128 + 200 * (v[((r + 21 * ch) % 64 + 1)::int] + v[(c % 64 + 1)::int]))))::int as p from vs, k)"""


_EDGES = """e as (select seq, least(greatest(coalesce(lag(p) over down, p) + coalesce(lead(p) over down, p) + coalesce(lag(p) over along, p) + coalesce(lead(p) over along, p) - 4 * p, 0), 255) as e from {source}
window down as (partition by seq, c order by r), along as (partition by seq, r order by c))"""


def _measured(spark, d, names, channels=1):
    """The named measures of pictures of 64 x 64."""
    names = names.split()
    return pixels.measured(src.pictures(spark, d, 64, 64, channels), names).select("trip_id", "seq", "width", "height", "measures.*")


def _hex(bits: str, size: int = 64) -> str:
    """DuckDB SQL for a list of booleans as hexadecimal digits."""
    digit = " + ".join(f"{8 >> j} * {bits}[(4 * k + {j + 1})::int]::int" for j in range(4))
    return f"array_to_string(list_transform(range(0, {size // 4}), lambda k: substr('0123456789abcdef', ({digit} + 1)::int, 1)), '')"


@query("l1_plain_sharpness", f"with {_pixels(64, 64)}, {_EDGES.format(source='px')} select seq, round(var_pop(e), 6) as sharpness from e group by seq")
def plain_sharpness(spark, d):
    """As it is measured where there is no local equalisation."""
    return _measured(spark, d, "plain_sharpness").select("seq", F.round("plain_sharpness", 6).alias("sharpness"))


@query("l1_sharpness")
def sharpness(spark, d):
    """With local equalisation between the centres of tiles; compared with plain loops in the tests."""
    return _measured(spark, d, "sharpness").select("seq", F.round("sharpness", 6).alias("sharpness"))


@query("l2_centre_sharpness", f"with {_pixels(64, 64)}, m as (select * from px where r between 16 and 47 and c between 16 and 47), {_EDGES.format(source='m')} select seq, round(var_pop(e), 6) as sharpness from e group by seq")
def centre_sharpness(spark, d):
    return _measured(spark, d, "plain_centre_sharpness").select("seq", F.round("plain_centre_sharpness", 6).alias("sharpness"))


@query("l4_dual_blur", "with f as (select event_id as id, case when event_id % 9 = 0 then null else value / 4 end as a, (event_id % 100)::double as b from events) select id, case when b >= 50 then 'clear' when b < 15 then case when a >= 25 then 'suspect' else 'blurry' end else 'suspect' end as status from f")
def dual_blur(spark, d):
    f = src.table(spark, d, "events").selectExpr("event_id as id", "case when event_id % 9 = 0 then null else value / 4 end as a", "cast(event_id % 100 as double) as b")
    return f.select("id", scores.blur_status_dual(F.col("b"), F.col("a")).alias("status"))


@query("l5_blur_by_two_measures")
def blur_by_two_measures(spark, d):
    """The lesser of the edges' variances with and without local equalisation; compared with plain loops in the tests."""
    return _measured(spark, d, "blur_sharpness").select("seq", F.round("blur_sharpness", 6).alias("sharpness"))


@query("l6_noise")
def noise(spark, d):
    """Edges against spread at 256 x 256, to which pictures are scaled: compared with plain loops in the tests."""
    return _measured(spark, d, "noise").select("seq", F.round("noise", 6).alias("noise"))


_CHANNELS = f"{_pixels(64, 64, 3)}, v as (select seq, avg(p) filter (where ch = 2) as r, avg(p) filter (where ch = 1) as g, avg(p) filter (where ch = 0) as b, (stddev_pop(p) filter (where ch = 0) + stddev_pop(p) filter (where ch = 1) + stddev_pop(p) filter (where ch = 2)) / 3 as contrast from px group by seq)"


@query("l7_image_analysis", f"with {_CHANNELS} select seq, round((r + g + b) / 3, 6) as brightness, round(contrast, 6) as contrast, round(r - (r + g + b) / 3, 6) as cast_r, round(g - (r + g + b) / 3, 6) as cast_g, round(b - (r + g + b) / 3, 6) as cast_b from v")
def image_analysis(spark, d):
    names = ("brightness", "contrast", "cast_r", "cast_g", "cast_b")
    return _measured(spark, d, " ".join(names), 3).select("seq", *[F.round(c, 6).alias(c) for c in names])


@query("e10_channel_spread", f"with {_CHANNELS} select seq, round((r + g + b) / 3, 6) as mean, round(contrast, 6) as stdev from v")
def channel_spread(spark, d):
    return _measured(spark, d, "brightness contrast", 3).select("seq", F.round("brightness", 6).alias("mean"), F.round("contrast", 6).alias("stdev"))


_EXPOSURE = "round(case when m < 30 then m / 30 * 10 when m > 230 then (255 - m) / 25 * 10 else (case when m < 60 then 0.3 + 0.7 * (m - 30) / 30 when m > 200 then 1 - 0.7 * (m - 200) / 30 else 1 end) * (case when s > 30 then 1 else 0.5 + 0.5 * s / 30 end) * 100 end, 2) as exposure"


@query("l9_frame_exposures", f"with {_pixels(64, 64)}, s as (select seq, avg(p) as m, stddev_pop(p) as s from px group by seq) select seq, round(m, 2) as mean, round(s, 2) as stddev, {_EXPOSURE} from s")
def frame_exposures(spark, d):
    m = _measured(spark, d, "exposure_mean exposure_stddev")
    return m.select("seq", scores.frame_exposure(F.col("exposure_mean"), F.col("exposure_stddev")).alias("e")).select("seq", "e.*")


@query("l9_unreadable_frames", "select vec_id as seq, 128.0::double as mean, 0.0::double as stddev, 50.0::double as exposure from embeddings")
def unreadable_frames(spark, d):
    """Frames whose bytes are missing take fixed values."""
    bad = src.pictures(spark, d, 64, 64, 1).withColumn("data", F.lit(None).cast("binary"))
    m = pixels.measured(bad, ["exposure_mean", "exposure_stddev"]).select("seq", "measures.*")
    return m.select("seq", scores.frame_exposure(F.col("exposure_mean"), F.col("exposure_stddev")).alias("e")).select("seq", "e.*")


@query("l15_review_sizes", "select l_orderkey * 100 + l_linenumber as id, count(*) as n, max(greatest(1, round(w * k))::int) as width, max(greatest(1, round(h * k))::int) as height from (select *, least(768.0::double / w, 768.0::double / h, 1.0) as k from (select *, l_quantity::int * 100 as w, (l_partkey % 40)::int * 100 + 100 as h from lineitem)) group by 1")
def review_sizes(spark, d):
    """Sizes that images are scaled to before a review."""
    m = src.table(spark, d, "lineitem").selectExpr("l_orderkey * 100 + l_linenumber as id", "cast(l_quantity as int) * 100 as w", "cast(l_partkey % 40 as int) * 100 + 100 as h")
    s = m.select("id", scores.fit_inside(F.col("w"), F.col("h"), 768).alias("s"))
    return s.groupBy("id").agg(F.count("*").alias("n"), F.max("s.width").alias("width"), F.max("s.height").alias("height"))


def _bits(pixels: str, cells: str, bit: str) -> str:
    """DuckDB SQL for 64 bits of pictures by cells of rows i and columns j: b."""
    return f"with {pixels}, n as (select seq, {cells}, avg(p) as p from px group by all), m as (select seq, i, j, {bit} as bit from n), b as (select seq, list(bit order by i, j) as b from m where i < 8 and j < 8 group by seq)"


_RISING = "p > lead(p) over (partition by seq, i order by j)"


@query("j4_gradient_hashes", f"{_bits(_pixels(9, 8), 'r as i, c as j', _RISING)} select seq, {_hex('b')} as dhash from b")
def gradient_hashes(spark, d):
    """From 9 x 8 grey values, without Python."""
    p = src.pictures(spark, d, 9, 8, 1).select("seq", F.transform(F.sequence(F.lit(1), F.lit(72)), lambda i: F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("int")).alias("p"))
    return p.select("seq", hashing.digits(hashing.gradient_hash(F.col("p"))).alias("dhash"))


@query("j4_gradient_hashes_of_images", f"{_bits(_pixels(64, 64), 'r // 8 as i, (c * 9 + 8) // 64 as j', _RISING)} select seq, {_hex('b')} as dhash from b")
def gradient_hashes_of_images(spark, d):
    """Of pictures that are scaled to 9 x 8."""
    return _measured(spark, d, "dhash").select("seq", "dhash")


@query("j6_corner_hashes", f"{_bits(_pixels(64, 64), 'r // 2 as i, c // 2 as j', 'p > avg(p) over (partition by seq)')} select seq, {_hex('b')} as phash from b")
def corner_hashes(spark, d):
    return _measured(spark, d, "legacy_phash").select("seq", F.col("legacy_phash").alias("phash"))


@query("s5_analysed_trips", f"with {_CHANNELS}, t as (select label as trip_id, (r + g + b) / 3 as brightness from v join embeddings on vec_id = seq) select trip_id, count(*) as images, round(avg(brightness), 6) as brightness from t group by trip_id")
def analysed_trips(spark, d):
    """All images of each trip measured, and their mean brightness."""
    return _measured(spark, d, "brightness", 3).groupBy("trip_id").agg(F.count("*").alias("images"), F.round(F.avg("brightness"), 6).alias("brightness"))


_GAUSS = "exp(-8.0::double)"


@query("l12_optimised_pictures", f"""with {_pixels(64, 64)}, m as (select seq, avg(p) as m from px group by seq),
g as (select seq, r, c, 255 * pow(p / 255.0::double, 1 / case when m < 126 then 1.08 when m > 130 then 0.92 else 1.0 end::double) as p from px join m using (seq)),
h as (select *, ({_GAUSS} * coalesce(lag(p) over w, p) + p + {_GAUSS} * coalesce(lead(p) over w, p)) / (1 + 2 * {_GAUSS}) as x from g window w as (partition by seq, r order by c)),
v as (select *, ({_GAUSS} * coalesce(lag(x) over w, x) + x + {_GAUSS} * coalesce(lead(x) over w, x)) / (1 + 2 * {_GAUSS}) as y from h window w as (partition by seq, c order by r)),
o as (select seq, r * 64 + c as i, least(255, greatest(0, round(p + p - y)))::int as o from v)
select seq, md5(string_agg(printf('%02x', o), '' order by i)) as md5 from o group by seq""")
def optimised_pictures(spark, d):
    """Pictures with gamma by their brightness, sharpened by 0.25: the digest of their bytes in hexadecimal."""
    p = src.pictures(spark, d, 64, 64, 1)
    m = pixels.measured(p, ["brightness"]).withColumn("b", F.col("measures.brightness"))
    m = m.withColumns({"gamma": F.when(F.col("b") < 126, 1.08).when(F.col("b") > 130, 0.92).otherwise(1.0), "median": F.lit(0), "sharpen": F.lit(0.25)})
    return pixels.optimised_images(m).select("seq", F.md5(F.lower(F.hex("optimised"))).alias("md5"))


@query("s5_prepared_trips", f"with {_CHANNELS} select label as trip_id, seq, case when (r + g + b) / 3 < 80 then 1.08 when (r + g + b) / 3 > 180 then 0.92 else 1.0 end::double as gamma, 24 as thumbnail_width, 24 as thumbnail_height from v join embeddings on vec_id = seq")
def prepared_trips(spark, d):
    """For the images of all trips: how the optimiser would change them by their brightness, and the sizes of thumbnails of 24 pixels."""
    m = _measured(spark, d, "brightness", 3)
    p, s = scores.optimise_parameters(F.col("brightness"), F.lit(0.0)), scores.fit_inside(F.col("width"), F.col("height"), 24)
    return m.select("trip_id", "seq", p["gamma"].alias("gamma"), s["width"].alias("thumbnail_width"), s["height"].alias("thumbnail_height"))


@query("i17_dot_products", "select a.vec_id as seq, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as dot from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def dot_products(spark, d):
    e = src.table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w"))
    return e.join(b, "vec_id").select(F.col("vec_id").alias("seq"), F.round(vectors.dot(F.col("embedding"), F.col("w")), 6).alias("dot"))


@query("i23_rounded_values", "select event_id, round(value, 2) as rounded, round_even(value, 0) as even from events")
def rounded_values(spark, d):
    return src.table(spark, d, "events").select("event_id", F.round("value", 2).alias("rounded"), F.bround("value", 0).alias("even"))


@query("i14_built_in_functions", "select event_id, round(least(value, 100.0) + greatest(value - 50, 0.0), 6) as a, round(sqrt(value) + pow(value / 100, 2) + exp(-value / 100), 6) as b, ceil(value)::bigint as c, abs(value - 200) as d from events")
def built_in_functions(spark, d):
    v = F.col("value")
    return src.table(spark, d, "events").select("event_id", F.round(F.least(v, F.lit(100.0)) + F.greatest(v - 50, F.lit(0.0)), 6).alias("a"), F.round(F.sqrt(v) + F.pow(v / 100, F.lit(2)) + F.exp(-v / 100), 6).alias("b"), F.ceil(v).alias("c"), F.abs(v - 200).alias("d"))
