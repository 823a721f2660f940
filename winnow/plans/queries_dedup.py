"""Queries on exact and perceptual duplicates, similarity joins, components and best of group."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.config import DedupThresholds
from winnow.functions import hashing
from winnow.operators import graph, selection, similarity
from winnow.operators.relational import CATEGORIES
from winnow.plans import commands, curation, dedup
from winnow.plans.prelude import sql
from winnow.plans.registry import ORACLES, query
from winnow.sources import adapters as src

#: The product's distance of hashes.
HASH_DISTANCE = DedupThresholds().hash_distance


@query("j7_exact_duplicates", "select md5(text) as md5, min(doc_id) as first, count(*) as n from documents group by md5(text) having count(*) > 1")
def exact_duplicates(spark, d):
    return similarity.exact_duplicates(src.table(spark, d, "documents"), F.col("text"), "doc_id")


@query(
    "j5_perceptual_hashes",
    sql(
        "bits",
        """select seq, array_to_string(list_transform(range(1, 17), lambda k: substr('0123456789abcdef', (1 + 8 * pb[(4 * k - 3)::int]::int + 4 * pb[(4 * k - 2)::int]::int + 2 * pb[(4 * k - 1)::int]::int + pb[(4 * k)::int]::int)::int, 1)), '') as phash,
        array_to_string(list_transform(range(1, 17), lambda k: substr('0123456789abcdef', (1 + 8 * db[(4 * k - 3)::int]::int + 4 * db[(4 * k - 2)::int]::int + 2 * db[(4 * k - 1)::int]::int + db[(4 * k)::int]::int)::int, 1)), '') as dhash from bits""",
    ),
)
def perceptual_hashes(spark, d):
    return similarity.with_hashes(src.vectors(spark, d)).select("seq", hashing.digits(F.col("phash")).alias("phash"), hashing.digits(F.col("dhash")).alias("dhash"))


@query("j3_hash_pairs", sql("dist", f"select trip_id, i, j from dist where pd <= {HASH_DISTANCE} and dd <= {HASH_DISTANCE}"))
def hash_pairs(spark, d):
    return similarity.hash_pairs(src.hashed(src.vectors(spark, d)), HASH_DISTANCE)


@query("d10_hash_or_md5_pairs", sql("dist", f"select trip_id, i, j from dist where (pd <= {HASH_DISTANCE} and dd <= {HASH_DISTANCE}) or i % 50 = j % 50"))
def hash_or_md5_pairs(spark, d):
    rows = src.hashed(src.vectors(spark, d)).withColumn("file_md5", F.md5((F.col("seq") % 50).cast("string")))
    return similarity.hash_pairs(rows, HASH_DISTANCE, md5="file_md5")


@query("d11_cosine_pairs", sql("dist", "select trip_id, i, j, round(sim, 6) as sim from dist where sim >= 0.86"))
def cosine_pairs(spark, d):
    return similarity.cosine_pairs(src.vectors(spark, d), 0.86).withColumn("sim", F.round("sim", 6))


_TOP = """with b as (select trip_id, i, j, sim from dist union all select trip_id, j, i, sim from dist union all select trip_id, seq, seq, 1.0 from vecs),
r as (select *, row_number() over (partition by trip_id, i order by sim desc, j) as rn from b)
select trip_id, least(i, j) as i, greatest(i, j) as j, round(max(sim), 6) as sim from r where rn <= {k} and i <> j and sim >= {t} group by trip_id, least(i, j), greatest(i, j)"""


@query("d12_cosine_top_k", sql("vecs dist", _TOP.format(k=5, t=0.2)))
def cosine_top_k(spark, d):
    return similarity.cosine_pairs(src.vectors(spark, d), 0.2, top_k=5).withColumn("sim", F.round("sim", 6))


_TIERS = """with b as (select trip_id, i, j, sim from dist union all select trip_id, j, i, sim from dist union all select trip_id, seq, seq, 1.0 from vecs),
r as (select *, row_number() over (partition by trip_id, i order by sim desc, j) as rn from b),
n as (select distinct trip_id, least(i, j) as i, greatest(i, j) as j from r where rn <= 51 and i <> j),
t as (select dist.*, case when sim >= 0.93 then 'confirmed' when sim >= 0.90 then 'gray' when sim >= 0.86 and abs(j - i) <= 60 and (pd <= 8 or dd <= 8) then 'gray' else 'skip' end as tier from dist join n using (trip_id, i, j))"""


def _tiers():
    """The product's thresholds; images of one trip are some ten numbers apart here."""
    return DedupThresholds(gray_seq_distance=60)


@query("d13_tiered_pairs", sql("vecs dist", _TIERS + " select trip_id, i, j, round(sim, 6) as sim, tier from t where tier <> 'skip'"))
def tiered_pairs(spark, d):
    rows = src.hashed(src.vectors(spark, d))
    return similarity.tiered_pairs(rows, _tiers()).withColumn("sim", F.round("sim", 6))


@query("j12_strict_gray_pairs", sql("vecs dist", _TIERS + " select trip_id, i, j from t where tier = 'gray' and sim >= 0.92"))
def strict_gray_pairs(spark, d):
    rows = src.hashed(src.vectors(spark, d))
    gray = similarity.tiered_pairs(rows, _tiers()).where("tier = 'gray'")
    return dedup.review_gray(gray, _tiers()).where("confirmed").select("trip_id", "i", "j")


@query("d19_gray_pair_ends", sql("vecs dist curated", _TIERS + " select i, j, a.file_size as size_i, b.file_size as size_j from t join curated a on a.seq = i join curated b on b.seq = j where tier = 'gray'"))
def gray_pair_ends(spark, d):
    gray = similarity.tiered_pairs(src.hashed(src.vectors(spark, d)), _tiers()).where("tier = 'gray'")
    c = src.curated(spark, d).select("seq", "file_size")
    a, b = c.withColumnsRenamed({"seq": "i", "file_size": "size_i"}), c.withColumnsRenamed({"seq": "j", "file_size": "size_j"})
    return gray.join(a, "i").join(b, "j").select("i", "j", "size_i", "size_j")


_COMPONENTS = """e as (select i as a, j as b from dist where sim > {t} union select j, i from dist where sim > {t}),
reach as (select a, a as b from e union select reach.a, e.b from reach join e on reach.b = e.a),
comp as (select a as node, min(b) as label from reach group by a)"""


@query("d14_strict_groups", sql("dist", f"with recursive {_COMPONENTS.format(t=0.86)} select label, count(*) as size, array_to_string(list_sort(list(node)), ',') as members from comp group by label"))
def strict_groups(spark, d):
    pairs = similarity.cosine_pairs(src.vectors(spark, d), 0.86, strict=True).select(F.col("i").alias("a"), F.col("j").alias("b"))
    return graph.groups(pairs).select("label", "size", F.array_join("members", ",").alias("members"))


@query("k2_components", sql("dist", f"with recursive {_COMPONENTS.format(t=0.8)} select node, label from comp"))
def components(spark, d):
    return graph.components(similarity.cosine_pairs(src.vectors(spark, d), 0.8, strict=True).select(F.col("i").alias("a"), F.col("j").alias("b")))


@query("k4_group_similarities", sql("dist", f"with recursive {_COMPONENTS.format(t=0.86)} select label, count(*) as edges, round(max(sim), 6) as most, round(min(sim), 6) as least from dist join comp on node = i where sim > 0.86 group by label"))
def group_similarities(spark, d):
    pairs = similarity.cosine_pairs(src.vectors(spark, d), 0.86, strict=True)
    labels = graph.components(pairs.select(F.col("i").alias("a"), F.col("j").alias("b")))
    g = pairs.join(labels, F.col("i") == F.col("node")).groupBy("label")
    return g.agg(F.count("*").alias("edges"), F.round(F.max("sim"), 6).alias("most"), F.round(F.min("sim"), 6).alias("least"))


def _grouped(spark, d):
    """Curated rows in groups of twenty, without any graph: for the rules of selection."""
    return src.curated(spark, d).withColumn("label", F.floor(F.col("seq") / 20).cast("long"))


_MEMBERS = """g as (select *, seq // 20 as label, coalesce(sharpness, 0) as sh, width::bigint * height as px from curated)"""
_FOLD = """w as (select label, bool_or(coalesce(blur_status = 'clear', false)) as clear from g group by label),
pool as (select g.* from g join w using (label) where not clear or blur_status is distinct from 'suspect'),
l as (select label, list({'seq': seq, 'sh': sh, 'px': px, 'fs': file_size} order by seq) as m from pool group by label)
select label, list_reduce(m, lambda b, c: case when c.sh > b.sh * 1.2 then c when c.sh < b.sh * 0.8 then b when c.px > b.px or (c.px = b.px and c.fs > b.fs) then c else b end).seq as keep from l"""


@query("m2_keep_best_fold", sql("curated", f"with {_MEMBERS}, {_FOLD}"))
def keep_best(spark, d):
    return selection.keep_best(_grouped(spark, d))


@query("f4_keep_by_rank", sql("curated", f"with {_MEMBERS} select label, seq as keep from (select *, row_number() over (partition by label order by sharpness desc nulls last, px desc, file_size desc, seq) as rn from g) where rn = 1"))
def keep_by_rank(spark, d):
    return selection.keep_by_rank(_grouped(spark, d), "sharpness")


@query("g11_keep_by_key", sql("curated", f"with {_MEMBERS} select label, seq as keep from (select *, row_number() over (partition by label order by sh desc, px desc, file_size desc, seq) as rn from g) where rn = 1"))
def keep_by_key(spark, d):
    return selection.keep_by_key(_grouped(spark, d))


@query("m8_keep_by_pairs", sql("curated", f"""with {_MEMBERS}, l as (select label, list({{'seq': seq, 'sh': sh, 'px': px}} order by seq) as m from g group by label)
select label, list_reduce(m, lambda b, c: case when abs(c.sh - b.sh) >= 10 then case when c.sh > b.sh then c else b end when c.px > b.px then c else b end).seq as keep from l"""))
def keep_by_pairs(spark, d):
    return selection.keep_by_pairs(_grouped(spark, d))


_EVIDENCE = f"""ev as (select trip_id, i, j, 'hash' as source, null::double as score, true as confirmed from dist where pd <= {HASH_DISTANCE} and dd <= {HASH_DISTANCE}
union all select trip_id, i, j, 'tiered', sim, true from t where tier = 'confirmed' union all select trip_id, i, j, 'gray', sim, sim >= 0.92 from t where tier = 'gray')"""


def _assess(spark, d, images=None):
    rows = src.curated(spark, d) if images is None else images
    return dedup.assess(rows, _tiers())


@query("j13_pair_evidence", sql("vecs dist", f"{_TIERS}, {_EVIDENCE} select trip_id, i, j, source, coalesce(round(score, 6), -1) as score, confirmed from ev"))
def pair_evidence(spark, d):
    e = dedup.pair_evidence(src.hashed(src.vectors(spark, d)), _tiers())
    return e.withColumn("score", F.coalesce(F.round("score", 6), F.lit(-1.0)))


@query("j14_capabilities", sql("vecs dist", f"{_TIERS}, {_EVIDENCE} select coalesce(bool_or(source = 'hash'), false) as hash, coalesce(bool_or(source in ('tiered', 'gray')), false) as tiered, false as dense from ev"))
def capabilities(spark, d):
    return _assess(spark, d).capabilities()


_ASSESS = f"""ce as (select i as a, j as b from ev where confirmed union select j, i from ev where confirmed),
reach as (select a, a as b from ce union select reach.a, ce.b from reach join ce on reach.b = ce.a),
comp as (select a as node, min(b) as label from reach group by a),
g as (select c.*, label, coalesce(sharpness, 0) as sh, width::bigint * height as px from curated c join comp on node = seq),
keepers as (with {_FOLD})"""


@query("s2_dedup_assessment", sql("vecs dist curated", "with recursive " + f"{_TIERS}, {_EVIDENCE}, {_ASSESS}".removeprefix("with ") + " select c.trip_id, c.seq, coalesce(g.label, c.seq) as label, coalesce(k.keep, c.seq) = c.seq as kept from curated c left join g on g.seq = c.seq left join keepers k on k.label = g.label"))
def dedup_assessment(spark, d):
    return _assess(spark, d).images


@query("s7_assessed_by_sql", ORACLES["s2_dedup_assessment"])
def assessed_by_sql(spark, d):
    """The assessment of s2: evidence and components by command, best of group and what is kept from SQL text."""
    commands.register(spark)
    src.curated(spark, d).createOrReplaceTempView("curated")
    commands.run(spark, "assess", "curated", into="assessed", gray_seq_distance=60)
    return spark.sql("""with grouped as (select c.*, a.label from curated c join assessed a using (trip_id, seq)), best as (select * from keep_best_of(TABLE(select label, seq, sharpness, width, height, file_size, blur_status from grouped
where label in (select label from grouped group by label having count(*) > 1)) PARTITION BY label ORDER BY seq))
select g.trip_id, g.seq, g.label, coalesce(b.keep, g.seq) = g.seq as kept from grouped g left join best b using (label)""")


@query("h3_kept_and_removed", sql("vecs dist curated", "with recursive " + f"{_TIERS}, {_EVIDENCE}, {_ASSESS}".removeprefix("with ") + " select c.trip_id, count(*) filter (where coalesce(k.keep, c.seq) = c.seq) as kept, count(*) filter (where coalesce(k.keep, c.seq) <> c.seq) as removed from curated c left join g on g.seq = c.seq left join keepers k on k.label = g.label group by c.trip_id"))
def kept_and_removed(spark, d):
    images = _assess(spark, d).images
    return images.groupBy("trip_id").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("removed"))


@query("j10_dense_assessment", sql("dist curated", f"""with recursive e as (select i as a, j as b from dist where sim >= 0.9 or (pd <= {HASH_DISTANCE} and dd <= {HASH_DISTANCE}) union select j, i from dist where sim >= 0.9 or (pd <= {HASH_DISTANCE} and dd <= {HASH_DISTANCE})),
reach as (select a, a as b from e union select reach.a, e.b from reach join e on reach.b = e.a),
comp as (select a as node, min(b) as label from reach group by a),
g as (select c.*, label, coalesce(sharpness, 0) as sh, width::bigint * height as px from curated c join comp on node = seq), keepers as (with {_FOLD})
select c.trip_id, c.seq, coalesce(k.keep, c.seq) = c.seq as kept from curated c left join g on g.seq = c.seq left join keepers k on k.label = g.label"""))
def dense_assessment(spark, d):
    return dedup.assess(src.curated(spark, d), DedupThresholds(), "dense").images.select("trip_id", "seq", "kept")


@query("m10_reduced_decisions", sql("curated", """with i as (select *, case when seq % 6 = 0 then null else 'animal' end as category, seq % 10 = 3 as gone from curated)
select seq, coalesce(blur_status, 'suspect') as final_blur_status, coalesce(category, 'other') as final_category, case when category is null then 'fallback' else 'model' end as category_source,
case when blur_status is not distinct from 'blurry' or gone then 'trashed' else 'active' end as final_status, case when blur_status is not distinct from 'blurry' then 'blur' when gone then 'duplicate' else '' end as trashed_reason from i"""))
def reduced_decisions(spark, d):
    images = src.curated(spark, d).withColumn("category", F.when(F.col("seq") % 6 != 0, "animal"))
    return selection.reduced(images, images.where("seq % 10 = 3").select("seq"))


_GATED = "gdist as (select d.* from dist d join curated a on a.seq = d.i join curated b on b.seq = d.j where a.blur_status is distinct from 'blurry' and b.blur_status is distinct from 'blurry')"
_SUMMED = f"""gone as (select g.seq from g join keepers k on k.label = g.label where k.keep <> g.seq),
im as (select *, case seq % 6 when 0 then null when 1 then 'people' when 2 then 'animal' when 3 then 'landscape' else 'other' end as category from curated),
dec as (select trip_id, seq, coalesce(category, 'other') as c, case when blur_status is not distinct from 'blurry' then 'blur' when seq in (select seq from gone) then 'duplicate' end as reason from im)
select trip_id, count(*) as total, count(*) filter (where reason is null) as active, count(*) filter (where reason = 'blur') as blurred, count(*) filter (where reason = 'duplicate') as duplicates,
{', '.join(f"count(*) filter (where reason is null and c = '{c}') as {c}" for c in CATEGORIES)} from dec group by trip_id"""


@query("s1_curation_summary", sql("vecs dist curated", f"with recursive {_GATED}, " + f"{_TIERS}, {_EVIDENCE}, {_ASSESS}".removeprefix("with ").replace("from dist", "from gdist").replace("select dist.*", "select gdist.*") + f", {_SUMMED}"))
def curation_summary(spark, d):
    """The whole pipeline of a trip."""
    images = src.curated(spark, d).withColumn("category", F.expr("case seq % 6 when 0 then null when 1 then 'people' when 2 then 'animal' when 3 then 'landscape' else 'other' end"))
    return curation.summary(curation.curate(images, _tiers()))
