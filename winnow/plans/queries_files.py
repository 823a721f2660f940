"""Queries on files: stores, uploads, ingestion, caches, manifests and text of tools."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnow.functions import headers, media_types, scores, text
from winnow.plans.prelude import sql
from winnow.plans.registry import query
from winnow.sources import adapters as src
from winnow.sources import files, schemas, store
from winnow.sources.shared import run_dir


def _located(name, kind, bucket, prefix):
    @query(name, sql("media", f"select id, '{prefix}' || regexp_replace(file_path, '^uploads/', '') as uri from media"))
    def located(spark, d):
        return files.located(src.media(spark, d), kind, bucket).select("id", "uri")


_located("a6_local_uris", "local", "/srv/media", "file:///srv/media/")
_located("a7_s3_uris", "s3", "album", "s3a://album/")
_located("a8_oss_uris", "oss", "album", "oss://album/")
_located("a9_cos_uris", "cos", "album", "cosn://album/")


@query("a10_stores_by_kind", sql("media", """select id, case when trip_id % 2 = 0 then 's3a://' || trip_id || '/' || file_path else 'file://' || trip_id || '/' || file_path end as uri from media"""))
def stores_by_kind(spark, d):
    """Each trip in the kind of store, and the bucket, that is set for it."""
    m = src.media(spark, d).select("id", "trip_id", "file_path")
    kinds = spark.createDataFrame([(0, files.SCHEMES["s3"]), (1, files.SCHEMES["local"])], "odd int, scheme string")
    m = m.withColumn("odd", (F.col("trip_id") % 2).cast("int")).join(F.broadcast(kinds), "odd")
    return m.select("id", F.concat("scheme", F.lit("://"), "trip_id", F.lit("/"), "file_path").alias("uri"))


@query("a3_evolved_rows", sql("media", "select id, trip_id, 'active' as status, 'public' as visibility, 'none' as processing_status from media"))
def evolved_rows(spark, d):
    """Rows of an older schema, with the defaults of the columns that were added since."""
    old = src.media(spark, d).select("id", F.col("trip_id").cast("string").alias("trip_id"), "file_path")
    return schemas.evolve(old, "media_items").select("id", F.col("trip_id").cast("long").alias("trip_id"), "status", "visibility", "processing_status")


@query("a11_reads_once", "select event_id, case when row_number() over (partition by user_id, event_type order by ts, event_id) = 1 then 'download' else 'cache' end as source from events")
def reads_once(spark, d):
    """Each path, here a type of event, is downloaded once a run, here a user."""
    e = src.table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("run"), F.col("event_type").alias("path"))
    return files.read_once(e, ["ts", "event_id"]).select("event_id", "source")


@query("a12_ingested_files", """with u as (select doc_id as id, 'f' || doc_id || case doc_id % 4 when 0 then '.jpg' when 1 then '.MP4' when 2 then '.txt' else '' end as name, case when doc_id % 8 = 3 then 'image/png' else '' end as mime, text from documents)
select id, 't1/originals/' || id || case id % 4 when 0 then '.jpg' when 1 then '.mp4' else '.png' end as file_path, case id % 4 when 0 then 'image' when 1 then 'video' else 'unknown' end as media_type, strlen(text)::bigint as file_size, md5(text) as md5, 'active' as status, 'none' as processing_status
from u where id % 4 in (0, 1) or mime = 'image/png'""")
def ingested_files(spark, d):
    u = src.table(spark, d, "documents").selectExpr("doc_id as id", "concat('f', doc_id, case doc_id % 4 when 0 then '.jpg' when 1 then '.MP4' when 2 then '.txt' else '' end) as name", "case when doc_id % 8 = 3 then 'image/png' else '' end as mime", "cast(text as binary) as content")
    return files.ingested(u, "t1")


@query("a16_part_sizes", "select o_orderkey as id, case when s > 10240::bigint * 1048576 then 134217728 when s > 1024::bigint * 1048576 then 67108864 when s > 500::bigint * 1048576 then 33554432 else 16777216 end::bigint as part_size from (select o_orderkey, cast(floor(o_totalprice) as bigint) * 50000 as s from orders)")
def part_sizes(spark, d):
    o = src.table(spark, d, "orders").selectExpr("o_orderkey as id", "cast(o_totalprice as bigint) * 50000 as size")
    return o.select("id", media_types.part_size(F.col("size")).alias("part_size"))


@query("a17_part_etags", "select conv_id as upload_id, turn::int as part_no, md5(text) as etag from conversations")
def part_etags(spark, d):
    """The tag of each part that is relayed."""
    parts = src.table(spark, d, "conversations").selectExpr("conv_id as upload_id", "concat('part_', turn) as name", "cast(text as binary) as content")
    return files.part_list(parts).select("upload_id", "part_no", "etag")


@query("a21_manifest_paths", r"select doc_id, path, count(*) as n from (select doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' '))) as path from documents) where path <> '' group by all")
def manifest_paths(spark, d):
    """Texts read as lists of paths."""
    t = src.table(spark, d, "documents").select("doc_id", F.explode(text.manifest_lines(F.col("text"))).alias("path"))
    return t.groupBy("doc_id", "path").agg(F.count("*").alias("n"))


@query("a22_process_results", "select event_id, case when event_id % 3 = 0 then null else props end as result from events")
def process_results(spark, d):
    """The last line of JSON that a process wrote, among other lines."""
    out = F.expr("case event_id % 3 when 0 then 'loading\\nno result' when 1 then concat('{\"old\": 1}\\n', props, '\\n') else concat('{broken\\n', props, '\\n{also broken') end")
    return src.table(spark, d, "events").select("event_id", text.last_json_line(out).alias("result"))


@query("a23_analysis_batches", sql("media", "with i as (select trip_id, id, row_number() over (partition by trip_id order by id) - 1 as seq from media where media_type = 'image') select trip_id, seq // 3 as batch, count(*) as n from i group by all"))
def analysis_batches(spark, d):
    from winnow.operators import relational as rel

    m = rel.indexed(src.media(spark, d).where("media_type = 'image'"), "trip_id", ["id"])
    return rel.batched(m, 3).groupBy("trip_id", "batch").agg(F.count("*").alias("n"))


@query("a24_copied_paths", sql("media", """select distinct regexp_replace(p, '^uploads/', '') as path, case when p like '%originals%' then 'copied' else 'failed' end as outcome from (select unnest([file_path, thumbnail_path, optimized_path, compiled_path]) as p from media) where p is not null and p <> ''"""))
def copied_paths(spark, d):
    paths = files.distinct_paths(src.media(spark, d))
    return files.copy_plan(paths, paths.where("path like '%originals%'"))


_STORED = """select doc_id as id, case lang when 'en' then 'uploads/' else '' end || coalesce(source, 'none') || '/' || doc_id || '.txt' as file_path,
case when n_chars > 2000 then coalesce(source, 'none') || '/thumbs/' || doc_id end as thumbnail_path, '' as optimized_path, cast(null as {string}) as compiled_path, text from documents"""


def _of_documents(spark, d, text):
    """Rows of SQL text over documents that both engines read alike."""
    return spark.sql(text.replace("from documents", "from {documents}"), documents=src.table(spark, d, "documents"))


def _folder(spark, name):
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("a24_migrated_files", f"""with m as ({_STORED.format(string="varchar")})
select file_path as path, 'copied' as outcome, strlen(coalesce(text, ''))::bigint as size, md5(coalesce(text, '')) as md5 from m union all select thumbnail_path, 'failed', -1, '-' from m where thumbnail_path is not null""")
def migrated_files(spark, d):
    """Documents stored as files in one folder of the shared store and copied to another; their thumbnails
    were never stored, so each of these fails by itself. Sizes and digests are read from the target."""
    media = _of_documents(spark, d, _STORED.format(string="string"))
    one, two = _folder(spark, "store"), _folder(spark, "store")
    store.save_files(media.select(F.col("file_path").alias("path"), F.col("text").alias("content")), one)
    outcomes, _ = store.migrate(media, one, two)
    outcome = F.when(F.col("outcome") == "failed", "failed").otherwise("copied")
    out = outcomes.select("path", outcome.alias("outcome")).join(store.digests(outcomes, two), "path", "left")
    return out.select("path", "outcome", F.coalesce("size", F.lit(-1).cast("long")).alias("size"), F.coalesce("md5", F.lit("-")).alias("md5"))


@query("a18_merged_files", """with p as (select *, row_number() over (partition by conv_id order by turn, role, text) as part_no from conversations)
select 'merged/' || conv_id || '.txt' as path, 'merged' as outcome, sum(strlen(coalesce(text, '')))::bigint as size, md5(string_agg(coalesce(text, ''), '' order by part_no)) as md5 from p group by conv_id""")
def merged_files(spark, d):
    """Turns stored as the parts of an upload for each conversation, and the uploads merged in the store."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    parts = src.table(spark, d, "conversations").select(F.col("conv_id").alias("upload_id"), F.row_number().over(w).alias("part_no"), F.coalesce("text", F.lit("")).alias("content"))
    root = _folder(spark, "store")
    store.save_parts(parts, root)
    uploads = parts.groupBy("upload_id").agg(F.count("*").alias("total_parts")).withColumn("path", F.concat(F.lit("merged/"), F.col("upload_id"), F.lit(".txt")))
    done = store.complete_uploads(uploads, root)
    return done.select("path", "outcome").join(store.digests(uploads, root), "path")


@query("a26_thumbnail_sources", sql("media", """select id, coalesce(nullif(thumbnail_path, ''), case when media_type = 'image' then coalesce(nullif(optimized_path, ''), file_path) end) as thumbnail_from,
nullif(thumbnail_path, '') is null and media_type = 'image' as made from media"""))
def thumbnail_sources(spark, d):
    return files.thumbnail_source(src.media(spark, d)).select("id", "thumbnail_from", "made")


@query("a29_missing_settings", """with n as (select * from (values ('s3', 'BUCKET'), ('s3', 'REGION'), ('oss', 'BUCKET'), ('oss', 'REGION'), ('oss', 'KEY'), ('oss', 'SECRET'), ('cos', 'BUCKET'), ('cos', 'REGION'), ('cos', 'KEY'), ('cos', 'SECRET')) as t(kind, name)),
h as (select ['local', 's3', 'oss', 'cos'][s_suppkey % 4 + 1] as kind, ['BUCKET', 'REGION', 'KEY', 'SECRET'][s_nationkey % 4 + 1] as name, case when s_acctbal < 8000 then '' else s_name end as value from supplier)
select kind, name from n where not exists (select 1 from h where h.kind = n.kind and h.name = n.name and h.value <> '')""")
def missing_settings(spark, d):
    """What stores still need, of settings that suppliers give: those of small balance have no value."""
    pick = lambda c, *names: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % 4 + 1).cast("int"))
    have = src.table(spark, d, "supplier").select(pick("s_suppkey", "local", "s3", "oss", "cos").alias("kind"), pick("s_nationkey", "BUCKET", "REGION", "KEY", "SECRET").alias("name"), F.when(F.col("s_acctbal") < 8000, "").otherwise(F.col("s_name")).alias("value"))
    return files.missing_settings(have)


_HEADS = """select doc_id, cast(64 + n_chars % 5000 as int) as w, cast(64 + doc_id % 3000 as int) as h, cast(1 + doc_id % 8 as int) as o, cast(doc_id % 4 as int) as kind from documents"""


@query("l14_turned_thumbnails", f"""with f as ({_HEADS}), t as (select *, case when kind = 3 then 0 when kind = 1 and o >= 5 then h else w end as sw, case when kind = 3 then 0 when kind = 1 and o >= 5 then w else h end as sh from f),
k as (select *, case when kind <> 3 then least(400.0::double / sw, 400.0::double / sh, 1.0) end as k from t)
select doc_id, ['png', 'jpeg', 'webp', 'unknown'][kind + 1] as kind, sw as width, sh as height, case when kind = 3 then 0 else greatest(1, round(sw * k))::int end as thumbnail_width, case when kind = 3 then 0 else greatest(1, round(sh * k))::int end as thumbnail_height from k""")
def turned_thumbnails(spark, d):
    """Sizes of thumbnails from the headers of image files, whose sizes and turns documents give; every fourth is cut short."""
    f = _of_documents(spark, d, _HEADS)
    n = lambda c, digits: F.lpad(F.hex(c), digits, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), n("w", 8), n("h", 8), F.lit("0802000000"))
    exif = F.concat(F.lit("FFE10022457869660000" + "4D4D002A00000008" + "0001" + "0112000300000001"), n("o", 4), F.lit("0000" + "00000000"))
    frame = F.concat(F.lit("FFC0001108"), n("h", 4), n("w", 4), F.lit("03011100021100031100"))
    jpeg = F.concat(F.lit("FFD8"), exif, frame, F.lit("FFDA"))
    little = lambda c: F.concat(*[F.substring(n(F.col(c) - 1, 6), i, 2) for i in (5, 3, 1)])
    webp = F.concat(F.hex(F.lit("RIFF")), F.lit("00000000"), F.hex(F.lit("WEBPVP8X")), F.lit("0A00000000000000"), little("w"), little("h"))
    content = F.when(F.col("kind") == 0, png).when(F.col("kind") == 1, jpeg).when(F.col("kind") == 2, webp).otherwise(F.substring(png, 1, 36))
    read = f.select("doc_id", headers.headers(F.unhex(content)).alias("x")).select("doc_id", "x.*")
    width, height = headers.turned(F.col("width"), F.col("height"), F.col("orientation"))
    s = scores.fit_inside(width, height, 400)
    ok = F.col("kind") != "unknown"
    return read.select("doc_id", "kind", width.alias("width"), height.alias("height"), F.when(ok, s["width"]).otherwise(0).alias("thumbnail_width"), F.when(ok, s["height"]).otherwise(0).alias("thumbnail_height"))


@query("i5_trimmed_names", sql("media", "select id, length(trim(category)) > 0 and category is not null as named, trim('  ' || coalesce(category, '') || ' ') as name from media"))
def trimmed_names(spark, d):
    return src.media(spark, d).select("id", text.non_blank(F.col("category")).alias("named"), F.trim(F.concat(F.lit("  "), F.coalesce("category", F.lit("")), F.lit(" "))).alias("name"))


@query("i6_store_paths", sql("media", "select id, regexp_replace(thumbnail_path, '^uploads/', '') as path from media where thumbnail_path is not null"))
def store_paths(spark, d):
    return src.media(spark, d).where("thumbnail_path is not null").select("id", text.store_path(F.col("thumbnail_path")).alias("path"))


@query("i8_kinds_by_prefix", sql("media", "select id, case when mime_type like 'image/%' then 'image' when mime_type like 'video/%' then 'video' else 'other' end as kind from media"))
def kinds_by_prefix(spark, d):
    return src.media(spark, d).select("id", media_types.kind_by_prefix(F.col("mime_type")).alias("kind"))


@query("i10_appended_errors", sql("media", "select id, nullif(concat_ws(chr(10), nullif(coalesce(blur_status, ''), ''), nullif(coalesce(category, ''), '')), '') as log from media"))
def appended_errors(spark, d):
    return src.media(spark, d).select("id", text.append_line(F.col("blur_status"), F.col("category")).alias("log"))


@query("i11_joined_errors", sql("media", "select id, nullif(concat_ws('; ', nullif(coalesce(category, ''), ''), nullif(coalesce(blur_status, ''), '')), '') as errors from media"))
def joined_errors(spark, d):
    return src.media(spark, d).select("id", text.joined_errors(F.array("category", "blur_status")).alias("errors"))


@query("i13_hours_before", "select event_id, ts < timestamp '2024-01-16' - interval 72 hour as old from events")
def hours_before(spark, d):
    from winnow.operators import state

    e = src.table(spark, d, "events")
    return e.select("event_id", state.stale(F.col("ts").cast("timestamp"), F.lit("2024-01-16").cast("timestamp"), 72).alias("old"))


@query("i18_clamped_scores", "select event_id, round(least(greatest(value / 100 - 1, 0), 1), 6) as score from events")
def clamped_scores(spark, d):
    return src.table(spark, d, "events").select("event_id", F.round(text.clamped(F.col("value") / 100 - 1), 6).alias("score"))


@query("i24_digests", "select doc_id, md5(text) as md5, sha256(text) as sha256 from documents")
def digests(spark, d):
    return src.table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("i26_quoted_paths", "select doc_id, chr(39) || replace(text, chr(39), chr(39) || chr(92) || chr(39) || chr(39)) || chr(39) as quoted from documents")
def quoted_paths(spark, d):
    return src.table(spark, d, "documents").select("doc_id", text.shell_quoted(F.col("text")).alias("quoted"))
