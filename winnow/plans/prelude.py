"""DuckDB SQL of the adapters, as common table expressions that the queries' SQL starts with."""

from __future__ import annotations

from winnow.sources.adapters import MEDIA_ID, SCENE

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "users": (
        (),
        "select c_custkey as id, c_name as username, case c_mktsegment when 'MACHINERY' then 'admin' else 'regular' end as role, "
        "case c_mktsegment when 'BUILDING' then 'pending' when 'HOUSEHOLD' then 'disabled' else 'active' end as status from customer",
    ),
    "trips": (
        (),
        "select o_orderkey as id, o_custkey as user_id, concat('Trip ', o_orderkey) as title, "
        "case when o_orderkey % 10 = 0 then null else repeat(concat(o_orderpriority, ' '), cast(1 + o_orderkey % 15 as int)) end as description, "
        "case o_orderstatus when 'F' then 'public' when 'P' then 'unlisted' else 'private' end as visibility, o_orderdate as created_at from orders",
    ),
    "media0": (
        (),
        f"""select {MEDIA_ID} as id, l_orderkey as trip_id, case l_linestatus when 'O' then 'image' else 'video' end as media_type,
        case l_returnflag when 'R' then 'trashed' else 'active' end as status, case when l_discount < 0.02 then 'private' else 'public' end as visibility,
        case l_linenumber % 6 when 0 then null when 1 then 'uploading' when 2 then 'cancelled' when 3 then '' else 'ready' end as processing_status,
        case l_suppkey % 6 when 0 then 'people' when 1 then 'animal' when 2 then 'landscape' when 3 then 'other' when 4 then '' else null end as category,
        cast(floor(l_extendedprice) as bigint) as file_size, cast(l_quantity as int) * 100 as width, cast(l_partkey % 40 as int) * 100 + 100 as height,
        case when cast(round(l_tax * 100) as int) = 0 then null else round(l_tax * 10, 4) end as quality_score,
        case when l_linenumber % 4 = 0 then concat('g', l_orderkey) end as duplicate_group_id,
        concat('IMG_', l_partkey, case l_partkey % 7 when 0 then '' when 1 then '.' when 2 then '.JPG' when 3 then '.mp4' when 4 then '.tar.gz' when 5 then '.heic' else '.png' end) as original_filename,
        case l_suppkey % 5 when 0 then 'image/jpeg' when 1 then 'video/mp4' when 2 then 'application/pdf' when 3 then 'image/png' else '' end as mime_type,
        case when l_partkey % 9 = 0 then null else cast(l_partkey % 256 as double) end as avg_brightness,
        case l_suppkey % 4 when 0 then 'clear' when 1 then 'suspect' when 2 then 'blurry' end as blur_status, l_shipdate as created_at from lineitem""",
    ),
    "media": (
        ("media0",),
        """select *, concat(trip_id, '/originals/', id) as file_path, case when width % 300 = 0 then concat('uploads/', trip_id, '/thumbs/', id) end as thumbnail_path,
        case when width % 500 = 0 then concat(trip_id, '/optimized/', id) end as optimized_path,
        case when width % 700 = 0 then concat(trip_id, '/compiled/', id) when width % 200 = 0 then '' end as compiled_path,
        case when width % 1100 = 0 then concat(trip_id, '/preview/', id) end as preview_proxy_path from media0""",
    ),
    "grps": (
        ("media",),
        """select duplicate_group_id as id, trip_id, case when trip_id % 7 = 0 then null else min(id) end as default_image_id, count(*) as image_count
        from media where duplicate_group_id is not null group by duplicate_group_id, trip_id""",
    ),
    "tags": (
        (),
        r"""select media_id, regexp_replace(lower(raw), '\s+', '', 'g') as tag_name from (select doc_id as media_id,
        unnest([source, upper(lang), concat('Lang ', lang), 'image', case when doc_id % 3 = 0 then 'Image' else 'video' end]) as raw from documents)""",
    ),
    "vecs0": ((), f"select label as trip_id, vec_id as seq, vec_id // {SCENE} as scene, list_transform(embedding, lambda x: x::double) as v from embeddings"),
    "vecs": (
        ("vecs0",),
        """select trip_id, seq, list_transform(list_zip(v, w), lambda z: z[1] * (1 - c) + z[2] * c) as v
        from (select a.trip_id, a.seq, a.v, b.w, case when a.seq % 2 = 0 then 0.0::double else (60 + a.seq % 7 * 5)::double / 100 end as c
        from vecs0 a join (select trip_id, scene, arg_min(v, seq) as w from vecs0 group by trip_id, scene) b using (trip_id, scene))""",
    ),
    "frames": (
        ("vecs0",),
        """select a.trip_id as media_id, a.seq / 2.0::double as t, list_transform(list_zip(a.v, b.w), lambda z: least(255, greatest(0, floor(128 + 600 * (z[1] * 0.1::double + z[2] * 0.9::double))))) as p
        from vecs0 a join (select trip_id, scene, arg_min(v, seq) as w from vecs0 group by trip_id, scene) b using (trip_id, scene)""",
    ),
    "changes": (
        ("frames",),
        """select media_id, t, list_avg(list_transform(list_zip(p, q), lambda z: abs(z[1] - z[2]))) as change from (select *, lag(p) over (partition by media_id order by t) as q from frames) where q is not null
        union all select media_id, min(t), null from frames group by media_id""",
    ),
    "scores": (
        ("changes",),
        """select media_id, t, change, coalesce(least(change, abs(change - coalesce(lag(change) over (partition by media_id order by t), 0))) / 100, 0) as score from changes""",
    ),
    "hashed": (
        ("vecs",),
        f"""select trip_id, seq, v, xor(('0x' || substr(md5('p' || trip_id || '~' || seq // {SCENE}), 1, 16))::ubigint, ((1 << (seq * 7 % 9)) - 1)::ubigint) as phash,
        xor(('0x' || substr(md5('d' || trip_id || '~' || seq // {SCENE}), 1, 16))::ubigint, ((1 << (seq * 5 % 6)) - 1)::ubigint) as dhash from vecs""",
    ),
    "curated": (
        ("vecs",),
        """select *, case when seq % 11 = 0 then null else cast(seq * 37 % 200 as double) end as sharpness,
        case seq % 5 when 0 then 'suspect' when 1 then null when 4 then 'blurry' else 'clear' end as blur_status,
        cast(seq * 13 % 7 as int) * 100 as width, cast(seq * 7 % 5 as int) * 100 as height, seq * 101 % 1000 as file_size from vecs""",
    ),
    "bits": (
        ("vecs",),
        """select trip_id, seq, v, list_transform(v, lambda x: x > list_sum(v) / len(v)) as pb,
        list_transform(range(1, 65), lambda i: coalesce(v[i::int] > v[(i + 1)::int], false)) as db from vecs""",
    ),
    "dist": (
        ("hashed",),
        """select a.trip_id, a.seq as i, b.seq as j, list_cosine_similarity(a.v, b.v) as sim, bit_count(xor(a.phash, b.phash)) as pd, bit_count(xor(a.dhash, b.dhash)) as dd
        from hashed a join hashed b on a.trip_id = b.trip_id and a.seq < b.seq""",
    ),
    "jobev": (
        (),
        """select event_id as id, user_id as job_id, ts as created_at, case event_type when 'error' then 'error' when 'signup' then 'warn' else 'info' end as level,
        case event_type when 'purchase' then 'completed' when 'error' then 'failed' when 'signup' then 'queued' else 'running' end as status, event_type as step, value from events""",
    ),
    "cuts0": ((), "select user_id as media_id, floor(floor(epoch(ts)) / 1440.0) as minute, value from events"),
    "cuts1": (
        ("cuts0",),
        """select *, case media_id % 4 when 2 then 4.0 when 3 then 1.0 else 32.0 end::double as speed, min(minute) over (partition by media_id) as first,
        max(minute) over (partition by media_id) as last from cuts0""",
    ),
    "cuts": (
        ("cuts1",),
        """select media_id, case when media_id % 4 = 0 then floor((minute - first) / speed / 16) * 16 else (minute - first) / speed end::double as t,
        ((last - first + 5) / speed)::double as duration, value from cuts1""",
    ),
    "points": (("cuts",), "select distinct media_id, t from (select media_id, t from cuts union all select distinct media_id, 0.0 from cuts union all select distinct media_id, duration from cuts)"),
    "between0": (
        ("points",),
        """select media_id, t as a, lead(t) over (partition by media_id order by t) as b, row_number() over (partition by media_id order by t) as rn,
        lead(t, 2) over (partition by media_id order by t) is null as last from points""",
    ),
    "between1": (("between0",), "select *, case when rn = 1 then a else least(a + 0.5, b) end as s from between0 where b is not null"),
    "segs0": (("between1",), "select media_id, s as start, case when last then b else greatest(b - 0.5, s) end as end_ from between1"),
    "segs1": (
        ("segs0",),
        "select *, end_ - start as duration, (row_number() over (partition by media_id order by start) - 1)::int as segment_index from segs0 where end_ > start",
    ),
    "segs2": (
        ("segs1",),
        """select *, (media_id * 31 + segment_index // 3 * 17 + segment_index % 3) % 120 as s0, (media_id * 7 + segment_index // 3 * 29 + segment_index % 3 * 2) % 101 as b0,
        (media_id * 13 + segment_index // 3 * 5 + segment_index % 3) % 101 as e0 from segs1""",
    ),
    "segs": (
        ("segs2",),
        """select * exclude (s0, b0, e0), case when media_id % 3 = 0 then 60 + s0 % 40 else s0 end::double as sharpness, case when media_id % 3 = 0 then 60 + b0 % 40 else b0 end::double as stability,
        case when media_id % 3 = 0 then 10 + e0 % 90 else e0 end::double as exposure from segs2""",
    ),
    "targets": (("cuts",), "select distinct media_id, case when duration < 60 then null when duration <= 600 then 60.0 else 300.0 end::double as target from cuts"),
    "cands": (
        ("segs", "targets"),
        """select *, row_number() over (partition by media_id order by overall desc, start) as rk from (select *, 0.4 * sharpness + 0.3 * stability + 0.3 * exposure as overall from segs) join targets using (media_id)
        where sharpness >= 50 and stability >= 30 and exposure between 10 and 100 and duration >= 2""",
    ),
    "offers": (
        ("cands",),
        """select media_id, segment_index, duration, target, drawn, row_number() over (partition by media_id order by rk, drawn, rk2) as n from (
        select media_id, segment_index, duration, target, rk, 0 as drawn, 0 as rk2 from cands
        union all select a.media_id, b.segment_index, b.duration, b.target, a.rk, 1, b.rk from cands a join cands b on a.media_id = b.media_id and a.segment_index <> b.segment_index
        and least(abs(b.start - a.end_), abs(a.start - b.end_)) <= 2 and (greatest(a.overall, b.overall) <= 0 or abs(a.overall - b.overall) / greatest(a.overall, b.overall) <= 0.1)) where target is not null""",
    ),
    "steps": (
        ("offers",),
        """select distinct media_id, 0::bigint as n, []::integer[] as taken, 0.0::double as used, false as outer_taken from offers
        union all select media_id, n, case when ok then list_append(taken, segment_index) else taken end, case when ok then used + duration else used end, case when drawn = 0 then ok else outer_taken end from (
        select o.media_id, o.n, o.segment_index, o.duration, o.drawn, s.taken, s.used, s.outer_taken, not list_contains(s.taken, o.segment_index) and s.used < o.target and (o.drawn = 0 or s.outer_taken)
        and (o.drawn = 0 and len(s.taken) = 0 or s.used + o.duration <= o.target * 1.1) as ok from steps s join offers o on o.media_id = s.media_id and o.n = s.n + 1)""",
    ),
    "chosen": (
        ("steps",),
        """select media_id, segment_index from cands where target is null
        union all select media_id, unnest(taken) as segment_index from (select media_id, arg_max(taken, n) as taken from steps group by media_id)""",
    ),
}


def sql(names: str, body: str) -> str:
    """SQL with the common table expressions that it names, and those that they need, before it."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in CTES[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    head = ", ".join(f"{n} as ({CTES[n][1]})" for n in order)
    body = body.strip()
    if "steps" in order:  # the one that refers to itself
        head = "recursive " + head
    if body.startswith("with recursive "):
        return f"with recursive {head}, {body.removeprefix('with recursive ')}"
    if body.startswith("with "):
        return f"with {head}, {body.removeprefix('with ')}"
    return f"with {head} {body}"
