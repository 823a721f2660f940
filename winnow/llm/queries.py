"""One query for each operator of this subpackage, over its whole table, and the
DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import ann, chat, divergence, embedding_dedup, filter_audit, html_text, language, mixing, near_dup, packing, quality, sharding, token_cache
from winnow.llm.shared import run_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_chat_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op5_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(_table(spark, sf_dir, "documents"))


def op6_token_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so that every distinct text is encoded."""
    cache = f"{run_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    return token_cache.count_tokens(_table(spark, sf_dir, "documents"), cache)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_embeddings(_table(spark, sf_dir, "embeddings"))


def op8_sainte_lague_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.coalesce(mixing.first_shard(F.col("by_shard")), F.lit(-1)).alias("shard"))


def op9_minhash_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), width=2)


def op10_vector_bin_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op11_baseline_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op12_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predict_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_filter_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


_QUERIES = (
    op1_harmonic_packing,
    op2_learned_partitions,
    op3_crf_main_text,
    op4_chat_snapshot_collapse,
    op5_cross_parsing_language,
    op6_token_digest_cache,
    op7_embedding_near_dedup,
    op8_sainte_lague_mixing,
    op9_minhash_odd_sketches,
    op10_vector_bin_sharding,
    op11_baseline_divergence,
    op12_additive_quality,
    op13_filter_incidence,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_OP4 = """
with t as (select distinct conv_id, turn, role, text from conversations),
p as (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as place from t),
s as (select conv_id, place, '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) as said from p),
r as (select conv_id, place, string_agg(said, '') over (partition by conv_id order by place rows between unbounded preceding and current row) as upto,
             count(*) over (partition by conv_id) as n from s),
w as (select conv_id, n, upto from r where place = n),
one as (select n, upto, min(conv_id) as conv_id from w group by n, upto),
k as (select conv_id, n from one where not exists (select 1 from r where r.place < r.n and r.place = one.n and r.upto = one.upto))
select k.conv_id, cast((s.place - 1) // 256 as integer) as part, cast(k.n as bigint) as n_turns, string_agg(s.said, '' order by s.place) as rendered
from k join s on s.conv_id is not distinct from k.conv_id group by all
"""

_OP8 = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                  md5('mix-1|' || coalesce(cast(doc_id as varchar), md5(text), '')) as draw from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) as rk from s),
w as (select *, [5.0::double, 2.0::double, 1.0::double][((rk - 1) % 3 + 1)::int] as w, 2.0::double * source_size as cap from r),
q as (select *, cap / w as ratio from w),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by ratio, rk rows between unbounded preceding and 1 preceding), 0))
              / (sum(w) over () - coalesce(sum(w) over (order by ratio, rk rows between unbounded preceding and 1 preceding), 0)) as level from q),
t as (select source, rk, source_size, round(least(w * (select arg_min(level, [ratio, rk]) from l where level <= ratio), cap), 6) as target from l),
b as (select *, greatest(1, coalesce(floor(min(target) filter (where target > 0) over () / 1000), 1))::bigint as block from t),
h as (select *, floor(sum(target) over () / block)::bigint as house from b),
z as (select h.rk, row_number() over (order by target / (2 * seat - 1) desc, rk) as place, house
      from h, lateral (select unnest(generate_series(1, (target * 1.01 / block)::bigint + 10)) as seat) where target > 0),
u as (select rk, list_transform(range(1, 9), lambda s: len(list_filter(list(place), lambda p: p <= house * s // 8))) as e0 from z group by rk, house),
p as (select h.*, ceil(source_size / block)::bigint as blocks, coalesce(e0, [0, 0, 0, 0, 0, 0, 0, 0]) as e0 from h left join u using (rk)),
a as (select *, list_transform(e0, lambda e: least(e, 2 * blocks)) as ends, least(e0[8], 2 * blocks) as quota from p),
c as (select *, case when blocks > 0 then quota // blocks else 0 end as passes,
             case when blocks > 0 then (quota - quota // blocks * blocks) / blocks else 0.0 end as rate,
             ('0x' || substr(md5('mix-1|' || coalesce('0' || source, '1')), 1, 8))::bigint / 4294967296.0 as phase from a),
o as (select d.*, coalesce(sum(size) over (partition by source order by draw, size rows between unbounded preceding and 1 preceding), 0)::bigint as first from d),
x as (select o.doc_id, o.size, o.first, c.* exclude (source), first // block as b1, (first + o.size) // block as b2 from o join c on o.source is not distinct from c.source),
y as (select *, block * floor(b1 * rate + phase) + (first - b1 * block) * (floor((b1 + 1) * rate + phase) - floor(b1 * rate + phase)) as w1,
             block * floor(b2 * rate + phase) + (first + size - b2 * block) * (floor((b2 + 1) * rate + phase) - floor(b2 * rate + phase)) as w2 from x),
v as (select *, case when size = 0 then null when passes > 0 then first when w2 > w1 then w1 end::bigint as began from y)
select doc_id, cast(size as bigint) as size, source_size, target, cast(passes * size + w2 - w1 as bigint) as taken,
       case when began is null then -1 else len(list_filter(ends, lambda e: e * block <= began)) end::integer as shard from v
"""

_OP2 = """
with v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.vec_id as query_id, c.vec_id, list_distance(q.v, c.v) as score from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
r as (select *, row_number() over (partition by query_id order by score, vec_id) as rank from p)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""

_OP7 = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
           where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
e as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.93),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, e.b from r join e on r.b = e.a),
c as (select a, min(b) as component_id from r group by a),
n as (select a, count(*) as n from e group by a)
select m.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, m.vec_id = c.component_id as kept
from embeddings m join c on c.a = m.vec_id left join n on n.a = m.vec_id
"""

_OP9 = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i::int] || ' ' || w[(i + 1)::int]) when len(w) = 1 then w else [] end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)),
e as (select a, b from l union select b, a from l),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on r.b = e.a),
c as (select a, min(b) as component_id from r group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d join c on c.a = d.doc_id left join n on n.doc_id = d.doc_id
"""

_OP11 = r"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select id, lang, source, unnest(w) as term from d),
k as (select lang, term, count(*)::hugeint as times from t group by lang, term having count(distinct id) >= 30),
l as (select lang, count(*)::hugeint as v, sum(times)::hugeint as n from k group by lang),
c as (select lang, source, term, count(*)::hugeint as times from t semi join k using (lang, term) group by all),
g as (select lang, source, coalesce(v, 0) as v, coalesce(l.n, 0) as ln, coalesce(c.n, 0) as n
      from (select distinct lang, source from d) left join l using (lang) left join (select lang, source, sum(times)::hugeint as n from c group by all) c using (lang, source)),
p as (select g.lang, g.source, k.term, coalesce(c.times, 0) as times, 1 + 1000000000 * (coalesce(c.times, 0) + 5) // (g.n + 5 * g.v) as p, 1 + 1000000000 * (k.times + 5) // (g.ln + 5 * g.v) as q
      from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
f as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
x as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value
      from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
y as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from p where times > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (from x union all from y))
select lang, source, part, item, value, cast(rank as integer) as rank from r where part = 'pair' or rank <= 50
"""

_OP13 = r"""
with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
m as (select doc_id, part, len(w) < 200 as a, 100 * len(list_distinct(w)) < 50 * len(w) as b, 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * len(text) as c,
             regexp_matches(text, '[#$%&*|]') as d, coalesce(min(doc_id) over (partition by text) < doc_id, false) as e from w),
l as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
h as (select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as mask, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
      from m left join l using (doc_id) group by all),
x as (select unnest([1, 2, 3, 4, 5]) as i),
o as (select chr(64 + a.i) || chr(64 + b.i) || chr(64 + c.i) || chr(64 + d.i) || chr(64 + e.i) as filter_order
      from x a, x b, x c, x d, x e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s as (select filter_order, i as step, 1 << (ascii(filter_order[i]) - 65) as bit,
             list_sum(list_transform(range(1, i), lambda j: 1 << (ascii(filter_order[j]) - 65)))::int as earlier from o, x),
r as (select part, filter_order, step, bit,
             sum(case when mask & (bit | coalesce(earlier, 0)) = 0 then n else 0 end) as kept, sum(case when mask & bit > 0 and mask & coalesce(earlier, 0) = 0 then n else 0 end) as removed,
             sum(case when mask & bit > 0 and mask & coalesce(earlier, 0) > 0 then n else 0 end) as redundant, sum(case when mask = bit then n else 0 end) as unique_fails,
             sum(case when mask & bit > 0 and mask & coalesce(earlier, 0) = 0 then good else 0 end) as good_lost, sum(case when mask & bit > 0 and mask & coalesce(earlier, 0) = 0 then toxic else 0 end) as toxic_lost
      from h, s group by all)
select part, filter_order, cast(step as integer) as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
       good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_learned_partitions": _OP2,
        "op4_chat_snapshot_collapse": _OP4,
        "op7_embedding_near_dedup": _OP7,
        "op8_sainte_lague_mixing": _OP8,
        "op9_minhash_odd_sketches": _OP9,
        "op11_baseline_divergence": _OP11,
        "op13_filter_incidence": _OP13,
    }
