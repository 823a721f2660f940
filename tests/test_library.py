"""Operators of the library on small inputs, with the boundaries and quirks that were decided on."""

from __future__ import annotations

import math
import random
import struct
import zlib
from datetime import datetime
from itertools import permutations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from winnow.config import DedupThresholds, VideoThresholds, from_env
from winnow.functions import hashing, media_types, pixels, scores, text
from winnow.operators import classify, graph, relational, selection, similarity, state, video
from winnow.plans import dedup
from winnow.sources import files, schemas
from winnow.streaming import progress


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("name", "want"), [("a.jpg", "jpg"), ("a.tar.gz", "gz"), (".bashrc", "bashrc"), ("none", ""), ("dot.", "")])
def test_extension(spark, name, want):
    assert one(spark, text.extension(F.lit(name))) == want


def test_normalise_tag_strips_all_white_space(spark):
    assert one(spark, text.normalise_tag(F.lit(" Se　a Side\t"))) == "seaside"


def test_excerpt(spark):
    assert one(spark, text.excerpt(F.lit("x" * 101))) == "x" * 100 + "..."
    assert one(spark, text.excerpt(F.lit("x" * 100))) == "x" * 100
    assert one(spark, text.excerpt(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize(("reply", "want"), [('```json\n{"a": 1}\n```', '{"a": 1}'), ('so: {"a": [1]} ok', '{"a": [1]}'), ("[1, 2]", "[1, 2]"), ("no", None)])
def test_embedded_json(spark, reply, want):
    assert one(spark, text.embedded_json(F.lit(reply))) == want


def test_part_sizes_at_their_limits(spark):
    mb = 1024 * 1024
    for size, want in [(500 * mb, 16), (500 * mb + 1, 32), (1024 * mb, 32), (1024 * mb + 1, 64), (10240 * mb, 64), (10240 * mb + 1, 128)]:
        assert one(spark, media_types.part_size(F.lit(size))) == want * mb
    assert one(spark, media_types.upload_plan(F.lit(100 * mb)))["mode"] == "simple"
    assert one(spark, media_types.upload_plan(F.lit(100 * mb + 1))).asDict() == {"mode": "multipart", "part_size": 16 * mb, "parts": 7}


@pytest.mark.parametrize(("head", "name", "want"), [(b"\xff\xd8\xff\xe0", "a.mp4", "image/jpeg"), (b"RIFF\x01\x02\x03\x04WEBPVP8 ", "a", "image/webp"), (b"RIFF\x01\x02\x03\x04AVI LIST", "a", "video/x-msvideo"), (b"\0\0\0\x18ftypheic", "a", "image/heic"), (b"\0\0\0\x18ftypisom", "a", "video/mp4"), (b"plain", "a.PNG", "image/png"), (b"plain", "a.txt", "application/octet-stream")])
def test_file_kinds(spark, head, name, want):
    assert one(spark, media_types.classified(F.lit(head), F.lit(name)))["mime"] == want


def png(pixels):
    """A grey PNG of rows of bytes."""
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in pixels))) + chunk(b"IEND", b"")


def test_files_and_images(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.png").write_bytes(png([[0, 255] * 4] * 8))
    (tmp_path / "a" / "note.txt").write_bytes(b"hello")
    got = {r.name: r for r in files.blobs(spark, str(tmp_path)).collect()}
    assert got["x.png"].mime == "image/png" and got["x.png"].supported and got["x.png"].kind == "image"
    assert got["note.txt"].kind == "unknown" and not got["note.txt"].supported and got["note.txt"].size == 5
    image = files.images(spark, str(tmp_path / "a")).first()
    assert (image.width, image.height) == (8, 8)
    (tmp_path / "list").write_text(" a.jpg \n\n b.png\n")
    assert sorted(r.path for r in files.manifest(spark, str(tmp_path / "list")).collect()) == ["a.jpg", "b.png"]


def test_store_uris():
    assert files.store_uri("s3", "bucket", "uploads/a/b.jpg") == "s3a://bucket/a/b.jpg"
    with pytest.raises(ValueError, match="unknown"):
        files.store_uri("ftp", "b", "k")


def test_parts_merge_in_order(rows):
    parts = rows([("u", 2, "b"), ("u", 1, "a"), ("u", 10, "c")], "upload_id string, part_no int, content string")
    assert files.merged_parts(parts).first().merged == "abc"
    missing = files.missing_parts(rows([("u", 3)], "upload_id string, total_parts int"), parts).collect()
    assert [(r.upload_id, r.part_no) for r in missing] == [("u", 3)]


def test_schemas_evolve(rows):
    df = schemas.evolve(rows([("1", "t")], "id string, trip_id string"), "media_items")
    assert set(schemas.schema("media_items").fieldNames()) <= set(df.columns)
    assert df.first().status == "active" and df.first().processing_status == "none"
    assert schemas.evolve(df, "media_items").columns == df.columns


def test_tables_are_created_once(spark):
    schemas.create_tables(spark)
    schemas.create_tables(spark)
    assert spark.table("media_tags").columns == ["id", "media_id", "tag_name", "created_at"]


@given(st.lists(st.integers(0, 63), max_size=20, unique=True), st.integers(0, 2**64 - 1))
@settings(max_examples=20, deadline=None)
def test_hamming_counts_flipped_bits(spark, flips, base):
    other = base
    for f in flips:
        other ^= 1 << f
    assert one(spark, hashing.hamming(hashing.parsed(F.lit(f"{base:016x}")), hashing.parsed(F.lit(f"{other:016x}")))) == len(flips)
    assert one(spark, hashing.digits(hashing.parsed(F.lit(f"{base:016X}")))) == f"{base:016x}"
    # with fewer differences than parts, a part is the same
    for count in (1, 5, 21):
        shared = F.arrays_overlap(*[hashing.bands(hashing.parsed(F.lit(f"{x:016x}")), count) for x in (base, other)])
        assert one(spark, shared) == any((base ^ other) << 64 * i // count & (1 << 64) - 1 >> 64 - (64 * (i + 1) // count - 64 * i // count) << 64 - (64 * (i + 1) // count - 64 * i // count) == 0 for i in range(count))


def test_hamming_of_odd_hashes_is_null(spark):
    for odd in ("ff", "0" * 15 + "g", "0" * 17, None):
        assert one(spark, hashing.hamming(hashing.parsed(F.lit(odd).cast("string")), hashing.parsed(F.lit("0" * 16)))) is None


def test_gradient_hash(spark):
    assert one(spark, hashing.digits(hashing.gradient_hash(F.array(*[F.lit(float(9 - i % 9)) for i in range(72)])))) == "f" * 16
    assert one(spark, hashing.digits(hashing.gradient_hash(F.array(*[F.lit(1.0)] * 72)))) == "0" * 16


def hashed(rows, pairs):
    df = rows([(1, i, p, d, m) for i, (p, d, m) in enumerate(pairs)], "trip_id int, seq long, phash string, dhash string, md5 string")
    return df.withColumns({c: hashing.parsed(F.col(c)) for c in ("phash", "dhash")})


def test_hash_pairs_at_the_limit(rows):
    zero, four, five = "0" * 16, f"{0b1111:016x}", f"{0b11111:016x}"
    df = hashed(rows, [(zero, zero, "a"), (four, four, "b"), (five, zero, "c"), (zero, five, "a"), (None, None, None)])
    assert {(r.i, r.j) for r in similarity.hash_pairs(df, 4).collect()} == {(0, 1), (1, 2), (1, 3)}
    assert {(r.i, r.j) for r in similarity.hash_pairs(df, 4, md5="md5").collect()} == {(0, 1), (1, 2), (1, 3), (0, 3)}


def test_hash_pairs_brute_force(rows):
    r = random.Random(0)
    base = [r.getrandbits(64) for _ in range(3)]
    mine = [(r.choice(base) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))), r.choice(base) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3)))) for _ in range(60)]
    got = {(x.i, x.j) for x in similarity.hash_pairs(hashed(rows, [(f"{p:016x}", f"{d:016x}", None) for p, d in mine]), 4).collect()}
    assert got == {(i, j) for j in range(60) for i in range(j) if (mine[i][0] ^ mine[j][0]).bit_count() <= 4 and (mine[i][1] ^ mine[j][1]).bit_count() <= 4}


def test_hash_links_join_the_same(rows):
    """Copies are linked to the first of them alone, and components stay what they are."""
    r = random.Random(1)
    base = [(r.getrandbits(64), r.getrandbits(64)) for _ in range(4)]
    mine = [(p ^ (1 << r.randrange(64) if r.random() < 0.3 else 0), d) for p, d in (r.choice(base) for _ in range(80))]
    df = hashed(rows, [*((f"{p:016x}", f"{d:016x}", None) for p, d in mine), (None, "0" * 16, None), (None, None, None)])
    of = lambda pairs: {x.node: x.label for x in graph.components(pairs.select(F.col("i").alias("a"), F.col("j").alias("b"))).collect()}
    links = similarity.hash_links(df)
    assert of(links) == of(similarity.hash_pairs(df)) and links.count() < similarity.hash_pairs(df).count() / 2


def test_cosine_pairs_brute_force(rows):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(70, 5))
    x[7] = 0
    df = rows([(i % 2, i, x[i].tolist()) for i in range(70)], "trip_id int, seq long, v array<double>")
    u = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
    s = u @ u.T
    want = {(i, j) for j in range(70) for i in range(j) if i % 2 == j % 2 and s[i, j] >= 0.6}
    assert {(r.i, r.j) for r in similarity.cosine_pairs(df, 0.6, block=8).collect()} == want
    near = set()
    for i in range(70):
        own = sorted((j for j in range(70) if j % 2 == i % 2), key=lambda j: (-s[i, j] if i != j else -1.0, j))[:4]
        near |= {(min(i, j), max(i, j)) for j in own if j != i and s[i, j] >= 0.2}
    got = {(r.i, r.j) for r in similarity.cosine_pairs(df.where("seq <> 7"), 0.2, top_k=4, block=8).collect()}
    assert got == {p for p in near if 7 not in p}


@pytest.mark.parametrize(("sim", "apart", "p", "d", "want"), [(0.93, 99, None, None, "confirmed"), (0.9299, 99, None, None, "gray"), (0.90, 99, None, None, "gray"), (0.87, 6, 8, None, "gray"), (0.87, 7, 0, 0, "skip"), (0.87, -6, 9, 8, "gray"), (0.87, 1, None, None, "skip"), (0.85, 0, 0, 0, "skip")])
def test_tiers(spark, sim, apart, p, d, want):
    assert one(spark, similarity.tier(F.lit(sim), F.lit(apart), F.lit(p).cast("int"), F.lit(d).cast("int"))) == want


def test_gray_review_falls_back_to_the_strict_threshold(rows):
    gray = rows([(1, i, i + 1, s) for i, s in enumerate([0.96, 0.92, 0.919999, 0.85])], "trip_id int, i long, j long, sim double")
    assert [r.confirmed for r in dedup.review_gray(gray, DedupThresholds()).orderBy("i").collect()] == [True, True, False, False]
    verdicts = lambda g: g.where("i in (0, 3)").select("trip_id", "i", "j", (F.col("i") == 3).alias("is_duplicate"))
    assert [r.confirmed for r in dedup.review_gray(gray, DedupThresholds(), verdicts).orderBy("i").collect()] == [False, True, False, True]


@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=30))
@settings(max_examples=5, deadline=None)
def test_components(spark, pairs):
    pairs = [p for p in pairs if p[0] != p[1]] or [(0, 1)]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == root


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.label for r in graph.components(edges).collect()} == {0}


MEMBERS = "label long, seq long, sharpness double, blur_status string, width int, height int, file_size long"


def python_fold(members):
    clear = any(m[3] == "clear" for m in members)
    pool = [m for m in members if not (clear and m[3] == "suspect")]
    best = pool[0]
    for cur in pool[1:]:
        a, b = best[2] or 0, cur[2] or 0
        if b > a * 1.2 or (b >= a * 0.8 and (cur[4] * cur[5], cur[6]) > (best[4] * best[5], best[6])):
            best = cur
    return best[1]


def test_keep_best_folds_in_order(rows):
    r = random.Random(1)
    data = [(g, g * 10 + k, r.choice([None, 80.0, 90.0, 100.0, 110.0, 130.0]), r.choice(["clear", "suspect", None, "blurry"]), r.choice([1, 2]), 1, r.choice([5, 6])) for g in range(60) for k in range(r.randint(1, 6))]
    got = {x.label: x.keep for x in selection.keep_best(rows(data, MEMBERS)).collect()}
    assert got == {g: python_fold([m for m in data if m[0] == g]) for g in range(60)}


def test_a_segment_that_is_asked_for_but_missing_is_an_error(rows):
    segments = rows([(1, 0, 0.0, 2.0), (1, 1, 2.0, 5.0)], 'media_id int, segment_index int, start double, `end` double')
    order = lambda *i: rows([(1, k, x) for k, x in enumerate(i)], "media_id int, pos int, segment_index int")
    assert [r.there for r in video.requested(order(1, 0), segments, strict=True).orderBy("pos").collect()] == [True, True]
    assert [r.there for r in video.requested(order(1, 7), segments).orderBy("pos").collect()] == [True, False]
    with pytest.raises(Exception, match="no segment 7 of 1"):
        video.requested(order(1, 7), segments, strict=True).collect()


def test_quirk_best_depends_on_order(rows):
    """The 20 % band isn't transitive: the order of the same members changes the winner."""
    kinds = [(100.0, 3), (115.0, 2), (130.0, 1)]
    winners = set()
    for order in permutations(kinds):
        data = [(1, i, s, None, w, 1, 1) for i, (s, w) in enumerate(order)]
        keep = selection.keep_best(rows(data, MEMBERS)).first().keep
        winners.add(order[keep])
    assert len(winners) > 1


def test_hash_mode_assessment(rows):
    v = [float(i % 7) for i in range(64)]
    w = [float((i * 5) % 11) for i in range(64)]
    df = rows([(1, i, x, 50.0, "clear", 10 + i, 10, 5) for i, x in enumerate([v, v, w, v])], "trip_id int, seq long, v array<double>, sharpness double, blur_status string, width int, height int, file_size long")
    images = {r.seq: r for r in dedup.assess(df, mode="hash").images.collect()}
    assert {s: r.label for s, r in images.items()} == {0: 0, 1: 0, 2: 2, 3: 0}
    assert [s for s, r in sorted(images.items()) if r.kept] == [2, 3]
    with pytest.raises(ValueError, match="mode"):
        dedup.assess(df, mode="other")


def test_labels_and_scores(spark):
    f = lambda *x: one(spark, scores.segment_label(*[F.lit(float(v)) for v in x]))
    assert [f(19, 100, 50), f(50, 14, 50), f(50, 100, 9), f(50, 100, 101), f(49, 100, 50), f(50, 29, 50), f(50, 59, 50), f(50, 60, 100)] == ["severely_blurry", "severely_shaky", "severely_exposed", "severely_exposed", "blurry", "shaky", "slightly_shaky", "good"]
    assert one(spark, scores.blur_status(F.lit(None).cast("double"), F.lit(1.0))) == "suspect"
    assert [one(spark, scores.target_duration(F.lit(x))) for x in (59.9, 60.0, 600.0, 600.1)] == [None, 60.0, 60.0, 300.0]
    nulls = [F.lit(None).cast("double")] * 5
    assert one(spark, scores.overall(F.lit(0.5), *nulls)) == pytest.approx(0.5)
    assert one(spark, scores.overall(F.lit(0.1), *[F.lit(1.0)] * 5)) == pytest.approx(0.2)


def chosen(segments, target):
    """Positions chosen of (start, end, overall), in order of start."""
    return sorted(video.choose(*map(list, zip(*segments, strict=True)), target, VideoThresholds()))


def test_greedy_choice_of_segments():
    """The best first, and what would exceed the target by over a tenth is passed over: 10 + 3 + 2."""
    assert chosen([(0.0, 10.0, 90.0), (10.0, 18.0, 80.0), (20.0, 23.0, 70.0), (25.0, 27.0, 60.0)], 15.0) == [0, 2, 3]
    assert chosen([(0.0, 10.0, 90.0), (20.0, 28.0, 80.0)], None) == [0, 1]
    # a neighbour of like score goes before a better one elsewhere
    assert chosen([(0.0, 10.0, 90.0), (11.0, 15.0, 82.0), (50.0, 54.0, 89.0)], 14.0) == [0, 1]
    # the first may exceed the target
    assert chosen([(0.0, 50.0, 90.0), (60.0, 61.0, 80.0)], 14.0) == [0]


def plainly_chosen(segments, target):
    """The choice by two nested loops over all segments."""
    gap, like, over = 2.0, 0.10, 1.1
    order = sorted(range(len(segments)), key=lambda i: -segments[i][2])
    got, total = [], 0.0
    for i in order:
        (s, e, q), long_ = segments[i], segments[i][1] - segments[i][0]
        if total >= target or i in got or (got and total + long_ > target * over):
            continue
        got.append(i)
        total += long_
        for j in order:
            s2, e2, q2 = segments[j]
            near = min(abs(s2 - e), abs(s - e2)) <= gap and (max(q, q2) <= 0 or abs(q - q2) / max(q, q2) <= like)
            if total < target and j not in got and near and total + e2 - s2 <= target * over:
                got.append(j)
                total += e2 - s2
    return sorted(got)


def random_segments(r):
    at, out = 0.0, []
    for _ in range(r.randint(1, 25)):
        at += r.choice([0.0, 0.5, 1.0, 2.0, 2.5, 7.0])
        to = at + r.randint(2, 12)
        out.append((at, to, float(r.choice([0, 40, 60, 62, 65, 70, 77, 90]))))
        at = to
    return out


def test_greedy_choice_brute_force():
    r = random.Random(3)
    for _ in range(400):
        segments, target = random_segments(r), float(r.randint(5, 80))
        assert chosen(segments, target) == plainly_chosen(segments, target)


def test_segment_selection_and_plans_brute_force(rows):
    """n6 and n7 over random videos, many in a task, some of them without a target."""
    r = random.Random(4)
    videos = {m: random_segments(r) for m in range(40)}
    target = {m: None if m % 5 == 0 else float(r.randint(5, 60)) for m in videos}
    labels = {m: [r.choice(["good", "good", "slightly_shaky", "blurry"]) for _ in v] for m, v in videos.items()}
    data = [(m, i, *x, x[1] - x[0], labels[m][i]) for m, v in videos.items() for i, x in enumerate(v)]
    s = rows(data, "media_id int, segment_index int, start double, end double, overall double, duration double, label string").repartition(3)
    t = rows(list(target.items()), "media_id int, target double")
    got: dict = {m: [] for m in videos}
    for x in video.select_segments(s, t).collect():
        got[x.media_id].append(x.segment_index)
    plans = {x.media_id: x for x in video.processed(s, t).collect()}
    for m, v in videos.items():
        pool = [i for i in range(len(v)) if labels[m][i] != "blurry" and v[i][1] - v[i][0] >= 2]
        want = pool if target[m] is None else [pool[k] for k in plainly_chosen([v[i] for i in pool], target[m])]
        assert sorted(got[m]) == want
        plan = "keep" if target[m] is None and len(want) == len(v) else "compile" if want else "error"
        assert (plans[m].plan, plans[m].segments, plans[m].selected) == (plan, len(v), len(want))
        assert plans[m].seconds == pytest.approx(sum(v[i][1] - v[i][0] for i in want))


def test_boundaries(rows):
    videos = rows([(1, 10.0), (2, 5.0)], "media_id int, duration double")
    got = video.boundaries(videos, rows([(1, 4.0), (1, 4.5), (1, 10.0)], "media_id int, t double")).collect()
    assert sorted((r.media_id, r.start, r.end) for r in got) == [(1, 0.0, 3.5), (1, 5.0, 10.0), (2, 0.0, 2.0), (2, 2.0, 4.0), (2, 4.0, 5.0)]


def test_quirk_crossfade_offset_is_not_cumulative(rows):
    df = rows([(1, 0, 10.0), (1, 1, 8.0), (1, 2, 6.0), (1, 3, 0.5)], "media_id int, pos int, duration double")
    got = video.transitions(df, "crossfade", 1.0).orderBy("pos").collect()
    assert [(r.transition, r.offset) for r in got] == [("start", None), ("crossfade", 9.0), ("crossfade", 7.0), ("concat", None)]
    assert {r.transition for r in video.transitions(df, "none").collect()} == {"none"}


def test_category_rules(spark):
    f = lambda *x: one(spark, classify.by_scores(*[F.lit(v) for v in x]))
    assert [f(0.3, 0.32, 0.2, 0.18), f(0.3, 0.34, 0.2, 0.16), f(0.2, 0.38, 0.3, 0.12), f(0.25, 0.25, 0.35, 0.15), f(0.25, 0.25, 0.25, 0.25)] == ["people", "animal", "animal", "landscape", "people"]


def test_quirk_cover_ignores_status(rows):
    m = rows([("t", "a", "image", "trashed", 0.9, 1), ("t", "b", "image", "active", 0.5, 0), ("u", "c", "video", "active", None, 2), ("u", "d", "video", "active", None, 1)], "trip_id string, id string, media_type string, status string, quality_score double, created_at int")
    assert {r.trip_id: r.cover_id for r in relational.covers(m).collect()} == {"t": "a", "u": "d"}


def test_quirk_unknown_category_is_passed_over(rows):
    m = rows([("people",), ("x",)], "category string")
    assert m.where(relational.category_filter("nonsense")).count() == 2
    assert m.where(relational.category_filter("people")).count() == 1


def test_missing_blur_status_is_not_blurry(rows):
    m = rows([("blurry",), (None,), ("clear",)], "blur_status string")
    assert m.where(relational.not_blurry()).count() == 2


def test_states(rows, spark):
    users = rows([(1, "active", "admin"), (2, "active", "regular"), (3, "pending", "regular")], "id int, status string, role string")
    assert [r.status for r in state.user_action(users, "disable").orderBy("id").collect()] == ["active", "disabled", "pending"]
    assert [r.status for r in state.user_action(users, "approve").orderBy("id").collect()] == ["active", "active", "active"]
    media = rows([("a", 1, "active"), ("b", 1, "trashed"), ("c", 2, "active")], "id string, trip_id int, status string")
    got = state.trash(media, rows([("a",), ("a",), ("b",), ("c",)], "id string"), 1)
    assert got.where("changed").count() == 1 and got.count() == 3
    assert one(spark, state.trashed_reason(rows([("blur",)], "trashed_reason string").withColumn("status", F.lit("active")), F.lit(True)).first().trashed_reason and F.lit("blur,duplicate")) == "blur,duplicate"


def test_config_from_environment():
    t = from_env(DedupThresholds, "WINNOW", {"WINNOW_CONFIRMED": "0.5", "WINNOW_TOP_K": "7", "WINNOW_STRICT": "x"})
    assert (t.confirmed, t.top_k, t.strict) == (0.5, 7, 0.92)


def test_tail_resumes_at_its_checkpoint(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    seen: list[int] = []

    def run():
        events = progress.event_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
        progress.tail(events, f"{tmp_path}/cursor", lambda batch, _: seen.extend(r.event_id for r in batch.collect())).awaitTermination()

    day = datetime(2024, 1, 1)
    spark.createDataFrame([(1, day, 1, "a"), (2, day, 1, "b")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    spark.createDataFrame([(3, day, 1, "c")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert sorted(seen) == [1, 2, 3]


def test_first_seen_stream(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    day = datetime(2024, 1, 1)
    spark.createDataFrame([(1, day, 1, "a"), (2, day, 1, "a"), (3, day, 2, "a")], schema).write.parquet(f"{tmp_path}/in")
    events = progress.event_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
    q = progress.first_seen(events, ["user_id", "event_type"]).writeStream.format("memory").queryName("first_seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("first_seen").count() == 2


def test_measures_of_images(spark, tmp_path):
    board = [[255 * ((i // 8 + j // 8) % 2) for j in range(64)] for i in range(64)]
    for name, p in (("flat", [[128] * 64] * 64), ("black", [[0] * 64] * 64), ("board", board)):
        (tmp_path / f"{name}.png").write_bytes(png(p))
    got = {r.origin.rsplit("/", 1)[1][:-4]: r.measures for r in pixels.measured(files.images(spark, str(tmp_path))).collect()}
    assert got["flat"].sharpness == 0 and got["board"].sharpness > 100 and got["board"].centre_sharpness > 100
    assert (got["flat"].brightness, got["flat"].contrast, got["flat"].cast_r, got["black"].brightness) == (128, 0, 0, 0)
    assert got["board"].exposure_stddev == pytest.approx(127.5) and got["board"].noise > got["flat"].noise == 0
    assert got["flat"].phash == "0" * 16 and got["board"].phash == "55aa" * 4
    assert one(spark, scores.exposure_score(F.lit(got["flat"].exposure_mean), F.lit(got["flat"].exposure_stddev))) == 50.0
    assert one(spark, scores.exposure_score(F.lit(got["black"].exposure_mean), F.lit(0.0))) == 0.0


def test_broken_images_measure_null(rows):
    df = rows([(4, 4, 3, b"x"), (0, 0, 1, None), (2, 1, 1, b"ab")], "width int, height int, channels int, data binary")
    assert [r.measures.sharpness is None for r in pixels.measured(df).orderBy("width").collect()] == [True, False, True]


def test_edits_and_frames():
    import numpy as np

    x = pixels.channels(1, 1, 3, bytes([30, 20, 10]))
    assert x.tolist() == [[[10.0, 20.0, 30.0]]]
    assert pixels.edited(x, 1.0, 300.0, 1.0).max() == 255 and len(set(pixels.edited(x, 1.0, 0.0, 0.0).ravel().tolist())) == 1
    assert pixels.frame_difference(np.zeros((80, 80)), np.full((80, 80), 7.0)) == 7.0


def plain_edges(g, h, w):
    """Four neighbours less four times the pixel, borders repeated, by loops."""
    at = lambda r, c: g[min(max(r, 0), h - 1)][min(max(c, 0), w - 1)]
    return [[at(r - 1, c) + at(r + 1, c) + at(r, c - 1) + at(r, c + 1) - 4 * g[r][c] for c in range(w)] for r in range(h)]


def variance(rows_):
    flat = [x for r in rows_ for x in r]
    m = sum(flat) / len(flat)
    return sum((x - m) ** 2 for x in flat) / len(flat)


def test_noise_and_sharpness_by_loops(spark):
    """The measures that SQL can't express, of pictures of 9 x 8, by plain loops."""
    import numpy as np

    r = random.Random(2)
    for _ in range(3):
        g = [[r.randrange(256) for _ in range(9)] for _ in range(8)]
        x = np.array(g, dtype=np.float64)
        got = pixels.measure(9, 8, 1, bytes(v for row in g for v in row))
        assert got["plain_sharpness"] == pytest.approx(variance([[min(max(v, 0), 255) for v in row] for row in plain_edges(g, 8, 9)]))
        large = [[g[i * 8 // 256][j * 9 // 256] for j in range(256)] for i in range(256)]
        assert got["noise"] == pytest.approx(variance(plain_edges(large, 256, 256)) / (variance(large) + 1), rel=1e-9)


def cosines_by_loops(trip, x, least, k=None):
    import numpy as np

    u = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
    s = np.round(u @ u.T, 12)
    out = set()
    for i in range(len(x)):
        own = sorted((j for j in range(len(x)) if trip[j] == trip[i]), key=lambda j: (-s[i, j], j))
        out |= {(min(i, j), max(i, j)) for j in own[:k] if j != i and s[i, j] >= least}
    return out


@pytest.mark.parametrize(("least", "k"), [(0.9, None), (0.3, None), (-0.2, None), (0.8, 3), (-1.0, 5)])
def test_cosine_pairs_over_cells(rows, least, k):
    """Clusters, copies in a third of the rows, multiples of one vector, zero vectors, and a trip of one block."""
    import numpy as np

    r = np.random.default_rng(5)
    x = r.normal(size=(12, 6))[r.integers(0, 12, 240)] + r.normal(size=(240, 6)) * 0.3
    x[:60] *= r.uniform(0.5, 2, size=(60, 1))
    if k is None:  # copies tie, and which of those that tie is nearest is told by rounding
        x[60:140] = x[60] * r.integers(1, 9, size=(80, 1))
        x[[150, 151]] = 0
    trip = [0 if i < 230 else 1 for i in range(240)]
    df = rows([(trip[i], i, x[i].tolist()) for i in range(240)], "trip_id int, seq long, v array<double>")
    found = [(p.i, p.j) for p in similarity.cosine_pairs(df, least, top_k=k, block=20, sending=0).collect()]
    assert len(found) == len(set(found)) and set(found) == cosines_by_loops(trip, x, least, k)


def test_cells_spare_comparisons(rows):
    """Vectors in clusters meet a fraction of their trip; random ones are no worse off than without cells, and few vectors stay together."""
    import numpy as np

    r = np.random.default_rng(6)

    def compared(x, sending=0):
        df = rows([(0, i, v.tolist()) for i, v in enumerate(x)], "trip_id int, seq long, v array<double>")
        cells = similarity.in_cells(df, 0.9, block=64, sending=sending).groupBy("cell").agg(F.count_if(~F.col("guest")).alias("n"), F.count_if("guest").alias("g"))
        return cells.selectExpr("sum(n * (n - 1) / 2 + n * g)").first()[0] / (len(x) * (len(x) - 1) / 2)

    x = r.normal(size=(40, 16))[r.integers(0, 40, 1000)] + r.normal(size=(1000, 16)) * 0.05
    assert compared(x) < 0.2
    assert compared(r.normal(size=(1000, 16))) <= 1
    assert compared(x, similarity.SENDING) == 1


def test_cells_are_chosen_by_their_cost():
    """Ten million vectors in clusters are worth dividing; without clusters they aren't."""
    import numpy as np

    r = np.random.default_rng(8)
    clustered = similarity.unit(pa.chunked_array([list(r.normal(size=(40, 16))[r.integers(0, 40, 1024)] + r.normal(size=(1024, 16)) * 0.05)]))
    assert len(similarity.fit_pivots(clustered, 10_000_000, 0.9)) == 256
    alike = r.normal(size=(1024, 64))
    alike /= np.linalg.norm(alike, axis=1, keepdims=True)
    assert len(similarity.fit_pivots(alike, 20_000, 0.86)) == 1


def test_cosines_are_held_a_tile_at_a_time(rows, monkeypatch):
    import numpy as np

    x = np.random.default_rng(7).normal(size=(90, 4))
    df = rows([(0, i, v.tolist()) for i, v in enumerate(x)], "trip_id int, seq long, v array<double>")
    monkeypatch.setattr(similarity, "TILE_NUMBERS", 64)
    for k in (None, 4):
        assert {(p.i, p.j) for p in similarity.cosine_pairs(df, 0.5, top_k=k).collect()} == cosines_by_loops([0] * 90, x, 0.5, k)


@pytest.mark.parametrize("k", [1, 3, 50, 51, 70])
def test_nearest_by_sorting(k):
    """Ties at the border included; and only what reaches it is sorted."""
    import numpy as np

    r = np.random.default_rng(k)
    s = np.round(r.normal(size=(40, 51)), 1)
    ids = r.permutation(1000)[:51]
    rows_, columns = similarity.nearest(s, ids, k)
    for i in range(40):
        want = sorted(range(51), key=lambda j: (-s[i, j], ids[j]))[:k]
        assert columns[rows_ == i].tolist() == want
    assert similarity.nearest(np.zeros((2, 0)), ids[:0], k)[0].tolist() == []


def test_top_k_sorts_little(monkeypatch):
    import numpy as np

    sizes = []
    sort = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sizes.append(len(keys[0])) or sort(keys))
    similarity.nearest(np.random.default_rng(1).normal(size=(200, 2000)), np.arange(2000), 50)
    assert sizes == [200 * 50]  # of 400,000 numbers


def test_two_parts_of_hashes_are_equal(spark):
    r = random.Random(9)
    for _ in range(40):
        base = r.getrandbits(64)
        other = base
        for bit in r.sample(range(64), 4):
            other ^= 1 << bit
        keys = [hashing.bands(hashing.parsed(F.lit(f"{x:016x}")), 6, together=2) for x in (base, other)]
        assert one(spark, F.arrays_overlap(*keys)) and one(spark, F.size(keys[0])) == 15


def equalised_by_loops(g, h, w, tiles=8, limit=2.0):
    """Local equalisation pixel by pixel: each tile's mapping, and the four mappings around a pixel weighed by nearness."""
    down, across = min(tiles, h), min(tiles, w)
    th, tw = -(-h // down), -(-w // across)
    mirror = lambda i, n: i if i < n else 2 * n - 2 - i
    maps = {}
    for a in range(down):
        for b in range(across):
            values = [g[mirror(i, h)][mirror(j, w)] for i in range(a * th, (a + 1) * th) for j in range(b * tw, (b + 1) * tw)]
            counts = [values.count(v) for v in range(256)]
            top = max(1, int(limit * len(values) / 256))
            over = sum(max(n - top, 0) for n in counts)
            counts = [min(n, top) + over // 256 for n in counts]
            rest = over % 256
            at, step = 0, max(1, 256 // rest) if rest else 1
            while rest:
                counts[at] += 1
                at, rest = at + step, rest - 1
            maps[a, b] = [min(255, round(sum(counts[: v + 1]) * (255 / len(values)))) for v in range(256)]
    out = []
    for i in range(h):
        row = []
        for j in range(w):
            y, x = i / th - 0.5, j / tw - 0.5
            y1, x1 = math.floor(y), math.floor(x)
            dy, dx = y - y1, x - x1
            total = 0.0
            for a, wy in ((max(y1, 0), 1 - dy), (min(y1 + 1, down - 1), dy)):
                total += wy * sum(wx * maps[a, b][g[i][j]] for b, wx in ((max(x1, 0), 1 - dx), (min(x1 + 1, across - 1), dx)))
            row.append(total)
        out.append(row)
    return out


@pytest.mark.parametrize(("h", "w", "high"), [(64, 64, 255), (8, 9, 255), (41, 70, 90), (50, 33, 255), (3, 20, 255)])
def test_local_equalisation_by_loops(h, w, high):
    """Of pictures larger than the tiles are many, whose sides aren't whole tiles, and of small ones; and the measures that rest on it."""
    import numpy as np

    r = random.Random(h * w)
    g = [[min(255, max(0, int(r.gauss(high / 2 + 40 * math.sin(i / 9 + j / 5), high / 8)))) for j in range(w)] for i in range(h)]
    want = equalised_by_loops(g, h, w)
    got = pixels.equalised(np.array(g, dtype=np.float64))
    assert np.abs(got - np.array(want)).max() <= 0.5 + 1e-6  # rounded to bytes
    edges = plain_edges(got.tolist(), h, w)
    m = pixels.measure(w, h, 1, bytes(v for row in g for v in row), ("sharpness", "blur_sharpness"))
    assert list(m) == ["sharpness", "blur_sharpness"]
    assert m["sharpness"] == pytest.approx(variance([[min(max(round(v), 0), 255) for v in row] for row in edges]))
    assert m["blur_sharpness"] == pytest.approx(min(variance(edges), variance(plain_edges(g, h, w))))


def around(g, i, j, r):
    h, w = len(g), len(g[0])
    return [[g[min(max(i + a, 0), h - 1)][min(max(j + b, 0), w - 1)] for b in range(-r, r + 1)] for a in range(-r, r + 1)]


@pytest.mark.parametrize(("h", "w"), [(17, 23), (2, 5), (1, 1)])
def test_optimiser_kernels_by_loops(h, w):
    import numpy as np

    r = random.Random(h)
    rgb = [[[r.randrange(256) for _ in range(3)] for _ in range(w)] for _ in range(h)]
    x = np.array(rgb, dtype=np.float64)
    luma = lambda p: 0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2]
    byte = lambda v: min(255, max(0, v))
    near = lambda got, want: np.abs(got.astype(float) - np.clip(np.array(want), 0, 255)).max() <= 0.5 + 1e-6
    one_ = lambda k: [[p[k] for p in row] for row in rgb]
    median = [[[sorted(sum(around(one_(k), i, j, 1), []))[4] for k in range(3)] for j in range(w)] for i in range(h)]
    assert (pixels.optimised(x, median=3) == np.array(median)).all()
    assert near(pixels.optimised(x, gamma=1.08), [[[255 * (v / 255) ** (1 / 1.08) for v in p] for p in row] for row in rgb])
    g = [[luma(p) for p in row] for row in rgb]
    e = pixels.equalised(np.array(g)).tolist()
    assert near(pixels.optimised(x, equalise=True), [[[v + e[i][j] - g[i][j] for v in p] for j, p in enumerate(row)] for i, row in enumerate(rgb)])
    tint = (200.0, 100.0, 40.0)
    assert near(pixels.optimised(x, tint=tint), [[[g[i][j] + t - luma(tint) for t in tint] for j in range(w)] for i in range(h)])
    for sigma in (0.25, 1.0):
        k = max(1, math.ceil(3 * sigma))
        weights = [math.exp(-a * a / (2 * sigma * sigma)) for a in range(-k, k + 1)]
        total = sum(weights)
        blur = [[sum(wa * wb * v for wa, row in zip(weights, around(g, i, j, k), strict=True) for wb, v in zip(weights, row, strict=True)) / total**2 for j in range(w)] for i in range(h)]
        assert near(pixels.optimised(x, sharpen=sigma), [[[v + g[i][j] - blur[i][j] for v in p] for j, p in enumerate(row)] for i, row in enumerate(rgb)])
    assert byte(-1) == 0 and (pixels.optimised(x) == x).all()
    # in order: median, then gamma, then sharpened
    both = pixels.optimised(pixels.median_filtered(x, 3), gamma=0.92, sharpen=0.5)
    assert (pixels.optimised(x, gamma=0.92, median=3, sharpen=0.5) == both).all()


def test_optimised_images(rows):
    data = [(2, 2, n, bytes(range(10, 10 + 4 * n)), None, 0, None, n) for n in (1, 3, 4)] + [(2, 2, 3, b"short", 1.08, 3, 0.25, 9), (1, 1, 1, b"\x40", 1.08, None, None, 5)]
    df = rows(data, "width int, height int, channels int, data binary, gamma double, median int, sharpen double, id int")
    got = {r.id: r for r in pixels.optimised_images(df).collect()}
    assert all(bytes(got[n].optimised) == bytes(got[n].data) for n in (1, 3, 4))  # laid out as it came
    assert got[9].optimised is None and got[5].optimised[0] > 0x40


def test_only_what_is_asked_for_is_measured(rows, monkeypatch):
    import numpy as np

    monkeypatch.setattr(pixels, "equalised", lambda *a: 1 / 0)
    monkeypatch.setattr(pixels, "resized", lambda *a: 1 / 0)
    assert pixels.measure(3, 2, 1, bytes(range(6)), ("brightness", "plain_sharpness"))["brightness"] == 2.5
    with pytest.raises(ZeroDivisionError):
        pixels.measure(3, 2, 1, bytes(range(6)), ("noise",))
    assert np.isfinite(pixels.measure(3, 2, 3, bytes(range(18)), ("cast_r",))["cast_r"])


def scene_scores_by_loops(frames):
    out, was, before = [], None, None
    for t, p in sorted(frames):
        change = None if was is None or len(was) != len(p) or not p else sum(abs(a - b) for a, b in zip(was, p, strict=True)) / len(p)
        out.append((t, change, 0.0 if change is None else min(1.0, min(change, abs(change - (before or 0.0))) / 100)))
        was, before = p, change
    return out


def test_scene_scores_by_loops(rows):
    """Frames of several minutes with gaps, a change of size, frames at one time, single frames; in several tasks."""
    r = random.Random(3)
    videos = {1: [], 2: [(5.0, b"\x01\x02")], 3: [(0.0, b"")]}
    base = bytes(r.randrange(256) for _ in range(48))
    for k in range(300):
        if r.random() < 0.1:
            base = bytes(r.randrange(256) for _ in range(48 if k < 200 else 12))
        videos[1].append((k * 0.9 + (200 if k > 120 else 0), bytes(min(255, b + r.randrange(4)) for b in base)))
    videos[1].append(videos[1][7])
    df = rows([(m, t, p, "x") for m, v in videos.items() for t, p in v], "media_id int, t double, pixels binary, step string").repartition(3)
    got = sorted((x.media_id, x.t, x.change, x.score) for x in video.frame_scores(df).collect() if x.media_id == 1)
    want = sorted((1, *x) for x in scene_scores_by_loops(videos[1]))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(g[2:] == pytest.approx(w[2:]) or (g[2] is None and w[2] is None) for g, w in zip(got, want, strict=True))
    cuts = video.scene_cuts(df).collect()
    assert len(cuts) == sum(w[3] > 0.3 for w in want) > 10
    assert video.frame_scores(df).where("media_id > 1").count() == 2 and video.scene_cuts(df.where("false")).count() == 0


def test_provider_cascade(rows):
    """The first sound answer in order counts; what is no verdict is passed over."""
    from winnow.operators import review

    pairs = rows([(1, 0, k, 0.95 if k == 4 else 0.9) for k in range(1, 6)], "trip_id int, i long, j long, sim double")
    yes, no = '{"is_duplicate": true, "confidence": 3}', '{"is_duplicate": false, "confidence": 0.2}'
    data = [(1, 0, 1, "a", yes), (1, 0, 1, "b", no), (1, 0, 2, "a", "hm"), (1, 0, 2, "b", no), (1, 0, 3, "c", yes), (1, 0, 4, "a", None)]
    got = {r.j: r for r in review.reviewed(pairs, rows(data, "trip_id int, i long, j long, provider string, reply string"), ["a", "b"]).collect()}
    assert [(got[k].is_duplicate, got[k].confidence, got[k].provider, got[k].fell_back) for k in range(1, 6)] == [(True, 1.0, "a", False), (False, 0.2, "b", False), (False, 0.0, None, True), (True, 0.92, None, True), (False, 0.0, None, True)]


def test_routes_fall_back(rows):
    df = rows([(1, i, [float(i % 2), 1.0], 0, 0) for i in range(4)], "trip_id int, seq long, v array<double>, phash long, dhash long")
    assert dedup.routed_evidence(df, vectors=False)[0] == "hash"
    mode, evidence = dedup.routed_evidence(df, dense=lambda r: r)
    assert mode == "dense" and {r.source for r in evidence.collect()} == {"hash", "dense"}
    mode, evidence = dedup.routed_evidence(df, dense=lambda r: r.withColumn("v", F.raise_error(F.lit("no")).cast("array<double>")))
    assert mode == "tiered" and {r.source for r in evidence.collect()} == {"hash", "tiered"}


def test_shared_folder_is_needed_on_a_cluster(spark):
    from winnow.sources import shared

    class Conf:
        get = staticmethod(lambda name, other=None: other)

    class Cluster:
        conf, sparkContext = Conf, type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(Cluster)
    kept = shared.written(spark.range(3).toDF("x"), "kept")
    scratch = shared.Scratch()
    gone = scratch.written(spark.range(3).toDF("x"), "gone")
    scratch.drop()
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        spark.read.parquet(gone._winnow_path).count()


def test_manifest_lines_keep_digits(spark):
    """A line's place in the list is nothing to trim; blanks at its ends are."""
    assert one(spark, text.manifest_lines(F.lit("0a0\n12b1\n\n  c 2 \n3"))) == ["0a0", "12b1", "c 2", "3"]


def test_layers_lose_no_pair_of_many_alike(rows):
    """Of 520 copies, far more than a list of nearest ones holds, every pair is found: in tiers if they are to be whole, and by dense vectors."""
    n = 520
    df = rows([(1, i, [1.0, 2.0], 0, 0) for i in range(n)], "trip_id int, seq long, v array<double>, phash long, dhash long")
    assert similarity.tiered_pairs(df, whole=True).where("tier = 'confirmed'").count() == n * (n - 1) // 2
    evidence = dedup.pair_evidence(df, mode="dense", by_hash=similarity.hash_links)
    assert evidence.where("source = 'dense'").count() == n * (n - 1) // 2


def test_boundaries_of_videos_with_and_without_cuts(rows):
    """Cuts at the ends of a video, one beyond them, no cuts, no length, and cuts of a video that isn't known."""
    videos = rows([(1, 10.0), (2, 5.0), (3, 0.0), (4, None), (5, 4.0)], "media_id int, duration double")
    cuts = rows([(1, 0.0), (1, 3.0), (1, 3.4), (5, 9.0), (6, 1.0), (6, 4.0), (None, 1.0)], "media_id int, t double")
    got = sorted(tuple(r) for r in video.boundaries(videos, cuts).collect())
    assert got == [(1, 0.0, 2.5), (1, 3.9, 10.0), (2, 0.0, 2.0), (2, 2.0, 4.0), (2, 4.0, 5.0), (5, 0.0, 3.5), (5, 4.5, 9.0), (6, 1.0, 4.0)]


def test_hash_pairs_are_there_once_without_a_table_of_them(rows):
    """Equal hashes meet in every part, and equal md5 once more."""
    df = rows([(1, i, 5, 9, "x" if i < 3 else None) for i in range(6)], "trip_id int, seq long, phash long, dhash long, md5 string")
    got = similarity.hash_pairs(df, 4, md5="md5")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Broadcast" not in plan
    assert sorted((r.i, r.j) for r in got.collect()) == [(i, j) for i in range(6) for j in range(i + 1, 6)]
