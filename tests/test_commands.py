"""The library from SQL text and by name."""

from __future__ import annotations

import random

import pytest

from winnow.config import VideoThresholds
from winnow.operators import selection, video
from winnow.plans import commands


def test_segments_are_chosen_from_sql(spark, rows):
    """As by `video.choose`, video by video: with and without a target, in many small groups."""
    commands.register(spark)
    r = random.Random(5)
    data = []
    for m in range(30):
        at = 0.0
        for i in range(r.randint(1, 25)):
            n = r.choice([2.0, 3.0, 8.0])
            data.append((m, i, at, at + n, float(r.randint(1, 30)), None if m % 5 == 0 else 20.0))
            at += n + r.choice([0.0, 1.0, 9.0])
    rows(data, "media_id long, segment_index int, start double, `end` double, overall double, target double").repartition(4).createOrReplaceTempView("candidates")
    got = {(x.media_id, x.segment_index) for x in spark.sql("select * from choose_segments(TABLE(candidates) PARTITION BY media_id ORDER BY (start, segment_index))").collect()}
    want = set()
    for m in range(30):
        own = sorted(d for d in data if d[0] == m)
        want |= {(m, own[k][1]) for k in video.choose([d[2] for d in own], [d[3] for d in own], [d[4] for d in own], own[0][5], VideoThresholds())}
    assert got == want and 30 < len(got) < len(data)


def test_best_of_groups_from_sql(spark, rows):
    commands.register(spark)
    r = random.Random(6)
    data = [(k // 7, k, r.choice([None, 10.0, 11.0, 12.5, 30.0]), r.choice([None, 100, 200]), r.choice([None, 100]), r.randint(1, 3), r.choice(["clear", "suspect", None])) for k in range(350)]
    df = rows(data, "label long, seq long, sharpness double, width int, height int, file_size long, blur_status string").repartition(3)
    df.createOrReplaceTempView("members")
    got = spark.sql("select * from keep_best_of(TABLE(members) PARTITION BY label ORDER BY seq)").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, selection.keep_best(df).collect())) and len(got) == 50
    assert spark.sql("select * from keep_best_of(TABLE(select * from members where false) PARTITION BY label ORDER BY seq)").count() == 0


def test_commands_by_name(spark, rows):
    rows([(4, 4, 1, bytes(range(0, 160, 10)), "a"), (4, 4, 1, b"", "b"), (4, 4, 1, bytes(16), "c")], "width int, height int, channels int, data binary, id string").createOrReplaceTempView("images")
    got = {r.id: r.blur_status for r in commands.run(spark, "analyze", "images", into="analysed", clear_threshold=51.0).collect()}
    assert got["b"] == "unknown" and got["c"] == "blurry" and spark.table("analysed").count() == 3
    assert commands.run(spark, "batch_quality", "images").where("quality.mean = 128").count() == 1
    v = [[1.0, 0.0], [0.999, 0.02], [0.0, 1.0], [0.93, 0.36]]
    rows([(1, i, x) for i, x in enumerate(v)], "trip_id int, seq long, v array<double>").createOrReplaceTempView("vectors")
    assert [r.members for r in commands.run(spark, "dedup", "vectors", threshold=0.99).collect()] == [[0, 1]]
    assert [r.members for r in commands.run(spark, "find_duplicates", "vectors").collect()] == [[0, 1, 3]]
    near = {(r.i, r.j): r.tier for r in commands.run(spark, "clip-neighbors", "vectors", confirmed=0.97).collect()}
    assert near[0, 1] == "confirmed" and near[0, 3] == "gray"
    with pytest.raises(ValueError, match="Unknown command: rate"):
        commands.run(spark, "rate", "vectors")
    with pytest.raises(TypeError):
        commands.run(spark, "dedup", "vectors", nearness=1)
