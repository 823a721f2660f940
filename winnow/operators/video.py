"""Segments of videos: boundaries, labels, selection and plans."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnow.config import VideoThresholds
from winnow.functions import scores
from winnow.sources.packages import ship

DROPPED = ("severely_blurry", "severely_shaky", "severely_exposed", "blurry", "shaky")


def parse_cuts(logs: DataFrame) -> DataFrame:
    """Scene cuts (media_id, t, score) from a tool's log lines (media_id, log)."""
    lines = logs.select("media_id", F.explode(F.split("log", "\n")).alias("line"))
    t = F.regexp_extract("line", r"pts_time:\s*([\d.]+)", 1).try_cast("double")
    score = F.regexp_extract("line", r"scene_score[=:]\s*([\d.]+)", 1).try_cast("double")
    return lines.select("media_id", t.alias("t"), F.coalesce(score, F.lit(0.0)).alias("score")).where("t is not null")


#: Seconds of a video whose frames meet in one task.
FRAME_STEP = 60.0


def frame_scores(frames: DataFrame) -> DataFrame:
    """How much each frame (media_id, t, pixels) starts a new scene: media_id, t, change and score.

    change is the mean absolute difference of bytes to the frame before, score the
    lesser of it and of its difference to the change before, by 100 and at most 1, as
    scene filters of video tools have it. The first frame, and one after a frame of
    another size, has no change and the score 0. Frames at one time go by pixels.
    Frames meet by steps of time; what a step needs of the one before it is that
    step's last frame, so no video is too long.
    """
    ship(frames.sparkSession)

    @F.pandas_udf("double")
    def difference(a: pd.Series, b: pd.Series) -> pd.Series:
        same = lambda x, y: None if not x or not y or len(x) != len(y) else float(np.abs(np.frombuffer(x, np.uint8).astype(np.int16) - np.frombuffer(y, np.uint8)).mean())
        return pd.Series([same(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    def before(df: DataFrame, column: str, name: str) -> DataFrame:
        """df with the column's value in the frame before, of the same step or of the last one before it."""
        w = Window.partitionBy("media_id", "step").orderBy("t", "pixels")
        last = df.groupBy("media_id", "step").agg(F.max_by(F.struct(F.col(column).alias("x")), F.struct("t", "pixels")).alias("last"))
        last = last.select("media_id", "step", F.lag("last").over(Window.partitionBy("media_id").orderBy("step")).alias("last"))
        out = df.withColumns({"_n": F.row_number().over(w), "_lag": F.lag(column).over(w)}).join(last, ["media_id", "step"])
        return out.withColumn(name, F.when(F.col("_n") == 1, F.col("last.x")).otherwise(F.col("_lag"))).drop("_n", "_lag", "last")

    rows = frames.select("media_id", "t", "pixels", F.floor(F.col("t") / FRAME_STEP).alias("step"))
    rows = before(rows, "pixels", "was").withColumn("change", difference("pixels", "was")).drop("was")
    rows = before(rows, "change", "change_before")
    score = F.least(F.least("change", F.abs(F.col("change") - F.coalesce("change_before", F.lit(0.0)))) / 100, F.lit(1.0))
    return rows.select("media_id", "t", "change", F.when(F.col("change").isNull(), 0.0).otherwise(score).alias("score"))


def scene_cuts(frames: DataFrame, t: VideoThresholds = VideoThresholds()) -> DataFrame:
    """Scene cuts (media_id, t, score) of videos, from their frames."""
    return frame_scores(frames).where(F.col("score") > t.scene).select("media_id", "t", "score")


def cut_points(videos: DataFrame, cuts: DataFrame) -> DataFrame:
    """Where segments may begin or end (media_id, pos from 0, t): cuts, and the video's own ends, each once, in order."""
    points = videos.select("media_id", F.explode(F.array(F.lit(0.0), F.col("duration"))).alias("t")).union(cuts.select("media_id", "t")).distinct()
    return points.withColumn("pos", F.row_number().over(Window.partitionBy("media_id").orderBy("t")) - 1)


def boundaries(videos: DataFrame, cuts: DataFrame, t: VideoThresholds = VideoThresholds()) -> DataFrame:
    """Segments (media_id, start, end) of videos (media_id, duration).

    Between cuts, ends drawn in by a margin but for the video's own; without cuts,
    in steps of equal length, the last cut short. Empty segments are left out.

    Whether a video has cuts is told by a window and not by joins: of these Spark may
    broadcast a side, which is as large as all videos.
    """
    lines = videos.select("media_id", "duration", F.lit(None).cast("double").alias("t")).union(cuts.where("media_id is not null and t is not null").select("media_id", F.lit(None).cast("double"), "t"))
    lines = lines.withColumn("cut", F.max("t").over(Window.partitionBy("media_id")).isNotNull())
    n = F.ceil(F.col("duration") / t.segment_seconds)
    steps = F.when(n > 0, F.concat(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: i * t.segment_seconds), F.array("duration")))
    own = F.when(F.col("t").isNotNull(), F.array("t")).when(F.col("cut"), F.array(F.lit(0.0), F.col("duration"))).otherwise(steps)
    points = lines.select("media_id", "cut", F.explode(own).alias("t")).distinct()
    w = Window.partitionBy("media_id").orderBy("t")
    between = points.select("media_id", "cut", F.col("t").alias("a"), F.lead("t").over(w).alias("b"), F.row_number().over(w).alias("n"), F.lead("t", 2).over(w).isNull().alias("last")).where("b is not null")
    start = F.when((F.col("n") == 1) | ~F.col("cut"), F.col("a")).otherwise(F.least(F.col("a") + t.cut_margin, F.col("b")))
    end = F.when(F.col("last") | ~F.col("cut"), F.col("b")).otherwise(F.greatest(F.col("b") - t.cut_margin, F.col("start")))
    return between.withColumn("start", start).select("media_id", "start", end.alias("end")).where("end > start")


def indexed(segments: DataFrame) -> DataFrame:
    """Segments with their number from 0 and duration."""
    return segments.withColumn("segment_index", F.row_number().over(Window.partitionBy("media_id").orderBy("start")) - 1).withColumn("duration", F.col("end") - F.col("start"))


def scored(segments: DataFrame) -> DataFrame:
    """Segments (sharpness, stability, exposure) with overall score and label."""
    s, b, e = F.col("sharpness"), F.col("stability"), F.col("exposure")
    return segments.withColumns({"overall": scores.segment_score(s, b, e), "label": scores.segment_label(s, b, e)})


def candidates(segments: DataFrame, t: VideoThresholds = VideoThresholds(), excluded: list[int] | None = None) -> DataFrame:
    """Segments that a summary may take."""
    out = segments.where(~F.col("label").isin(*DROPPED) & (F.col("duration") >= t.min_segment))
    return out.where(~F.col("segment_index").isin(*excluded)) if excluded else out


def choose(start: list[float], end: list[float], overall: list[float], target: float | None, t: VideoThresholds) -> list[int]:
    """Positions of what a summary of one video takes, of segments in order of start.

    The best come first; a segment that would exceed the target by over a tenth is
    passed over, and one that was taken draws in neighbours in time of like score.
    """
    n = len(start)
    if target is None:
        return list(range(n))
    best = sorted(range(n), key=lambda i: -overall[i])  # stable: the earlier of equal ones
    rank = {i: k for k, i in enumerate(best)}
    by_end = sorted(range(n), key=lambda i: end[i])
    ends = [end[i] for i in by_end]
    room, used, taken = target * t.over_target, 0.0, set()

    def neighbours(i: int) -> list[int]:
        """Segments that end near i's start or start near its end, and score like it, the best first."""
        after = range(bisect_left(start, end[i] - t.adjacency_gap), bisect_right(start, end[i] + t.adjacency_gap))
        before = by_end[bisect_left(ends, start[i] - t.adjacency_gap) : bisect_right(ends, start[i] + t.adjacency_gap)]
        top = {j: max(overall[i], overall[j]) for j in {*after, *before} - {i}}
        return sorted((j for j in top if top[j] <= 0 or abs(overall[i] - overall[j]) / top[j] <= t.score_proximity), key=rank.__getitem__)

    def offer(i: int, anyway: bool) -> bool:
        nonlocal used
        fits = i not in taken and used < target and (anyway or used + end[i] - start[i] <= room)
        if fits:
            taken.add(i)
            used += end[i] - start[i]
        return fits

    for i in best:
        if offer(i, anyway=not taken):
            for j in neighbours(i):
                offer(j, anyway=False)
    return sorted(taken)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, of batches in which they follow each other."""
    left = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        left = part if left is None else pa.concat_tables([left, part])
        if left.num_rows == 0:
            continue
        keys = left.column(key).combine_chunks()
        cuts = [0, *(np.flatnonzero(np.array([a != b for a, b in zip(keys[1:].to_pylist(), keys[:-1].to_pylist(), strict=True)])) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield left.slice(a, b - a)
        left = left.slice(cuts[-1])
    if left is not None and left.num_rows:
        yield left


def select_segments(segments: DataFrame, targets: DataFrame, t: VideoThresholds = VideoThresholds(), excluded: list[int] | None = None) -> DataFrame:
    """The segments of each video's summary: media_id, segment_index. targets: media_id, target (null: all).

    A video's candidates meet in one task, many videos in each: they are as many as its segments.
    """
    return _selected(segments, targets, t, excluded).select("media_id", "segment_index")


def _selected(segments: DataFrame, targets: DataFrame, t: VideoThresholds, excluded: list[int] | None = None) -> DataFrame:
    """`select_segments` with start, end and the place (pos, from 0) of each in its summary, which need no join to be had."""
    ship(segments.sparkSession)
    pool = candidates(segments, t, excluded).join(targets.hint("merge"), "media_id").select("media_id", "segment_index", "start", "end", "overall", "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for video in _runs(batches, "media_id"):
            start, end, overall = (video.column(c).to_pylist() for c in ("start", "end", "overall"))
            taken = choose(start, end, overall, video.column("target")[0].as_py(), t)
            out = video.select(["media_id", "segment_index", "start", "end"]).take(pa.array(taken, pa.int64()))
            yield from out.append_column("pos", pa.array(range(len(taken)), pa.int32())).combine_chunks().to_batches()

    # the window has each video's rows in order, and leaves them where they are if they lie together already
    ordered = pool.withColumn("n", F.row_number().over(Window.partitionBy("media_id").orderBy("start", "segment_index")))
    return ordered.mapInArrow(run, pool.select("media_id", "segment_index", "start", "end", F.lit(0).alias("pos")).schema)


def adjacent(segments: DataFrame, t: VideoThresholds = VideoThresholds()) -> DataFrame:
    """Pairs (media_id, i, j, i < j) of segments that are near in time and of like score.

    One of a pair ends within the gap of where the other starts: segments are dealt
    by start and by end to steps as long as the gap, so that only those of the same
    or the next step meet, however long a video is.
    """
    step = lambda c: F.floor(F.col(c) / t.adjacency_gap)
    ends = segments.select("media_id", F.col("segment_index").alias("a"), F.col("end"), F.col("overall").alias("of_a"), F.explode(F.array(step("end") - 1, step("end"), step("end") + 1)).alias("step"))
    starts = segments.select("media_id", F.col("segment_index").alias("b"), F.col("start"), F.col("overall").alias("of_b"), step("start").alias("step"))
    met = ends.join(starts, ["media_id", "step"]).where((F.col("a") != F.col("b")) & (F.abs(F.col("start") - F.col("end")) <= t.adjacency_gap))
    top = F.greatest("of_a", "of_b")
    met = met.where((top <= 0) | (F.abs(F.col("of_a") - F.col("of_b")) / top <= t.score_proximity))
    return met.select("media_id", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct()


def processed(segments: DataFrame, targets: DataFrame, t: VideoThresholds = VideoThresholds()) -> DataFrame:
    """Videos in one go, from scored segments: each one's segments, how many are kept, seconds of these and the plan."""
    chosen = _selected(segments, targets, t)
    kept = chosen.groupBy("media_id").agg(F.count("*").alias("selected"), F.sum(F.col("end") - F.col("start")).alias("seconds"))
    return _plans(segments, kept, targets, "seconds").withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))


def edit_plans(segments: DataFrame, selected: DataFrame, targets: DataFrame) -> DataFrame:
    """What becomes of each video: kept as it is, compiled from n segments, or an error as nothing is left."""
    return _plans(segments, selected.groupBy("media_id").agg(F.count("*").alias("selected")), targets)


def _plans(segments: DataFrame, kept: DataFrame, targets: DataFrame, *more: str) -> DataFrame:
    """`edit_plans` from the number kept of each video (media_id, selected), with more columns of that table."""
    n = segments.groupBy("media_id").agg(F.count("*").alias("segments"))
    out = n.join(kept.hint("merge"), "media_id", "left").join(targets.hint("merge"), "media_id").withColumn("selected", F.coalesce("selected", F.lit(0)))
    plan = F.when(F.col("target").isNull() & (F.col("selected") == F.col("segments")), "keep").when(F.col("selected") == 0, "error").otherwise("compile")
    return out.select("media_id", "segments", "selected", plan.alias("plan"), *more)


def transitions(segments: DataFrame, kind: str = "fade", seconds: float = 0.5) -> DataFrame:
    """The transition of each chosen segment (media_id, pos, duration) to be rendered.

    fade: in and out, if the segment is twice as long. crossfade: with the one
    before, if both are; the offset counts from the start of that one alone.
    """
    return _with_transitions(segments, kind, seconds).select("media_id", "pos", "transition", "offset")


def _with_transitions(segments: DataFrame, kind: str = "fade", seconds: float = 0.5) -> DataFrame:
    """segments with `transitions`' columns."""
    before = F.lag("duration").over(Window.partitionBy("media_id").orderBy("pos"))
    long_ = F.col("duration") >= 2 * seconds
    if kind == "fade":
        return segments.withColumns({"transition": F.when(long_, "fade").otherwise("none"), "offset": F.when(long_, F.col("duration") - seconds)})
    if kind == "crossfade":
        both = long_ & (before >= 2 * seconds)
        return segments.withColumns({"transition": F.when(before.isNull(), "start").when(both, "crossfade").otherwise("concat"), "offset": F.when(both, before - seconds)})
    return segments.withColumns({"transition": F.lit("none"), "offset": F.lit(None).cast("double")})


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Segments of the new analysis, with the id and choice of the old where it had that number; other videos stay."""
    kept = old.select("media_id", "segment_index", F.col("id").alias("old_id"), F.col("selected").alias("old_selected"))
    out = new.join(kept.hint("merge"), ["media_id", "segment_index"], "left").withColumns({"id": F.coalesce("old_id", "id"), "selected": F.coalesce("old_selected", "selected")}).drop("old_id", "old_selected")
    return out.unionByName(old.join(new.select("media_id").distinct().hint("merge"), "media_id", "left_anti"))


def requested(order: DataFrame, segments: DataFrame, strict: bool = False) -> DataFrame:
    """Segments in the order they are asked for (media_id, pos, segment_index), with whether they are there.

    strict: a segment that isn't there is an error, which ends the query when it is met.
    """
    own = segments.select("media_id", "segment_index", "start", "end", F.lit(True).alias("there"))
    out = order.join(own, ["media_id", "segment_index"], "left")
    missing = F.lit(False)
    if strict:
        missing = F.raise_error(F.concat(F.lit("no segment "), F.col("segment_index"), F.lit(" of "), F.col("media_id"))).cast("boolean")
    return out.withColumn("there", F.when(F.col("there"), True).otherwise(missing))


def with_choice(segments: DataFrame, choice: DataFrame) -> DataFrame:
    """Segments (media_id, segment_index, selected) after a choice (the same columns) for some of them."""
    new = choice.select("media_id", "segment_index", F.col("selected").alias("chosen"))
    return segments.join(new, ["media_id", "segment_index"], "left").withColumn("selected", F.coalesce("chosen", "selected")).drop("chosen")


def probed(videos: DataFrame) -> DataFrame:
    """Videos with what a probe found of duration, width, height and codec; where it found nothing, 0 and `unknown`."""
    zero = {"duration": F.lit(0.0), "width": F.lit(0), "height": F.lit(0), "codec": F.lit("unknown")}
    return videos.withColumns({c: F.coalesce(c, v) for c, v in zero.items()})


def edited(segments: DataFrame, targets: DataFrame, kind: str = "fade", t: VideoThresholds = VideoThresholds()) -> DataFrame:
    """The segments of each video's summary in order of time (media_id, pos, segment_index, start, end), with their transitions."""
    chosen = _selected(segments, targets, t).withColumn("duration", F.col("end") - F.col("start"))
    return _with_transitions(chosen, kind).select("media_id", "pos", "segment_index", "start", "end", "transition", "offset")
