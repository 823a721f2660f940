"""The library from SQL text and by name.

`register` gives a session two table functions, each of which takes a table argument
with `PARTITION BY` and `ORDER BY` and sees one group's rows in order:

    choose_segments(TABLE(candidates) PARTITION BY media_id ORDER BY (start, segment_index))
    keep_best_of(TABLE(members) PARTITION BY label ORDER BY seq)

`run` calls what the product has as commands by their names, over tables of the session,
and can leave the result as a view for SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.config import DedupThresholds, VideoThresholds
from winnow.functions import pixels, scores
from winnow.operators import graph, similarity, video
from winnow.plans import dedup
from winnow.sources.packages import ship


class _Group:
    """Collects the batches of one group; the groups are as large as a video's segments, or a set of duplicates."""

    def __init__(self) -> None:
        self.batches: list[pa.RecordBatch] = []

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        self.batches.append(batch)
        yield from ()

    def rows(self) -> pa.Table | None:
        return pa.Table.from_batches(self.batches) if self.batches else None


class ChooseSegments(_Group):
    """media_id and segment_index of a video's summary, of its candidates (media_id, segment_index, start, end, overall, target)."""

    def terminate(self) -> Iterator[pa.Table]:
        t = self.rows()
        if t is not None:
            start, end, overall = (t.column(c).to_pylist() for c in ("start", "end", "overall"))
            taken = video.choose(start, end, overall, t.column("target")[0].as_py(), VideoThresholds())
            yield t.select(["media_id", "segment_index"]).take(pa.array(taken, pa.int64())).cast(pa.schema([("media_id", pa.int64()), ("segment_index", pa.int32())]))


class KeepBestOf(_Group):
    """label and seq of what is kept of a group (label, seq, sharpness, width, height, file_size, blur_status), as `selection.keep_best` has it."""

    def terminate(self) -> Iterator[pa.Table]:
        t = self.rows()
        if t is None:
            return
        members = t.to_pylist()
        if any(m["blur_status"] == "clear" for m in members):
            members = [m for m in members if m["blur_status"] != "suspect"]
        best = None
        for m in members:
            now = (m["sharpness"] or 0.0, (m["width"] or 0) * (m["height"] or 0), m["file_size"], m["seq"])
            larger = best is not None and now[1:3] > best[1:3]
            if best is None or now[0] > best[0] * 1.2 or (now[0] >= best[0] * 0.8 and larger):
                best = now
        yield pa.table({"label": pa.array([members[0]["label"]], pa.int64()), "keep": pa.array([best[3]], pa.int64())})


def register(spark: SparkSession) -> None:
    """Gives the session the table functions."""
    ship(spark)
    spark.udtf.register("choose_segments", F.arrow_udtf(ChooseSegments, returnType="media_id long, segment_index int"))
    spark.udtf.register("keep_best_of", F.arrow_udtf(KeepBestOf, returnType="label long, keep long"))


def _thresholds(options: dict) -> DedupThresholds:
    return replace(DedupThresholds(), **options)


def _analyze(images: DataFrame, blur_threshold: float = 15.0, clear_threshold: float = 50.0) -> DataFrame:
    """Images (width, height, channels, data) with blur_score and blur_status; `unknown` if they can't be read."""
    m = pixels.measured(images, ["blur_sharpness"]).withColumn("blur_score", F.col("measures.blur_sharpness")).drop("measures")
    s = F.col("blur_score")
    return m.withColumn("blur_status", F.when(s.isNull(), "unknown").when(s < blur_threshold, "blurry").when(s < clear_threshold, "suspect").otherwise("clear"))


def _dedup(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Groups (label, size, members) of rows (trip_id, seq, v) by cosine."""
    pairs = similarity.cosine_pairs(rows, threshold)
    return graph.groups(pairs.select(F.col("i").alias("a"), F.col("j").alias("b")))


def _clip_neighbors(rows: DataFrame, **options) -> DataFrame:
    """Pairs of nearest neighbours (trip_id, i, j, sim) with their tier, of rows (trip_id, seq, v)."""
    return similarity.tiered_pairs(similarity.with_hashes(rows), _thresholds(options))


def _assess(rows: DataFrame, **options) -> DataFrame:
    """Rows (trip_id, seq, label, kept) of the whole assessment."""
    return dedup.assess(rows, _thresholds(options)).images


def _quality(rows: DataFrame) -> DataFrame:
    """Rows with the exposure of a frame (exposure_mean, exposure_stddev) or of an image (width, height, channels, data)."""
    m = rows if "exposure_mean" in rows.columns else pixels.measured(rows, ["exposure_mean", "exposure_stddev"]).select("*", "measures.*").drop("measures")
    return m.withColumn("quality", scores.frame_exposure(F.col("exposure_mean"), F.col("exposure_stddev")))


COMMANDS: dict[str, Callable[..., DataFrame]] = {
    "analyze": _analyze,
    "dedup": _dedup,
    "clip-neighbors": _clip_neighbors,
    "find_duplicates": lambda rows, threshold=0.92: _dedup(rows, threshold),
    "batch_quality": _quality,
    "assess": _assess,
}


def run(spark: SparkSession, command: str, table: str, into: str | None = None, **options) -> DataFrame:
    """The result of a command over a table or view, which becomes the view `into`, if that is named.

    Raises ValueError for a command that there is none of, and TypeError for an option that it hasn't.
    """
    if command not in COMMANDS:
        raise ValueError(f"Unknown command: {command}")
    out = COMMANDS[command](spark.table(table), **options)
    if into:
        out.createOrReplaceTempView(into)
    return out
