"""Quality scores, labels and plans as expressions over measured columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from winnow.config import DedupThresholds, QualityWeights, VideoThresholds


def sharpness_score(variance: Column) -> Column:
    return F.least(variance / 500, F.lit(1.0))


def exposure_norm(mean: Column) -> Column:
    return 1 - F.abs(mean - 128) / 128


def contrast_score(stddev: Column) -> Column:
    return F.exp(-0.5 * F.pow((stddev - 60) / 20, F.lit(2)))


def resolution_score(pixels: Column) -> Column:
    return F.least(pixels / 12_000_000, F.lit(1.0))


def noise_score(ratio: Column) -> Column:
    return 1 - F.least(ratio, F.lit(1.0))


def file_size_score(size: Column) -> Column:
    return F.least(size / 5_000_000, F.lit(1.0))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Mean by weight of what is not null; 0 if all is null."""
    top = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    bottom = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def overall(sharpness: Column, exposure: Column, contrast: Column, resolution: Column, noise: Column, size: Column, w: QualityWeights = QualityWeights()) -> Column:
    """The overall score of six dimensions, capped for images that are hardly sharp."""
    score = weighted_mean([(sharpness, w.sharpness), (exposure, w.exposure), (contrast, w.contrast), (resolution, w.resolution), (noise, w.noise), (size, w.file_size)])
    return F.when(sharpness < w.veto_below, F.least(score, F.lit(w.veto_cap))).otherwise(score)


def model_overall(sharpness: Column, technical: Column, aesthetic: Column, resolution: Column, exposure: Column, size: Column) -> Column:
    """The score with two models' marks: technical (0 to 100) and aesthetic (0 to 10), either of which may be null."""
    score = weighted_mean([(sharpness, 0.30), (technical / 100, 0.25), (aesthetic / 10, 0.20), (resolution, 0.10), (exposure, 0.10), (size, 0.05)])
    return F.when(technical < 15, F.least(score, F.lit(0.10))).when(technical < 20, F.least(score, F.lit(0.25))).otherwise(score)


def blur_status(full: Column, centre: Column, t: DedupThresholds = DedupThresholds()) -> Column:
    """By the lesser of two sharpness values; what can't be measured is suspect."""
    s = F.least(full, centre)
    return F.when(full.isNull() | centre.isNull(), "suspect").when(s < t.blur, "blurry").when(s < t.clear, "suspect").otherwise("clear")


def blur_status_dual(laplacian: Column, technical: Column, t: DedupThresholds = DedupThresholds()) -> Column:
    """As by variance alone, but what it finds blurry is only suspect if a model's mark disagrees; the mark may be missing."""
    low = F.when(technical >= t.technical_blur, "suspect").otherwise("blurry")
    return F.when(laplacian >= t.clear, "clear").when(laplacian < t.blur, low).otherwise("suspect")


def exposure_score(mean: Column, stddev: Column) -> Column:
    """0 to 100 by brightness and spread of a frame."""
    ramp = F.when(mean < 60, 0.3 + 0.7 * (mean - 30) / 30).when(mean > 200, 1 - 0.7 * (mean - 200) / 30).otherwise(1.0)
    spread = F.when(stddev > 30, 1.0).otherwise(0.5 + 0.5 * stddev / 30)
    return F.when(mean < 30, mean / 30 * 10).when(mean > 230, (255 - mean) / 25 * 10).otherwise(ramp * spread * 100)


def stability_score(difference: Column) -> Column:
    """0 to 100 by the mean difference of two frames."""
    return F.when(difference < 5, 100.0).when(difference <= 15, 100 - (difference - 5) / 10 * 50).otherwise(F.greatest(F.lit(0.0), 50 - (difference - 15) / 30 * 50))


def segment_score(sharpness: Column, stability: Column, exposure: Column) -> Column:
    return 0.4 * F.coalesce(sharpness, F.lit(0.0)) + 0.3 * F.coalesce(stability, F.lit(100.0)) + 0.3 * F.coalesce(exposure, F.lit(50.0))


def segment_label(sharpness: Column, stability: Column, exposure: Column, t: VideoThresholds = VideoThresholds()) -> Column:
    return (
        F.when(sharpness < t.severe_blur, "severely_blurry")
        .when(stability < t.severe_shake, "severely_shaky")
        .when((exposure < t.exposure_low) | (exposure > t.exposure_high), "severely_exposed")
        .when(sharpness < t.blurry, "blurry")
        .when(stability < t.shaky, "shaky")
        .when(stability < t.slightly_shaky, "slightly_shaky")
        .otherwise("good")
    )


def target_duration(seconds: Column) -> Column:
    """Seconds a summary is to take; null for videos that are kept as they are."""
    return F.when(seconds < 60, F.lit(None).cast("double")).when(seconds <= 600, 60.0).otherwise(300.0)


def optimise_parameters(brightness: Column, noise: Column) -> Column:
    """gamma, median (0: none) and sharpen (null: none) for an analysed image."""
    return F.struct(
        F.when(brightness < 80, 1.08).when(brightness > 180, 0.92).otherwise(1.0).alias("gamma"),
        F.when(noise >= 0.4, 3).otherwise(0).alias("median"),
        F.when(noise >= 0.6, F.lit(None).cast("double")).when(noise >= 0.4, 0.2).otherwise(0.25).alias("sharpen"),
    )


def edit_parameters(brightness: Column, contrast: Column, saturation: Column, sharpness: Column) -> Column:
    """Linear a x + b, saturation and sigma of a manual edit, from values of -100 to 100 (sharpness: 0 to 100)."""
    a = F.greatest(F.lit(0.1), 1 + contrast / 100)
    return F.struct(
        a.alias("a"),
        (128 * (1 - a) + 128 * brightness / 100).alias("b"),
        F.greatest(F.lit(0.0), 1 + saturation / 100).alias("saturation"),
        (0.3 + 1.7 * sharpness / 100).alias("sigma"),
    )


def fit_inside(width: Column, height: Column, box: int) -> Column:
    """Size of an image scaled to fit a square box, never enlarged."""
    scale = F.least(box / width, box / height, F.lit(1.0))
    return F.struct(F.greatest(F.lit(1), F.round(width * scale)).cast("int").alias("width"), F.greatest(F.lit(1), F.round(height * scale)).cast("int").alias("height"))


def frame_exposure(mean: Column, stddev: Column) -> Column:
    """mean, stddev and exposure of a frame, rounded to two places; of one that can't be read 128, 0 and 50."""
    return F.struct(
        F.coalesce(F.round(F.round(mean, 9), 2), F.lit(128.0)).alias("mean"),
        F.coalesce(F.round(F.round(stddev, 9), 2), F.lit(0.0)).alias("stddev"),
        F.when(mean.isNull(), 50.0).otherwise(F.round(exposure_score(mean, stddev), 2)).alias("exposure"),
    )
