"""Measures of decoded images: sharpness, noise, exposure, colour casts and perceptual hashes.

Images are rows as Spark's image source gives them (width, height, channels,
data in rows of blue, green, red). Measures are taken with numpy, one Arrow batch
at a time. What has no pixels, or fewer bytes than its size says, measures null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.sources.packages import ship

MEASURES = (
    "sharpness double, centre_sharpness double, plain_sharpness double, plain_centre_sharpness double, blur_sharpness double, brightness double, contrast double, cast_r double, cast_g double, cast_b double, noise double, "
    "exposure_mean double, exposure_stddev double, phash string, dhash string, legacy_phash string"
)


def channels(width: int, height: int, count: int, data: bytes) -> np.ndarray | None:
    """Pixels as height x width x (red, green, blue), or None."""
    if not data or width < 1 or height < 1 or count not in (1, 3, 4) or len(data) < width * height * count:
        return None
    x = np.frombuffer(data, dtype=np.uint8, count=width * height * count).reshape(height, width, count).astype(np.float64)
    return np.repeat(x, 3, axis=2) if count == 1 else x[:, :, 2::-1]


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luma of pixels, 0 to 255."""
    return rgb @ np.array([0.299, 0.587, 0.114])


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of the areas that the smaller picture's pixels cover; nearest pixels where it is larger."""
    for axis, size in ((0, height), (1, width)):
        n = x.shape[axis]
        at = np.arange(size) * n // size
        x = np.add.reduceat(x, at, axis=axis) / np.diff(np.append(at, n)).reshape((-1, 1) if axis == 0 else (1, -1)) if n >= size else np.take(x, at, axis=axis)
    return x


def laplacian(g: np.ndarray) -> np.ndarray:
    """The sum of four neighbours less four times the pixel, edges repeated."""
    p = np.pad(g, 1, mode="edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g


def equalised(g: np.ndarray, tiles: int = 8, limit: float = 2.0) -> np.ndarray:
    """Contrast-limited local equalisation of a picture of bytes.

    Each tile has a mapping of its own: the cumulated counts of its values, those over
    the limit spread over all. A pixel's value is mapped by the four tiles whose centres
    lie around it, by its nearness to them. Pictures are continued by reflection to whole tiles.
    """
    v = np.clip(np.rint(g), 0, 255).astype(np.int64)
    h, w = v.shape
    down, across = min(tiles, h), min(tiles, w)
    more = (-h % down, -w % across)
    v = np.pad(v, ((0, more[0]), (0, more[1])), mode="reflect" if more[0] < h and more[1] < w else "edge")
    th, tw = v.shape[0] // down, v.shape[1] // across
    area = th * tw
    tile = (np.arange(v.shape[0]) // th * across)[:, None] + np.arange(v.shape[1]) // tw
    counts = np.bincount((tile * 256 + v).ravel(), minlength=down * across * 256).reshape(-1, 256)
    top = max(1, int(limit * area / 256))
    over = np.maximum(counts - top, 0).sum(axis=1)
    counts = np.minimum(counts, top) + (over // 256)[:, None]
    for t, rest in enumerate(over % 256):
        if rest:
            counts[t, : rest * max(1, 256 // rest) : max(1, 256 // rest)] += 1
    maps = np.clip(np.rint(counts.cumsum(axis=1) * (255 / area)), 0, 255).reshape(down, across, 256)

    def around(n: int, size: int, tiles: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tiles before and after each of n places, and how near the second is."""
        at = np.arange(n) / size - 0.5
        first = np.floor(at).astype(np.int64)
        return np.maximum(first, 0), np.minimum(first + 1, tiles - 1), at - first

    v = v[:h, :w]
    y1, y2, dy = (x[:, None] for x in around(h, th, down))
    x1, x2, dx = around(w, tw, across)
    upper = maps[y1, x1, v] * (1 - dx) + maps[y1, x2, v] * dx
    lower = maps[y2, x1, v] * (1 - dx) + maps[y2, x2, v] * dx
    return np.clip(np.rint(upper * (1 - dy) + lower * dy), 0, 255)


def sharpness(g: np.ndarray, equalise: bool = True) -> float:
    """Population variance of the edges of an equalised picture, kept as bytes: negative ones are 0."""
    e = laplacian(equalised(g) if equalise else g)
    return float(np.clip(np.round(e), 0, 255).var())


def centre(g: np.ndarray) -> np.ndarray:
    """The middle half of a picture in both directions."""
    h, w = g.shape
    return g[h // 4 : h // 4 + max(1, h // 2), w // 4 : w // 4 + max(1, w // 2)]


def hexadecimal(bits: np.ndarray) -> str:
    return np.packbits(bits.ravel().astype(np.uint8)).tobytes().hex()


class Picture:
    """One image, and what several of its measures need, worked out once and only if asked for."""

    def __init__(self, rgb: np.ndarray) -> None:
        self.rgb = rgb

    grey = cached_property(lambda self: grey(self.rgb))
    means = cached_property(lambda self: self.rgb.mean(axis=(0, 1)))
    edges = cached_property(lambda self: laplacian(self.grey))
    small = cached_property(lambda self: resized(self.grey, 256, 256))
    eight = cached_property(lambda self: resized(self.grey, 8, 8))
    nine = cached_property(lambda self: resized(self.grey, 8, 9))
    big = cached_property(lambda self: resized(self.grey, 32, 32))

    @cached_property
    def exposure(self) -> tuple[float, float]:
        histogram = np.bincount(np.clip(np.round(self.grey), 0, 255).astype(np.int64).ravel(), minlength=256) / self.grey.size
        mean = float(histogram @ np.arange(256))
        return mean, float(np.sqrt(max(0.0, histogram @ np.arange(256) ** 2 - mean**2)))


_OF = {
    "sharpness": lambda p: sharpness(p.grey),
    "centre_sharpness": lambda p: sharpness(centre(p.grey)),
    "plain_sharpness": lambda p: sharpness(p.grey, False),
    "plain_centre_sharpness": lambda p: sharpness(centre(p.grey), False),
    "blur_sharpness": lambda p: float(min(laplacian(equalised(p.grey)).var(), p.edges.var())),
    "brightness": lambda p: float(p.means.mean()),
    "contrast": lambda p: float(p.rgb.std(axis=(0, 1)).mean()),
    "cast_r": lambda p: float(p.means[0] - p.means.mean()),
    "cast_g": lambda p: float(p.means[1] - p.means.mean()),
    "cast_b": lambda p: float(p.means[2] - p.means.mean()),
    "noise": lambda p: float(laplacian(p.small).var() / (p.small.var() + 1)),
    "exposure_mean": lambda p: p.exposure[0],
    "exposure_stddev": lambda p: p.exposure[1],
    "phash": lambda p: hexadecimal(p.eight > p.eight.mean()),
    "dhash": lambda p: hexadecimal(p.nine[:, :-1] > p.nine[:, 1:]),
    "legacy_phash": lambda p: hexadecimal(p.big[:8, :8] > p.big.mean()),
}


def measure(width: int, height: int, count: int, data: bytes, names: Sequence[str] = tuple(_OF)) -> dict | None:
    """The named measures of one image, or None."""
    rgb = channels(width, height, count, data)
    if rgb is None:
        return None
    p = Picture(rgb)
    return {n: _OF[n](p) for n in names}


def measured(images: DataFrame, names: Sequence[str] = tuple(_OF)) -> DataFrame:
    """images (width, height, channels, data) with a struct `measures` of the named ones; no others are worked out."""
    ship(images.sparkSession)
    kinds = dict(m.split() for m in MEASURES.split(", "))

    @F.pandas_udf(", ".join(f"{n} {kinds[n]}" for n in names))
    def run(width: pd.Series, height: pd.Series, count: pd.Series, data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(*x, names) or dict.fromkeys(names) for x in zip(width, height, count, data, strict=True)], columns=list(names))

    return images.withColumn("measures", run("width", "height", "channels", "data"))


def frame_difference(a: np.ndarray, b: np.ndarray) -> float:
    """Mean absolute difference of two frames at 64 x 64."""
    return float(np.abs(resized(a, 64, 64) - resized(b, 64, 64)).mean())


def edited(rgb: np.ndarray, a: float, b: float, saturation: float) -> np.ndarray:
    """Pixels after a linear change of brightness and contrast and a change of saturation, as bytes."""
    g = grey(rgb)[:, :, None]
    return np.clip(np.round((g + (rgb - g) * saturation) * a + b), 0, 255).astype(np.uint8)


def median_filtered(x: np.ndarray, size: int) -> np.ndarray:
    """Each channel's median of size x size pixels around, edges repeated."""
    r = size // 2
    p = np.pad(x, ((r, r), (r, r), (0, 0)), mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(p, (size, size), axis=(0, 1)), axis=(-2, -1))


def blurred(x: np.ndarray, sigma: float) -> np.ndarray:
    """A picture of one channel after a Gaussian blur, rows and then columns, edges repeated."""
    r = max(1, int(np.ceil(3 * sigma)))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (1, 0):
        p = np.pad(x, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        x = sum(k * np.take(p, np.arange(i, i + x.shape[axis]), axis=axis) for i, k in enumerate(w))
    return x


def optimised(rgb: np.ndarray, gamma: float | None = None, median: int = 0, equalise: bool = False, tint: tuple[float, float, float] | None = None, sharpen: float | None = None) -> np.ndarray:
    """Pixels as the optimiser changes them, as bytes: median, gamma (over 1 is brighter), local equalisation of
    luma, the tint's colour at each pixel's luma, and luma sharpened by what a blur takes away."""
    x = rgb
    if median > 1:
        x = median_filtered(x, median)
    if gamma not in (None, 1.0):
        x = 255 * (x / 255) ** (1 / gamma)
    if equalise:
        x = x + (equalised(grey(x)) - grey(x))[:, :, None]
    if tint is not None:
        t = np.array(tint, dtype=np.float64)
        x = grey(x)[:, :, None] + (t - grey(t))
    if sharpen is not None:
        g = grey(x)
        x = x + (g - blurred(g, sharpen))[:, :, None]
    return np.clip(np.round(x), 0, 255).astype(np.uint8)


def optimised_images(images: DataFrame) -> DataFrame:
    """images (width, height, channels, data; gamma, median, sharpen) with the bytes of the `optimised` picture,
    laid out like data; null for what has no pixels."""
    ship(images.sparkSession)

    @F.pandas_udf("binary")
    def run(width: pd.Series, height: pd.Series, count: pd.Series, data: pd.Series, gamma: pd.Series, median: pd.Series, sharpen: pd.Series) -> pd.Series:
        out = []
        for w, h, n, d, g, m, s in zip(width, height, count, data, gamma, median, sharpen, strict=True):
            rgb = channels(w, h, n, d)
            if rgb is None:
                out.append(None)
                continue
            x = optimised(rgb, None if pd.isna(g) else g, 0 if pd.isna(m) else int(m), sharpen=None if pd.isna(s) else s)
            alpha = np.frombuffer(d, np.uint8, w * h * n).reshape(h, w, n)[:, :, 3:] if n == 4 else x[:, :, :0]
            out.append((x[:, :, :1] if n == 1 else np.concatenate([x[:, :, ::-1], alpha], axis=2)).tobytes())
        return pd.Series(out)

    return images.withColumn("optimised", run("width", "height", "channels", "data", "gamma", "median", "sharpen"))
