"""Sizes, turns, durations and codecs from the headers of JPEG, PNG, WebP and MP4 files.

Only the parts of a file that its headers lie in are read, by seeking from one to the
next. What is broken, cut short or of another kind has fixed values: kind `unknown`, size
and duration 0, codec `unknown`.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.sources.packages import ship

HEADER = "kind string, width int, height int, orientation int, duration double, codec string"
UNKNOWN = ("unknown", 0, 0, 1, 0.0, "unknown")
# Fixed values of formats.
_CODECS = {"avc1": "h264", "avc3": "h264", "hvc1": "hevc", "hev1": "hevc", "vp09": "vp9", "av01": "av1", "mp4v": "mpeg4"}
_NO_FRAME = {0xC4, 0xC8, 0xCC}
_MOOV = {"moov", "trak", "mdia", "minf", "stbl"}


class Broken(ValueError):
    pass


def _take(f: BinaryIO, n: int) -> bytes:
    got = f.read(n)
    if len(got) < n:
        raise Broken("cut short")
    return got


def _orientation(exif: bytes) -> int:
    """The turn that EXIF data tell, 1 if they don't."""
    order = {b"II": "<", b"MM": ">"}.get(exif[:2])
    if order is None or len(exif) < 8:
        return 1
    at = struct.unpack_from(order + "I", exif, 4)[0]
    if at + 2 > len(exif):
        return 1
    for k in range(struct.unpack_from(order + "H", exif, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(exif):
            break
        tag, _, _, value = struct.unpack_from(order + "HHIH", exif, entry)
        if tag == 0x0112:
            return value if 1 <= value <= 8 else 1
    return 1


def _jpeg(f: BinaryIO) -> tuple:
    turn, at = 1, 2
    while True:
        f.seek(at)
        mark, kind = _take(f, 2)
        if mark != 0xFF:
            raise Broken("no marker")
        if kind == 0xFF:  # fill
            at += 1
            continue
        if kind == 0x01 or 0xD0 <= kind <= 0xD7:  # without a length
            at += 2
            continue
        if kind in (0xD9, 0xDA):
            raise Broken("no frame")
        size = struct.unpack(">H", _take(f, 2))[0]
        if 0xC0 <= kind <= 0xCF and kind not in _NO_FRAME:
            _, height, width = struct.unpack(">BHH", _take(f, 5))
            return "jpeg", width, height, turn, 0.0, "unknown"
        if kind == 0xE1 and size > 8 and _take(f, 6) == b"Exif\0\0":
            turn = _orientation(f.read(size - 8))
        at += 2 + max(size, 2)


def _png(f: BinaryIO) -> tuple:
    f.seek(12)
    name, width, height = struct.unpack(">4sII", _take(f, 12))
    if name != b"IHDR" or max(width, height) >= 1 << 31:
        raise Broken("no size")
    return "png", width, height, 1, 0.0, "unknown"


def _webp(f: BinaryIO) -> tuple:
    f.seek(12)
    name, _, b = struct.unpack("<4sI10s", _take(f, 18))
    if name == b"VP8X":
        return "webp", 1 + int.from_bytes(b[4:7], "little"), 1 + int.from_bytes(b[7:10], "little"), 1, 0.0, "unknown"
    if name == b"VP8L" and b[0] == 0x2F:
        bits = int.from_bytes(b[1:5], "little")
        return "webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), 1, 0.0, "unknown"
    if name == b"VP8 " and b[3:6] == b"\x9d\x01\x2a":
        return "webp", int.from_bytes(b[6:8], "little") & 0x3FFF, int.from_bytes(b[8:10], "little") & 0x3FFF, 1, 0.0, "unknown"
    raise Broken("no size")


def _boxes(f: BinaryIO, at: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Name, start of content and end of the boxes between two places."""
    while at + 8 <= end:
        f.seek(at)
        size, name = struct.unpack(">I4s", _take(f, 8))
        start = at + 8
        if size == 1:
            size, start = struct.unpack(">Q", _take(f, 8))[0], at + 16
        elif size == 0:
            size = end - at
        if size < start - at or at + size > end:
            raise Broken("a box out of bounds")
        yield name.decode("latin-1"), start, at + size
        at += size


def _mp4(f: BinaryIO, size: int) -> tuple:
    duration, best, codec, tracks = 0.0, (0, 0, 1), "unknown", []

    def walk(at: int, end: int, track: dict) -> None:
        nonlocal duration
        for name, start, stop in _boxes(f, at, end):
            if name in _MOOV:
                own = {} if name == "trak" else track
                if name == "trak":
                    tracks.append(own)
                walk(start, stop, own)
                continue
            if name not in ("mvhd", "tkhd", "stsd"):
                continue
            f.seek(start)
            b = _take(f, min(stop - start, 256))
            wide = b[0] == 1
            if name == "mvhd":
                scale, length = struct.unpack_from(">IQ" if wide else ">II", b, 20 if wide else 12)
                duration = length / scale if scale else 0.0
            elif name == "tkhd":
                place = 52 if wide else 40
                track["matrix"] = struct.unpack_from(">ii", b, place)
                track["size"] = tuple(x >> 16 for x in struct.unpack_from(">II", b, place + 36))
            elif len(b) >= 16:
                track["codec"] = b[12:16].decode("latin-1")

    walk(0, size, {})
    for t in tracks:
        width, height = t.get("size", (0, 0))
        if width * height > best[0] * best[1]:
            a, b = t["matrix"]
            # turned by a quarter if the first row of the matrix moves along the other axis
            best, codec = (width, height, 6 if a == 0 and b > 0 else 8 if a == 0 and b < 0 else 1), _CODECS.get(t.get("codec", ""), t.get("codec", "unknown"))
    if not duration and best == (0, 0, 1):
        raise Broken("no movie")
    return "mp4", *best, duration, codec


def header(f: BinaryIO, size: int) -> tuple:
    """HEADER of a file of that size, as it is stored; `turned` gives the sizes as it is seen."""
    try:
        f.seek(0)
        head = f.read(12)
        if head[:2] == b"\xff\xd8":
            return _jpeg(f)
        if head[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(f)
        if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            return _webp(f)
        if head[4:8] == b"ftyp":
            return _mp4(f, size)
    except (Broken, struct.error, UnicodeError, RecursionError):
        pass
    return UNKNOWN


def headers(content: Column) -> Column:
    """HEADER of contents, as a struct."""

    @F.pandas_udf(HEADER)
    def run(contents: pd.Series) -> pd.DataFrame:
        rows = [UNKNOWN if c is None else header(io.BytesIO(c), len(c)) for c in contents]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in HEADER.split(", ")])

    return run(content)


def turned(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """Width and height of a picture as it is seen, after its turn."""
    side = orientation >= 5
    return F.when(side, height).otherwise(width), F.when(side, width).otherwise(height)


def probed_files(paths: DataFrame, root: str, settings: dict[str, str] | None = None) -> DataFrame:
    """path, HEADER and the size in bytes of files (path) below a root, whose headers alone are read; a file
    that isn't there has the fixed values, and no size."""
    ship(paths.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from winnow.sources.store import Store

        store = Store(root, settings)
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                size = store.size(path)
                if size is None:
                    out.append((path, *UNKNOWN, None))
                    continue
                with store.fs.open_input_file(store.at(path)) as f:
                    out.append((path, *header(f, size), size))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.int64())
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", *[x.split()[0] for x in HEADER.split(", ")], "size"])

    return paths.select("path").distinct().mapInArrow(run, f"path string, {HEADER}, size long")
