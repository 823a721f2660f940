"""Sizes and turns from headers of files of each kind, whole and broken."""

from __future__ import annotations

import io
import random
import struct

import pytest
from pyspark.sql import functions as F

from winnow.functions import headers
from winnow.sources import store


def segment(kind, content):
    return bytes([0xFF, kind]) + struct.pack(">H", len(content) + 2) + content


def exif(turn, order="<"):
    start = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    entries = [(0x010F, 2, 4, 0), (0x0112, 3, 1, turn)]
    return b"Exif\0\0" + start + struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHIHH", t, k, n, v, 0) for t, k, n, v in entries) + b"\0\0\0\0"


def jpeg(width, height, turn=None, order="<", thumbnail=b""):
    parts = [segment(0xE0, b"JFIF\0" + b"\0" * 9)]
    if turn is not None:
        parts.append(segment(0xE1, exif(turn, order) + thumbnail))
    parts += [segment(0xDB, b"\0" * 65), b"\xff", segment(0xC4, b"\0" * 20), segment(0xC2, b"\x08" + struct.pack(">HH", height, width) + b"\x03" + b"\0" * 9)]
    return b"\xff\xd8" + b"".join(parts) + segment(0xDA, b"\0" * 10) + b"pixels" * 1000


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", width, height, 8, 2, 0, 0, 0) + b"\0" * 5000


def box(name, *content):
    inner = b"".join(content)
    return struct.pack(">I4s", len(inner) + 8, name.encode()) + inner


def mp4(width, height, seconds, codec=b"avc1", matrix=(0x10000, 0), wide=False, first=True, sound=True):
    times = struct.pack(">QQIQ" if wide else ">IIII", 0, 0, 600, int(seconds * 600))
    mvhd = box("mvhd", bytes([int(wide), 0, 0, 0]), times, b"\0" * 80)

    def track(w, h, c):
        own = struct.pack(">QQIIQ" if wide else ">IIIII", 0, 0, 1, 0, 0) + b"\0" * 16 + struct.pack(">9i", *matrix, 0, 0, 0x10000, 0, 0, 0, 0x40000000) + struct.pack(">II", w << 16, h << 16)
        stsd = box("stsd", b"\0\0\0\0\0\0\0\x01", box(c.decode(), b"\0" * 78))
        return box("trak", box("tkhd", bytes([int(wide), 0, 0, 3]), own), box("mdia", box("minf", box("stbl", stsd))))

    moov = box("moov", mvhd, *([track(0, 0, b"mp4a")] if sound else []), track(width, height, codec))
    data = struct.pack(">I4sQ", 1, b"mdat", 16 + 300_000) + b"\xff\xd8" * 150_000
    return box("ftyp", b"isom\0\0\2\0isomiso2") + (moov + data if first else data + moov)


def read(content):
    return headers.header(io.BytesIO(content), len(content))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("turn", [None, 1, 3, 6, 8, 0, 9])
def test_jpeg(turn, order):
    assert read(jpeg(640, 480, turn, order)) == ("jpeg", 640, 480, turn if turn in (1, 3, 6, 8) else 1, 0.0, "unknown")


def test_jpeg_with_a_picture_in_its_exif():
    assert read(jpeg(4000, 3000, 6, thumbnail=jpeg(160, 120)[:900]))[:4] == ("jpeg", 4000, 3000, 6)


def test_png_and_webp():
    assert read(png(70_000, 3))[:3] == ("png", 70_000, 3)
    riff = lambda name, b: b"RIFF\0\0\0\0WEBP" + name + struct.pack("<I", len(b)) + b
    assert read(riff(b"VP8X", b"\0\0\0\0" + (639).to_bytes(3, "little") + (479).to_bytes(3, "little")))[:3] == ("webp", 640, 480)
    assert read(riff(b"VP8L", b"\x2f" + (99 | 49 << 14).to_bytes(4, "little") + b"\0" * 9))[:3] == ("webp", 100, 50)
    assert read(riff(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 320, 200)))[:3] == ("webp", 320, 200)


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("first", [True, False])
def test_mp4(wide, first):
    assert read(mp4(1920, 1080, 12.5, wide=wide, first=first)) == ("mp4", 1920, 1080, 1, 12.5, "h264")
    assert read(mp4(1920, 1080, 3, b"hvc1", matrix=(0, 0x10000), wide=wide, first=first)) == ("mp4", 1920, 1080, 6, 3.0, "hevc")
    assert read(mp4(10, 20, 3, b"xxxx", matrix=(0, -0x10000), sound=False))[3:] == (8, 3.0, "xxxx")


def test_broken_files_have_fixed_values():
    """Cut at any place, and with random bytes turned: never an error."""
    r = random.Random(4)
    for whole in (jpeg(640, 480, 6), png(64, 64), mp4(64, 64, 1.0), b"", b"GIF89a", b"\xff\xd8", b"\0\0\0\x18ftyp"):
        for cut in [*range(min(len(whole), 400)), len(whole)]:
            assert len(read(whole[:cut])) == 6
        for _ in range(200):
            bad = bytearray(whole[:600])
            for _ in range(4):
                if bad:
                    bad[r.randrange(len(bad))] = r.randrange(256)
            assert len(read(bytes(bad))) == 6
    assert read(b"\xff\xd8\xff\xd9") == headers.UNKNOWN == read(box("ftyp", b"isom") + b"\0\0\0\0free")


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


@pytest.mark.parametrize("content", [jpeg(64, 48, 6), png(64, 48), mp4(64, 48, 2.0, first=False)])
def test_headers_alone_are_read(content):
    f = Counting(content)
    assert headers.header(f, len(content))[1:3] == (64, 48) and f.taken < 1200 < len(content)


def test_probed_files(spark, rows, tmp_path):
    s = store.Store(str(tmp_path))
    s.save("t/a.jpg", jpeg(640, 480, 6))
    s.save("t/b.mp4", mp4(1920, 1080, 12.5, first=False))
    s.save("t/c.png", png(5, 6)[:18])
    s.save("t/d", b"")
    paths = rows([(f"t/{n}",) for n in ("a.jpg", "b.mp4", "c.png", "d", "none")], "path string")
    df = headers.probed_files(paths, str(tmp_path))
    width, height = headers.turned(F.col("width"), F.col("height"), F.col("orientation"))
    got = {r.path: tuple(r)[1:] for r in df.select("path", "kind", width.alias("w"), height.alias("h"), "duration", "codec", (F.col("size") > 0).alias("full")).collect()}
    assert got["t/a.jpg"] == ("jpeg", 480, 640, 0.0, "unknown", True) and got["t/b.mp4"] == ("mp4", 1920, 1080, 12.5, "h264", True)
    assert got["t/c.png"] == ("unknown", 0, 0, 0.0, "unknown", True) and got["t/d"][-1] is False and got["t/none"][-1] is None
