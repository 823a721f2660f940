"""File kinds by MIME type, extension and first bytes, and upload plans by size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The supported formats.
MIME_OF_EXTENSION = {
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".webp": "image/webp",
    ".heic": "image/heic",
    ".mp4": "video/mp4",
    ".mov": "video/quicktime",
    ".avi": "video/x-msvideo",
    ".mkv": "video/x-matroska",
}
EXTENSION_OF_MIME = {m: e for e, m in MIME_OF_EXTENSION.items() if e != ".jpeg"}
#: Hexadecimal beginnings of files, as LIKE patterns.
MAGIC = [
    ("FFD8FF%", "image/jpeg"),
    ("89504E470D0A1A0A%", "image/png"),
    ("52494646________57454250%", "image/webp"),
    ("52494646________41564920%", "video/x-msvideo"),
    ("________6674797068656963%", "image/heic"),
    ("________667479706D696631%", "image/heic"),
    ("________667479707174%", "video/quicktime"),
    ("________66747970%", "video/mp4"),
    ("1A45DFA3%", "video/x-matroska"),
]
MB = 1024 * 1024


def _map(of: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in of.items() for x in kv])


def dotted_extension(name: Column) -> Column:
    """The lower-case extension with its dot; a name's first dot doesn't count as one."""
    return F.lower(F.regexp_extract(name, r"[^/.](\.[^./]*)$", 1))


def mime_of_name(name: Column) -> Column:
    return _map(MIME_OF_EXTENSION)[dotted_extension(name)]


def supported(mime: Column, name: Column) -> Column:
    return F.coalesce(mime.isin(*EXTENSION_OF_MIME), F.lit(False)) | F.coalesce(dotted_extension(name).isin(*MIME_OF_EXTENSION), F.lit(False))


def file_extension(name: Column, mime: Column) -> Column:
    """A supported extension of the name, else that of the MIME type, else the name's, else .bin."""
    own = dotted_extension(name)
    return F.when(own.isin(*MIME_OF_EXTENSION), own).otherwise(F.coalesce(_map(EXTENSION_OF_MIME)[mime], F.nullif(own, F.lit("")), F.lit(".bin")))


def media_type(mime: Column) -> Column:
    kinds = {k: [m for m in EXTENSION_OF_MIME if m.startswith(k)] for k in ("image", "video")}
    return F.when(mime.isin(*kinds["image"]), "image").when(mime.isin(*kinds["video"]), "video").otherwise("unknown")


def sniffed(content: Column) -> Column:
    """The MIME type that a file's first bytes show, or null."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.lit(None).cast("string")
    for pattern, mime in reversed(MAGIC):
        out = F.when(head.like(pattern), mime).otherwise(out)
    return out


def classified(content: Column, name: Column) -> Column:
    """mime and kind of a file: by first bytes, else by extension, else unknown."""
    mime = F.coalesce(sniffed(content), mime_of_name(name), F.lit("application/octet-stream"))
    return F.struct(mime.alias("mime"), media_type(mime).alias("kind"))


def part_size(size: Column) -> Column:
    return F.when(size > 10240 * MB, 128 * MB).when(size > 1024 * MB, 64 * MB).when(size > 500 * MB, 32 * MB).otherwise(16 * MB).cast("long")


def upload_plan(size: Column) -> Column:
    """mode (multipart from over 100 MB), part_size and parts of an upload."""
    many = size > 100 * MB
    return F.struct(
        F.when(many, "multipart").otherwise("simple").alias("mode"),
        F.when(many, part_size(size)).alias("part_size"),
        F.when(many, F.ceil(size / part_size(size))).cast("long").alias("parts"),
    )


def kind_by_prefix(mime: Column) -> Column:
    """image or video by the first part of a MIME type, else other."""
    return F.when(mime.startswith("image/"), "image").when(mime.startswith("video/"), "video").otherwise("other")
