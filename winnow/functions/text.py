"""Scalar functions on names, tags, paths and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_tag(name: Column) -> Column:
    """Lower case, without white space of any kind."""
    return F.regexp_replace(F.lower(name), r"(?U)\s+", "")


def year_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def extension(name: Column) -> Column:
    """What follows the last dot: empty if there is none, or if it is the last character."""
    return F.regexp_extract(name, r"\.([^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def excerpt(text: Column, size: int = 100) -> Column:
    """The first code points, with an ellipsis if there are more."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(F.coalesce(text, F.lit("")))


def default(value: Column, other: str) -> Column:
    """The value, or another where it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(other))


def store_path(path: Column) -> Column:
    """A path in the store, without the prefix of local uploads."""
    return F.regexp_replace(path, "^uploads/", "")


def append_reason(old: Column, reason: str) -> Column:
    """A comma list with one more entry; null and empty lists have none."""
    return F.concat_ws(",", F.nullif(old, F.lit("")), F.lit(reason))


def append_line(old: Column, new: Column) -> Column:
    """A log with one more line; null where neither has any."""
    return F.nullif(F.concat_ws("\n", F.nullif(old, F.lit("")), F.nullif(new, F.lit(""))), F.lit(""))


def non_blank(text: Column) -> Column:
    return F.coalesce(F.length(F.trim(text)) > 0, F.lit(False))


def thumbnail_url(media_id: Column) -> Column:
    return F.concat(F.lit("/api/media/"), media_id.cast("string"), F.lit("/thumbnail"))


def original_url(media_id: Column) -> Column:
    return F.concat(F.lit("/api/media/"), media_id.cast("string"), F.lit("/original"))


def embedded_json(text: Column) -> Column:
    """The JSON in a reply: a fenced block, else the whole, else the first braces or brackets
    to their last; null if none of them is valid."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit(""))
    tries = [fenced, F.trim(text), F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit(""))]
    return F.coalesce(*[F.when(F.try_parse_json(t).isNotNull(), t) for t in tries])


def pair_verdict(reply: Column) -> Column:
    """A reviewer's verdict, with confidence from 0 to 1; null unless both fields have their types."""
    v = F.from_json(embedded_json(reply), "is_duplicate boolean, confidence double")
    sound = v["is_duplicate"].isNotNull() & v["confidence"].isNotNull()
    return F.when(sound, F.struct(v["is_duplicate"].alias("is_duplicate"), clamped(v["confidence"]).alias("confidence")))


def clamped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x, or the nearer end of a range that it is out of."""
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def joined_errors(errors: Column) -> Column:
    """Messages in one line; null if there is none."""
    return F.nullif(F.array_join(F.filter(errors, lambda e: e.isNotNull() & (e != "")), "; "), F.lit(""))


def shell_quoted(path: Column) -> Column:
    """A path between single quotes, as lists of files to be put together have it."""
    return F.concat(F.lit("'"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def last_json_line(output: Column) -> Column:
    """The last line of a process's output that is JSON; null if there is none."""
    lines = F.transform(F.split(output, "\n"), F.trim)
    return F.get(F.reverse(F.filter(lines, lambda x: x.startswith("{") & F.try_parse_json(x).isNotNull())), F.lit(0))


def manifest_lines(content: Column) -> Column:
    """The paths of a list of files, one a line, trimmed; blank lines are left out."""
    return F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(x)), lambda x: x != "")  # F.trim by itself would take places as the characters to trim
