"""Text expressions: escaping, names, ids, formatted labels.

The formats of ids and labels, their prefixes and the characters of a safe name are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def html_escape(x: Column) -> Column:
    """&, <, > and both quotes as entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def safe_name(x: Column) -> Column:
    """Letters, digits, space, _ and - alone, trimmed, 60 characters at most; null if nothing is left."""
    out = F.substring(F.trim(F.regexp_replace(x, "[^A-Za-z0-9 _-]", "")), 1, 60)
    return F.when(out != "", out)


def basename(x: Column) -> Column:
    return F.element_at(F.split(F.translate(x, "\\", "/"), "/"), -1)


def stem(x: Column) -> Column:
    return F.regexp_replace(basename(x), r"(?<=.)\.[^.]*$", "")


def not_blank(x: Column) -> Column:
    """Whether anything but white space, Unicode's included, is there."""
    return F.coalesce(x.rlike(r"[^\s\p{Z}\x1c-\x1f\x85]"), F.lit(False))


def observation_id(sensor: Column, frame: Column, index: Column) -> Column:
    return F.format_string("%s:%s:observation:%04d", sensor, frame, index)


def track_id(sensor: Column, number: Column) -> Column:
    return F.concat_ws(":", sensor, F.lit("bytetrack"), number.cast("string"))


def identity_label(name: Column, track: Column, score: Column) -> Column:
    return F.when(name.isNull(), F.format_string("Unknown #%d", track)).otherwise(F.format_string("%s %.2f", name, score))


def model_id(path: Column, is_directory: Column) -> Column:
    return F.concat(F.when(is_directory, "openvino:").otherwise("ultralytics:"), basename(path))


def iso_seconds(ts: Column) -> Column:
    return F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ss")


def has_offset(text: Column) -> Column:
    """Whether an ISO-8601 text names its offset."""
    return F.coalesce(text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d([.,]\d+)?)?(Z|[+-]\d\d(:?\d\d(:?\d\d)?)?)$"), F.lit(False))


def iso_text(ts: Column) -> Column:
    """A UTC timestamp as ISO-8601 with its offset; microseconds only where there are any."""
    micros = F.unix_micros(ts) % 1_000_000
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def index_list(x: Column) -> Column:
    """Comma-separated whole numbers as a sorted array without repeats; null if any is none or negative."""
    parts = F.transform(F.split(x, ","), lambda p: F.trim(p).try_cast("bigint"))
    return F.when(~F.exists(parts, lambda p: F.coalesce(p < 0, F.lit(True))), F.array_sort(F.array_distinct(parts)))


def whole_numbers(x: Column) -> Column:
    """A JSON array of whole numbers as an array."""
    return F.from_json(x, "array<bigint>")


def class_name(names: list[str], class_id: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), class_id)
