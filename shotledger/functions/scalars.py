"""Scalar functions of texts, paths, times and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_filled(*values: Column) -> Column:
    """The first of the texts that is neither null nor empty; the last one stands as it is."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values[:-1]], values[-1])


def filled_number(new: Column, old: Column) -> Column:
    """The new number unless it is null or zero."""
    return F.coalesce(F.nullif(new, F.lit(0).cast("double")), old)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """From the last dot of the file name on, with it; names whose only dots lead them have none."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.left(name, F.char_length(name) - F.char_length(extension(path)))


def parent(path: Column) -> Column:
    """All before the last slash; empty where there is none."""
    return F.regexp_replace(F.regexp_extract(path, "^(.*)/", 1), "/+$", "")


def thumbnail_path(storage: Column, given: Column) -> Column:
    """The path given, unless it is missing or the photo's own; else ``thumbnail/<stem>_thumb.jpg`` two folders up."""
    up = parent(parent(storage))
    made = F.concat(F.when(up == "", F.lit("")).otherwise(F.concat(up, F.lit("/"))), F.lit("thumbnail/"), stem(storage), F.lit("_thumb.jpg"))
    return F.when(F.nullif(given, F.lit("")).isNotNull() & (given != storage), given).otherwise(made)


def under(*parts: Column | str) -> Column:
    """Path of the parts; literal texts may be given as such."""
    return F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def public_url(path: Column, base: str) -> Column:
    """Web addresses stand; other paths follow the base with doubled slashes made one."""
    joined = F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(path, "^/+", ""))
    return F.when(path.rlike("^https?://"), path).otherwise(F.regexp_replace(joined, "(?<!:)//+", "/"))


def without_base(url: Column, base: str) -> Column:
    return F.when(url.startswith(base), F.substring(url, len(base) + 1, 2**31 - 1)).otherwise(url)


def iso_text(ts: Column) -> Column:
    """``2024-01-02T03:04:05``, with six digits of a fraction where there is one; empty for null."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.coalesce(F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction)), F.lit(""))


def dotted_date(*times: Column) -> Column:
    """``2024.01.02`` of the first time that isn't null."""
    return F.date_format(F.coalesce(*times), "yyyy.MM.dd")


def from_epoch(seconds: Column, zone: str = "UTC") -> Column:
    """Wall-clock time of epoch seconds in a zone; zero and null give null."""
    micros = F.round(F.nullif(seconds, F.lit(0.0)) * 1_000_000).cast("long")
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_micros(micros).cast("timestamp_ntz"))


def trimmed_list(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: F.trim(x))


def clamp(k: Column, low: Column | int, high: Column) -> Column:
    return F.greatest(F.lit(low) if isinstance(low, int) else low, F.least(k, high))


def int_or_zero(value: Column) -> Column:
    """A number in text: missing is 0; text that isn't a number stops the query."""
    return F.coalesce(value.cast("int"), F.lit(0))


def mebibytes(n: Column) -> Column:
    return n / F.lit(1024.0 * 1024.0)


def fixed(x: Column, digits: int = 2) -> Column:
    """Text with so many decimals and no grouping."""
    return F.format_string(f"%.{digits}f", x.cast("double"))


def fit_within(width: Column, height: Column, most_width: int = 1024, most_height: int = 768) -> tuple[Column, Column]:
    """Size of an image shrunk to fit with its proportions kept; smaller ones stay."""
    scale = F.least(F.lit(1.0), F.lit(float(most_width)) / width, F.lit(float(most_height)) / height)
    return tuple(F.greatest(F.lit(1), F.round(x * scale)).cast("int") for x in (width, height))


def upload_strategy(size: Column, resumable_from: int, direct: bool = True) -> Column:
    """How a file of this size is to be sent: ``resumable``, ``presigned``, or ``proxy`` where the store takes no direct upload."""
    return F.when(F.lit(not direct), F.lit("proxy")).when(size >= resumable_from, F.lit("resumable")).otherwise(F.lit("presigned"))
