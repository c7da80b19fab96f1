"""Camera metadata: from rationals and texts as cameras write them to numbers. Damaged values give null, never an error.

A rational is a struct of two longs, ``num`` and ``den``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rational(r: Column) -> Column:
    return F.try_divide(r["num"].cast("double"), r["den"].cast("double"))


def degrees(dms: Column, ref: Column) -> Column:
    """Decimal degrees of a list of three rationals. North and east are positive; all other marks, a missing one too, negative."""
    part = lambda k: rational(F.get(dms, F.lit(k)))
    value = part(0) + part(1) / 60 + part(2) / 3600
    return F.when(F.upper(ref).isin("N", "E"), value).otherwise(-value)


def altitude(r: Column, below: Column) -> Column:
    """Metres; negative where the mark says below sea level."""
    return F.when(below == 1, -rational(r)).otherwise(rational(r))


def direction(r: Column, ref: Column, declination: float = 8.5) -> Column:
    """Degrees from true north: magnetic directions are turned by the declination and kept in 0 to 360."""
    value = rational(r)
    turned = value - declination
    return F.when(F.upper(ref) == "M", F.when(turned < 0, turned + 360).otherwise(turned)).otherwise(value)


def located(lat: Column, lon: Column, value: Column) -> Column:
    """The value, unless the place is the (0, 0) that cameras without a fix write."""
    return F.when((lat == 0) & (lon == 0), F.lit(None)).otherwise(value)


def epoch_seconds(text: Column, subsec: Column, offset: Column, default_offset: str = "+09:00") -> Column:
    """Seconds since 1970 of ``Y:M:D h:m:s`` text, digits after the second, and an offset ``+hh:mm``; null for bad text."""
    clean = F.regexp_replace(F.trim(text), " +", " ")
    whole = F.try_to_timestamp(clean, F.lit("y:M:d H:m:s")).cast("timestamp_ntz")
    digits = F.regexp_extract(F.coalesce(subsec, F.lit("")), r"^\d+", 0)
    fraction = F.coalesce(F.left(F.rpad(digits, 6, "0"), F.lit(6)).try_cast("double"), F.lit(0.0)) / 1e6
    zone = F.when(offset.rlike(r"^[+-]\d{2}:\d{2}$"), offset).otherwise(F.lit(default_offset))
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")
    shift = F.when(zone.startswith("-"), -minutes).otherwise(minutes) * 60
    return F.when(whole.isNotNull(), seconds_of(whole) - shift + fraction)


def seconds_of(wall: Column) -> Column:
    """Seconds between 1970-01-01 00:00 and a wall-clock time, zones aside."""
    days = F.datediff(wall.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return (days * 86400 + F.hour(wall) * 3600 + F.minute(wall) * 60 + F.second(wall)).cast("double")
