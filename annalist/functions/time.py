"""Signed time strings and year buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^([+-])0*(\d+)-(\d{2})-(\d{2})T"


def parse_time(raw: Column) -> dict[str, Column]:
    """year, month, day and bc of strings like -0044-00-00T00:00:00Z; what does not match gives null and bc false."""
    part = lambda g: F.regexp_extract(raw, PATTERN, g)
    number = lambda c, kind: c.try_cast(kind)
    return {
        "year": number(F.concat(F.when(part(1) == "-", "-").otherwise(""), part(2)), "long"),
        "month": number(part(3), "short"),
        "day": number(part(4), "short"),
        "bc": part(1) == "-",
    }


def century_bucket(year: Column) -> Column:
    """Hundreds, rounded half to even as the compatible queries need it (1850 -> 1800, 1851 -> 1900)."""
    return F.rint(year / 100).cast("long") * 100


def century_floor(year: Column) -> Column:
    """The hundred that the year lies in (1850 -> 1800, -50 -> -100)."""
    return F.floor(year / 100).cast("long") * 100
