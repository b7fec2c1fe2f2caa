"""Camera settings as photographers write them, from their numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest(v: Column) -> Column:
    return F.floor(v + F.lit(0.5)).cast("string")


def shutter(v: Column) -> Column:
    """Seconds: whole ones without a decimal, parts of one as 1/n; empty for none."""
    whole = F.abs(v - F.round(v)) < 0.05
    return F.when(v <= 0, "").when(v >= 1, F.concat(F.when(whole, nearest(v)).otherwise(F.format_string("%.1f", v)), F.lit("s"))).otherwise(F.concat(F.lit("1/"), nearest(F.try_divide(F.lit(1.0), v))))


def aperture(v: Column) -> Column:
    """f/2.8, and f/4 without a decimal; empty for none."""
    return F.when(v <= 0, "").when(F.floor(v * 10 + F.lit(0.5)) % 10 == 0, F.concat(F.lit("f/"), nearest(v))).otherwise(F.concat(F.lit("f/"), F.format_string("%.1f", v)))


def focal(v: Column) -> Column:
    return F.when(v <= 0, "").otherwise(F.concat(nearest(v), F.lit(" mm")))


def bias(v: Column) -> Column:
    """Exposure compensation with its sign."""
    return F.when(F.abs(v) < 0.005, "0 EV").otherwise(F.concat(F.format_string("%+.1f", v), F.lit(" EV")))
