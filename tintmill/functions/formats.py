"""Number formats of the text outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weight(w: Column) -> Column:
    """A weight to six fixed places, halves rounded away from zero, by integers alone."""
    units = F.round(w * F.lit(1_000_000.0)).cast("bigint")
    return F.concat(F.floor(units / 1_000_000).cast("string"), F.lit("."), F.lpad((units % 1_000_000).cast("string"), 6, "0"))


def _even(x: Column) -> Column:
    """The nearest whole number as text, ties to even."""
    return F.rint(x).cast("bigint").cast("string")


def _tenth(x: Column) -> Column:
    """One place, rounding the exact binary value, ties to even.

    Whether x lies above the tie between two tenths is read off ``x * 16 - m + x * 4``, which no step rounds.
    """
    t = F.floor(x * 10)
    m = (2 * t + 1).cast("double")
    over = (x * 16 - m) + x * 4
    tenths = t + F.when((over > 0) | ((over == 0) & (t % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def rate(records: Column, seconds: Column) -> Column:
    """Records a second, short enough for a column; no rate where no time has passed."""
    each = records.cast("double") / F.when(seconds > 0, seconds)
    return F.when(seconds <= 0, "-- rec/s").when(each >= 1e6, F.concat(_tenth(each / 1e6), F.lit("M rec/s"))).when(each >= 1e3, F.concat(_even(each / 1e3), F.lit("k rec/s"))).otherwise(F.concat(_even(each), F.lit(" rec/s")))


def human(size: Column) -> Column:
    """A number of bytes in decimal units, one place from kilobytes on."""
    x = size.cast("double")
    out = F.when(x < 1e3, F.concat(size.cast("string"), F.lit(" B")))
    for power, unit in ((1, "kB"), (2, "MB"), (3, "GB")):
        out = out.when(x < 1e3 ** (power + 1), F.concat(_tenth(x / 1e3**power), F.lit(f" {unit}")))
    return out.otherwise(F.concat(_tenth(x / 1e12), F.lit(" TB")))
