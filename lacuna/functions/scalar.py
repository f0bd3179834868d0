"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Physical ranges (low, high; None: open) by what a column measures. Fixed values.
RANGES = {"ndvi": (-1, 1), "ndwi": (-1, 1), "evi": (-1, 2), "temp": (-100, 70), "precip": (0, None)}


def out_of_range(value: Column, kind: str) -> Column:
    """True for NaN-free but impossible values and infinities; null is not invalid."""
    low, high = RANGES[kind]
    bad = value < low if high is None else (value < low) | (value > high)
    return F.coalesce(bad | (F.abs(value) == float("inf")), F.lit(False))


def cleaned(value: Column, kind: str) -> Column:
    return F.when(~out_of_range(value, kind), value)


def source_label(target: Column, sensors: dict[str, Column], tolerance: float = 1e-7) -> Column:
    """The first sensor that equals the target within the tolerance, else 'unknown'."""
    out = F.lit("unknown")
    for name, value in reversed(sensors.items()):
        out = F.when(F.abs(value - target) <= tolerance, F.lit(name)).otherwise(out)
    return out


def first_source(sensors: list[Column]) -> Column:
    """The place of the first sensor with a value, else -1."""
    out = F.lit(-1)
    for i, value in reversed(list(enumerate(sensors))):
        out = F.when(value.isNotNull(), i).otherwise(out)
    return out


def distance_bin(days: Column) -> Column:
    return F.when(days.isNull(), "none").when(days <= 7, "0-7").when(days <= 15, "8-15").when(days <= 30, "16-30").otherwise("31+")


def confidence_bin(p: Column) -> Column:
    return F.when(p.isNull(), None).when(p <= 0.5, "low").when(p <= 0.8, "medium").otherwise("high")


def gap_score(rmse: Column) -> Column:
    """30 points at no error, none from an RMSE of 0.10 on (not rounded)."""
    return 30 * F.greatest(F.lit(0.0), 1 - rmse / 0.10)


def season_day(date: Column) -> Column:
    """Day of the year 1..366 in which equal month and day have equal numbers in all years."""
    return F.dayofyear(F.make_date(F.lit(2000), F.month(date), F.day(date)))


def season_bin(date: Column, days: int = 15) -> Column:
    return F.floor((F.dayofyear(date) - 1) / days).cast("int")


def bool_of(text: Column) -> Column:
    """True/False/1/0 in any case and spacing; anything else raises an error."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False).when(low.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean"))


def quantile(sorted_values: Column, q: float) -> Column:
    """Linear-interpolated quantile of a sorted array; null for an empty one."""
    n = F.size(sorted_values)
    at = (n - 1) * q
    low = F.floor(at).cast("int")
    a = F.get(sorted_values, low)
    b = F.coalesce(F.get(sorted_values, low + 1), a)
    return F.when(n > 0, a + (b - a) * (at - low))
