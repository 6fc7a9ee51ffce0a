"""Scalar expressions with the semantics that the panel needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seasons by month number.
SEASONS = {12: "winter", 1: "winter", 2: "winter", 3: "spring", 4: "spring", 5: "spring", 6: "summer", 7: "summer", 8: "summer", 9: "autumn", 10: "autumn", 11: "autumn"}
#: Meteorological season codes by month number.
SEASON_CODES = {12: "DJF", 1: "DJF", 2: "DJF", 3: "MAM", 4: "MAM", 5: "MAM", 6: "JJA", 7: "JJA", 8: "JJA", 9: "SON", 10: "SON", 11: "SON"}
#: Scene classes that are kept.
CLEAR_CLASSES = (4, 5, 6, 11)


def at_least(c: Column, low) -> Column:
    """Clip from below; NULL stays NULL (greatest() would give ``low``)."""
    return F.when(c < low, F.lit(low)).otherwise(c)


def clipped(c: Column, low, high) -> Column:
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or either is NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def normalised_difference(a: Column, b: Column) -> Column:
    return ratio(a - b, a + b)


def zero_filled(code: Column, width: int = 5) -> Column:
    """Left-pad with zeros, never cutting longer codes."""
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def digits(code: Column) -> Column:
    return F.regexp_replace(code, r"\D", "")


def unit_key(level: Column, group: Column, code: Column) -> Column:
    return F.concat_ws(":", level, group, code)


def last_part(key: Column) -> Column:
    return F.element_at(F.split(key, ":"), -1)


def number(c: Column) -> Column:
    """Placeholders such as ``X`` and ``-`` become NULL."""
    return F.trim(c.cast("string")).try_cast("double")


def season(month: Column, codes: dict[int, str] | None = None) -> Column:
    table = codes or SEASONS
    return F.create_map(*(F.lit(v) for item in table.items() for v in item))[month]


def month_parts(month_dt: Column) -> dict[str, Column]:
    return {"month_dt": month_dt, "year": F.year(month_dt), "month_num": F.month(month_dt), "season": season(F.month(month_dt))}


def masked(value: Column, scene_class: Column, classes: tuple[int, ...] = CLEAR_CLASSES) -> Column:
    return F.when(scene_class.isin(*classes), value)


def quantised(value: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """0..255 by truncation; missing becomes 0."""
    return F.coalesce(F.floor((clipped(value, low, high) - low) / (high - low) * 255).cast("int"), F.lit(0))
