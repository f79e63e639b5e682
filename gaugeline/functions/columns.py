"""Column expressions. All stay inside Catalyst; none needs Python workers.

Missing measurements are null, never NaN: Spark orders NaN above every number, so a NaN would pass
``value > limit``.  ``nan_to_null`` is applied where data enters.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000

# Text accepted as a number; Spark's own cast would also take Java suffixes such as "1d".
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def col(name: str) -> Column:
    """Column by its exact name; dots and brackets in sensor names are not parsed."""
    return F.col("`" + name.replace("`", "``") + "`")


# --- entering data ---------------------------------------------------------------------------


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def blank_to_null(text: Column) -> Column:
    """Blank text, or text containing ``NA`` anywhere, becomes null."""
    return F.when(text.rlike(r"^\s*$|NA"), None).otherwise(text)


def to_number(text: Column) -> Column:
    """Double, or null where the text is no number."""
    text = text.cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def to_number_comma(text: Column) -> Column:
    """Like ``to_number``; the decimal sign may be a point or a comma."""
    return to_number(F.regexp_replace(text, ",", "."))


def parse_time(text: Column, formats: Sequence[str] = ()) -> Column:
    """First format that fits; null where none does. The plain cast (ISO forms) is tried first."""
    tries = [text.try_cast("timestamp")]
    tries += [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return F.coalesce(*tries)


def sentinels_to_null(value: Column, sentinels: Sequence[float] = (-9999.0,)) -> Column:
    return F.when(value.isin(*sentinels) | F.isnan(value), None).otherwise(value)


def floor_negative(value: Column) -> Column:
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def keep_within(value: Column, low=None, high=None) -> Column:
    """Null outside ``[low, high]``; either bound may be missing. Works on numbers and times."""
    tests = []
    if low is not None:
        tests.append(value < low)
    if high is not None:
        tests.append(value > high)
    if not tests:
        return value
    return F.when(reduce(lambda a, b: a | b, tests), None).otherwise(value)


# --- time ------------------------------------------------------------------------------------


def round_hour(time: Column) -> Column:
    """Nearest hour; a half hour goes to the even hour (counted from 1970)."""
    us = F.unix_micros(time)
    rest = F.pmod(us, F.lit(HOUR_US))
    whole = F.floor((us - rest) / HOUR_US).cast("bigint")
    up = (rest * 2 > HOUR_US) | ((rest * 2 == HOUR_US) & (F.pmod(whole, F.lit(2)) == 1))
    return F.timestamp_micros((whole + F.when(up, 1).otherwise(0)) * F.lit(HOUR_US))


def season_keys(time: Column) -> list[Column]:
    return [
        F.year(time).alias("year"),
        F.dayofyear(time).alias("doy"),
        (F.hour(time) + F.minute(time) / 60.0).alias("hour"),
    ]


def hour_of_year(time: Column) -> Column:
    return (F.dayofyear(time) - 1) * 24 + F.hour(time)


def in_time_range(time: Column, start=None, end=None, closed: str = "left") -> Column:
    """``closed``: left ``[a,b)``, right ``(a,b]``, both ``[a,b]`` or neither ``(a,b)``."""
    if closed not in ("left", "right", "both", "neither"):
        raise ValueError(f"closed must be left, right, both or neither, not {closed!r}")
    test = F.lit(True)
    if start is not None:
        test &= (time >= start) if closed in ("left", "both") else (time > start)
    if end is not None:
        test &= (time <= end) if closed in ("right", "both") else (time < end)
    return test


# --- values ----------------------------------------------------------------------------------


def round_half_even(value: Column, places: int = 2) -> Column:
    """Half-to-even on the scaled double; Spark's ``round`` goes half up."""
    scale = 10.0**places
    return F.rint(value * scale) / scale


def decompose(degrees: Column, magnitude: Column | None = None) -> tuple[Column, Column]:
    x, y = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return (x, y) if magnitude is None else (x * magnitude, y * magnitude)


def exceeds(value: Column, limit: Column) -> Column:
    """1 above the limit, 0 at or below it, null where the value is missing."""
    return F.when(value.isNotNull(), (value > limit).cast("int"))


def exceeds_or_zero(value: Column, limit: Column) -> Column:
    """Like ``exceeds`` for predictions: a missing value counts as 0."""
    return F.coalesce((nan_to_null(value) > limit).cast("int"), F.lit(0))


def row_flag(flags: Sequence[Column]) -> Column:
    """1 if any flag is 1, 0 if none is, null if all are missing."""
    return flags[0] if len(flags) == 1 else F.greatest(*flags)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(value > high, F.lit(high)).when(value < low, F.lit(low)).otherwise(value)


def finite(value: Column) -> Column:
    """True for an ordinary number; false for null, NaN and infinities."""
    return F.coalesce(F.abs(nan_to_null(value)) < float("inf"), F.lit(False))


def binary_label(value: Column) -> Column:
    return F.rint(value).cast("int")


# --- text ------------------------------------------------------------------------------------


def leading_number(text: Column) -> Column:
    """Number before the unit in ``"7.02 pH"``."""
    return to_number(F.split(F.trim(text), r"\s+")[0])


def first_integer(name: Column) -> Column:
    """First run of digits in a name as an integer; 0 without one."""
    return F.coalesce(F.regexp_extract(name, r"(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def file_safe(name: Column) -> Column:
    return F.regexp_replace(name, r'[\\/*?:"<>|]', "_")
