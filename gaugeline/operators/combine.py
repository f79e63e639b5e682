"""Joining sources onto one time axis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from gaugeline.functions import (
    blank_to_null,
    clamp,
    col,
    decompose,
    exceeds,
    floor_negative,
    keep_within,
    nan_to_null,
    round_hour,
    row_flag,
    sentinels_to_null,
    to_number,
)
from gaugeline.operators.gaps import dedup_time, drop_long_gaps, fill_small_gaps, interpolate
from gaugeline.operators.ordered import Axis, join_keys
from gaugeline.sources.tables import Store, as_is

Bounds = Mapping[str, tuple]


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[col(c) for c in columns])


def clean_ranges(
    df: DataFrame, bounds: Bounds, *, floored: Sequence[str] = (), sentinels: Sequence[float] = ()
) -> DataFrame:
    """One projection: negatives to 0 for ``floored``, sentinels and values outside bounds to null."""
    out = []
    for c in df.columns:
        value = col(c)
        if c in floored:
            value = floor_negative(value)
        if c in bounds:
            if sentinels and isinstance(df.schema[c].dataType, NumericType):
                value = sentinels_to_null(value, sentinels)
            value = keep_within(value, *bounds[c])
        out.append(value.alias(c))
    return df.select(*out)


def to_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Blank or NA text to null, the rest to double where it is a number; numbers lose their NaN."""
    out = []
    for c in df.columns:
        if c not in columns:
            out.append(col(c))
        elif isinstance(df.schema[c].dataType, NumericType):
            out.append(nan_to_null(col(c).cast("double")).alias(c))
        else:
            out.append(nan_to_null(to_number(blank_to_null(col(c)))).alias(c))
    return df.select(*out)


def decompose_direction(df: DataFrame, direction: str, magnitude: str | None = None) -> DataFrame:
    """Replace a column of degrees by its x and y components, in place."""
    x, y = decompose(col(direction), None if magnitude is None else col(magnitude))
    out = []
    for c in df.columns:
        out += [x.alias(f"{c}_x"), y.alias(f"{c}_y")] if c == direction else [col(c)]
    return df.select(*out)


def require_limits(columns: Sequence[str], limits: Mapping[str, float] | DataFrame) -> None:
    known = limits.columns if isinstance(limits, DataFrame) else limits
    missing = [c for c in columns if c not in known]
    if missing:
        raise ValueError(f"no limit for column(s): {', '.join(missing)}")


def binarize(
    df: DataFrame, columns: Sequence[str], limits: Mapping[str, float] | DataFrame, flag: str | None = "anomaly"
) -> DataFrame:
    """Replace values by 1 (above the limit) or 0; null stays. ``flag`` sums up the row.

    A limit table is read once, as one struct."""
    require_limits(columns, limits)
    if isinstance(limits, DataFrame):
        row = limits.select(F.struct(*[col(c).cast("double").alias(f"l{i}") for i, c in enumerate(columns)]).alias("l"))
        df, limit = df.withColumn("__limits", row.scalar()), {c: F.col("__limits")[f"l{i}"] for i, c in enumerate(columns)}
    else:
        limit = {c: F.lit(float(limits[c])) for c in columns}
    binary = {c: exceeds(col(c), limit[c]) for c in columns}
    out = df.select(*[binary[c].alias(c) if c in binary else col(c) for c in df.columns if c != "__limits"])
    if flag is None:
        return out
    return out.withColumn(flag, row_flag([col(c) for c in columns]))


def numbers_or_flags(df: DataFrame, columns: Sequence[str], limits: Mapping[str, float] | DataFrame | None) -> DataFrame:
    """A source's columns as numbers, or with limits as 0/1 flags that ``anomaly`` sums up."""
    df = to_numbers(df, columns)
    return df if limits is None else binarize(df, columns, limits)


def limits_long(limits: DataFrame) -> DataFrame:
    """One-row limit table to ``(param, limit)``."""
    values = limits.select(*[col(c).cast("double").alias(c) for c in limits.columns])
    return values.unpivot([], [col(c) for c in values.columns], "param", "limit")


def limit_lines(limits: DataFrame, wanted: Sequence[str], scale: DataFrame | None = None) -> DataFrame:
    """Limits of the wanted columns for display; scaled limits are clamped into [0, 1]."""
    names = [c for c in limits.columns if c in wanted]
    long = limits_long(limits.select(*[col(c) for c in names]))
    if scale is None:
        return long
    spread = F.col("max") - F.col("min")
    scaled = F.when(spread == 0, F.lit(0.5)).otherwise((F.col("limit") - F.col("min")) / spread)
    return long.join(scale, "param").select("param", clamp(scaled).alias("limit"))


def clean_profiler(
    df: DataFrame,
    axis: Axis,
    *,
    names: Mapping[str, str],
    sensors: Sequence[str],
    bounds: Bounds,
    tie: Sequence[str] = (),
    max_gap: int = 6,
    sentinels: Sequence[float] = (-9999.0,),
    store: Store = as_is,
) -> DataFrame:
    """The primary series: rename, range rules, one row per hour, small gaps filled and flagged.
    ``store`` is applied before each of the two scans."""
    df = rename(df, names)
    df = clean_ranges(df, {**{s: () for s in sensors}, **{k: v for k, v in bounds.items() if k in df.columns}},
                      sentinels=sentinels)
    df = df.where(col(axis.time).isNotNull())
    # Rounding can bring several readings to one hour; the earliest stays.
    df = df.withColumn("__raw", col(axis.time)).withColumn(axis.time, round_hour(col(axis.time)))
    df = dedup_time(df, axis, ["__raw", *(tie or sensors)])
    df = select(df, [*axis.keys, axis.time, *sensors])
    return fill_small_gaps(store(df), axis, sensors, max_gap=max_gap, store=store)


def add_source(
    df: DataFrame,
    source: DataFrame,
    axis: Axis,
    *,
    source_time: str = "Time",
    round_to_hour: bool = False,
    include_missing: bool = False,
    max_gap: int = 6,
    sparse: bool = False,
    limits: Mapping[str, float] | DataFrame | None = None,
    basis: str = "row",
    store: Store = as_is,
) -> DataFrame:
    """Join a further source by time and clean the new columns.

    With ``include_missing`` or ``sparse`` nothing is dropped or filled.  Otherwise runs of more
    than ``max_gap`` rows without any new value are dropped, and what is left is filled up to
    ``max_gap`` cells from a known value.  ``limits`` turns the new columns into 0/1 flags.
    ``store`` is applied between the dropping and the filling, which both scan the whole table.
    """
    merged, new = join_source(df, source, axis, source_time=source_time, round_to_hour=round_to_hour, limits=limits)
    if sparse or include_missing:
        return merged
    return fill_joined(store(merged), axis, new, max_gap=max_gap, basis=basis, store=store)


def join_source(
    df: DataFrame,
    source: DataFrame,
    axis: Axis,
    *,
    source_time: str = "Time",
    round_to_hour: bool = False,
    limits: Mapping[str, float] | DataFrame | None = None,
) -> tuple[DataFrame, list[str]]:
    """The table with the columns of a further source at equal times, as numbers or flags, and their names."""
    if source_time != axis.time and source_time in source.columns:
        source = source.withColumnRenamed(source_time, axis.time)
    if round_to_hour:
        source = source.withColumn(axis.time, round_hour(col(axis.time)))
    new = [c for c in source.columns if c != axis.time and c not in axis.keys]
    twice = [c for c in new if c in df.columns]
    if twice:
        raise ValueError(f"column(s) in both tables: {', '.join(twice)}")
    source = to_numbers(select(source, [*axis.keys, axis.time, *new]), new)
    if limits is not None:
        source = binarize(source, new, limits, flag=None)
    merged = select(join_keys(df, source, [*axis.keys, axis.time], "left"), [*df.columns, *new])
    if limits is not None:
        merged = merged.withColumn("anomaly", row_flag([col(c) for c in new]))
    return merged, new


def fill_joined(
    df: DataFrame, axis: Axis, new: Sequence[str], *, max_gap: int = 6, basis: str = "row", store: Store = as_is
) -> DataFrame:
    """Long runs of rows without any of the new columns go, short ones are filled.  Both scan the whole
    table, and ``store`` is applied between them."""
    flags = [f.name for f in df.schema if f.name in new and f.dataType.typeName() != "double"]
    if flags:
        df = df.select(*[col(c).cast("double").alias(c) if c in flags else col(c) for c in df.columns])
    return interpolate(store(drop_long_gaps(df, axis, new, max_gap)), axis, new, limit=max_gap, direction="both", basis=basis)


def observed_values(
    df: DataFrame, time: str, groups: Mapping[str, Sequence[str]], wanted: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Long view ``(time, param, value)`` of the columns of the wanted groups that the table has."""
    names = [c for g in wanted for c in groups[g] if c in df.columns]
    return df.select(*[col(k) for k in keys], col(time), *[col(c).cast("double").alias(c) for c in names]).unpivot(
        [col(c) for c in [*keys, time]], [col(c) for c in names], "param", "value"
    )
