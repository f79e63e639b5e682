"""Regular time: de-duplication, hourly spine, gap filling, runs and segments."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions import HOUR_US, col, round_half_even
from gaugeline.operators.ordered import LAYOUT, Axis, Record, Scan, cut_evenly, join_keys, placed, scan, series_cols, unplace
from gaugeline.sources.tables import Store, as_is


def dedup_time(df: DataFrame, axis: Axis, tie: Sequence[str]) -> DataFrame:
    """First row of each time, by the order of ``tie``; rows that miss a tie column come last.

    An aggregate rather than a ranking window: copies of one time combine before the shuffle, so a
    time that holds a large share of the rows is no hot group.
    """
    by = [*axis.keys, axis.time]
    rest = [c for c in df.columns if c not in by]
    order = [c for t in tie for c in (col(t).isNull(), col(t))]
    first = F.min_by(F.struct(*[col(c) for c in rest]), F.struct(*order)).alias("__first")
    picked = df.groupBy(*[col(c) for c in by]).agg(first)
    return picked.select(*[col(c) if c in by else F.col("__first")[c].alias(c) for c in df.columns])


def duplicate_times(df: DataFrame, axis: Axis, count: str = "n") -> DataFrame:
    by = [*axis.key_cols, col(axis.time)]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(count)).where(F.col(count) > 1)


def hourly_spine(sources: Sequence[DataFrame], axis: Axis) -> DataFrame:
    """Every hour from the earliest to the latest time over all sources, per series."""
    by = axis.key_cols
    spans = [
        s.groupBy(*by).agg(F.min(col(axis.time)).alias("lo"), F.max(col(axis.time)).alias("hi")) for s in sources
    ]
    span = reduce(DataFrame.unionByName, spans).groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    hours = F.sequence(F.col("lo"), F.col("hi"), F.expr("interval 1 hour"))
    return span.select(*by, F.explode(hours).alias(axis.time))


def align(spine: DataFrame, source: DataFrame, axis: Axis) -> DataFrame:
    """A source laid onto the spine; hours without a reading are null. Times must be unique."""
    return join_keys(spine, source, [*axis.keys, axis.time], "left")


def align_all(sources: Sequence[DataFrame], axis: Axis, ties: Sequence[Sequence[str]], columns: Sequence[str]) -> DataFrame:
    """All sources on one spine of whole hours, with the given columns of theirs; of rows of one time the first
    counts, by the source's tie columns, as in ``dedup_time``.

    The sources and the spine are one union with one aggregate over (series, time), so rows are shuffled
    once however many sources there are.
    """
    parts = []
    for i, (source, tie) in enumerate(zip(sources, ties, strict=True)):
        values = [col(c) for c in source.columns if c in columns]
        order = [c for t in tie for c in (col(t).isNull(), col(t))]
        rows = source.where(col(axis.time).isNotNull())
        parts.append(rows.select(*axis.key_cols, col(axis.time), F.struct(*values).alias(f"__v{i}"), F.struct(*order).alias(f"__o{i}")))
    laid = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    whole = laid.unionByName(hourly_spine([laid], axis), allowMissingColumns=True)
    firsts = [F.min_by(F.col(f"__v{i}"), F.col(f"__o{i}")).alias(f"__v{i}") for i in range(len(parts))]
    found = whole.groupBy(*axis.key_cols, col(axis.time)).agg(*firsts)
    of = {c: i for i, source in enumerate(sources) for c in source.columns if c in columns}
    return found.select(*axis.key_cols, col(axis.time), *[F.col(f"__v{of[c]}")[c].alias(c) for c in columns])


def insert_missing_hours(df: DataFrame, axis: Axis, max_gap: int = 6, flag: str = "Interpolated") -> DataFrame:
    """Insert the hours missing in steps of more than 1 h and at most ``max_gap`` h, flagged with 1.

    Present rows get flag 0; larger steps stay open. A row emits at most ``max_gap`` rows.
    """
    ahead = scan(df, axis, Scan(after={"__next": col(axis.time)})).drop(LAYOUT)  # inserted hours have places of their own
    df = df.drop(LAYOUT)
    step = (F.unix_micros(F.col("__next")) - F.unix_micros(col(axis.time))) / HOUR_US
    missing = F.when((step > 1) & (step <= max_gap), F.floor(step).cast("int") - 1).otherwise(0)
    offsets = F.sequence(F.lit(0), missing, F.lit(1))
    rows = ahead.withColumn("__h", F.explode(offsets))
    kept = [*axis.keys, axis.time, flag]
    out = []
    for c in df.columns:
        if c == axis.time:
            moved = F.timestamp_micros(F.unix_micros(col(c)) + F.col("__h") * F.lit(HOUR_US))
            out.append(moved.alias(c))
        elif c in kept:
            out.append(col(c))
        else:
            out.append(F.when(F.col("__h") == 0, col(c)).alias(c))
    if flag in df.columns:
        out = [o for o, c in zip(out, df.columns) if c != flag]
    return rows.select(*out, (F.col("__h") > 0).cast("int").alias(flag))


def interpolate(
    df: DataFrame,
    axis: Axis,
    columns: Sequence[str],
    *,
    limit: int | None = None,
    direction: str = "forward",
    basis: str = "row",
    places: int | None = None,
) -> DataFrame:
    """Straight line between the known neighbours of a missing cell.

    ``basis="row"`` counts positions (also across missing hours), ``"time"`` counts hours.
    ``forward`` without limit: leading nulls stay, trailing nulls repeat the last value.
    ``forward`` with limit k: only the first k of a run are filled.  ``both`` with limit k: a cell
    within k of a known value on either side is filled; ends take the nearest value.
    """
    if direction not in ("forward", "both") or basis not in ("row", "time"):
        raise ValueError("direction is forward or both; basis is row or time")
    known = {c: col(c) for c in columns}
    if basis == "time":
        known = {c: Record(col(c).isNotNull(), {"x": col(c), "t": F.unix_micros(col(axis.time))}) for c in columns}
    walked = scan(
        df,
        axis,
        Scan(
            last={f"__p{i}": known[c] for i, c in enumerate(columns)},
            following={f"__q{i}": known[c] for i, c in enumerate(columns)},
        ),
        position="__rn",
    )
    filled = {}
    for i, c in enumerate(columns):
        p, q = F.col(f"__p{i}"), F.col(f"__q{i}")
        if basis == "row":
            at, left, right, x0, x1 = F.col("__rn"), p["rn"], q["rn"], p["v"], q["v"]
        else:
            at, left, right = (t / HOUR_US for t in (F.unix_micros(col(axis.time)), p["v"]["t"], q["v"]["t"]))
            x0, x1 = p["v"]["x"], q["v"]["x"]
        line = x0 + (x1 - x0) / (right - left) * (at - left)
        value = F.when(col(c).isNotNull(), col(c)).when(p.isNotNull() & q.isNotNull(), line)
        if direction == "forward":
            value = value.when(p.isNotNull(), x0)
            near = p.isNotNull() if limit is None else (at - left) <= limit
        else:
            value = value.when(p.isNotNull(), x0).when(q.isNotNull(), x1)
            near = (
                F.lit(True)
                if limit is None
                else F.coalesce((at - left) <= limit, F.lit(False)) | F.coalesce((right - at) <= limit, F.lit(False))
            )
        value = F.when(near, value)
        filled[c] = (round_half_even(value, places) if places is not None else value).alias(c)
    return walked.select(*[filled.get(c, col(c)) for c in df.columns])


def fill_small_gaps(
    df: DataFrame,
    axis: Axis,
    columns: Sequence[str],
    *,
    max_gap: int = 6,
    flag: str = "Interpolated",
    limit: int | None = None,
    places: int | None = 2,
    store: Store = as_is,
) -> DataFrame:
    """Insert missing hours in small gaps, then fill by position. Without ``limit`` long null runs
    of present rows are filled too.  ``store`` is applied between the two scans."""
    whole = store(insert_missing_hours(df, axis, max_gap, flag))
    return interpolate(whole, axis, columns, limit=limit, places=places)


def all_missing(columns: Sequence[str]):
    return reduce(lambda a, b: a & b, [col(c).isNull() for c in columns])


def drop_long_gaps(df: DataFrame, axis: Axis, columns: Sequence[str], max_gap: int = 6) -> DataFrame:
    """Drop runs of more than ``max_gap`` consecutive rows in which all ``columns`` are null.

    The run length follows from the row numbers of the present rows on both sides, so a run may
    span any number of buckets.
    """
    missing = all_missing(columns)
    present = F.when(~missing, F.lit(1))
    walked = scan(
        df, axis, Scan(last={"__p": present}, following={"__q": present}), position="__rn", size="__size"
    )
    left = F.coalesce(F.col("__p")["rn"], F.lit(0))
    right = F.coalesce(F.col("__q")["rn"], F.col("__size") + 1)
    return walked.where(~(missing & (right - left - 1 > max_gap))).select(*[col(c) for c in df.columns])


def segments(
    df: DataFrame,
    axis: Axis,
    *,
    step_hours: float = 1.0,
    name: str = "Segment",
    row: str | None = None,
    position: str | None = None,
    previous_position: str | None = None,
) -> DataFrame:
    """Number unbroken stretches: +1 at each step longer than ``step_hours``, from 1.

    Optional columns: ``row`` (row number in the series), ``position`` (row number in the segment)
    and ``previous_position`` (the position of the row before).  One summary serves all of them.
    """
    inside = Window.partitionBy("__k").orderBy(*axis.order())
    step = int(step_hours * HOUR_US)
    us = F.unix_micros(col(axis.time))
    columns = df.columns
    df = df.where(col(axis.time).isNotNull())
    bucket = None
    if axis.parts:
        df, bucket = cut_evenly(df, axis), F.col("__part")
    base = (
        placed(df, axis, bucket)
        .withColumn("__lr", F.row_number().over(inside).cast("bigint"))
        .withColumn("__brk", (us - F.lag(us).over(inside) > step))
    )
    brk = F.coalesce(F.col("__brk"), F.lit(False))
    summary = base.groupBy("__k").agg(
        F.count(F.lit(1)).alias("__n"),
        F.min(us).alias("__lo"),
        F.max(us).alias("__hi"),
        F.sum(brk.cast("bigint")).alias("__breaks"),
        F.max(F.when(brk, F.col("__lr"))).alias("__lastbrk"),
    )
    summary = summary.withColumns(unplace(axis))
    by_bucket = Window.partitionBy(*series_cols(axis)).orderBy("__b")
    before = by_bucket.rowsBetween(*_BEFORE_ALL)
    previous_end = F.lag("__hi").over(by_bucket)
    opened = (
        summary.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        # the first row of a series opens a segment, too
        .withColumn("__first", previous_end.isNull())
        .withColumn("__open", F.coalesce(F.col("__lo") - previous_end > step, F.lit(True)))
        .withColumn(
            "__start",
            F.coalesce(F.col("__off") + F.col("__lastbrk"), F.when(F.col("__open"), F.col("__off") + 1)),
        )
    )
    new = F.col("__breaks") + (F.col("__open") & ~F.col("__first")).cast("bigint")
    carried = opened.select(
        "__k",
        "__off",
        "__open",
        (F.lit(1) + F.coalesce(F.sum(new).over(before), F.lit(0))
         + (F.col("__open") & ~F.col("__first")).cast("bigint")).alias("__seg0"),
        F.last("__start", True).over(before).alias("__start0"),
    )
    joined = base.join(carried, "__k", "left")
    up_to = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    strictly = inside.rowsBetween(*_BEFORE_ALL)
    rn = F.col("__off") + F.col("__lr")
    opened_here = F.when(brk, F.col("__off") + F.col("__lr"))
    border = F.when(F.col("__open"), F.col("__off") + 1)
    start = F.coalesce(F.last(opened_here, True).over(up_to), border, F.col("__start0"))
    previous_start = F.when(F.col("__lr") == 1, F.col("__start0")).otherwise(
        F.coalesce(F.last(opened_here, True).over(strictly), border, F.col("__start0"))
    )
    out = [col(c) for c in columns]
    out.append((F.col("__seg0") + F.sum(brk.cast("bigint")).over(up_to)).alias(name))
    if row:
        out.append(rn.alias(row))
    if position:
        out.append((rn - start + 1).alias(position))
    if previous_position:
        out.append((rn - previous_start).alias(previous_position))
    return joined.select(*out)


_BEFORE_ALL = (Window.unboundedPreceding, -1)


def metadata_first(df: DataFrame, metadata: Sequence[str] = ("Segment", "Interpolated")) -> DataFrame:
    """Move the metadata columns to the positions after the first column."""
    rest = [c for c in df.columns if c not in metadata]
    return df.select(*[col(c) for c in [rest[0], *metadata, *rest[1:]]])
