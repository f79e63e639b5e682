"""Ordered scans that never put a whole series on one task.

A window over ``partitionBy(key)`` sends one series to one task, and a window without keys sends the
whole table.  The scans here cut each series into time buckets instead:

1. a small summary per (key, bucket) is aggregated, combined before the shuffle; where row numbers are
   asked for, it is taken after the shuffle by (key, bucket) that step 3 needs anyway;
2. the summary is scanned in order of the bucket, which yields what earlier or later buckets hand over;
3. the handed-over values are joined back on (key, bucket) and each bucket is finished on its own.

The summary of one key has at most (time range / bucket width) rows and a bucket holds at most
(bucket width / grid step) rows once times are unique, so neither grows with the number of keys or
with one key's share of the data.  No result is approximated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions import HOUR_US, col

_BEFORE = (Window.unboundedPreceding, -1)
_UP_TO = (Window.unboundedPreceding, Window.currentRow)


@dataclass(frozen=True)
class Axis:
    """What orders a series: its time column, the columns that name the series, and the buckets.

    ``tie`` orders rows of equal time; without it times must be unique within a series.  A null key
    names a series of its own.  On an hourly grid a bucket holds at most ``bucket_hours`` rows of a series.

    ``parts`` is for series off the grid whose rows crowd into few hours, and for ordering by a
    number instead of a time: buckets then are cut at approximate quantiles of the series, about
    equally full whatever the distribution, at the price of one more pass over the order column.
    """

    time: str = "ts"
    keys: Sequence[str] = ()
    tie: Sequence[str] = ()
    bucket_hours: float = 24.0 * 7
    parts: int | None = None

    def __post_init__(self):
        object.__setattr__(self, "keys", tuple(self.keys))
        object.__setattr__(self, "tie", tuple(self.tie))

    @property
    def key_cols(self) -> list[Column]:
        return [col(k) for k in self.keys]

    def with_(self, **changes) -> Axis:
        return replace(self, **changes)

    def order(self) -> list[Column]:
        return [col(self.time)] + [col(t) for t in self.tie]

    def bucket(self) -> Column:
        return F.floor(F.unix_micros(col(self.time)) / int(self.bucket_hours * HOUR_US)).cast("bigint")


@dataclass(frozen=True)
class Record:
    """Values that belong together, as one struct; it counts as present where ``when`` holds."""

    when: Column
    fields: Mapping[str, Column]


Value = Column | Record


@dataclass(frozen=True)
class Scan:
    """Columns to add by ``scan``; each maps a new name to a column or record.

    total      running sum up to and including the row (null counts as 0)
    whole      sum over the whole series
    last       latest value present at or before the row
    prior      latest value present strictly before the row
    following  earliest value present at or after the row
    after      earliest value present strictly after the row
    """

    total: Mapping[str, Column] = field(default_factory=dict)
    whole: Mapping[str, Column] = field(default_factory=dict)
    last: Mapping[str, Value] = field(default_factory=dict)
    prior: Mapping[str, Value] = field(default_factory=dict)
    following: Mapping[str, Value] = field(default_factory=dict)
    after: Mapping[str, Value] = field(default_factory=dict)


def _present(value: Value) -> Column:
    return value.when if isinstance(value, Record) else value.isNotNull()


def _fields(value: Value) -> list[Column]:
    return list(value.fields.values()) if isinstance(value, Record) else [value]


def _assemble(value: Value, present: Column, parts: Sequence[Column], row: Column | None) -> Column:
    """Put a value together from its parts, with the row number it came from if there is one."""
    whole = F.struct(*[c.alias(n) for c, n in zip(parts, value.fields)]) if isinstance(value, Record) else parts[0]
    if row is not None:
        whole = F.struct(row.cast("bigint").alias("rn"), whole.alias("v"))
    elif not isinstance(value, Record):
        return whole
    return F.when(present, whole)


#: A group with less than this share of all rows is small enough for one task.
_LARGE_SHARE = 256


def group_key(keys: Sequence[str]) -> Column:
    return F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def of_large_groups(df: DataFrame, table: DataFrame, keys: Sequence[str], size: str, value: Column) -> Column:
    """A value of the group of a row, null for rows of small groups.

    ``table`` has a row per group, and the group's number of rows as ``size``.  At most 256 groups are
    large; they come as one scalar map, so that rows are not shuffled by a few group names.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    entry = F.struct(group_key(keys).alias("key"), value.alias("value"))
    large = table.where(col(size) * _LARGE_SHARE > total).agg(F.map_from_entries(F.collect_list(entry)))
    return F.try_element_at(large.scalar(), group_key(keys))


def cut_evenly(df: DataFrame, axis: Axis, name: str = "__part") -> DataFrame:
    """Number the rows of each series by ``axis.parts`` buckets of about equal size; a series with less than
    a 256th of all rows is one bucket.

    The cut points are approximate; they decide how full buckets are and nothing else, as any
    cut in order gives the same scan. Rows of equal order value share a bucket.
    """
    value = col(axis.time)
    value = (F.unix_micros(value) if df.schema[axis.time].dataType.typeName().startswith("timestamp") else value).cast("double")
    steps = F.array(*[F.lit(i / axis.parts) for i in range(1, axis.parts)])
    points = F.percentile_approx(value, steps, axis.parts * 16)
    if axis.keys:
        cuts = df.groupBy(*axis.key_cols).agg(points.alias("__cuts"), F.count(F.lit(1)).alias("__n"))
        held = df.withColumn("__cuts", of_large_groups(df, cuts, axis.keys, "__n", F.col("__cuts")))
    else:
        held = df.withColumn("__cuts", df.agg(points).scalar())
    return held.withColumn(name, _cuts_below(F.col("__cuts"), value, axis.parts)).drop("__cuts")


def _cuts_below(cuts: Column, value: Column, parts: int) -> Column:
    """How many of the sorted cut points lie below the value, by halving."""
    steps = [F.lit(1 << k) for k in range(max(parts - 1, 1).bit_length() - 1, -1, -1)]

    def ahead(at: Column, step: Column) -> Column:
        return at + F.when(F.get(cuts, at + step - 1) < value, step).otherwise(0)

    return F.aggregate(F.array(*steps), F.lit(0), ahead).cast("bigint")


def join_keys(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by columns of equal names in which null equals null; the left side's columns stay."""
    renamed = right.withColumnsRenamed({n: f"__right_{i}" for i, n in enumerate(names)})
    same = [left[f"`{n}`"].eqNullSafe(renamed[f"__right_{i}"]) for i, n in enumerate(names)]
    return left.join(renamed, same, how).drop(*[f"__right_{i}" for i in range(len(names))])


def place(axis: Axis, bucket: Column | None = None) -> Column:
    """Series and bucket of a row as one struct.

    A struct is never null itself, so a join on it keeps rows without a time or key, infers no
    null filter that would tell the two sides apart, and so lets Spark reuse one shuffle for both.
    """
    bucket = axis.bucket() if bucket is None else bucket
    return F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(axis.keys)], bucket.cast("bigint").alias("b"))


#: Column of a table laid out for ordered work; see ``laid_out``.
LAYOUT = "__k"


def laid_out(df: DataFrame, axis: Axis) -> DataFrame:
    """The rows that have a time, with the series and time bucket of each as ``LAYOUT``.

    Scans use the column where a table has it and hand it on.  A table written bucketed by it
    (``sources.tables.bucketed``) is scanned without moving a row, and so is what a scan of it gives.
    """
    if axis.parts:
        raise ValueError("a layout has time buckets")
    return df.where(col(axis.time).isNotNull()).withColumn(LAYOUT, place(axis))


def placed(df: DataFrame, axis: Axis, bucket: Column | None) -> DataFrame:
    return df if bucket is None and LAYOUT in df.columns else df.withColumn(LAYOUT, place(axis, bucket))


def unplace(axis: Axis) -> dict[str, Column]:
    parts = {f"__s{i}": F.col("__k")[f"k{i}"] for i in range(len(axis.keys))}
    return {**parts, "__b": F.col("__k")["b"]}


def series_cols(axis: Axis) -> list[Column]:
    return [F.col(f"__s{i}") for i in range(len(axis.keys))]


def somewhere(axis: Axis, time: Column, salt: Column) -> Column:
    """The time, or for points without one a time long before all data, where they find nothing.
    Such points are spread over many buckets."""
    width = int(axis.bucket_hours * HOUR_US)
    early = F.timestamp_micros(F.lit(-(2**60)) + F.pmod(F.xxhash64(salt), F.lit(1 << 16)) * F.lit(width))
    return F.coalesce(time, early)


def _window(part: list[Column], order: list[Column], frame, descending: bool = False):
    # Frames that end "unbounded following" are rescanned for every row; a descending order with a
    # preceding frame gives the same values in one pass.
    order = [c.desc() for c in order] if descending else order
    return Window.partitionBy(*part).orderBy(*order).rowsBetween(*frame)


def scan(
    df: DataFrame,
    axis: Axis,
    spec: Scan,
    *,
    position: str | None = None,
    size: str | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Add the columns of ``spec``; see the module text for the form of the plan.

    With ``position`` the row number within the series (from 1) is added under that name, and each
    value of last/prior/following/after becomes ``struct(rn, v)`` with the row number it came from.
    With ``size`` the number of rows of the series is added.  ``bucket`` replaces the time bucket;
    it must grow with the order of the axis.
    """
    backward = {**spec.last, **spec.prior}
    forward = {**spec.following, **spec.after}
    columns = df.columns
    if bucket is None:  # rows without a time have no place in the order
        df = df.where(col(axis.time).isNotNull())
        if axis.parts:
            df, bucket = cut_evenly(df, axis), F.col("__part")
    base = placed(df, axis, bucket)
    part = [F.col("__k")]
    order = axis.order()
    if position is not None:
        number = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
        base = base.withColumn("__lr", number.cast("bigint"))

    # 1. summary of each bucket; single fields of fixed width keep it a hash aggregate
    stamp = order[0] if len(order) == 1 else F.struct(*order)
    sums = []
    if position is not None or size is not None:
        sums.append(F.count(F.lit(1)).alias("__n"))
    sums += [F.sum(e).alias(f"__t_{n}") for n, e in spec.total.items()]
    sums += [F.sum(e).alias(f"__w_{n}") for n, e in spec.whole.items()]
    for names, pick, mark, prefix in ((backward, F.max_by, F.max, "__l"), (forward, F.min_by, F.min, "__f")):
        for n, value in names.items():
            at = F.when(_present(value), stamp)
            sums += [pick(e, at).alias(f"{prefix}{i}_{n}") for i, e in enumerate(_fields(value))]
            if position is not None:
                sums.append(pick(F.col("__lr"), at).alias(f"{prefix}r_{n}"))
            if isinstance(value, Record):
                sums.append(mark(at).isNotNull().alias(f"{prefix}p_{n}"))
    summary = base.groupBy("__k").agg(*sums).withColumns(unplace(axis))

    # 2. what other buckets hand over
    series = series_cols(axis)
    whole = Window.partitionBy(*series)
    over_before = _window(series, [F.col("__b")], _BEFORE)
    over_after = _window(series, [F.col("__b")], _BEFORE, descending=True)
    if position is not None:
        summary = summary.withColumn("__off", F.coalesce(F.sum("__n").over(over_before), F.lit(0)))

    def handed(n: str, value: Value, prefix: str) -> Column:
        parts = [F.col(f"{prefix}{i}_{n}") for i in range(len(_fields(value)))]
        present = F.col(f"{prefix}p_{n}") if isinstance(value, Record) else parts[0].isNotNull()
        row = None if position is None else F.col("__off") + F.col(f"{prefix}r_{n}")
        return _assemble(value, present, parts, row)

    carry = [F.col("__k")]
    if position is not None:
        carry.append(F.col("__off"))
    if size is not None:
        carry.append(F.sum("__n").over(whole).alias("__size"))
    carry += [F.sum(f"__t_{n}").over(over_before).alias(f"__ct_{n}") for n in spec.total]
    carry += [F.sum(f"__w_{n}").over(whole).alias(f"__cw_{n}") for n in spec.whole]
    carry += [F.last(handed(n, v, "__l"), True).over(over_before).alias(f"__cl_{n}") for n, v in backward.items()]
    carry += [F.last(handed(n, v, "__f"), True).over(over_after).alias(f"__cf_{n}") for n, v in forward.items()]
    carried = summary.select(*carry)

    # 3. finish inside the bucket
    joined = base.join(carried, "__k", "left")
    row = None if position is None else F.col("__off") + F.col("__lr")
    up_to, before = _window(part, order, _UP_TO), _window(part, order, _BEFORE)
    down_to, behind = (_window(part, order, f, descending=True) for f in (_UP_TO, _BEFORE))
    out = [col(c) for c in columns]
    if position is not None:
        out.append(row.alias(position))
    if size is not None:
        out.append(F.col("__size").alias(size))
    for n, e in spec.total.items():
        inside = F.coalesce(F.sum(e).over(up_to), F.lit(0))
        out.append((inside + F.coalesce(F.col(f"__ct_{n}"), F.lit(0))).alias(n))
    out += [F.col(f"__cw_{n}").alias(n) for n in spec.whole]
    for names, frame, prefix in (
        (spec.last, up_to, "__cl_"),
        (spec.prior, before, "__cl_"),
        (spec.following, down_to, "__cf_"),
        (spec.after, behind, "__cf_"),
    ):
        for n, value in names.items():
            here = _assemble(value, _present(value), _fields(value), row)
            out.append(F.coalesce(F.last(here, True).over(frame), F.col(prefix + n)).alias(n))
    return joined.select(*out)


# Points and history share one order column: time in quarter microseconds, so that a point can
# stand just before (-1) or just after (+1) history of the same time.


def instant(time: Column, side: int | Column = 0) -> Column:
    return F.unix_micros(time) * 4 + (F.lit(side) if isinstance(side, int) else side)


def instant_bucket(axis: Axis, at: str) -> Column | None:
    """Time bucket of an instant; none if the axis cuts evenly instead."""
    return None if axis.parts else F.floor(col(at) / (4 * int(axis.bucket_hours * HOUR_US))).cast("bigint")


def last_before(
    points: DataFrame,
    history: DataFrame,
    axis: Axis,
    *,
    point_time: str,
    values: Sequence[str],
    hit: str = "hit",
    inclusive: bool = False,
) -> DataFrame:
    """As-of lookup: for each point the latest history row before it (or at it, if ``inclusive``).

    Points and history go through one ordered scan, so the work is linear in both and there is no
    range join.  ``hit`` holds ``struct(time, values…)`` or null. Lookback is unbounded.
    """
    keys = axis.key_cols
    payload = [c for c in points.columns if c not in axis.keys]
    whole = F.struct(*[col(c) for c in payload])
    asked = points.select(
        *keys,
        instant(somewhere(axis, col(point_time), whole), 1 if inclusive else -1).alias("__u"),
        whole.alias("__p"),
    )
    names = {f"__h{i}": v for i, v in enumerate(values)}
    known = history.where(col(axis.time).isNotNull()).select(
        *keys, instant(col(axis.time)).alias("__u"), col(axis.time).alias("__t"), *[col(v).alias(n) for n, v in names.items()]
    )
    both = asked.unionByName(known, allowMissingColumns=True)
    found = Record(F.col("__t").isNotNull(), {"time": F.col("__t"), **{v: F.col(n) for n, v in names.items()}})
    walked = scan(
        both, axis.with_(time="__u", tie=()), Scan(last={hit: found}), bucket=instant_bucket(axis, "__u")
    )
    return walked.where(F.col("__t").isNull()).select(
        *keys, *[F.col("__p")[c].alias(c) for c in payload], F.col(hit)
    )


def with_context(df: DataFrame, keys: Sequence[str], row: str, back: int, width: int | None = None) -> DataFrame:
    """Cut a numbered series into blocks and repeat the ``back`` rows before each block as context.

    Adds ``__blk`` and ``__ctx`` (true for repeated rows, to be dropped after the window).  With the
    default width an eighth of the rows is repeated; a block has at most ``width + back`` rows.
    """
    width = width or max(8 * back, 256)
    if width < back:
        raise ValueError("width must be at least back")
    here = F.floor((col(row) - 1) / width).cast("bigint")
    near_end = F.pmod(col(row) - 1, F.lit(width)) >= width - back
    copies = F.array(F.struct(here.alias("blk"), F.lit(False).alias("ctx")))
    repeated = F.array(F.struct((here + 1).alias("blk"), F.lit(True).alias("ctx")))
    return (
        df.withColumn("__c", F.explode(F.when(near_end, F.concat(copies, repeated)).otherwise(copies)))
        .withColumn("__blk", F.col("__c.blk"))
        .withColumn("__ctx", F.col("__c.ctx"))
        .drop("__c")
    )


def block_window(keys: Sequence[str], row: str):
    return Window.partitionBy(*[col(k) for k in keys], "__blk").orderBy(col(row))
