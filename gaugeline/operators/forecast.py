"""Baseline forecasts of sample targets from history: naive, linear and seasonal.

``targets`` is a long table with one row per (series keys, sample, step): the output time and one
column per output.  ``history`` has the time column and the same output columns.  All baselines
return ``(keys…, sample, step, param, pred, target)`` so that they can be unioned and compared.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions import HOUR_US, col
from gaugeline.operators.ordered import Axis, join_keys, last_before

SAMPLE, STEP = "sample_id", "step"


def _hours(hours: float) -> int:
    return int(round(hours * HOUR_US))


def _by_sample(targets: DataFrame, axis: Axis, outputs: Sequence[str]) -> DataFrame:
    """One row per sample: first output time (µs) and its steps. The list is as long as the horizon."""
    step = F.struct(
        col(STEP).alias("step"), F.unix_micros(col(axis.time)).alias("us"), F.array(*[col(o).cast("double") for o in outputs]).alias("y")
    )
    return targets.groupBy(*axis.key_cols, col(SAMPLE)).agg(
        F.min(F.unix_micros(col(axis.time))).alias("__t0"), F.collect_list(step).alias("__steps")
    )


def _long(rows: DataFrame, axis: Axis, outputs: Sequence[str], pred, extra: Sequence[str] = ()) -> DataFrame:
    """Explode steps and outputs; ``pred(step, i)`` gives the forecast of output i."""
    s = F.col("__s")
    cells = [
        F.struct(F.lit(o).alias("param"), pred(s, i).cast("double").alias("pred"), s["y"][i].alias("target"))
        for i, o in enumerate(outputs)
    ]
    return (
        rows.withColumn("__s", F.explode("__steps"))
        .withColumn("__c", F.explode(F.array(*cells)))
        .select(*axis.key_cols, *[col(e) for e in extra], col(SAMPLE), s["step"].alias(STEP), "__c.param", "__c.pred", "__c.target")
    )


def _complete(history: DataFrame, outputs: Sequence[str]) -> DataFrame:
    return history.dropna(how="any", subset=[f"`{o}`" for o in outputs])


# --- naive -----------------------------------------------------------------------------------


def naive_forecast(
    targets: DataFrame,
    history: DataFrame,
    axis: Axis,
    outputs: Sequence[str],
    gap_hours: float | Sequence[float] = 5,
) -> DataFrame:
    """Last complete row strictly before (first output time - gap), repeated for each step.

    A list of gaps asks for each of them in the same pass and adds a column ``gap_hours``.
    """
    gaps = [gap_hours] if isinstance(gap_hours, (int, float)) else list(gap_hours)
    points = _by_sample(targets, axis, outputs).withColumn(
        "gap_hours", F.explode(F.array(*[F.lit(float(g)) for g in gaps]))
    )
    cut = F.timestamp_micros((F.col("__t0") - F.col("gap_hours") * HOUR_US).cast("bigint"))
    found = last_before(
        points.withColumn("__cut", cut), _complete(history, outputs), axis, point_time="__cut", values=outputs
    )
    extra = [] if isinstance(gap_hours, (int, float)) else ["gap_hours"]
    return _long(found, axis, outputs, lambda s, i: F.col("hit")[outputs[i]], extra)


# --- linear ----------------------------------------------------------------------------------


def _moments(x: Column, us: Column, outputs: Sequence[str], over=None) -> Column:
    """Sums for least squares as one struct: n, x, xx, the x extremes, and y, xy per output."""

    def s(e):
        return F.sum(e) if over is None else F.sum(e).over(over)

    lo, hi = F.min(us), F.max(us)
    if over is not None:
        lo, hi = lo.over(over), hi.over(over)
    seen = x.isNotNull()
    return F.struct(
        F.coalesce(s(seen.cast("bigint")), F.lit(0)).cast("double").alias("n"),
        F.coalesce(s(x), F.lit(0.0)).alias("x"),
        F.coalesce(s(x * x), F.lit(0.0)).alias("xx"),
        lo.alias("lo"),
        hi.alias("hi"),
        F.array(*[F.coalesce(s(col(o)), F.lit(0.0)) for o in outputs]).alias("y"),
        F.array(*[F.coalesce(s(x * col(o)), F.lit(0.0)) for o in outputs]).alias("xy"),
    )


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 for b = 0: never null, which keeps the generated code short."""
    return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))


def _centred(m: Column, outputs: Sequence[str], shift: float | Column = 0.0) -> Column:
    """Sums to count, means and sums of squares and products around the means; zeros without rows.
    The mean of x is moved by ``shift`` hours to a common origin."""
    n, x = (F.coalesce(m[f], F.lit(0.0)) for f in ("n", "x"))
    ys = [F.coalesce(m["y"][i], F.lit(0.0)) for i in range(len(outputs))]
    return F.struct(
        n.alias("n"),
        ((_ratio(x, n) + shift) if isinstance(shift, Column) or shift else _ratio(x, n)).alias("x"),
        (F.coalesce(m["xx"], F.lit(0.0)) - _ratio(x * x, n)).alias("xx"),
        m["lo"].alias("lo"),
        m["hi"].alias("hi"),
        F.array(*[_ratio(y, n) for y in ys]).alias("y"),
        F.array(*[F.coalesce(m["xy"][i], F.lit(0.0)) - _ratio(x * y, n) for i, y in enumerate(ys)]).alias("xy"),
    )


def _merge(rows: DataFrame, parts: Sequence[str], outputs: Sequence[str], name: str) -> DataFrame:
    """Merge centred parts into one column.

    Merging around the means keeps the digits that raw sums over a long window would lose.
    """

    def total(of) -> Column:
        return reduce(lambda a, b: a + b, [of(F.col(m)) for m in parts])

    def extreme(pick, field: str) -> Column:
        found = [F.col(f"{m}.{field}") for m in parts]
        return found[0] if len(found) == 1 else pick(*found)

    n, mean = F.col("__n"), F.col("__x")
    outs = range(len(outputs))
    # means first, as columns: the sums of squares refer to them many times
    rows = rows.withColumn("__n", total(lambda m: m["n"]))
    rows = rows.withColumns(
        {
            "__x": _ratio(total(lambda m: m["n"] * m["x"]), n),
            **{f"__y{i}": _ratio(total(lambda m, i=i: m["n"] * m["y"][i]), n) for i in outs},
        }
    )
    merged = F.struct(
        n.alias("n"),
        mean.alias("x"),
        total(lambda m: m["xx"] + m["n"] * (m["x"] - mean) * (m["x"] - mean)).alias("xx"),
        extreme(F.least, "lo").alias("lo"),
        extreme(F.greatest, "hi").alias("hi"),
        F.array(*[F.col(f"__y{i}") for i in outs]).alias("y"),
        F.array(
            *[
                total(lambda m, i=i: m["xy"][i] + m["n"] * (m["x"] - mean) * (m["y"][i] - F.col(f"__y{i}")))
                for i in outs
            ]
        ).alias("xy"),
    )
    return rows.withColumn(name, merged).drop("__n", "__x", *[f"__y{i}" for i in outs])


def _cells_per_window(window_hours: float, most_hours: float) -> int:
    """Few equal cells per window, if possible no longer than a bucket of the axis. An hour has a
    whole number of microseconds for each of these divisors."""
    return next((k for k in (1, 2, 3, 4, 5, 6, 8) if window_hours / k <= most_hours), 8)


def linear_forecast(
    targets: DataFrame,
    history: DataFrame,
    axis: Axis,
    outputs: Sequence[str],
    window_hours: float = 6,
    gap_hours: float = 5,
) -> DataFrame:
    """Least squares on time over complete rows in ``[t0 - gap - window, t0 - gap)``.

    The window is the tail of one cell of the time line, whole cells, and the head of another.
    Head and tail are running sums, whole cells are aggregated once, and a sample merges a handful
    of parts.  A history row is read twice, not once per sample whose window covers it.
    """
    keys = axis.key_cols
    cells = _cells_per_window(window_hours, axis.bucket_hours)
    length = _hours(window_hours)
    width = length // cells
    if width * cells != length:
        raise ValueError("window must divide into whole microseconds per cell")
    us = F.unix_micros(col(axis.time))
    cell_of = lambda u: F.floor(u / width).cast("bigint")

    known = _complete(history, outputs).select(
        *keys, us.alias("__u"), cell_of(us).alias("__cell"), F.lit(1).alias("__o"),
        *[col(o).cast("double").alias(o) for o in outputs],
    )
    x = F.when(F.col("__o") == 1, (F.col("__u") - F.col("__cell") * width) / HOUR_US)
    seen_us = F.when(F.col("__o") == 1, F.col("__u"))
    samples = _by_sample(targets, axis, outputs).withColumn(
        "__end", F.col("__t0") - F.lit(_hours(gap_hours))
    )

    def ask(points: DataFrame, at: Column, descending: bool, name: str, shift: float) -> DataFrame:
        """Running sums of the cell that holds ``at``: rows before it, or rows at and after it."""
        carried = [c for c in points.columns if c not in axis.keys]
        asked = points.select(
            *keys, at.alias("__u"), cell_of(at).alias("__cell"), F.lit(0).alias("__o"),
            F.struct(*[col(c) for c in carried]).alias("__p"),
        )
        order = [F.col("__u").desc(), F.col("__o").desc()] if descending else [F.col("__u"), F.col("__o")]
        run = Window.partitionBy(*keys, "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        both = asked.unionByName(known, allowMissingColumns=True)
        return (
            both.select(*keys, "__o", "__p", "__cell", _moments(x, seen_us, outputs, run).alias(name))
            .where(F.col("__o") == 0)
            .select(*keys, *[F.col("__p")[c].alias(c) for c in carried], F.col("__cell").alias(f"{name}_cell"),
                    _centred(F.col(name), outputs, shift).alias(name))
        )

    hours = width / HOUR_US
    with_tail = ask(samples, F.col("__end") - length, True, "__tail", 0.0)
    with_head = ask(with_tail, F.col("__end"), False, "__head", cells * hours)

    asked_cells = samples.select(*keys, cell_of(F.col("__end")).alias("__cell"), F.lit(0).alias("__o")).distinct()
    blocks = (
        known.unionByName(asked_cells, allowMissingColumns=True)
        .groupBy(*keys, "__cell")
        .agg(_moments(x, seen_us, outputs).alias("m"))
    )
    rows = with_head
    parts = ["__tail", "__head"]
    if cells > 1:
        # the whole cells depend on the cell of the head alone, so they are merged once per cell
        in_order = Window.partitionBy(*keys).orderBy("__cell")
        middle = blocks.select(
            *keys,
            F.col("__cell").alias("__head_cell"),
            *[F.first("m").over(in_order.rangeBetween(k - cells, k - cells)).alias(f"__whole{k}") for k in range(1, cells)],
        )
        whole = {f"__whole{k}": _centred(F.col(f"__whole{k}"), outputs, k * hours) for k in range(1, cells)}
        middle = _merge(middle.withColumns(whole), list(whole), outputs, "__mid").select(*keys, "__head_cell", "__mid")
        rows = join_keys(rows, middle, [*axis.keys, "__head_cell"], "left")
        parts.insert(1, "__mid")
    fitted = _merge(rows, parts, outputs, "__all")
    line = F.col("__all")
    origin = F.col("__tail_cell") * F.lit(width)

    def pred(s, i):
        # one point, or points at one time, give their mean
        slope = F.when(line["hi"] > line["lo"], _ratio(line["xy"][i], line["xx"])).otherwise(F.lit(0.0))
        return F.when(line["n"] > 0, line["y"][i] + slope * ((s["us"] - origin) / HOUR_US - line["x"]))

    return _long(fitted, axis, outputs, pred)


def linear_window_sweep(
    targets: DataFrame,
    history: DataFrame,
    axis: Axis,
    outputs: Sequence[str],
    windows: Sequence[int] = range(1, 60),
    gap_hours: float = 5,
) -> DataFrame:
    """The linear baseline for each of several whole-hour windows, with a column ``window_hours``.

    The time line is cut into cells of an hour, and a sample marks its cutoff and every hour before it.  A
    mark gets the sums of its cell's rows before it and of those from it on, by running sums in the
    cell.  From the cutoff backwards these parts add up: each window takes over the window before it, so
    a sample meets a summary of every hour and no history row, on the hourly grid or off it.
    """
    if min(windows) < 1:
        raise ValueError("windows have at least one hour")
    keys = axis.key_cols
    hour_of = lambda u: F.floor(u / HOUR_US).cast("bigint")
    us = F.unix_micros(col(axis.time))
    known = _complete(history, outputs).select(
        *keys, us.alias("__u"), hour_of(us).alias("__cell"), F.lit(1).alias("__o"), *[col(o).cast("double").alias(o) for o in outputs]
    )
    marks = F.explode(F.sequence(F.lit(0), F.lit(max(windows)))).alias("window_hours")
    samples = _by_sample(targets, axis, outputs).withColumn("__end", F.col("__t0") - F.lit(_hours(gap_hours)))
    at = F.col("__end") - F.col("window_hours") * F.lit(HOUR_US)
    # samples without a time are spread over cells before all times
    nowhere = F.lit(-1_000_000_000) - F.pmod(F.xxhash64(col(SAMPLE)), F.lit(1 << 16))
    asked = samples.select(*keys, col(SAMPLE), "__end", "__steps", marks).select(
        *keys, at.alias("__u"), F.coalesce(hour_of(at), nowhere).alias("__cell"), F.lit(0).alias("__o"),
        F.struct(col(SAMPLE).alias("sample"), "__end", "__steps", "window_hours").alias("__p"),
    )
    # marks come before rows of their time, seen from either end
    in_cell = Window.partitionBy(*keys, "__cell")
    up = in_cell.orderBy("__u", "__o").rowsBetween(Window.unboundedPreceding, 0)
    down = in_cell.orderBy(F.desc("__u"), F.desc("__o")).rowsBetween(Window.unboundedPreceding, 0)
    x = F.when(F.col("__o") == 1, (F.col("__u") - F.col("__cell") * F.lit(HOUR_US)) / HOUR_US)
    seen_us = F.when(F.col("__o") == 1, F.col("__u"))
    both = asked.unionByName(known, allowMissingColumns=True)
    summed = both.select(
        *keys, "__o", "__p", "__cell", _moments(x, seen_us, outputs, up).alias("__before"), _moments(x, seen_us, outputs, down).alias("__after")
    ).where(F.col("__o") == 0)
    shift = (F.col("__cell") * F.lit(HOUR_US) - F.col("__p.__end")) / HOUR_US
    cells = summed.select(
        *keys, F.col("__p.sample").alias(SAMPLE), "__p.__end", "__p.__steps", "__p.window_hours",
        _centred(F.col("__before"), outputs, shift).alias("__before"), _centred(F.col("__after"), outputs, shift).alias("__after"),
    )
    # the cutoff's own cell ends at the cutoff; all other cells are passed whole
    first = F.col("window_hours") == 0
    back = Window.partitionBy(*keys, col(SAMPLE)).orderBy("window_hours")
    passed = back.rowsBetween(Window.unboundedPreceding, -1)
    anywhere = back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = F.col("__before"), F.col("__after")

    def added(of) -> Column:
        """A sum over the cells passed, and over the window's own part of its last cell."""
        return F.coalesce(F.sum(of(before) + F.when(first, F.lit(0.0)).otherwise(of(after))).over(passed), F.lit(0.0)) + of(after)

    def extreme(pick, over, name: str) -> Column:
        inner = F.when(first, before[name]).otherwise(pick(before[name], after[name]))
        return pick(over(inner).over(passed), after[name])

    # outputs are measured from a value of the sample, which keeps the digits that raw sums would lose
    mean = lambda i: F.when(before["n"] > 0, before["y"][i]).when(~first & (after["n"] > 0), after["y"][i])
    rows = cells.withColumns({f"__ref{i}": F.coalesce(F.first(mean(i), True).over(anywhere), F.lit(0.0)) for i in range(len(outputs))})
    sums = {
        "__n": added(lambda m: m["n"]), "__x": added(lambda m: m["n"] * m["x"]), "__xx": added(lambda m: m["xx"] + m["n"] * m["x"] * m["x"]),
        "__lo": extreme(F.least, F.min, "lo"), "__hi": extreme(F.greatest, F.max, "hi"),
    }
    for i in range(len(outputs)):
        off = lambda m, i=i: m["y"][i] - F.col(f"__ref{i}")
        sums[f"__y{i}"] = added(lambda m, off=off: m["n"] * off(m))
        sums[f"__xy{i}"] = added(lambda m, i=i, off=off: m["xy"][i] + m["n"] * m["x"] * off(m))
    rows = rows.withColumns(sums).where(F.col("window_hours").isin([int(w) for w in windows]))
    n, mean_x = F.col("__n"), _ratio(F.col("__x"), F.col("__n"))

    def pred(s, i):
        y = _ratio(F.col(f"__y{i}"), n)
        slope = _ratio(F.col(f"__xy{i}") - F.col("__x") * y, F.col("__xx") - F.col("__x") * mean_x)
        slope = F.when(F.col("__hi") > F.col("__lo"), slope).otherwise(F.lit(0.0))
        return F.when(n > 0, F.col(f"__ref{i}") + y + slope * ((s["us"] - F.col("__end")) / HOUR_US - mean_x))

    return _long(rows, axis, outputs, pred, ["window_hours"])


# --- seasonal --------------------------------------------------------------------------------

# Day distances of the nearest and of the wider season, in days.
NEAR_DAYS, WIDE_DAYS = 4, 15
_SUMS = ("n", "nn", "s")


def values_long(
    history: DataFrame, axis: Axis, outputs: Sequence[str], secondary: DataFrame | None = None
) -> DataFrame:
    """Long history ``(keys…, time, param, value)``; a column of the secondary table has priority."""
    parts = []
    for source, names in (
        (secondary, [o for o in outputs if secondary is not None and o in secondary.columns]),
        (history, [o for o in outputs if (secondary is None or o not in secondary.columns) and o in history.columns]),
    ):
        if names:
            ids = [*axis.key_cols, col(axis.time)]
            wide = source.select(*ids, *[col(o).cast("double").alias(o) for o in names])
            parts.append(wide.unpivot(ids, [col(o) for o in names], "param", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _minute(time: Column) -> Column:
    return F.hour(time) * 60 + F.minute(time)


def _sum_all(names: Sequence[str] = _SUMS) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def _zeros(names: Sequence[str] = _SUMS) -> list[Column]:
    return [(F.lit(0.0) if n.startswith("s") else F.lit(0).cast("bigint")).alias(n) for n in names]


def _place(day: Column) -> Column:
    """Place of a day of the year (1..366) on a circle of 365, where day 366 falls on day 1."""
    return F.pmod(day - 1, F.lit(365))


def _sums_over(window, names: Sequence[str], suffix: str) -> dict[str, Column]:
    return {f"{n}{suffix}": F.sum(n).over(window) for n in names}


def _season_means(cells: DataFrame, asks: DataFrame, axis: Axis, diurnal_hours: float) -> DataFrame:
    """Mean for each asked (keys, param, year, day, minute) over the first season tier with rows.

    ``cells`` is history summed per (keys, param, year, day, minute): rows ``n``, values ``nn``, sum
    ``s``.  A tier's sum over the other years is its sum over all years (year 0 below) less that of the
    asked year; counts are whole numbers, so an empty tier is exactly empty.

    Two range windows follow each other: over days for each minute, then over minutes for each asked
    day.  The year is a circle: its first and last days are repeated beyond the other end, the only
    copies made.  Rows of zeros give each asked day a place for every minute in use.  Sizes are bounded
    by the calendar, not by the data.
    """
    by = [*axis.keys, "param"]
    at = [col(b) for b in by]
    minutes = int(diurnal_hours * 60)
    years = F.explode(F.array(F.col("year"), F.lit(0)))
    sums = cells.select(*at, years.alias("year"), _place(F.col("doy")).alias("p"), "minute", *_SUMS)
    both = asks.select(*at, F.col("year").alias("ask"), years.alias("year"), _place(F.col("day")).alias("p"), "minute").distinct()
    in_use = cells.groupBy(*at).agg(F.collect_set("minute").alias("__minutes"))
    grid = join_keys(both.select(*at, "year", "p").distinct(), in_use, by).select(
        *at, "year", "p", F.explode("__minutes").alias("minute"), *_zeros()
    )
    spot = [*at, F.col("year"), F.col("p"), F.col("minute")]
    table = sums.unionByName(grid).groupBy(*spot).agg(*_sum_all())

    turn = F.when(F.col("p") < WIDE_DAYS, F.array(F.lit(0), F.lit(365))).when(
        F.col("p") >= 365 - WIDE_DAYS, F.array(F.lit(0), F.lit(-365))
    ).otherwise(F.array(F.lit(0)))
    circle = table.withColumn("__turn", F.explode(turn)).withColumn("__at", F.col("p") + F.col("__turn"))
    days = Window.partitionBy(*at, "year", "minute").orderBy("__at")
    near = _sums_over(days.rangeBetween(-NEAR_DAYS, NEAR_DAYS), _SUMS, "_near")
    wide = _sums_over(days.rangeBetween(-WIDE_DAYS, WIDE_DAYS), _SUMS, "_wide")
    by_minute = circle.withColumns({**near, **wide}).where("__turn = 0").select(*spot, *near, *wide)

    day = Window.partitionBy(*at, "year", "p")
    around = day.orderBy("minute").rangeBetween(-minutes, minutes)
    marked = both.unionByName(by_minute, allowMissingColumns=True)
    tiers = {
        **{f"__t0{n}": F.sum(f"{n}_near").over(around) for n in _SUMS},
        **{f"__t1{n}": F.sum(f"{n}_near").over(day) for n in _SUMS},
        **{f"__t2{n}": F.sum(f"{n}_wide").over(day) for n in _SUMS},
    }
    # an asked place has its own row; the place of all years is asked once for each year
    found = marked.withColumns(tiers).where("ask is not null")
    sign = F.when(F.col("year") == 0, 1).otherwise(-1)
    other = found.groupBy(*at, F.col("ask").alias("year"), "p", "minute").agg(
        *[F.sum(sign * F.coalesce(F.col(t), F.lit(0))).alias(t) for t in tiers]
    )
    # the last tier: everything of the other years
    whole = cells.groupBy(*at, "year").agg(*_sum_all()).groupBy(*at).agg(
        *[F.sum(n).alias(f"__all_{n}") for n in _SUMS],
        F.map_from_entries(F.collect_list(F.struct("year", F.struct(*_SUMS)))).alias("__by_year"),
    )
    own = F.try_element_at("__by_year", F.col("year"))
    joined = join_keys(other, whole, by, "left")
    joined = joined.withColumns({f"__t3{n}": F.coalesce(F.col(f"__all_{n}"), F.lit(0)) - F.coalesce(own[n], F.lit(0)) for n in _SUMS})

    def mean(t: int) -> Column:
        return F.try_divide(f"__t{t}s", F.nullif(F.col(f"__t{t}nn"), F.lit(0)))

    first = F.when(F.col("__t0n") > 0, mean(0)).when(F.col("__t1n") > 0, mean(1)).when(F.col("__t2n") > 0, mean(2)).otherwise(mean(3))
    return joined.select(*at, "year", "p", "minute", first.alias("pred"))


def _cells(values: DataFrame, axis: Axis) -> DataFrame:
    t = col(axis.time)
    value = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    return values.where(t.isNotNull()).groupBy(
        *axis.key_cols, "param", F.year(t).alias("year"), F.dayofyear(t).alias("doy"), _minute(t).alias("minute")
    ).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("nn"), F.coalesce(F.sum(value), F.lit(0.0)).alias("s"))


def seasonal_forecast(
    targets: DataFrame,
    history: DataFrame,
    axis: Axis,
    outputs: Sequence[str],
    *,
    diurnal_hours: float = 2,
    secondary: DataFrame | None = None,
) -> DataFrame:
    """Mean of other years at the same season: day within 4 and hour within ``diurnal_hours``, else
    day within 4, else day within 15, else everything. The first tier with rows counts, even if
    its values are all null. Day distance is circular, hour distance is not."""
    t = col(axis.time)
    ids = [*axis.key_cols, col(SAMPLE), col(STEP), t]
    wanted = (
        targets.select(*ids, *[col(o).cast("double").alias(o) for o in outputs])
        .unpivot(ids, [col(o) for o in outputs], "param", "target")
        .select(
            *axis.key_cols, col(SAMPLE), col(STEP), "param", "target",
            F.year(t).alias("year"), F.dayofyear(t).alias("day"), _minute(t).alias("minute"), _place(F.dayofyear(t)).alias("p"),
        )
    )
    asks = wanted.select(*axis.key_cols, "param", "year", "day", "minute")
    means = _season_means(_cells(values_long(history, axis, outputs, secondary), axis), asks, axis, diurnal_hours)
    return join_keys(wanted, means, [*axis.keys, "param", "year", "p", "minute"], "left").select(
        *axis.key_cols, col(SAMPLE), col(STEP), "param", "pred", "target"
    )


def season_curve(
    history: DataFrame,
    axis: Axis,
    outputs: Sequence[str],
    *,
    diurnal_hours: float = 2,
    secondary: DataFrame | None = None,
) -> DataFrame:
    """The seasonal mean over all years for each of 24 x 366 hours of the year after the history.

    Returns ``(keys…, param, hour_no, doy, hour, value)``.
    """
    values = values_long(history, axis, outputs, secondary)
    cells = _cells(values, axis)
    by = [*axis.key_cols, F.col("param")]
    last_year = history.groupBy(*axis.key_cols).agg(F.max(F.year(col(axis.time))).alias("__y"))
    start = F.make_timestamp(F.col("__y") + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    hours = last_year.select(
        *axis.key_cols, F.explode(F.sequence(F.lit(0), F.lit(24 * 366 - 1))).alias("hour_no"), start.alias("__from")
    )
    at = F.timestamp_micros(F.unix_micros("__from") + F.col("hour_no") * F.lit(HOUR_US))
    curve = hours.select(
        *axis.key_cols, "hour_no", F.explode(F.array(*[F.lit(o) for o in outputs])).alias("param"),
        F.dayofyear(at).alias("day"), (F.hour(at) * 60).alias("minute"),
    )
    # a year before all history: no year is left out
    asks = curve.select(*by, F.lit(-1).alias("year"), "day", "minute")
    means = _season_means(cells, asks, axis, diurnal_hours).drop("year")
    curve = curve.withColumn("p", _place(F.col("day")))
    return join_keys(curve, means, [*axis.keys, "param", "p", "minute"], "left").select(
        *by, "hour_no", F.col("day").alias("doy"), (F.col("minute") / 60).cast("int").alias("hour"), F.col("pred").alias("value")
    )


def fill_curve(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Straight lines across missing hours, nearest value at the ends. A curve has 8,784 rows."""
    by = [*[col(k) for k in keys], F.col("param")]
    up = Window.partitionBy(*by).orderBy("hour_no").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy(F.col("hour_no").desc()).rowsBetween(Window.unboundedPreceding, 0)
    here = F.when(F.col("value").isNotNull(), F.struct("hour_no", "value"))
    p, q = F.col("__p"), F.col("__q")
    line = p["value"] + (q["value"] - p["value"]) / (q["hour_no"] - p["hour_no"]) * (F.col("hour_no") - p["hour_no"])
    filled = F.coalesce(F.col("value"), F.when(p.isNotNull() & q.isNotNull(), line), p["value"], q["value"])
    return (
        curve.withColumn("__p", F.last(here, True).over(up))
        .withColumn("__q", F.last(here, True).over(down))
        .withColumn("value", filled)
        .drop("__p", "__q")
    )
