"""The end-to-end flows: combine sources, cut samples, evaluate forecasts.

A flow is one lazy plan; the caller writes its result and the next flow reads that table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import col, keep_within, round_hour
from gaugeline.operators import combine, forecast, gaps, metrics, samples, scaling
from gaugeline.operators.ordered import LAYOUT, Axis, laid_out
from gaugeline.operators.rolling import rolling_sum
from gaugeline.plans import site
from gaugeline.sources.tables import Store, as_is


def clean_weather(weather: DataFrame, axis: Axis, *, round_to_hour: bool = False) -> DataFrame:
    """Station columns to the nine used: range rules, wind components, 24 h precipitation."""
    df = combine.rename(weather, {**site.WEATHER_NAMES, "Time": axis.time})
    wanted = [n for n in site.WEATHER_NAMES.values() if n in df.columns]
    df = combine.select(df, [*axis.keys, axis.time, *wanted])
    if round_to_hour:
        df = df.withColumn(axis.time, round_hour(col(axis.time)))
    low, high = (F.lit(t).cast("timestamp") for t in site.WEATHER_TIME_RANGE)
    df = df.withColumn(axis.time, keep_within(col(axis.time), low, high))
    df = combine.clean_ranges(df, site.WEATHER_BOUNDS, floored=["Shortwave (solar) radiation (W/m2)"])
    df = combine.decompose_direction(df, "Hourly average wind direction (°)", "Average wind speed (m/s)")
    df = rolling_sum(df, axis, "Precipitation (mm/hr)", 24)
    df = combine.rename(
        df,
        {
            "Hourly average wind direction (°)_x": "Wind speed, x (m/s)",
            "Hourly average wind direction (°)_y": "Wind speed, y (m/s)",
            "rolling Precipitation (mm/hr)": "24hr precipitation total (mm)",
        },
    )
    return combine.select(df, [*axis.keys, axis.time, *site.WEATHER_COLUMNS])


def clean_site_profiler(raw: DataFrame, axis: Axis, max_gap: int = 6, store: Store = as_is) -> DataFrame:
    df = raw if axis.time in raw.columns else raw.withColumnRenamed("TIMESTAMP", axis.time)
    return combine.clean_profiler(
        df, axis, names=site.PROFILER_NAMES, sensors=site.PROFILER_SENSORS, bounds=site.PROFILER_BOUNDS, max_gap=max_gap,
        store=store,
    )


def combine_dense(
    profiler: DataFrame,
    sources: Sequence[tuple[DataFrame, Mapping]],
    axis: Axis,
    store: Store = as_is,
) -> DataFrame:
    """Join the cleaned primary series with further sources and number the segments.

    Each source comes with the options of ``add_source`` and has unique times.  All sources are joined first;
    a row that a later step drops or fills has its columns already.  The joined table is laid out by series
    and time bucket, and the steps follow one another within that layout: with ``store`` from
    ``sources.tables.bucketed`` (by ``LAYOUT``), every source is shuffled once, the joined table once, and no
    row moves after that.
    """
    df, steps = profiler, []
    for source, options in sources:
        known = {"source_time", "round_to_hour", "limits"}
        df, new = combine.join_source(df, source, axis, **{k: v for k, v in options.items() if k in known})
        if not (options.get("sparse") or options.get("include_missing")):
            steps.append((new, {k: v for k, v in options.items() if k in ("max_gap", "basis")}))
    df = store(laid_out(df, axis))
    for new, options in steps:
        df = store(combine.fill_joined(df, axis, new, store=store, **options))
    return gaps.metadata_first(gaps.segments(df, axis).drop(LAYOUT))


def combine_sparse(
    sources: Sequence[tuple[DataFrame, Mapping[str, float] | DataFrame | None]], axis: Axis
) -> DataFrame:
    """All sources on one continuous hourly spine; nothing is dropped or filled.

    Times are rounded to the hour, and of readings in one hour the earliest stays, since a spine needs unique
    times.  A source may come with limits, which turn it into 0/1 flags.
    """
    rounded, ties, taken = [], [], []
    for source, _ in sources:
        rest = [c for c in source.columns if c not in (axis.time, *axis.keys)]
        if twice := [c for c in rest if c in taken]:
            raise ValueError(f"column(s) in more than one table: {', '.join(twice)}")
        taken += rest
        rounded.append(source.withColumn("__raw", col(axis.time)).withColumn(axis.time, round_hour(col(axis.time))))
        ties.append(["__raw", *rest])
    df = gaps.align_all(rounded, axis, ties, taken)
    for tie, (_, limits) in zip(ties, sources):
        df = combine.numbers_or_flags(df, tie[1:], limits)
    return df


def site_values(combined: DataFrame, axis: Axis, wanted: Sequence[str] = tuple(site.COLUMN_GROUPS)) -> DataFrame:
    """Long view of the site's columns by group, for display: ``(keys…, time, param, value)``."""
    unknown = [g for g in wanted if g not in site.COLUMN_GROUPS]
    if unknown:
        raise ValueError(f"no column group: {', '.join(unknown)}")
    return combine.observed_values(combined, axis.time, site.COLUMN_GROUPS, wanted, axis.keys)


def cut_tolerant(
    combined: DataFrame,
    axis: Axis,
    targets: Sequence[str],
    predictors: Sequence[str],
    length: int,
    tolerance: float,
    to_scale: Sequence[str] = (),
    params: DataFrame | None = None,
    store: Store = as_is,
) -> DataFrame:
    """Scaled, expanded fault-tolerant samples ``(sample_id, step, columns…)``.  Rows are numbered once;
    ``store`` keeps them for the search of ends and for the expansion."""
    numbered = store(samples.number_rows(scaling.scale(combined, to_scale, params), axis))
    ends = samples.tolerant_samples(numbered, axis, targets, predictors, length, tolerance)
    return samples.expand(store(ends), numbered, axis.keys, length)


def cut_strict(
    combined: DataFrame,
    axis: Axis,
    targets: Sequence[str],
    length: int,
    to_scale: Sequence[str] = (),
    params: DataFrame | None = None,
    store: Store = as_is,
) -> DataFrame:
    """Scaled, expanded samples without gaps before the last row."""
    numbered = store(samples.number_rows(scaling.scale(combined, to_scale, params), axis))
    ends = samples.strict_samples(numbered, axis, targets, length)
    return samples.expand(ends, numbered, axis.keys, length - 1)


def baselines(
    targets: DataFrame,
    history: DataFrame,
    axis: Axis,
    outputs: Sequence[str],
    *,
    gap_hours: float = 1,
    window_hours: float = 550,
    diurnal_hours: float = 2,
    secondary: DataFrame | None = None,
) -> DataFrame:
    """Naive, linear and seasonal forecasts, in one long table with ``model``."""
    made = {
        "Naive": forecast.naive_forecast(targets, history, axis, outputs, gap_hours),
        "Linear": forecast.linear_forecast(targets, history, axis, outputs, window_hours, gap_hours),
        "Seasonal": forecast.seasonal_forecast(
            targets, history, axis, outputs, diurnal_hours=diurnal_hours, secondary=secondary
        ),
    }
    out = None
    for name, df in made.items():
        df = df.withColumn("model", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def compare_models(
    preds: DataFrame,
    limits: Mapping[str, float] | DataFrame,
    params: DataFrame | None = None,
    *,
    num_samples: int | None = None,
    order: Sequence[str] = ("sample_id",),
) -> DataFrame:
    """Regression scores of the predictions as they are, and class scores after undoing the scaling
    and comparing with the limits; one row per model. Store the predictions first: each group of
    scores reads them again.

    All samples count; ``num_samples`` restricts both halves to the same first samples."""
    first = metrics.first_samples(preds, num_samples, order)
    regression = metrics.regression_metrics(first)
    original = first if params is None else scaling.unscale(first, params, ["pred", "target"])
    values = metrics.binarize_predictions(original, limits)
    classes = metrics.classification_metrics(values)
    areas = metrics.roc_auc(values).join(metrics.pr_auc(values), "model")
    return regression.join(classes, "model", "left").join(areas, "model", "left")
