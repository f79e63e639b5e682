"""Hand-written frames for the corner cases."""

import datetime as dt
import time
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline import functions as fn
from gaugeline.operators import calibration, combine, forecast, gaps, metrics, samples, scaling
from gaugeline.operators.ordered import Axis, last_before
from gaugeline.operators.rolling import rolling_sum
from gaugeline.plans import flows, site
from gaugeline.sources import delimited, logs, params

T0 = dt.datetime(2024, 1, 1)
AX = Axis(time="ts", bucket_hours=5)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def series(spark, values, hours=None, name="v"):
    hours = range(len(values)) if hours is None else hours
    return spark.createDataFrame([(at(h), v) for h, v in zip(hours, values)], f"ts timestamp, {name} double")


def listed(df, *cols):
    rows = df.orderBy("ts").select(*cols).collect()
    return [r[0] if len(cols) == 1 else tuple(r) for r in rows]


# --- time ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "given, rounded",
    [
        ("2024-01-01 00:30:00", "2024-01-01 00:00:00"),
        ("2024-01-01 01:30:00", "2024-01-01 02:00:00"),
        ("2024-01-01 01:29:59.999999", "2024-01-01 01:00:00"),
        ("2024-01-01 01:30:00.000001", "2024-01-01 02:00:00"),
        ("1969-12-31 22:30:00", "1969-12-31 22:00:00"),
        ("1969-12-31 23:30:00", "1970-01-01 00:00:00"),
    ],
)
def test_round_hour(spark, given, rounded):
    got = spark.range(1).select(fn.round_hour(F.lit(given).cast("timestamp")).cast("string")).first()[0]
    assert got == rounded


def test_places_on_the_circle_keep_day_distances(spark):
    place = {r.id: r.p for r in spark.range(1, 367).select("id", forecast._place(F.col("id")).alias("p")).collect()}
    for a in place:
        for b in place:
            gap = abs(place[a] - place[b])
            assert min(gap, 365 - gap) == min(abs(a - b), 365 - abs(a - b))


# --- values ----------------------------------------------------------------------------------


def test_missing_values_stay_missing_under_rules(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (None,), (-9999.0,), (30.0,)], "v double")
    got = [r[0] for r in combine.clean_ranges(df, {"v": (0, 25)}, sentinels=[-9999.0]).collect()]
    assert got == [1.0, None, None, None, None]


def test_to_numbers_takes_only_numbers(spark):
    texts = ["1.5", " 2 ", "", "  ", "NA", "#N/A", "3 NA", "1,5", "1d", "4e2", "abc", "-.5", "inf", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r[0] for r in combine.to_numbers(df, ["v"]).collect()]
    assert got == [1.5, 2.0, None, None, None, None, None, None, None, 400.0, None, -0.5, math.inf, None]


def test_value_at_its_limit_is_no_exceedance(spark):
    df = spark.createDataFrame([(50.0, 1.0), (50.1, None), (None, None), (1.0, 3.0)], "`a.x` double, b double")
    got = [tuple(r) for r in combine.binarize(df, ["a.x", "b"], {"a.x": 50, "b": 2}).collect()]
    assert got == [(0, 0, 0), (1, None, 1), (None, None, None), (0, 1, 1)]
    with pytest.raises(ValueError):
        combine.binarize(df, ["a.x", "b"], {"b": 2})


def test_missing_prediction_counts_as_zero(spark):
    df = spark.createDataFrame([("m", "a", None, 3.0), ("m", "a", math.nan, None)], "model string, param string, pred double, target double")
    got = [tuple(r)[2:] for r in metrics.binarize_predictions(df, {"a": 2.0}).collect()]
    assert got == [(0, 1), (0, 0)]


def test_missing_limit_is_an_error(spark):
    df = spark.createDataFrame([("m", "a", 1.0, 3.0), ("m", "b", 1.0, 3.0)], "model string, param string, pred double, target double")
    limits = spark.createDataFrame([("a", 2.0)], "param string, limit double")
    for given in ({"a": 2.0}, limits, limits.union(spark.createDataFrame([("b", None)], limits.schema))):
        assert metrics.binarize_predictions(df.where("param = 'a'"), given).count() == 1
        with pytest.raises(Exception, match="no limit for column: b"):
            metrics.binarize_predictions(df, given).collect()
    with pytest.raises(ValueError):
        metrics.binarize_predictions(df, {"a": 2.0}, ["a", "b"])


def test_constant_column_scales_to_the_midpoint(spark):
    df = spark.createDataFrame([(1.0, 7.0, None), (3.0, None, None), (2.0, 7.0, None)], "a double, c double, n double")
    got = [tuple(r) for r in scaling.scale(df, ["a", "c", "n", "zz"]).collect()]
    assert got == [(0.0, 0.5, None), (1.0, 0.5, None), (0.5, 0.5, None)]


def test_scaling_round_trip(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 5.0), ("b", 5.0)], "param string, pred double")
    p = spark.createDataFrame([("a", 1.0, 4.0), ("b", 5.0, 5.0)], params.PARAM_SCHEMA)
    wide = spark.createDataFrame([(1.0,), (4.0,), (2.5,)], "a double")
    scaled = scaling.scale(wide, ["a"], p).select(F.lit("a").alias("param"), F.col("a").alias("pred"))
    back = [r.pred for r in scaling.unscale(scaled, p, ["pred"]).collect()]
    assert back == [1.0, 4.0, 2.5]
    assert {r.pred for r in scaling.unscale(df.where("param = 'b'"), p, ["pred"]).collect()} == {5.0}


def test_decompose_replaces_in_place(spark):
    df = spark.createDataFrame([(1, 90.0, 2.0)], "id int, dir double, speed double")
    got = combine.decompose_direction(df, "dir", "speed")
    assert got.columns == ["id", "dir_x", "dir_y", "speed"]
    assert got.first().dir_y == pytest.approx(2.0)


# --- gaps ------------------------------------------------------------------------------------


def test_limited_fill_reaches_six_from_both_sides(spark):
    values = [1.0] + [None] * 20 + [22.0]
    got = listed(gaps.interpolate(series(spark, values), AX, ["v"], limit=6, direction="both"), "v")
    assert [v is None for v in got] == [False] * 7 + [True] * 8 + [False] * 7
    assert got[1] == pytest.approx(2.0) and got[20] == pytest.approx(21.0)
    short = [1.0] + [None] * 10 + [12.0]
    got = listed(gaps.interpolate(series(spark, short), AX, ["v"], limit=6, direction="both"), "v")
    assert got == pytest.approx([float(i) for i in range(1, 13)])


def test_open_ends(spark):
    values = [None, None, 5.0, None, 7.0, None, None]
    forward = listed(gaps.interpolate(series(spark, values), AX, ["v"]), "v")
    assert forward == [None, None, 5.0, 6.0, 7.0, 7.0, 7.0]
    both = listed(gaps.interpolate(series(spark, values), AX, ["v"], limit=1, direction="both"), "v")
    assert both == [None, 5.0, 5.0, 6.0, 7.0, 7.0, None]


def test_basis_of_interpolation(spark):
    df = series(spark, [0.0, None, 10.0], hours=[0, 1, 10])
    assert listed(gaps.interpolate(df, AX, ["v"]), "v") == [0.0, 5.0, 10.0]
    assert listed(gaps.interpolate(df, AX, ["v"], basis="time"), "v") == pytest.approx([0.0, 1.0, 10.0])


def test_step_of_six_hours_is_filled_and_of_seven_is_not(spark):
    df = series(spark, [0.0, 6.0, 13.0], hours=[0, 6, 13])
    got = listed(gaps.fill_small_gaps(df, AX, ["v"], max_gap=6), "ts", "v", "Interpolated")
    assert [(r[1], r[2]) for r in got] == [(0.0, 0), (1.0, 1), (2.0, 1), (3.0, 1), (4.0, 1), (5.0, 1), (6.0, 0), (13.0, 0)]


def test_fill_rounds_half_to_even(spark):
    df = series(spark, [0.125, 0.375], hours=[0, 1])
    assert listed(gaps.fill_small_gaps(df, AX, ["v"]), "v") == [0.12, 0.38]


def test_long_runs_are_dropped_also_at_the_end(spark):
    values = [None, 1.0, None, None, 2.0, None, None, None]
    got = listed(gaps.drop_long_gaps(series(spark, values), AX, ["v"], max_gap=2), "v")
    assert got == [None, 1.0, None, None, 2.0]


def test_segments_and_positions(spark):
    df = series(spark, [0.0] * 6, hours=[0, 1, 3, 4, 5, 20])
    got = listed(gaps.segments(df, AX, row="rn", position="pos", previous_position="prev"), "Segment", "rn", "pos", "prev")
    assert got == [(1, 1, 1, None), (1, 2, 2, 1), (2, 3, 1, 2), (2, 4, 2, 1), (2, 5, 3, 2), (3, 6, 1, 3)]


def test_duplicates_and_spine(spark):
    rows = [(at(0), 2, 1.0), (at(0), 1, 9.0), (at(3), 3, 4.0)]
    df = spark.createDataFrame(rows, "ts timestamp, id int, v double")
    assert gaps.duplicate_times(df, AX).collect()[0].n == 2
    one = gaps.dedup_time(df, AX, ["id"])
    assert listed(one, "id", "v") == [(1, 9.0), (3, 4.0)]
    ties = spark.createDataFrame([(at(0), None), (at(0), 5.0), (at(0), 7.0), (at(1), None)], "ts timestamp, v double")
    assert listed(gaps.dedup_time(ties, AX, ["v"]), "v") == [5.0, None]
    whole = gaps.align(gaps.hourly_spine([one], AX), one, AX)
    assert listed(whole, "v") == [9.0, None, None, 4.0]


def test_rolling_sum_includes_both_ends_and_skips_missing(spark):
    df = series(spark, [1.0] * 30)
    got = listed(rolling_sum(df, AX, "v", 24), "rolling v")
    assert got[23] == 24.0 and got[24] == 25.0 and got[29] == 25.0
    rows = [(at(0), None), (None, 5.0), (at(1), 2.0), (None, None)]
    odd = spark.createDataFrame(rows, "ts timestamp, v double")
    got = {(r.ts, r.v): r["rolling v"] for r in rolling_sum(odd, AX, "v", 24).collect()}
    assert got == {(at(0), None): 0.0, (None, 5.0): 0.0, (at(1), 2.0): 2.0, (None, None): 0.0}


def test_add_source_keeps_all_with_missing_included(spark):
    base = series(spark, [1.0] * 5)
    lab = spark.createDataFrame([(at(1), "NA", "3"), (at(3), "2,0", " 7 ")], "Time timestamp, `06-E.coli` string, x string")
    got = combine.add_source(base, lab, AX, include_missing=True)
    assert got.columns == ["ts", "v", "06-E.coli", "x"]
    assert listed(got, "x") == [None, 3.0, None, 7.0, None]
    assert listed(got, "`06-E.coli`") == [None] * 5


def test_same_named_columns_are_an_error(spark):
    base = series(spark, [1.0] * 3)
    source = spark.createDataFrame([(at(1), "3", "4")], "Time timestamp, v string, x string")
    with pytest.raises(ValueError, match="v"):
        combine.add_source(base, source, AX)


def test_null_keys_are_a_series(spark):
    rows = [(k, at(h), float(h)) for k in ("a", None) for h in range(4) if h != 2]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    axis = Axis(time="ts", keys=("k",), parts=3)
    assert gaps.fill_small_gaps(df, axis, ["v"]).where("k is null").count() == 4
    spine = gaps.hourly_spine([df], axis)
    assert gaps.align(spine, df, axis).where("k is null and v is not null").count() == 3
    wanted = df.withColumn("sample_id", F.concat_ws("-", "k", "ts")).withColumn("step", F.lit(0))
    preds = forecast.linear_forecast(wanted, df, Axis(time="ts", keys=("k",), bucket_hours=2), ["v"], 6, 1)
    by = {(r.k, r.sample_id[-19:]): r.pred for r in preds.collect()}
    assert all(by["a", t] == by[None, t] for k, t in by)
    sums = rolling_sum(df, Axis(time="ts", keys=("k",)), "v", 24).where("k is null").orderBy("ts")
    assert [r["rolling v"] for r in sums.collect()] == [0.0, 1.0, 4.0]


# --- as-of -----------------------------------------------------------------------------------


def test_as_of_excludes_or_includes_the_same_time(spark):
    history = series(spark, [1.0, 2.0, 3.0], hours=[0, 10, 20])
    points = spark.createDataFrame([(1, at(10)), (2, at(0)), (3, at(99)), (4, None)], "id int, c timestamp")
    strict = {r.id: r.hit and r.hit.v for r in last_before(points, history, AX, point_time="c", values=["v"]).collect()}
    assert strict == {1: 1.0, 2: None, 3: 3.0, 4: None}
    incl = last_before(points, history, AX, point_time="c", values=["v"], inclusive=True)
    assert {r.id: r.hit and r.hit.v for r in incl.collect()} == {1: 2.0, 2: 1.0, 3: 3.0, 4: None}


def targets(spark, hours, values=None):
    values = values or [0.0] * len(hours)
    return spark.createDataFrame(
        [(f"s{i}", 0, at(h), v) for i, (h, v) in enumerate(zip(hours, values))], "sample_id string, step int, ts timestamp, v double"
    )


def test_naive_forecast_needs_a_complete_row(spark):
    history = spark.createDataFrame([(at(0), 1.0, 1.0), (at(1), 2.0, None), (at(5), 9.0, 9.0)], "ts timestamp, v double, w double")
    wanted = targets(spark, [10]).withColumn("w", F.lit(0.0))
    got = {r.param: r.pred for r in forecast.naive_forecast(wanted, history, AX, ["v", "w"], 5).collect()}
    assert got == {"v": 1.0, "w": 1.0}


def test_linear_forecast_with_few_points(spark):
    history = series(spark, [4.0, 1.0, 2.0, 3.0], hours=[0, 100, 101, 102])
    wanted = targets(spark, [8, 106, 50, 107])
    got = {r.sample_id: r.pred for r in forecast.linear_forecast(wanted, history, AX, ["v"], 12, 3).collect()}
    assert got["s0"] == 4.0  # one point
    assert got["s1"] == pytest.approx(7.0)  # a line
    assert got["s2"] is None  # empty window
    assert got["s3"] == pytest.approx(8.0)


def test_linear_forecast_of_several_steps(spark):
    history = series(spark, [float(h) for h in range(20)])
    steps = [("a", 0, at(25), 25.0), ("a", 1, at(26), 26.0)]
    wanted = spark.createDataFrame(steps, "sample_id string, step int, ts timestamp, v double")
    got = {r.step: r.pred for r in forecast.linear_forecast(wanted, history, AX, ["v"], 9.5, 8).collect()}
    assert got == pytest.approx({0: 25.0, 1: 26.0})


def test_season_tiers(spark):
    def on(year, month, day, hour, v):
        return (dt.datetime(year, month, day, hour), v)

    history = spark.createDataFrame(
        [on(2020, 3, 1, 10, 1.0), on(2020, 3, 3, 22, 5.0), on(2020, 3, 12, 0, 9.0), on(2020, 7, 1, 5, None), on(2020, 9, 1, 0, 50.0), on(2021, 3, 1, 10, 77.0)],
        "ts timestamp, v double",
    )
    rows = [("near", 2021, 3, 2, 11), ("days", 2021, 3, 7, 10), ("wide", 2021, 3, 20, 0), ("all", 2021, 12, 1, 0), ("null", 2021, 7, 1, 5)]
    wanted = spark.createDataFrame([(n, 0, dt.datetime(y, m, d, h), 0.0) for n, y, m, d, h in rows], "sample_id string, step int, ts timestamp, v double")
    got = {r.sample_id: r.pred for r in forecast.seasonal_forecast(wanted, history, Axis(), ["v"]).collect()}
    # 2020 is a leap year: March 1 is day 61 there and day 60 in 2021
    assert got["near"] == 1.0
    assert got["days"] == 5.0
    assert got["wide"] == 9.0
    assert got["all"] == pytest.approx((1 + 5 + 9 + 50) / 4)
    assert got["null"] is None  # the nearest tier has rows, all without a value


# --- samples ---------------------------------------------------------------------------------


def test_strict_sample_may_end_in_a_new_segment(spark):
    df = series(spark, [0.0] * 7, hours=[0, 1, 2, 9, 10, 11, 12])
    ends = samples.strict_samples(samples.number_rows(df, AX), AX, ["v"], 3)
    assert sorted((r.sample_id, r.end_rn) for r in ends.collect()) == [
        ("segment_1", 3), ("segment_2", 4), ("segment_3", 6), ("segment_4", 7)
    ]
    assert samples.strict_samples(samples.number_rows(df, AX), AX, ["v"], 1).count() == 0


def test_valid_rows_ignore_the_first_row(spark):
    df = spark.createDataFrame(
        [(at(i), 1.0, p) for i, p in enumerate([1.0, None, None, 2.0, None])], "ts timestamp, t double, p double"
    )
    got = samples.valid_rows(df, AX, ["t"], ["p"], 2, 0.5)
    assert sorted((r.rn, r.missing) for r in got.collect()) == [(2, 0.0), (3, 0.5), (5, 0.5)]
    with pytest.raises(ValueError):
        samples.valid_rows(df, AX, ["t"], ["p"], 2, 90)


def test_load_samples_skips_short_and_incomplete(spark):
    rows = [("a", i, float(i), 1.0) for i in range(3)] + [("b", 0, 0.0, 1.0)]
    rows += [("c", 0, None, 1.0), ("c", 1, 1.0, 1.0), ("c", 2, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "sample_id string, step int, x double, y double")
    strict = {r.sample_id: (r.features, r.target) for r in samples.load_samples(df, ["x"], ["y"], input_rows=(0, 2)).collect()}
    assert strict == {"a": ([0.0, 1.0], [1.0])}
    loose = {r.sample_id: (r.features, r.target) for r in samples.load_samples(df, ["x"], ["y"], input_rows=(0, 2), fault_tolerant=True).collect()}
    assert loose == {"a": ([0.0, 1.0], [1.0]), "c": ([None, 1.0], [5.0])}
    names = spark.createDataFrame([("c",)], "sample_id string")
    assert samples.load_samples(df, ["x"], ["y"], input_rows=(0, 2), names=names, fault_tolerant=True).count() == 1


@pytest.mark.parametrize("n, share", [(10, 0.2), (7, 0.25), (1, 0.2), (3, 0.0)])
def test_split_sizes(spark, n, share):
    names = spark.createDataFrame([(f"Segment_{i}.csv",) for i in range(n)], "sample_id string")
    for kind, split in (("temporal", samples.temporal_split(names, share)), ("random", samples.random_split(names, share, 3))):
        rows = split.collect()
        parts = [[r.sample_id for r in rows if r.split == p] for p in ("train", "test")]
        assert (len(parts[0]), len(parts[1])) == samples.expected_split_sizes(n, share, kind)
        assert len(set(parts[0] + parts[1])) == n


def test_split_of_names_that_share_their_place(spark):
    # a third of all names has no number, a third shares one
    names = [(f"name_{c}" * 2,) for c in "abcdefghijklmnopqrstuvwxyz"] + [(f"s7_{c}",) for c in "abcdefghijklmnopqrstuvwxyz"] + [(f"s{i}",) for i in range(30)]
    df = spark.createDataFrame(names, "sample_id string")
    import hashlib
    import re

    def order(name):
        found = re.search(r"\d+", name)
        return int(found.group()) if found else 0, hashlib.md5(name.encode()).hexdigest()[:15], name

    for share in (0.05, 0.5, 0.8, 0.95):
        got = {r.sample_id for r in samples.temporal_split(df, share).collect() if r.split == "train"}
        assert got == set(sorted((n for n, in names), key=order)[: int(len(names) * (1 - share))])


def test_keyed_splits(spark):
    rows = [("s_1", k) for k in range(40)]
    df = spark.createDataFrame(rows, "sample_id string, k int")
    split = samples.random_split(df, 0.25, 1).collect()
    assert sum(r.split == "test" for r in split) == 10 and len({(r.sample_id, r.k) for r in split}) == 40


def test_samples_table(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)], "sample_id string, step int, x double")
    for _ in range(2):  # overwrites
        samples.write_samples(rows, str(tmp_path / "s"), buckets=4)
    assert sorted(map(tuple, samples.read_samples(spark, str(tmp_path / "s")).select("sample_id", "step", "x").collect())) == [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)]


def test_temporal_split_orders_by_number(spark):
    names = spark.createDataFrame([(n,) for n in ("s_10", "s_9", "s_2", "none", "s_2b")], "sample_id string")
    got = {r.sample_id for r in samples.temporal_split(names, 0.4).collect() if r.split == "train"}
    assert got == {"none", "s_2", "s_2b"}


# --- metrics ---------------------------------------------------------------------------------


def preds(spark, pairs, model="m"):
    rows = [(model, i, 0, "p", float(p) if p is not None else None, float(t) if t is not None else None) for i, (p, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, "model string, sample_id int, step int, param string, pred double, target double")


def test_regression_corner_cases(spark):
    r = metrics.regression_metrics(preds(spark, [(1, 2), (3, 2), (None, 5), (math.inf, 1)])).first()
    assert (r.n, r.mae, r.rmse, r.r2) == (2, 1.0, 1.0, 0.0)
    assert metrics.regression_metrics(preds(spark, [(2, 2), (2, 2)])).first().r2 == 1.0
    r = metrics.regression_metrics(preds(spark, [(None, 2)])).first()
    assert (r.n, r.mae, r.rmse, r.r2) == (0, None, None, None)


def test_class_corner_cases(spark):
    r = metrics.classification_metrics(preds(spark, [(0, 1), (0, 0)])).first()
    assert (r.tn, r.fp, r.fn, r.tp, r.accuracy, r.precision, r.recall, r.f1) == (1, 0, 1, 0, 0.5, 0.0, 0.0, 0.0)


def test_areas_with_ties_and_missing_classes(spark):
    df = preds(spark, [(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)])
    assert metrics.roc_auc(df).first().roc_auc == pytest.approx(0.875)
    # points (0,1) (.5,1) (1,2/3) (1,.5)
    assert metrics.pr_auc(df).first().pr_auc == pytest.approx(0.5 + 0.5 * (1 + 2 / 3) / 2)
    none = preds(spark, [(0.9, 0), (0.5, 0)])
    assert metrics.roc_auc(none).first().roc_auc is None
    assert metrics.pr_auc(none).first().pr_auc == 0.5


def test_curves_have_both_ends(spark):
    df = preds(spark, [(0.9, 1), (0.1, 0)])
    roc = sorted((r.fpr, r.tpr, r.score) for r in metrics.roc_points(df).collect() if r.score is not None)
    assert roc == [(0.0, 1.0, 0.9), (1.0, 1.0, 0.1)]
    assert [(r.fpr, r.tpr) for r in metrics.roc_points(df).where("score is null").collect()] == [(0.0, 0.0)]
    assert [(r.precision, r.recall) for r in metrics.pr_points(df).where("score is null").collect()] == [(1.0, 0.0)]


def test_first_samples_and_values(spark):
    df = preds(spark, [(i, i) for i in range(10)]).unionByName(preds(spark, [(i, i) for i in range(3)], "k"))
    assert {r.model: r["count"] for r in metrics.first_samples(df, 5).groupBy("model").count().collect()} == {"m": 5, "k": 3}
    assert metrics.first_values(df, 2).count() == 4


# --- calibration -----------------------------------------------------------------------------

LOG = (
    "KorEXO Calibration File Export\r\n"
    "Last Calibration Time=,6/5/2020 3:31:52 PM\r\nCalibration Start Time=,7/23/2020 2:18:25 PM\r\n"
    "Calibration End Time=,7/23/2020 2:37:20 PM\r\nParameter Type=,pH\r\n\r\n"
    "[Cal Point 1]\r\nStandard=,7.02 pH\r\nPre Calibration Value=,-3.65 pH\r\nPost Calibration Value=,7.02 pH\r\n"
    "Temperature=,22.712 °C\r\nPre Calibration Value=,-3.60\r\nnote=,a=,b\r\n"
    "----------\r\nParameter Type=,Sp Cond (µS/cm)\r\n\r\n\r\n[x]\r\nStandard=,1000.0 µS/cm\r\n----------\r\n"
)


def test_log_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(LOG.encode("latin-1"))
    (tmp_path / "b.txt").write_bytes(LOG.encode("latin-1"))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.csv").write_bytes(LOG.encode("latin-1"))
    parsed = calibration.parse_logs(logs.read_logs(spark, str(tmp_path))).orderBy("chapter").collect()
    assert [r.parameter_type for r in parsed] == ["pH", "Sp Cond (µS/cm)"]
    first = parsed[0].fields
    assert first["Pre Calibration Value"] == "-3.65 pH" and first["Pre Calibration Value 2"] == "-3.60"
    assert first["Temperature"] == "22.712 °C" and first["note"] == "a=,b" and "Calibration End Time" in first
    assert parsed[1].fields == {"Parameter Type": "Sp Cond (µS/cm)", "Standard": "1000.0 µS/cm"}


def test_summary_of_a_known_calibration(spark):
    parsed = calibration.parse_logs(spark.createDataFrame([(LOG,)], "content string"))
    row = calibration.summarize(parsed).where("parameter_type = 'pH'").first()
    assert row.timespan == dt.timedelta(days=47, hours=23, minutes=5, seconds=28)
    assert row.timespan_seconds == row.timespan.total_seconds()
    assert (row.pre1, row.post1, row.pre2) == (-3.65, 7.02, -3.60)
    assert row.correction1 == pytest.approx(10.67) and row.correction2 is None
    long = calibration.corrections_long(calibration.summarize(parsed), ["parameter_type"])
    assert long.count() == 6


def test_jump_needs_rows_between_and_both_sides(spark):
    sensor = series(spark, [float(h) for h in range(60)])
    cal = spark.createDataFrame([(1, at(10)), (2, at(30)), (3, at(42)), (4, at(58.5)), (5, at(200))], "id int, t timestamp")
    rows = {r.id: (r.before, r.after, r.difference, r.between_count) for r in calibration.calibration_jumps(cal, sensor, AX, "v", time="t").collect()}
    assert rows[1] == (None, None, None, 0)
    assert rows[2] == (29.0, 31.0, 2.0, 20)
    assert rows[3] == (None, None, None, 12)  # too few rows since the previous one
    assert rows[4] == (58.0, 59.0, 1.0, 16)
    assert rows[5][:3] == (None, None, None)


def test_each_calibration_comes_back(spark):
    sensor = series(spark, [float(h) for h in range(60)])
    cal = spark.createDataFrame([(1, at(10)), (2, at(30)), (2, at(30)), (3, at(30)), (4, None), (4, None)], "id int, t timestamp")
    rows = sorted((r.id, r.difference or 0.0, r.between_count) for r in calibration.calibration_jumps(cal, sensor, AX, "v", time="t").collect())
    assert rows == [(1, 0.0, 0), (2, 0.0, 0), (2, 2.0, 20), (3, 0.0, 0), (4, 0.0, 0), (4, 0.0, 0)]


# --- sources and flows -----------------------------------------------------------------------


def test_delimited_forms(spark, tmp_path):
    (tmp_path / "lab.csv").write_text(
        "﻿Time;06-E.coli;08-Kimtall 22°C\n2022-01-04T12:00:00;#N/A;76\n2022-01-10T12:00:00;0,5;1.25\nbad;;NA\n", encoding="utf-8"
    )
    df = delimited.read_measurements(spark, str(tmp_path / "lab.csv"))
    assert df.columns == ["Time", "06-E.coli", "08-Kimtall 22°C"]
    assert [tuple(r) for r in df.collect()] == [
        (dt.datetime(2022, 1, 4, 12), None, 76.0), (dt.datetime(2022, 1, 10, 12), 0.5, 1.25), (None, None, None)
    ]
    point = delimited.typed(delimited.read_text_table(spark, str(tmp_path / "lab.csv"), sep=";"), times=["Time"], decimal="point")
    assert [r[1] for r in point.collect()] == [None, None, None]


def test_limit_file(spark, tmp_path):
    (tmp_path / "l.csv").write_text("\ufeff01-Farge;Sink (Zn)\n20;10.5\n", encoding="utf-8")
    assert delimited.read_limits(spark, str(tmp_path / "l.csv")).first().asDict() == {"01-Farge": 20.0, "Sink (Zn)": 10.5}


def test_stages_are_removed(spark):
    import os

    from gaugeline.sources.tables import fresh_path, remove_stages

    path = fresh_path(spark, "gone")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file:")
    assert os.path.exists(local)
    remove_stages(spark)
    assert not os.path.exists(local)


def test_params_store(spark, tmp_path):
    assert params.load_params(spark, str(tmp_path / "none")).count() == 0
    p = params.params_from_mapping(spark, '{"a": {"min": 1, "max": 2}}')
    params.save_params(p, str(tmp_path / "p"))
    assert [tuple(r) for r in params.load_params(spark, str(tmp_path / "p")).collect()] == [("a", 1.0, 2.0)]


def test_site_flow(spark):
    names = {v: k for k, v in site.PROFILER_NAMES.items()}
    hours = [0, 1.4, 2, 5, 40, 41]
    raw = spark.createDataFrame(
        [(str(at(h)), *[5.0 if h != 2 else -9999.0 for _ in site.PROFILER_SENSORS]) for h in hours],
        "TIMESTAMP string, " + ", ".join(f"`{names[s]}` double" for s in site.PROFILER_SENSORS),
    ).withColumn("TIMESTAMP", F.col("TIMESTAMP").cast("timestamp"))
    axis = Axis(time="TIMESTAMP")
    clean = flows.clean_site_profiler(raw, axis)
    rows = clean.orderBy("TIMESTAMP").collect()
    assert [r.TIMESTAMP for r in rows] == [at(h) for h in (0, 1, 2, 3, 4, 5, 40, 41)]
    assert [r.Interpolated for r in rows] == [0, 0, 0, 1, 1, 0, 0, 0]
    # 5 is below the lowest share of dissolved oxygen
    assert all(r["Pfl - DO (% Sat)"] is None and r["Pfl - pH"] == 5.0 for r in rows)
    weather = spark.createDataFrame(
        [(str(at(h)), 90.0, 2.0, 3.0, 1000.0, 300.0, -1.0, 1.0, 20.0, 50.0) for h in (0, 1, 2, 5)],
        "Time string, " + ", ".join(f"`{n}` double" for n in site.WEATHER_NAMES),
    ).withColumn("Time", F.col("Time").cast("timestamp"))
    ready = flows.clean_weather(weather, axis)
    assert ready.columns == ["TIMESTAMP", *site.WEATHER_COLUMNS]
    last = ready.orderBy(F.desc("TIMESTAMP")).first()
    assert last["24hr precipitation total (mm)"] == 4.0 and last["Shortwave (solar) radiation (W/m2)"] == 0.0
    whole = flows.combine_dense(clean, [(ready, {"max_gap": 1})], axis)
    got = whole.orderBy("TIMESTAMP").collect()
    assert whole.columns[:3] == ["TIMESTAMP", "Segment", "Interpolated"]
    assert [(r.TIMESTAMP, r.Segment) for r in got] == [(at(0), 1), (at(1), 1), (at(2), 1), (at(5), 2)]
    sparse = flows.combine_sparse([(clean, None), (ready, None)], axis)
    assert sparse.count() == 42


def test_repeated_keys_of_long_paragraphs(spark):
    lines = [f"{'same' if i % 2 else f'k{i % 5000}'}=,{i}" for i in range(20_000)]
    log = "Parameter Type=,pH\nsame=,meta\n\n[data]\n" + "\n".join(lines)
    start = time.time()
    fields = calibration.parse_logs(spark.createDataFrame([(log,)], "content string")).first().fields
    assert time.time() - start < 30  # one key 10,000 times, 2,500 keys 4 times
    want = {"Parameter Type": "pH", "same": "meta"}
    seen = {}
    for line in lines:
        key, value = line.split("=,")
        seen[key] = seen.get(key, 0) + 1
        want[key if seen[key] == 1 else f"{key} {seen[key]}"] = value
    assert fields == want


def test_calibrations_without_a_time_meet_no_exchange(spark):
    sensor = series(spark, [float(h) for h in range(60)])
    cal = spark.createDataFrame([(1, at(10)), (2, None)], "id int, t timestamp")
    found = calibration.calibration_jumps(cal, sensor, AX, "v", time="t")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join LeftOuter") :]
    assert "isnotnull(" in joined.split("Join", 2)[1]
    assert sorted((r.id, r.difference, r.between_count) for r in found.collect()) == [(1, None, 0), (2, None, 0)]


def test_scores_of_many_groups(spark):
    """100,000 groups, one of which holds a third of all rows."""
    rows = spark.range(0, 420_000, numPartitions=8).select(
        F.when(F.col("id") % 4 == 0, F.lit(-1)).otherwise(F.col("id") % 100_003).alias("model"),
        (F.col("id") % 1000 / 1000).alias("pred"), (F.xxhash64("id") % 2 == 0).cast("int").cast("double").alias("target"),
    )
    auc = metrics.roc_auc(rows).toPandas().set_index("model").roc_auc
    spread = metrics.error_spread(rows).toPandas().set_index("model")
    assert len(auc) == len(spread) == rows.select("model").distinct().count()
    frame = rows.toPandas()
    for model in (-1, 1, 2, 100_002):
        part = frame[frame.model == model]
        hits, misses = part.pred[part.target == 1].to_numpy(), part.pred[part.target == 0].to_numpy()
        if len(hits) and len(misses):
            ranks = pd.Series(np.r_[hits, misses]).rank().to_numpy()[: len(hits)]
            assert auc[model] == pytest.approx((ranks.sum() - len(hits) * (len(hits) + 1) / 2) / (len(hits) * len(misses)))
        else:
            assert math.isnan(auc[model])
        err = (part.pred - part.target).to_numpy()
        q1, q3 = np.quantile(err, [0.25, 0.75])
        inside = err[(err >= q1 - 1.5 * (q3 - q1)) & (err <= q3 + 1.5 * (q3 - q1))]
        r = spread.loc[model]
        assert (r.n, r.q1, r.q3) == (len(err), pytest.approx(q1), pytest.approx(q3))
        assert (r.low, r.high) == (pytest.approx(min(q1, inside.min())), pytest.approx(max(q3, inside.max())))


@pytest.mark.parametrize("bins", [2, 7, 1 << 16])
def test_order_statistic_by_histograms(spark, monkeypatch, bins):
    monkeypatch.setattr(samples, "_BINS", bins)
    numbers = [0, 5, 5, 5, 9, (1 << 60) + 3, (1 << 60) + 3, 7, (1 << 63) - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "__place long")
    numbers.sort()
    for k in range(1, len(numbers) + 1):
        at = numbers[k - 1]
        assert samples._kth(df, k) == (at, sum(n < at for n in numbers), numbers.count(at))


def test_equal_names_are_split_by_count(spark):
    df = spark.createDataFrame([("s_1",)] * 50 + [("s_2",)] * 3 + [(None,)] * 7, "sample_id string")
    for split, test in ((samples.random_split(df, 0.3, 4), 18), (samples.temporal_split(df, 0.2), 12)):
        rows = split.collect()
        assert len(rows) == 60 and sum(r.split == "test" for r in rows) == test
        plan = split._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Sort" not in plan


def test_site_values_by_group(spark):
    lab, weather = site.LAB_PHYSICAL[0], site.WEATHER_COLUMNS[0]
    df = spark.createDataFrame([(at(0), 1.0, 2.0, 3.0)], f"ts timestamp, `{lab}` double, `{weather}` double, other double")
    listed = lambda *groups: sorted((r.param, r.value) for r in flows.site_values(df, AX, *groups).collect())
    assert listed() == sorted([(lab, 1.0), (weather, 2.0)]) and listed(["weather"]) == [(weather, 2.0)]
    with pytest.raises(ValueError):
        flows.site_values(df, AX, ["nowhere"])
