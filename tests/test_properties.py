"""Bucketed results equal plain ones, for any bucket width, with and without keys."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeline.operators import forecast, gaps, metrics, samples
from gaugeline.operators.ordered import Axis, Scan, scan
from gaugeline.operators.rolling import rolling_sum

T0 = dt.datetime(2023, 12, 20)


@pytest.fixture(scope="module")
def frame():
    """Three series; the first holds most rows."""
    rnd = random.Random(5)
    rows = []
    for key, n in ((1, 300), (2, 40), (3, 3)):
        hour = 0
        for _ in range(n):
            hour += rnd.choice([1, 1, 1, 1, 2, 3, 9, 60])
            rows.append((key, T0 + dt.timedelta(hours=hour), rnd.random() * 100 if rnd.random() < 0.4 else None))
    return pd.DataFrame(rows, columns=["k", "ts", "v"])


@pytest.fixture(scope="module")
def df(spark, frame):
    rows = [(int(k), t.to_pydatetime(), None if np.isnan(v) else float(v)) for k, t, v in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "k int, ts timestamp, v double").cache()


@pytest.mark.parametrize("bucket, parts", [(1, None), (7, None), (24 * 400, None), (24, 5)])
def test_scan_equals_windows(df, bucket, parts):
    axis = Axis(time="ts", keys=("k",), bucket_hours=bucket, parts=parts)
    got = scan(
        df, axis,
        Scan(total={"t": F.col("v").isNotNull().cast("int")}, last={"l": F.col("v")}, prior={"p": F.col("ts")},
             following={"f": F.col("v")}, after={"a": F.col("ts")}),
    )
    w = Window.partitionBy("k").orderBy("ts")
    want = df.select(
        "k", "ts", "v",
        F.count("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("t"),
        F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("l"), F.lag("ts").over(w).alias("p"),
        F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("f"), F.lead("ts").over(w).alias("a"),
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("bucket, parts", [(1, None), (24, 7), (24 * 400, None)])
def test_no_keys_equal_one_key(df, bucket, parts):
    one = df.where("k = 1")
    plain, keyed = Axis(time="ts", bucket_hours=bucket, parts=parts), Axis(time="ts", keys=("k",), bucket_hours=24 * 400)
    for op in (
        lambda a: gaps.segments(one, a, row="rn", position="p", previous_position="q"),
        lambda a: gaps.interpolate(one, a, ["v"], limit=2, direction="both"),
        lambda a: gaps.fill_small_gaps(one, a, ["v"]),
        lambda a: gaps.drop_long_gaps(one, a, ["v"], 2),
        lambda a: rolling_sum(one, a, "v", 24).withColumn("rolling v", F.round("rolling v", 9)),
    ):
        a, b = op(plain), op(keyed)
        order = ["ts", *sorted(set(a.columns) - {"ts", "k"})]  # inserted rows know their series only with keys
        assert sorted(map(str, a.select(order).collect())) == sorted(map(str, b.select(order).collect()))


def brute_interpolate(values, limit):
    out = pd.Series(values, dtype=float)
    return out.interpolate(method="linear", limit=limit, limit_direction="both")


@pytest.mark.parametrize("limit", [1, 3, 6])
def test_interpolation_equals_pandas(df, frame, limit):
    got = gaps.interpolate(df, Axis(time="ts", keys=("k",), bucket_hours=30), ["v"], limit=limit, direction="both").toPandas()
    for k, part in frame.groupby("k"):
        want = brute_interpolate(part.sort_values("ts")["v"].to_numpy(), limit)
        have = got[got.k == k].sort_values("ts")["v"].astype(float)
        np.testing.assert_allclose(have.to_numpy(), want.to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("cells", [1, 4, 24])
def test_rolling_sum_equals_brute_force(df, frame, cells):
    got = rolling_sum(df, Axis(time="ts", keys=("k",)), "v", 48, cells=cells).toPandas()
    for k, part in frame.groupby("k"):
        for t, s in got[got.k == k][["ts", "rolling v"]].itertuples(index=False):
            mask = (part.ts >= t - pd.Timedelta(hours=48)) & (part.ts <= t)
            assert s == pytest.approx(part.v[mask].sum())


def test_no_task_holds_a_series(spark, df):
    """Sums of cells and splits are not gathered in one partition."""
    one = df.where("k = 1").drop("k")
    for plan in (rolling_sum(one, Axis(time="ts"), "v", 24), gaps.segments(one, Axis(time="ts")), gaps.interpolate(one, Axis(time="ts"), ["v"])):
        text = plan._jdf.queryExecution().executedPlan().toString()
        # windows without keys run over bucket summaries only
        assert "rolling" not in str(plan.columns) or "SinglePartition" not in text


@pytest.mark.parametrize("bucket", [3, 24 * 400])
@pytest.mark.parametrize("rows_needed", [1, 2, 4])
def test_gap_feasibility_equals_brute_force(df, frame, bucket, rows_needed):
    spans = [0, 1, 5, 40]
    got = samples.gap_feasibility(df, Axis(time="ts", keys=("k",), bucket_hours=bucket), ["v"], rows_needed, spans).toPandas()
    for k, part in frame.groupby("k"):
        part = part.sort_values("ts").reset_index(drop=True)
        breaks = part.ts.diff() > pd.Timedelta(hours=1)
        position = part.groupby(breaks.cumsum()).cumcount() + 1
        for gap in spans:
            want = 0
            for t in part.ts[part.v.notna()]:
                before = part.ts <= t - pd.Timedelta(hours=gap)
                want += bool(before.any()) and position[before].iloc[-1] >= rows_needed
            assert got[(got.k == k) & (got.gap == gap)].n.tolist() == [want]


def test_coverage_equals_valid_rows(df):
    axis = Axis(time="ts", keys=("k",), bucket_hours=50)
    sets = {"v": ["v"], "all": ["v", "ts"]}
    got = {(r.k, r.targets, r.span, r.tolerance): r.n for r in samples.coverage_sweep(df, axis, sets, ["v"], [0, 1, 7], [0, 40, 100]).collect()}
    assert len(got) == 3 * 2 * 3 * 3 and all(n == 0 for (_, _, span, _), n in got.items() if span == 0)
    for span in (1, 7):
        for tolerance in (0, 40, 100):
            rows = samples.valid_rows(df, axis, ["v"], ["v"], span, tolerance / 100).groupBy("k").count().collect()
            counts = {r.k: r["count"] for r in rows}
            assert all(got[k, t, span, tolerance] == counts.get(k, 0) for k in (1, 2, 3) for t in sets)


@pytest.mark.parametrize("window, gap, bucket", [(6, 5, 168), (50, 1, 10), (550, 1, 24), (7.5, 2, 24)])
def test_linear_forecast_equals_least_squares(df, frame, window, gap, bucket):
    wanted = df.withColumn("sample_id", F.col("ts").cast("string")).withColumn("step", F.lit(0))
    axis = Axis(time="ts", keys=("k",), bucket_hours=bucket)
    got = forecast.linear_forecast(wanted, df, axis, ["v"], window, gap).toPandas()
    known = frame.dropna()
    assert len(got) == len(frame)
    for k, sample, pred in got[["k", "sample_id", "pred"]].itertuples(index=False):
        t = pd.Timestamp(sample)
        end = t - pd.Timedelta(hours=gap)
        part = known[(known.k == k) & (known.ts < end) & (known.ts >= end - pd.Timedelta(hours=window))]
        if part.empty:
            assert np.isnan(pred)
            continue
        x = (part.ts - t).dt.total_seconds().to_numpy() / 3600
        y = part.v.to_numpy()
        slope = 0.0 if len(x) == 1 else ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
        assert pred == pytest.approx(y.mean() - slope * x.mean(), rel=1e-9, abs=1e-7)


def test_window_sweep_equals_single_windows(df):
    wanted = df.where("k < 3").withColumn("sample_id", F.col("ts").cast("string")).withColumn("step", F.lit(0))
    axis = Axis(time="ts", keys=("k",))
    sweep = forecast.linear_window_sweep(wanted, df, axis, ["v"], [1, 6, 30], 2).toPandas()
    for w in (1, 6, 30):
        one = forecast.linear_forecast(wanted, df, axis, ["v"], w, 2).toPandas().sort_values(["k", "sample_id"])
        many = sweep[sweep.window_hours == w].sort_values(["k", "sample_id"])
        np.testing.assert_allclose(many.pred.astype(float), one.pred.astype(float), rtol=1e-9, atol=1e-9)


def test_window_sweep_off_the_grid(spark):
    rnd = random.Random(8)
    start = pd.Timestamp("2021-05-01")
    times = [start + pd.Timedelta(seconds=rnd.choice([rnd.randrange(200_000), 3600 * rnd.randrange(56), 3600 * rnd.randrange(56)])) for _ in range(400)]
    hist = pd.DataFrame({"k": [rnd.choice([1, 1, 2, None]) for _ in times], "ts": times, "v": [1e7 + rnd.random() if rnd.random() < 0.9 else np.nan for _ in times], "w": [rnd.random() for _ in times]})
    sdf = spark.createDataFrame(
        [(None if pd.isna(k) else int(k), t.to_pydatetime(), None if np.isnan(v) else v, w) for k, t, v, w in hist.itertuples(index=False)],
        "k int, ts timestamp, v double, w double",
    )
    wanted = sdf.limit(60).withColumn("sample_id", F.monotonically_increasing_id()).withColumn("step", F.lit(0))
    wanted = spark.createDataFrame(wanted.collect() + [(1, None, 0.0, 0.0, -1, 0)], wanted.schema)
    windows = [1, 2, 7, 24]
    sweep = forecast.linear_window_sweep(wanted, sdf, Axis(time="ts", keys=("k",)), ["v", "w"], windows, 0.5)
    assert "Join" not in sweep._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.sample_id, r.window_hours, r.param): r.pred for r in sweep.collect()}
    asked = wanted.toPandas()
    assert len(got) == len(asked) * len(windows) * 2
    known = hist.dropna(subset=["v", "w"])
    for r in asked.itertuples(index=False):
        end = r.ts - pd.Timedelta(minutes=30)
        series = known[known.k.isna() if pd.isna(r.k) else known.k == r.k]
        for hours in windows:
            part = series[(series.ts < end) & (series.ts >= end - pd.Timedelta(hours=hours))] if not pd.isna(r.ts) else series[:0]
            for name in ("v", "w"):
                pred = got[r.sample_id, hours, name]
                if part.empty:
                    assert pred is None
                    continue
                x, y = (part.ts - r.ts).dt.total_seconds().to_numpy() / 3600, part[name].to_numpy()
                slope = 0.0 if part.ts.nunique() == 1 else ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
                assert pred == pytest.approx(y.mean() - slope * x.mean(), rel=1e-9, abs=1e-6)


def test_seasonal_equals_brute_force(spark):
    rnd = random.Random(3)
    start = pd.Timestamp("2019-01-01")
    rows = sorted({start + pd.Timedelta(hours=rnd.randrange(4 * 8766)) for _ in range(700)})
    hist = pd.DataFrame({"ts": rows, "v": [rnd.random() if rnd.random() < 0.8 else np.nan for _ in rows]})
    sdf = spark.createDataFrame([(t.to_pydatetime(), None if np.isnan(v) else float(v)) for t, v in hist.itertuples(index=False)], "ts timestamp, v double")
    wanted = sdf.withColumn("sample_id", F.col("ts").cast("string")).withColumn("step", F.lit(0))
    got = forecast.seasonal_forecast(wanted, sdf, Axis(), ["v"]).toPandas()
    assert len(got) == len(hist)
    for sample, pred in got[["sample_id", "pred"]].itertuples(index=False):
        t = pd.Timestamp(sample)
        c = hist[hist.ts.dt.year != t.year]
        gap = (c.ts.dt.dayofyear - t.dayofyear).abs()
        gap = np.minimum(gap, 365 - gap)
        hours = ((c.ts.dt.hour * 60 + c.ts.dt.minute) - (t.hour * 60 + t.minute)).abs()
        for part in (c[(gap <= 4) & (hours <= 120)], c[gap <= 4], c[gap <= 15], c):
            if len(part):
                break
        want = part.v.mean()
        assert (np.isnan(want) and np.isnan(pred)) or pred == pytest.approx(want)


@pytest.mark.parametrize("span", [1, 5, 40])
def test_missing_share_equals_brute_force(df, frame, span):
    got = samples.missing_share(df, Axis(time="ts", keys=("k",), bucket_hours=50), ["v"], [span]).toPandas()
    for k, part in frame.groupby("k"):
        seen = part.sort_values("ts")["v"].notna().to_numpy()
        have = got[got.k == k].sort_values("ts")[f"miss_{span}"].to_numpy()
        for i in range(1, len(seen)):
            block = seen[max(0, i - span) : i]
            assert have[i] == pytest.approx(1 - block.mean())


def test_expanded_samples_are_whole(df):
    axis = Axis(time="ts", keys=("k",), bucket_hours=20)
    numbered = samples.number_rows(df, axis)
    ends = samples.tolerant_samples(df, axis, ["v"], ["v"], 5, 1.0)
    rows = samples.expand(ends, numbered, ["k"], 5).toPandas()
    n = {(r.k, r.sample_id): r.end_rn for r in ends.collect()}
    sizes = rows.groupby(["k", "sample_id"]).size()
    assert len(sizes) == len(n)
    for key, size in sizes.items():
        assert size == min(n[key], 6)


def test_quantiles_equal_numpy(spark):
    rnd = random.Random(1)
    values = [round(rnd.gauss(0, 1), 2) for _ in range(2000)] + [0.0] * 1500
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 3.0)], "g string, x double")
    got = {r.g: r for r in metrics.exact_quantiles(df, ["g"], "x", (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)).collect()}
    np.testing.assert_allclose([got["a"][f"q{i}"] for i in range(6)], np.quantile(values, [0, 0.1, 0.25, 0.5, 0.9, 1]))
    assert [got["b"][f"q{i}"] for i in range(6)] == [3.0] * 6


def test_roc_equals_pair_counting(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(40) / 40, int(rnd.random() < 0.3)) for _ in range(400)]
    df = spark.createDataFrame([("m", i, 0, "p", float(s), float(t)) for i, (s, t) in enumerate(rows)],
                               "model string, sample_id int, step int, param string, pred double, target double")
    pos, neg = [s for s, t in rows if t], [s for s, t in rows if not t]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df).first().roc_auc == pytest.approx(want)
