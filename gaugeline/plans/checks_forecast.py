"""Queries on baselines, metrics and the comparison of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import forecast, metrics, samples
from gaugeline.operators.combine import limits_long
from gaugeline.plans import flows
from gaugeline.plans.checks_samples import _SQL_TOLERANT, INPUTS
from gaugeline.plans.fixtures import (
    BY_USER, PLAIN, SQL_HOURLY, SQL_LIMITS, SQL_LIMITS_LONG, SQL_ORDER_HOURS, SQL_PREDICTIONS, SQL_USER_HOURLY,
    hour_number, hourly, limits_wide, order_hours, predictions, r3, r6, sql_r3, sql_r6, user_hourly,
)
from gaugeline.plans.registry import query
from gaugeline.sources import params
from gaugeline.sources.tables import stored


def _targets(df):
    """Every row is the target of a sample of one step."""
    return df.withColumn("sample_id", hour_number()).withColumn("step", F.lit(0))


def _steps(df):
    """Three hours make a sample; hours without a row leave it shorter."""
    hour = hour_number()
    return df.withColumn("sample_id", F.floor(hour / 3).cast("bigint")).withColumn("step", F.pmod(hour, F.lit(3)).cast("int"))


_SQL_STARTS = """t as (select *, epoch_us(ts) // 3600000000 // 3 as sample_id, cast(epoch_us(ts) // 3600000000 % 3 as int) as step from user_hourly),
      starts as (select user_id, sample_id, min(ts) as t0 from t group by 1, 2)"""


def _shown(preds, *ids):
    return preds.select(*ids, "sample_id", "step", "param", r6("pred"), r6("target"))


@query(
    "naive_forecast",
    f"""with {SQL_USER_HOURLY}, {_SQL_STARTS},
      h as (select * from user_hourly where high is not null),
      found as (select s.user_id, s.sample_id, h.value, h.high
                from (select *, t0 - interval 5 hour as cut from starts) s asof left join h on h.user_id = s.user_id and s.cut > h.ts)
      select t.user_id, t.sample_id, t.step, p.param, {sql_r6('p.pred', 'pred')}, {sql_r6('p.target', 'target')}
      from t join found f using (user_id, sample_id),
        lateral (values ('value', f.value, t.value), ('high', f.high, t.high)) as p(param, pred, target)""",
)
def naive_forecast(spark, d):
    h = user_hourly(spark, d)
    return _shown(forecast.naive_forecast(_steps(h), h, BY_USER, ["value", "high"], 5), "user_id")


@query(
    "linear_forecast",
    f"""with {SQL_USER_HOURLY}, {_SQL_STARTS},
      j as (select s.user_id, s.sample_id, s.t0, count(h.ts) as n, avg(h.value) as m,
              regr_slope(h.value, epoch_us(h.ts) / 3600e6 - epoch_us(s.t0) / 3600e6) as b,
              regr_intercept(h.value, epoch_us(h.ts) / 3600e6 - epoch_us(s.t0) / 3600e6) as a
            from starts s left join user_hourly h on h.user_id = s.user_id and h.ts < s.t0 - interval 5 hour
              and h.ts >= s.t0 - interval 53 hour group by 1, 2, 3)
      select user_id, sample_id, t.step, 'value' as param,
        {sql_r6('case when n = 0 then null when n = 1 then m else a + b * (epoch_us(t.ts) - epoch_us(t0)) / 3600e6 end', 'pred')},
        {sql_r6('t.value', 'target')} from t join j using (user_id, sample_id)""",
)
def linear_forecast(spark, d):
    h = user_hourly(spark, d)
    return _shown(forecast.linear_forecast(_steps(h), h, BY_USER, ["value"], 48, 5), "user_id")


def _sql_season(target_year: str, day: str, minute: str, source: str = "order_hours", where: str = "true") -> str:
    """Tier sums for each asked (year, day, minute)."""
    return f"""cells as (select year(ts) as y, dayofyear(ts) as d, hour(ts) * 60 + minute(ts) as m, value as v from {source}),
      asks as (select distinct {target_year} as ty, {day} as td, {minute} as tm from {{asked}}),
      diff as (select ty, td, tm, v, least(abs(d - td), 365 - abs(d - td)) as dd, abs(m - tm) as dm from asks join cells on {where}
               where least(abs(d - td), 365 - abs(d - td)) <= 15),
      near as (select ty, td, tm, count(*) filter (dd <= 4 and dm <= 120) as n1, avg(v) filter (dd <= 4 and dm <= 120) as v1,
                 count(*) filter (dd <= 4) as n2, avg(v) filter (dd <= 4) as v2, count(*) as n3, avg(v) as v3 from diff group by 1, 2, 3),
      rest as (select ty, avg(v) as v4 from (select distinct ty from asks) a join cells on {where} group by 1),
      season as (select ty, td, tm, case when n1 > 0 then v1 when n2 > 0 then v2 when n3 > 0 then v3 else v4 end as pred
                 from asks left join near using (ty, td, tm) left join rest using (ty))"""


_SQL_SEASONAL = _sql_season("year(ts)", "dayofyear(ts)", "hour(ts) * 60 + minute(ts)", where="y <> ty").format(asked="order_hours")


@query(
    "seasonal_forecast",
    f"""with {SQL_ORDER_HOURS}, {_SQL_SEASONAL}
      select epoch_us(ts) // 3600000000 as sample_id, 0 as step, 'value' as param, {sql_r3('pred', 'pred')}, {sql_r3('value', 'target')}
      from order_hours join season on ty = year(ts) and td = dayofyear(ts) and tm = hour(ts) * 60 + minute(ts)""",
)
def seasonal_forecast(spark, d):
    h = order_hours(spark, d)
    preds = forecast.seasonal_forecast(_targets(h), h, PLAIN, ["value"])
    return preds.select("sample_id", "step", "param", r3("pred"), r3("target"))


_SQL_SECOND = _sql_season("year(ts)", "dayofyear(ts)", "hour(ts) * 60 + minute(ts)", source="second", where="y <> ty").format(asked="order_hours")


@query(
    "seasonal_secondary",
    f"""with {SQL_ORDER_HOURS}, second as (select ts, value * 2 as value from order_hours where hour(ts) < 12), {_SQL_SECOND}
      select epoch_us(ts) // 3600000000 as sample_id, 0 as step, 'value' as param, {sql_r3('pred', 'pred')}, {sql_r3('value', 'target')}
      from order_hours join season on ty = year(ts) and td = dayofyear(ts) and tm = hour(ts) * 60 + minute(ts)""",
)
def seasonal_secondary(spark, d):
    """A column of the secondary source takes the place of the history's."""
    h = order_hours(spark, d)
    second = h.where(F.hour("ts") < 12).withColumn("value", F.col("value") * 2)
    preds = forecast.seasonal_forecast(_targets(h), h, PLAIN, ["value"], secondary=second)
    return preds.select("sample_id", "step", "param", r3("pred"), r3("target"))


@query(
    "season_curve",
    f"""with {SQL_ORDER_HOURS}, gappy as (select ts, case when month(ts) = 3 then null else value end as value from order_hours),
      start as (select make_timestamp(max(year(ts)) + 1, 1, 1, 0, 0, 0) as t0 from order_hours),
      hours as (select k as hour_no, t0 + k * interval 1 hour as ts from start, generate_series(0, 8783) g(k)),
      {_sql_season('1', 'dayofyear(ts)', 'hour(ts) * 60', source='gappy').format(asked='hours')},
      curve as (select hour_no, dayofyear(ts) as doy, hour(ts) as hour, pred from hours join season on td = dayofyear(ts) and tm = hour(ts) * 60),
      near_ as (select *,
        last_value(case when pred is not null then hour_no end ignore nulls) over (order by hour_no rows unbounded preceding) as i0,
        last_value(pred ignore nulls) over (order by hour_no rows unbounded preceding) as x0,
        first_value(case when pred is not null then hour_no end ignore nulls) over (order by hour_no rows between current row and unbounded following) as i1,
        first_value(pred ignore nulls) over (order by hour_no rows between current row and unbounded following) as x1 from curve)
      select 'value' as param, hour_no, doy, hour,
        {sql_r3('case when pred is not null then pred when x0 is null then x1 when x1 is null then x0 else x0 + (x1 - x0) / (i1 - i0) * (hour_no - i0) end', 'value')} from near_""",
)
def season_curve(spark, d):
    """A history without any value in March, so that the curve has hours to fill."""
    h = order_hours(spark, d).withColumn("value", F.when(F.month("ts") != 3, F.col("value")))
    curve = forecast.season_curve(h, PLAIN, ["value"])
    return forecast.fill_curve(curve).withColumn("value", r3("value"))


# --- metrics ---------------------------------------------------------------------------------

_USED = "from predictions where pred is not null and target is not null"
_SCORES = f"""n as n, {sql_r6('mae', 'mae')}, {sql_r6('rmse', 'rmse')}, {sql_r6('r2', 'r2')}"""


def _sql_scores(source: str, by: str) -> str:
    return f"""scores as (select {by}, count(*) as n, avg(abs(pred - target)) as mae, sqrt(avg((pred - target) ** 2)) as rmse,
      1 - sum((pred - target) ** 2) / nullif(var_pop(target) * count(*), 0) as r2
      from {source} where pred is not null and target is not null group by {by})"""


@query(
    "regression_metrics",
    f"with {SQL_HOURLY}, {SQL_PREDICTIONS}, {_sql_scores('predictions', 'model')} select model, {_SCORES} from scores",
)
def regression_metrics(spark, d):
    return metrics.regression_metrics(predictions(spark, d)).select("model", "n", r6("mae"), r6("rmse"), r6("r2"))


@query(
    "first_samples",
    f"""with {SQL_HOURLY}, {SQL_PREDICTIONS},
      ranked as (select *, dense_rank() over (partition by model order by sample_id) as s, row_number() over (partition by model order by sample_id, step, param) as v
                 from predictions)
      select 'samples' as kind, model, sample_id, step, param from ranked where s <= 50
      union all select 'values', model, sample_id, step, param from ranked where v <= 50""",
)
def first_samples(spark, d):
    """The optional restriction of an evaluation to its first samples or values."""
    p, ids = predictions(spark, d), ["model", "sample_id", "step", "param"]
    both = metrics.first_samples(p, 50).withColumn("kind", F.lit("samples"))
    return both.unionByName(metrics.first_values(p, 50).withColumn("kind", F.lit("values"))).select("kind", *ids)


@query(
    "horizon_rmse",
    f"with {SQL_HOURLY}, {SQL_PREDICTIONS} select model, step, param, {sql_r6('sqrt(avg((pred - target) ** 2))', 'rmse')} {_USED} group by 1, 2, 3",
)
def horizon_rmse(spark, d):
    return metrics.horizon_rmse(predictions(spark, d)).withColumn("rmse", r6("rmse"))


@query(
    "error_spread",
    f"""with {SQL_HOURLY}, {SQL_PREDICTIONS}, e as (select model, param, pred - target as e {_USED}),
      q as (select model, param, count(*) as n, quantile_cont(e, 0.25) as q1, quantile_cont(e, 0.5) as median, quantile_cont(e, 0.75) as q3 from e group by 1, 2)
      select model, param, n, {sql_r6('q1', 'q1')}, {sql_r6('median', 'median')}, {sql_r6('q3', 'q3')},
        {sql_r6('least(q1, min(e) filter (e >= q1 - 1.5e0 * (q3 - q1)))', 'low')}, {sql_r6('greatest(q3, max(e) filter (e <= q3 + 1.5e0 * (q3 - q1)))', 'high')}
      from q join e using (model, param) group by model, param, n, q1, median, q3""",
)
def error_spread(spark, d):
    spread = metrics.error_spread(predictions(spark, d), ("model", "param"))
    return spread.select("model", "param", "n", *[r6(c) for c in ("q1", "median", "q3", "low", "high")])


_SQL_BINARY = f"""flags as (select model, sample_id, step, param, case when pred > lim then 1 else 0 end as pred, case when target > lim then 1 else 0 end as target
      from predictions join limits_long using (param))"""


@query(
    "classification_metrics",
    f"""with {SQL_HOURLY}, {SQL_LIMITS}, {SQL_LIMITS_LONG}, {SQL_PREDICTIONS}, {_SQL_BINARY},
      c as (select model, count(*) filter (pred = 0 and target = 0) as tn, count(*) filter (pred = 1 and target = 0) as fp,
              count(*) filter (pred = 0 and target = 1) as fn, count(*) filter (pred = 1 and target = 1) as tp from flags group by 1)
      select model, tn, fp, fn, tp, {sql_r6('(tp + tn) / (tp + tn + fp + fn)', 'accuracy')}, {sql_r6('coalesce(tp / nullif(tp + fp, 0), 0)', '"precision"')},
        {sql_r6('coalesce(tp / nullif(tp + fn, 0), 0)', 'recall')}, {sql_r6('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')} from c""",
)
def classification_metrics(spark, d):
    binary = metrics.binarize_predictions(predictions(spark, d), limits_long(limits_wide(spark, d)))
    found = metrics.classification_metrics(binary)
    return found.select("model", "tn", "fp", "fn", "tp", *[r6(c) for c in ("accuracy", "precision", "recall", "f1")])


def _scored(spark, d):
    """Scores against whether the target is above 50."""
    return predictions(spark, d).withColumn("target", (F.col("target") > 50).cast("int"))


_SQL_STEPS = f"""scored as (select model, pred as score, sum((target > 50)::int) as pos, sum((target <= 50)::int) as neg {_USED} group by 1, 2),
  steps as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by model) as p, sum(neg) over (partition by model) as n
            from scored window w as (partition by model order by score desc rows unbounded preceding))"""


@query(
    "roc_auc",
    f"""with {SQL_HOURLY}, {SQL_PREDICTIONS}, {_SQL_STEPS}
      select model, {sql_r6('sum(neg * (2 * tp - pos) / 2e0) / (max(p) * max(n))', 'roc_auc')} from steps group by 1""",
)
def roc_auc(spark, d):
    return metrics.roc_auc(_scored(spark, d)).withColumn("roc_auc", r6("roc_auc"))


@query(
    "roc_points",
    f"with {SQL_HOURLY}, {SQL_PREDICTIONS}, {_SQL_STEPS} select model, {sql_r6('score', 'score')}, {sql_r6('fp / n', 'fpr')}, {sql_r6('tp / p', 'tpr')} from steps "
    "union all select distinct model, cast(null as double), 0e0, 0e0 from steps",
)
def roc_points(spark, d):
    return metrics.roc_points(_scored(spark, d)).select("model", r6("score"), r6("fpr"), r6("tpr"))


@query(
    "pr_auc",
    f"""with {SQL_HOURLY}, {SQL_PREDICTIONS}, {_SQL_STEPS},
      points as (select model, score, tp / p as recall, tp / (tp + fp) as prec from steps),
      pairs as (select *, lag(recall, 1, 0) over w as r0, lag(prec, 1, 1) over w as p0 from points window w as (partition by model order by score desc))
      select model, {sql_r6('sum((recall - r0) * (prec + p0) / 2)', 'pr_auc')} from pairs group by 1""",
)
def pr_auc(spark, d):
    return metrics.pr_auc(_scored(spark, d)).withColumn("pr_auc", r6("pr_auc"))


@query(
    "pr_points",
    f"with {SQL_HOURLY}, {SQL_PREDICTIONS}, {_SQL_STEPS} select model, {sql_r6('score', 'score')}, {sql_r6('tp / (tp + fp)', '"precision"')}, {sql_r6('tp / p', 'recall')} from steps "
    "union all select distinct model, cast(null as double), 1e0, 0e0 from steps",
)
def pr_points(spark, d):
    return metrics.pr_points(_scored(spark, d)).select("model", r6("score"), r6("precision"), r6("recall"))


# --- sweeps and comparison -------------------------------------------------------------------

_NAIVE_GAPS, _WINDOWS = range(1, 97, 2), range(1, 60)


@query(
    "baseline_sweep",
    f"""with {SQL_HOURLY}, h as (select ts, purchase as v from hourly where purchase is not null),
      naive as (select 'naive' as model, k as setting, t.ts, h.v as pred, t.purchase as target
                from (select ts, purchase, k, ts - k * interval 1 hour as cut from hourly, generate_series(1, 96, 2) g(k)) t asof left join h on t.cut > h.ts),
      fits as (select w as setting, t.ts, t.purchase as target, count(h.ts) as n, avg(h.v) as m,
                 regr_intercept(h.v, epoch_us(h.ts) / 3600e6 - epoch_us(t.ts) / 3600e6) as a
               from hourly t cross join generate_series(1, 59) g(w) left join h on h.ts < t.ts - interval 5 hour and h.ts >= t.ts - (w + 5) * interval 1 hour
               group by 1, 2, 3),
      predictions as (select model, setting, epoch_us(ts) as sample_id, pred, target from naive
        union all select 'linear', setting, epoch_us(ts), case when n = 1 then m else a end, target from fits),
      {_sql_scores('predictions', 'model, setting')}
      select model, setting, {_SCORES} from scores""",
)
def baseline_sweep(spark, d):
    h = hourly(spark, d).select("ts", "purchase")
    t = _targets(h)
    naive = forecast.naive_forecast(t, h, PLAIN, ["purchase"], list(_NAIVE_GAPS))
    linear = forecast.linear_window_sweep(t, h, PLAIN, ["purchase"], _WINDOWS, 5)
    both = naive.withColumn("setting", F.col("gap_hours").cast("bigint")).drop("gap_hours").withColumn("model", F.lit("naive"))
    both = both.unionByName(
        linear.withColumn("setting", F.col("window_hours").cast("bigint")).drop("window_hours").withColumn("model", F.lit("linear"))
    )
    by = ("model", "setting")
    scores = metrics.regression_metrics(both, by)
    return scores.select("model", "setting", "n", r6("mae"), r6("rmse"), r6("r2"))


@query(
    "evaluate_samples",
    f"""with {SQL_HOURLY}, {_SQL_TOLERANT}, h as (select ts, purchase as v from hourly where purchase is not null),
      t as (select ends.sample_id, c.ts, c.purchase as target from ends join cells c on c.rn = ends.end_rn),
      naive as (select t.sample_id, h.v as pred, target from (select *, ts - interval 1 hour as cut from t) t asof left join h on t.cut > h.ts),
      fits as (select t.sample_id, t.target, count(h.ts) as n, avg(h.v) as m, regr_intercept(h.v, epoch_us(h.ts) / 3600e6 - epoch_us(t.ts) / 3600e6) as a
               from t left join h on h.ts < t.ts - interval 1 hour and h.ts >= t.ts - interval 25 hour group by 1, 2),
      predictions as (select 'Naive' as model, * from naive union all select 'Linear', sample_id, case when n = 1 then m else a end, target from fits),
      {_sql_scores('predictions', 'model')} select model, {_SCORES} from scores""",
)
def evaluate_samples(spark, d):
    """Samples cut, their last rows forecast, and the forecasts scored."""
    h = hourly(spark, d)
    cut = stored(flows.cut_tolerant(h, PLAIN, ["purchase"], INPUTS, 24, 0.1))
    targets = samples.target_rows(cut, ["purchase"])
    naive = forecast.naive_forecast(targets, h, PLAIN, ["purchase"], 1).withColumn("model", F.lit("Naive"))
    linear = forecast.linear_forecast(targets, h, PLAIN, ["purchase"], 24, 1).withColumn("model", F.lit("Linear"))
    found = metrics.regression_metrics(naive.unionByName(linear))
    return found.select("model", "n", r6("mae"), r6("rmse"), r6("r2"))


@query(
    "compare_models",
    f"""with {SQL_ORDER_HOURS}, {_SQL_SEASONAL},
      naive as (select t.ts, h.value as pred, t.value as target from (select *, ts - interval 1 hour as cut from order_hours) t
                asof left join order_hours h on t.cut > h.ts),
      fits as (select t.ts, t.value as target, count(h.ts) as n, avg(h.value) as m,
                 regr_intercept(h.value, epoch_us(h.ts) / 3600e6 - epoch_us(t.ts) / 3600e6) as a
               from order_hours t left join order_hours h on h.ts < t.ts - interval 1 hour and h.ts >= t.ts - interval 551 hour group by 1, 2),
      predictions as (
        select 'Naive' as model, epoch_us(ts) // 3600000000 as sample_id, pred, target from naive
        union all select 'Linear', epoch_us(ts) // 3600000000, case when n = 1 then m else a end, target from fits
        union all select 'Seasonal', epoch_us(ts) // 3600000000, pred, value from order_hours
          join season on ty = year(ts) and td = dayofyear(ts) and tm = hour(ts) * 60 + minute(ts)),
      {_sql_scores('predictions', 'model')},
      bins as (select model, case when pred > 150000 then 1 else 0 end as p, case when target > 150000 then 1 else 0 end as t from predictions),
      c as (select model, count(*) filter (p = 0 and t = 0) as tn, count(*) filter (p = 1 and t = 0) as fp,
              count(*) filter (p = 0 and t = 1) as fn, count(*) filter (p = 1 and t = 1) as tp from bins group by 1),
      rates as (select *, tp / (tp + fn) as sens, tp / nullif(tp + fp, 0) as prec, (tp + fn) / (tp + tn + fp + fn) as base from c)
      select model, n, {sql_r6('mae / 1000', 'mae')}, {sql_r6('rmse / 1000', 'rmse')}, {sql_r6('r2', 'r2')}, tn, fp, fn, tp,
        {sql_r6('(tp + tn) / (tp + tn + fp + fn)', 'accuracy')}, {sql_r6('coalesce(prec, 0)', '"precision"')}, {sql_r6('sens', 'recall')},
        {sql_r6('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')},
        {sql_r6('(tp / (tp + fn) + tn / (tn + fp)) / 2', 'roc_auc')},
        {sql_r6('case when prec is null then (1 + base) / 2 else sens * (1 + prec) / 2 + (1 - sens) * (prec + base) / 2 end', 'pr_auc')}
      from scores join rates using (model)""",
)
def compare_models(spark, d):
    """Forecasts of values scaled by 1000; classes are told from values scaled back."""
    h = order_hours(spark, d)
    preds = flows.baselines(_targets(h), h, PLAIN, ["value"], gap_hours=1, window_hours=550)
    scaled = stored(preds.withColumns({c: F.col(c) / 1000 for c in ("pred", "target")}))
    saved = spark.createDataFrame([("value", 0.0, 1000.0)], params.PARAM_SCHEMA)
    found = flows.compare_models(scaled, {"value": 150000.0}, saved)
    return found.select(
        "model", "n", r6("mae"), r6("rmse"), r6("r2"), "tn", "fp", "fn", "tp",
        *[r6(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")],
    )
