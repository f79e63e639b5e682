"""Queries on usable samples, cutting, loading, splits and models."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from gaugeline.operators import models, samples
from gaugeline.plans import flows
from gaugeline.plans.checks_series import _SQL_SEGMENTS
from gaugeline.plans.fixtures import (
    BY_TYPE, BY_USER, PLAIN, SQL_HOURLY, SQL_TYPE_HOURLY, SQL_USER_HOURLY, hourly, micros, r6, scratch,
    sql_r6, table, type_hourly, user_hourly,
)
from gaugeline.plans.registry import query
from gaugeline.sources import params
from gaugeline.sources.tables import stored

INPUTS = ["click", "error", "signup", "view"]
_SEEN = " + ".join(f"({c} is not null)::int" for c in INPUTS)

_SQL_MISSING = f"""cells as (select *, row_number() over (order by ts) as rn, {_SEEN} as seen from hourly),
  shares as (select *, {{shares}} from cells)"""


def _sql_share(span: int) -> str:
    frame = f"(order by ts rows between {span} preceding and 1 preceding)"
    return f"1 - cast(coalesce(sum(seen) over {frame}, 0) as double) / nullif(count(*) over {frame} * 4, 0) as miss_{span}"


@query(
    "valid_rows",
    f"""with {SQL_HOURLY}, {_SQL_MISSING.format(shares=_sql_share(24))}
      select epoch_us(ts) as ts, rn, {sql_r6('miss_24', 'missing')} from shares where purchase is not null and miss_24 <= 0.1e0""",
)
def valid_rows(spark, d):
    found = samples.valid_rows(hourly(spark, d), PLAIN, ["purchase"], INPUTS, 24, 0.1)
    return found.select(micros(), "rn", r6("missing"))


_SPANS, _TOLERANCES = (0, 12, 24, 48, 96), range(0, 101, 10)
_SQL_TOLERANCE = " union all ".join(
    f"select '{name}' as targets, {span} as span, {tol} as tolerance, count(*) filter ({test} and "
    + (f"miss_{span} <= {tol}e0 / 100)" if span else "false)")
    + " as n from shares"
    for name, test in (("purchase", "purchase is not null"), ("both", "purchase is not null and view is not null"))
    for span in _SPANS
    for tol in _TOLERANCES
)


@query(
    "coverage_sweep",
    f"with {SQL_HOURLY}, {_SQL_MISSING.format(shares=', '.join(_sql_share(s) for s in _SPANS if s))} {_SQL_TOLERANCE}",
)
def coverage_sweep(spark, d):
    sets = {"purchase": ["purchase"], "both": ["purchase", "view"]}
    return samples.coverage_sweep(hourly(spark, d), PLAIN, sets, INPUTS, _SPANS, _TOLERANCES)


@query(
    "gapless_counts",
    f"""with {SQL_TYPE_HOURLY}, {_SQL_SEGMENTS.format(key='event_type', source='type_hourly')},
      c as (select event_type, l as length, count(*) filter (value is not null and pos >= l) as v, count(*) filter (high is not null and pos >= l) as h
            from numbered, generate_series(10, 168, 25) g(l) group by 1, 2)
      select event_type, 'value' as param, length, v as n from c union all select event_type, 'high', length, h from c""",
)
def gapless_counts(spark, d):
    return samples.gapless_counts(type_hourly(spark, d), BY_TYPE, ["value", "high"])


@query(
    "gap_feasibility",
    f"""with {SQL_USER_HOURLY}, {_SQL_SEGMENTS.format(key='user_id', source='user_hourly')},
      pts as (select user_id, ts, high is not null as has_high, gap, ts - gap * interval 1 hour as at
              from user_hourly, generate_series(0, 166, 5) g(gap)),
      hit as (select p.*, n.pos from pts p asof left join numbered n on n.user_id = p.user_id and p.at >= n.ts),
      c as (select user_id, gap, count(*) filter (coalesce(pos >= 2, false)) as v, count(*) filter (has_high and coalesce(pos >= 2, false)) as h
            from hit group by 1, 2)
      select user_id, gap, 'value' as param, v as n from c union all select user_id, gap, 'high', h from c""",
)
def gap_feasibility(spark, d):
    return samples.gap_feasibility(stored(user_hourly(spark, d)), BY_USER, ["value", "high"], 2)


# --- cutting ---------------------------------------------------------------------------------

_SQL_STRICT = f"""{_SQL_SEGMENTS.format(key='event_type', source='type_hourly')},
  placed as (select *, lag(pos) over (partition by event_type order by ts) as prev_pos from numbered),
  ends as (select event_type, rn as end_rn, ts as end_time,
             'segment_' || row_number() over (partition by event_type order by ts) as sample_id
           from placed where high is not null and rn >= 6 and prev_pos >= 5)"""


@query(
    "strict_samples",
    f"with {SQL_TYPE_HOURLY}, {_SQL_STRICT} select event_type, sample_id, end_rn, epoch_us(end_time) as end_time from ends",
)
def strict_samples(spark, d):
    numbered = samples.number_rows(type_hourly(spark, d), BY_TYPE)
    return samples.strict_samples(numbered, BY_TYPE, ["high"], 6).withColumn("end_time", micros("end_time"))


@query(
    "strict_sample_rows",
    f"""with {SQL_TYPE_HOURLY}, {_SQL_STRICT},
      scale as (select min(value) as lo, max(value) as hi from type_hourly)
      select e.event_type, e.sample_id, cast(n.rn - e.end_rn + 5 as int) as step, epoch_us(n.ts) as ts, {sql_r6('(n.value - lo) / (hi - lo)', 'value')}
      from ends e join numbered n on n.event_type = e.event_type and n.rn between e.end_rn - 5 and e.end_rn, scale""",
)
def strict_sample_rows(spark, d):
    cut = flows.cut_strict(type_hourly(spark, d), BY_TYPE, ["high"], 6, ["value"])
    return cut.select("event_type", "sample_id", "step", micros(), r6("value"))


_SQL_TOLERANT = f"""{_SQL_MISSING.format(shares=_sql_share(24))},
  ends as (select rn as end_rn, greatest(1, rn - 24) as first_rn, 'Segment_' || (row_number() over (order by ts) - 1) as sample_id
           from shares where purchase is not null and miss_24 <= 0.1e0)"""


@query(
    "tolerant_samples",
    f"""with {SQL_HOURLY}, {_SQL_TOLERANT}
      select sample_id, cast(rn - first_rn as int) as step, epoch_us(ts) as ts, {sql_r6('click', 'click')}, {sql_r6('purchase', 'purchase')}
      from ends join cells on rn between first_rn and end_rn""",
)
def tolerant_samples(spark, d):
    return _tolerant(spark, d).select("sample_id", "step", micros(), r6("click"), r6("purchase"))


def _tolerant(spark, d, tolerance=0.1):
    return flows.cut_tolerant(hourly(spark, d), PLAIN, ["purchase"], INPUTS, 24, tolerance, store=stored)


def _stored_rows(spark, d, tolerance=0.1):
    """Sample rows written as the samples table and read back."""
    path = scratch(spark, "samples")
    rows = _tolerant(spark, d, tolerance)
    samples.write_samples(rows, path, buckets=8)
    return samples.read_samples(spark, path, rows.schema)


def _loaded(spark, d, tolerance=0.1, **options):
    return samples.load_samples(_stored_rows(spark, d, tolerance), INPUTS, ["purchase"], input_rows=(0, 23), **options)


_SQL_ROWS = f"""{_SQL_TOLERANT},
  sample_rows as (select sample_id, rn - first_rn as step, count(*) over (partition by sample_id) as n, cells.* from ends join cells on rn between first_rn and end_rn),
  loaded as (select sample_id, max(n) as n, max(case when step = n - 1 then purchase end) as target,
      sum(case when step < 23 then seen end) as present, {{extra}}
    from sample_rows group by 1 having max(n) >= 23)"""


@query(
    "load_samples",
    f"""with {SQL_HOURLY}, {_SQL_ROWS.replace('>= 23', '>= 6').format(extra='sum(case when step < 6 then (click is not null)::int + (view is not null)::int end) as early, sum(case when step < 6 then click + view end) as total')}
      select sample_id, 12 as n_features, {sql_r6('total', 'total')}, {sql_r6('target', 'target')} from loaded where early = 12 and target is not null""",
)
def load_samples(spark, d):
    """Strict loading: some samples lack a cell of the two inputs in their first six rows and go."""
    found = samples.load_samples(_stored_rows(spark, d), ["click", "view"], ["purchase"], input_rows=(0, 6))
    total = F.aggregate("features", F.lit(0.0), lambda a, b: a + b)
    return found.select("sample_id", F.size("features").alias("n_features"), r6(total, "total"), r6(F.col("target")[0], "target"))


_WEIGHTED = "sum(case when step < 23 then " + " + ".join(
    f"coalesce({c}, 0) * (step * 4 + {i + 1})" for i, c in enumerate(INPUTS)
) + " end) as weighted"


@query(
    "flatten_features",
    f"""with {SQL_HOURLY}, {_SQL_ROWS.format(extra=_WEIGHTED)}
      select sample_id, 92 as n_features, cast(92 - present as int) as n_missing, {sql_r6('weighted', 'weighted')} from loaded""",
)
def flatten_features(spark, d):
    found = _loaded(spark, d, fault_tolerant=True)
    weights = F.transform("features", lambda v, i: F.coalesce(v, F.lit(0.0)) * (i + 1))
    return found.select(
        "sample_id", F.size("features").alias("n_features"),
        F.size(F.filter("features", lambda v: v.isNull())).alias("n_missing"),
        r6(F.aggregate(weights, F.lit(0.0), lambda a, b: a + b), "weighted"),
    )


# --- splits ----------------------------------------------------------------------------------


def _names(spark, d):
    return table(spark, d, "orders").select(F.concat(F.lit("Segment_"), "o_orderkey", F.lit("_v2.csv")).alias("sample_id"))


_SQL_TEMPORAL = """names as (select 'Segment_' || o_orderkey || '_v2.csv' as sample_id, o_orderkey as k from orders),
  split as (select sample_id, case when row_number() over (order by k, md5(sample_id)) <= floor((select count(*) from names) * (1 - 0.2e0)) then 'train' else 'test' end as split from names)"""


@query("temporal_split", f"with {_SQL_TEMPORAL} select sample_id, split from split")
def temporal_split(spark, d):
    return samples.temporal_split(_names(spark, d), 0.2)


@query("split_reuse", f"with {_SQL_TEMPORAL} select sample_id from split where split = 'test'")
def split_reuse(spark, d):
    path = scratch(spark, "split")
    params.save_split(samples.temporal_split(_names(spark, d), 0.2), path)
    return params.part_of(_names(spark, d), params.load_split(spark, path), "test")


def _sql_random(source: str, seed: int) -> str:
    """Names of the test part of a random split."""
    return f"""tests as (select sample_id from (select sample_id, row_number() over (order by substr(md5(sample_id || '|{seed}'), 1, 15), sample_id) as nth from {source})
      where nth <= ceil((select count(*) from {source}) * 0.2e0))"""


@query(
    "random_split",
    f"""with {_SQL_TEMPORAL}, {_sql_random('names', 10)}
      select sample_id, case when sample_id in (select sample_id from tests) then 'test' else 'train' end as split from names""",
)
def random_split(spark, d):
    return samples.random_split(_names(spark, d), 0.2, 10)


# --- models ----------------------------------------------------------------------------------


def _parts(spark, d):
    """Both parts written once: training reads them once per boosting round."""
    whole = stored(_loaded(spark, d, 0.9, fault_tolerant=True))
    split = stored(samples.random_split(whole.select("sample_id"), 0.2, 35))
    return stored(params.part_of(whole, split, "train")), stored(params.part_of(whole, split, "test"))


_SQL_WIDE = _SQL_ROWS.replace("<= 0.1e0", "<= 0.9e0")
_ROUNDS, _PATIENCE = 40, 3  # the loss on the test part ends training earlier


def _ended_early(training):
    """The model, if the loss on the test part and not the number of rounds ended its training."""
    if max(n for _, n, _ in training.curve) >= _ROUNDS:
        raise ValueError(f"training ended at its {_ROUNDS} rounds, not by validation")
    return training.model


@query(
    "gbt_regression",
    f"""with {SQL_HOURLY}, {_SQL_WIDE.format(extra='1 as one')}, {_sql_random('loaded', 35)}
      select sample_id, {sql_r6('target', 'target')}, true as in_range, true as better from loaded where sample_id in (select sample_id from tests)""",
)
def gbt_regression(spark, d):
    """Trained, saved, loaded: each prediction lies within the training targets or near, and training samples are
    closer to their predictions than to the mean."""
    train, test = _parts(spark, d)
    path = scratch(spark, "regressor")
    models.save(_ended_early(models.train_regressor(train, test, rounds=_ROUNDS, depth=3, subsample=0.8, rate=0.3, patience=_PATIENCE)), path)
    model = models.load(path)
    fitted = models.predict(model, train)
    y = F.col("target")
    known = fitted.agg(
        F.struct(F.min(y).alias("lo"), F.max(y).alias("hi"), (F.avg((F.col("pred") - y) ** 2) < F.var_pop(y)).alias("better"))
    ).scalar()
    out = models.predict(model, test).withColumn("known", known)
    # sums of trees may pass the training targets by a little
    slack = (F.col("known.hi") - F.col("known.lo")) * 0.2
    inside = F.col("pred").between(F.col("known.lo") - slack, F.col("known.hi") + slack)
    return out.select("sample_id", r6("target"), inside.alias("in_range"), "known.better")


@query(
    "gbt_classification",
    f"""with {SQL_HOURLY}, {_SQL_WIDE.format(extra='1 as one')}, {_sql_random('loaded', 35)}
      select sample_id, {sql_r6('least(target / 100, 1)', 'target')}, true as is_class, true as better from loaded where sample_id in (select sample_id from tests)""",
)
def gbt_classification(spark, d):
    """Labels are rounded by the training; training samples are told apart at least as well as by the
    more frequent class."""
    train, test = (p.withColumn("target", F.transform("target", lambda v: F.least(v / 100, F.lit(1.0)))) for p in _parts(spark, d))
    path = scratch(spark, "classifier")
    models.save(_ended_early(models.train_classifier(train, test, rounds=_ROUNDS, depth=3, subsample=0.8, rate=0.3, patience=_PATIENCE)), path)
    model = models.load(path)
    label = F.rint("target")
    right = F.avg((F.col("pred") == label).cast("double"))
    better = models.predict(model, train).agg(right >= F.greatest(F.avg(label), 1 - F.avg(label))).scalar()
    out = models.predict(model, test)
    return out.select("sample_id", r6("target"), F.col("pred").isin(0.0, 1.0).alias("is_class"), better.alias("better"))


# Trees of one split on three yes-no features: all a tree can see are eight cells, so SQL can train the same
# model on the cells' counts and sums.
_CURVE_ROUNDS, _CURVE_PATIENCE, _CURVE_RATE = 12, 3, 0.3
_FEATURES = ("coalesce(click > 50, false)", "coalesce(view > 50, false)", "hour(ts) < 12")


def _sql_boosting(classes: bool) -> str:
    cells = range(8)
    bits = [[c >> j & 1 for c in cells] for j in range(3)]
    lists = lambda terms: "[" + ", ".join(terms) + "]"
    # what the next tree is fitted to, summed in each cell
    if classes:
        rest = lists(
            f"case when round = 0 then (pos[{c + 1}] - neg[{c + 1}])::double else 4e0 * (pos[{c + 1}] / (1 + exp(2 * f[{c + 1}])) - neg[{c + 1}] / (1 + exp(-2 * f[{c + 1}]))) end"
            for c in cells
        )
        loss = lambda p: " + ".join(
            f"{p}pos[{c + 1}] * ln(1 + exp(-2 * f[{c + 1}])) + {p}neg[{c + 1}] * ln(1 + exp(2 * f[{c + 1}]))" for c in cells
        )
        total = lambda p: f"({loss(p)}) / list_sum({p}n)"
    else:
        rest = lists(f"case when round = 0 then ys[{c + 1}] else 2e0 * (ys[{c + 1}] - n[{c + 1}] * f[{c + 1}]) end" for c in cells)
        loss = lambda p: " + ".join(f"{p}yy[{c + 1}] - 2 * f[{c + 1}] * {p}ys[{c + 1}] + {p}n[{c + 1}] * f[{c + 1}] * f[{c + 1}]" for c in cells)
        total = lambda p: f"sqrt(({loss(p)}) / list_sum({p}n))"
    side = lambda name, j, s: "(" + " + ".join(f"{name}[{c + 1}]" for c in cells if bits[j][c] == s) + ")"
    gains = lists(" + ".join(f"{side('r', j, s)} ** 2 / {side('n', j, s)}" for s in (0, 1)) for j in range(3))
    means = lists(lists(f"{side('r', j, s)} / {side('n', j, s)}" for s in (0, 1)) for j in range(3))
    step = lists(
        f"f[{c + 1}] + w * m[best][case best when 1 then {bits[0][c]} when 2 then {bits[1][c]} else {bits[2][c]} end + 1]" for c in cells
    )
    sums = {"n": "count(y)", "ys": "coalesce(sum(y), 0)", "yy": "coalesce(sum(y * y), 0)", "pos": "count(case when y > 0.5 then 1 end)", "neg": "count(case when y <= 0.5 then 1 end)"}
    label = "least(purchase / 100, 1)" if classes else "purchase"
    return f"""with recursive {SQL_HOURLY},
      rows as (select {label} as y, epoch_us(ts) // 3600000000 % 5 = 0 as held, {' + '.join(f'({e})::int * {1 << j}' for j, e in enumerate(_FEATURES))} as c from hourly where purchase is not null),
      cell as (select g.c, h.held, {', '.join(f'{e} as {k}' for k, e in sums.items())}
        from range(8) g(c) cross join (values (false), (true)) h(held) left join rows on rows.c = g.c and rows.held = h.held group by 1, 2),
      train as (select {', '.join(f'list({k} order by c) as {k}' for k in sums)} from cell where not held),
      test as (select {', '.join(f'list({k} order by c) as t{k}' for k in sums)} from cell where held),
      boost as (
        select 0 as round, {lists('0e0' for _ in cells)} as f
        union all
        select round + 1, {step} from (
          select *, list_position(g, list_max(g)) as best, case when round = 0 then 1e0 else {_CURVE_RATE} end as w from (
            select *, {gains} as g, {means} as m from (select round, f, n, {rest} as r from boost, train where round < {_CURVE_ROUNDS}) x) z) q),
      losses as (select round, {total('')} as train_loss, {total('t')} as test_loss from boost, train, test where round > 0),
      lows as (select *, min(test_loss) over (order by round rows unbounded preceding) as low from losses),
      bests as (select l.round, l.train_loss, l.test_loss, (select min(b.round) from losses b where b.round <= l.round and b.test_loss = l.low) as b from lows l),
      ends as (select coalesce(min(round), {_CURVE_ROUNDS}) as stop from bests where round - b >= {_CURVE_PATIENCE}),
      curve as (select round, train_loss, test_loss, (select b from bests x, ends where x.round = stop) as b from bests, ends where round <= stop)
      select 'train' as part, round, {sql_r6('train_loss', 'loss')}, round = b as best from curve
      union all select 'test', round, {sql_r6('test_loss', 'loss')}, round = b from curve"""


def _curve(spark, d, classes: bool):
    """The loss of both parts after every round until the test part's has not fallen for some rounds."""
    label = F.least(F.col("purchase") / 100, F.lit(1.0)) if classes else F.col("purchase")
    rows = hourly(spark, d).where("purchase is not null").select(
        "ts", F.array(*[F.expr(e).cast("double") for e in _FEATURES]).alias("features"), F.array(label).alias("target")
    )
    held = F.pmod(F.floor(F.unix_micros("ts") / 3_600_000_000), F.lit(5)) == 0
    train, test = stored(rows.where(~held)), stored(rows.where(held))
    fit = models.train_classifier if classes else models.train_regressor
    found = fit(train, test, rounds=_CURVE_ROUNDS, depth=1, subsample=1.0, feature_share=1.0, rate=_CURVE_RATE, patience=_CURVE_PATIENCE)
    return found.frame(spark).select("part", "round", r6("loss"), "best")


@query("loss_curve", _sql_boosting(False))
def loss_curve(spark, d):
    return _curve(spark, d, False)


@query("loss_curve_classes", _sql_boosting(True))
def loss_curve_classes(spark, d):
    return _curve(spark, d, True)


def _line_model(data: bytes):
    """A straight line over the mean of the known inputs, from its two stored numbers."""
    intercept, slope = np.frombuffer(data, "<f8")

    def predict(x: np.ndarray) -> np.ndarray:
        return intercept + slope * np.nanmean(x, axis=1, keepdims=True)

    return predict


@query(
    "score_samples",
    f"""with {SQL_HOURLY}, {_SQL_ROWS.format(extra="sum(case when step < 23 then " + " + ".join(f"coalesce({c}, 0)" for c in INPUTS) + " end) as total")},
      usable as (select sample_id, total / present as x, target from loaded where target is not null and present > 0),
      line as (select regr_slope(target, x) as slope, regr_intercept(target, x) as intercept from usable)
      select sample_id, {sql_r6('intercept + slope * x', 'pred')}, {sql_r6('target', 'target')} from usable, line""",
)
def score_samples(spark, d):
    """A line is fitted, stored, sent to the workers and loaded there to score samples in batches."""
    found = stored(_loaded(spark, d, fault_tolerant=True))
    known = F.filter("features", lambda v: v.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, b: a + b) / F.size(known)
    rows = found.where(F.size(known) > 0).select(array_to_vector(F.array(mean)).alias("x"), F.col("target")[0].alias("y")).where("y is not null")
    numbers = [math.nan, math.nan]  # nothing to learn from
    if not rows.isEmpty():
        line = LinearRegression(featuresCol="x", labelCol="y", solver="normal").fit(rows)
        numbers = [line.intercept, line.coefficients[0]]
    path = scratch(spark, "line")
    models.store_model(spark, np.array(numbers, "<f8").tobytes(), path)
    scored = models.score_batches(found, models.stored_model(spark, path, _line_model), size=92)
    return scored.select("sample_id", r6(F.col("pred")[0], "pred"), r6(F.col("target")[0], "target"))
