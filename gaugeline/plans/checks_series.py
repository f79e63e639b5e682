"""Queries on regular time: duplicates, spine, gaps, segments, rolling sums and joined sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import combine, gaps
from gaugeline.operators.ordered import LAYOUT
from gaugeline.operators.rolling import rolling_sum as rolling
from gaugeline.plans import flows, site
from gaugeline.plans.fixtures import (
    BY_TYPE, BY_USER, PLAIN, SQL_HOURLY, SQL_TYPE_HOURLY, SQL_USER_HOURLY, events, hourly, micros, r6, sql_r6,
    type_hourly, user_hourly,
)
from gaugeline.plans.registry import query
from gaugeline.sources.tables import bucketed, stored


@query(
    "dedup_time",
    """select user_id, epoch_us(h) as ts, v, event_type from (
         select *, row_number() over (partition by user_id, h order by v is null, v, event_id) as nth from (
           select user_id, date_trunc('hour', ts) as h, case when event_id % 3 > 0 then value end as v, event_type, event_id from events)) where nth = 1""",
)
def dedup_time(spark, d):
    """Of readings in one hour the lowest stays, a missing one only if there is no other."""
    v = F.when(F.pmod("event_id", F.lit(3)) > 0, F.col("value"))
    rows = events(spark, d).select("user_id", F.date_trunc("hour", "ts").alias("ts"), "event_id", v.alias("v"), "event_type")
    return gaps.dedup_time(rows, BY_USER, ["v", "event_id"]).select("user_id", micros(), "v", "event_type")


@query(
    "duplicate_times",
    "select user_id, epoch_us(date_trunc('hour', ts)) as ts, count(*) as n from events group by 1, 2 having count(*) > 1",
)
def duplicate_times(spark, d):
    rows = events(spark, d).select("user_id", F.date_trunc("hour", "ts").alias("ts"))
    return gaps.duplicate_times(rows, BY_USER).select("user_id", micros(), "n")


def _sql_spine(source: str, key: str) -> str:
    return f"""spans as (select {key}, min(ts) as lo, max(ts) as hi from {source} group by 1),
      spine as (select {key}, unnest(generate_series(lo, hi, interval 1 hour)) as ts from spans)"""


@query(
    "hourly_spine",
    f"""with {SQL_USER_HOURLY}, {_sql_spine('user_hourly', 'user_id')}
      select s.user_id, epoch_us(s.ts) as ts, {sql_r6('u.value', 'value')} from spine s
      left join user_hourly u on u.user_id = s.user_id and u.ts = s.ts""",
)
def hourly_spine(spark, d):
    df = user_hourly(spark, d).select("user_id", "ts", "value")
    return gaps.align(gaps.hourly_spine([df], BY_USER), df, BY_USER).select("user_id", micros(), r6("value"))


_ALIGNED = ("click", "error", "purchase", "signup", "view")


@query(
    "align_sparse",
    "with "
    + ", ".join(
        f"""{t}s as (select user_id, (epoch_us(ts) + 1800000000) // 3600000000 as h, arg_min(value, ts) as {t}
               from events where event_type = '{t}' group by 1, 2)"""
        for t in _ALIGNED
    )
    + f""", spans as (select user_id, min(h) as lo, max(h) as hi from ({" union all ".join(f"select user_id, h from {t}s" for t in _ALIGNED)}) group by 1),
      spine as (select user_id, unnest(generate_series(lo, hi)) as h from spans),
      laid as (select * from spine {" ".join(f"left join {t}s using (user_id, h)" for t in _ALIGNED)})
      select user_id, h * 3600000000 as ts, click, error, signup, view,
             case when purchase is null then null when purchase > 50 then 1 else 0 end as purchase,
             case when purchase is null then null when purchase > 50 then 1 else 0 end as anomaly from laid""",
)
def align_sparse(spark, d):
    e = events(spark, d)
    part = lambda t: e.where(F.col("event_type") == t).select("user_id", "ts", F.col("value").alias(t))
    limits = {"purchase": {"purchase": 50.0}}
    combined = flows.combine_sparse([(part(t), limits.get(t)) for t in _ALIGNED], BY_USER)
    return combined.select("user_id", micros(), *_ALIGNED, "anomaly")


# --- gaps ------------------------------------------------------------------------------------


def _sql_line(source: str, key: str, column: str, extra: str = "") -> str:
    """Row numbers and known neighbours of a column."""
    part = f"partition by {key} order by ts"
    return f"""numbered as (select *, row_number() over ({part}) as rn from {source}),
      near as (select *,
        last_value(case when {column} is not null then rn end ignore nulls) over ({part} rows unbounded preceding) as i0,
        last_value({column} ignore nulls) over ({part} rows unbounded preceding) as x0,
        first_value(case when {column} is not null then rn end ignore nulls) over ({part} rows between current row and unbounded following) as i1,
        first_value({column} ignore nulls) over ({part} rows between current row and unbounded following) as x1
      from numbered)"""


_LINE = "x0 + (x1 - x0) / (i1 - i0) * (rn - i0)"


@query(
    "interpolate_linear",
    f"""with {SQL_USER_HOURLY}, {_sql_line('user_hourly', 'user_id', 'high')}
      select user_id, epoch_us(ts) as ts,
        {sql_r6(f'case when high is not null then high when i0 is null then null when i1 is null then x0 else {_LINE} end', 'high')} from near""",
)
def interpolate_linear(spark, d):
    return gaps.interpolate(user_hourly(spark, d), BY_USER, ["high"]).select("user_id", micros(), r6("high"))


@query(
    "interpolate_limited",
    f"""with {SQL_USER_HOURLY}, {_sql_line('user_hourly', 'user_id', 'high')}
      select user_id, epoch_us(ts) as ts,
        {sql_r6(f'''case when high is not null then high when not (coalesce(rn - i0 <= 2, false) or coalesce(i1 - rn <= 2, false)) then null
             when i0 is null then x1 when i1 is null then x0 else {_LINE} end''', 'high')} from near""",
)
def interpolate_limited(spark, d):
    df = gaps.interpolate(user_hourly(spark, d), BY_USER, ["high"], limit=2, direction="both")
    return df.select("user_id", micros(), r6("high"))


_SQL_INSERTED = """stepped as (select user_id, ts, value, lead(ts) over (partition by user_id order by ts) as nxt from user_hourly),
      hours as (select *, date_diff('hour', ts, nxt) as step from stepped),
      inserted as (select user_id, ts, value, 0 as flag from hours union all
        select user_id, ts + k * interval 1 hour, null, 1 from hours, generate_series(1, 5) g(k) where step between 2 and 6 and k < step)"""


@query(
    "fill_small_gaps",
    f"""with {SQL_USER_HOURLY}, {_SQL_INSERTED}, {_sql_line('inserted', 'user_id', 'value')}
      select user_id, epoch_us(ts) as ts, flag as "Interpolated",
        case when value is not null then value when i0 is null then null when i1 is null then x0
             else floor(({_LINE}) * 1e6 + 0.37) / 1e6 end as value from near""",
)
def fill_small_gaps(spark, d):
    df = user_hourly(spark, d).select("user_id", "ts", "value")
    filled = gaps.fill_small_gaps(df, BY_USER, ["value"], places=None, store=stored)
    return filled.select(
        "user_id", micros(), "Interpolated",
        F.when(F.col("Interpolated") == 0, F.col("value")).otherwise(r6(F.col("value"))).alias("value"),
    )


_SQL_RUNS = """{name}_n as (select *, row_number() over (partition by {key} order by ts) as rn0 from {source}),
      {name}_r as (select *, rn0 - row_number() over (partition by {key}, {column} is null order by ts) as run from {name}_n),
      {name} as (select * exclude (rn0, run, len) from (select *, count(*) over (partition by {key}, {column} is null, run) as len from {name}_r)
                 where not ({column} is null and len > {gap}))"""


@query(
    "drop_long_gaps",
    f"""with {SQL_USER_HOURLY}, {_SQL_RUNS.format(name='kept', key='user_id', source='user_hourly', column='high', gap=3)}
      select user_id, epoch_us(ts) as ts, {sql_r6('value', 'value')}, {sql_r6('high', 'high')} from kept""",
)
def drop_long_gaps(spark, d):
    return gaps.drop_long_gaps(user_hourly(spark, d), BY_USER, ["high"], 3).select("user_id", micros(), r6("value"), r6("high"))


_LOW = 90


@query(
    "add_source",
    f"""with {SQL_TYPE_HOURLY}, {SQL_USER_HOURLY},
      buys as (select event_type, date_trunc('hour', ts) as ts, min(value) as extra from events where value > {_LOW} group by 1, 2),
      merged as (select t.event_type, t.ts, t.value, b.extra from type_hourly t left join buys b using (event_type, ts)),
      {_SQL_RUNS.format(name='kept', key='event_type', source='merged', column='extra', gap=3)},
      {_sql_line('kept', 'event_type', 'extra')}
      select event_type, epoch_us(ts) as ts, {sql_r6('value', 'value')},
        {sql_r6(f'''case when extra is not null then extra when not (coalesce(rn - i0 <= 3, false) or coalesce(i1 - rn <= 3, false)) then null
             when i0 is null then x1 when i1 is null then x0 else {_LINE} end''', 'extra')} from near""",
)
def add_source(spark, d):
    base = type_hourly(spark, d).select("event_type", "ts", "value")
    joined = combine.add_source(base, _dirty_extra(spark, d), BY_TYPE, max_gap=3)
    return joined.select("event_type", micros(), r6("value"), r6("extra"))


def _dirty_extra(spark, d):
    """The lowest reading above ``_LOW`` of each hour as text, other hours without a number."""
    low = F.min(F.when(F.col("value") > _LOW, F.col("value")))
    extra = events(spark, d).groupBy("event_type", F.date_trunc("hour", "ts").alias("Time")).agg(low.alias("low"))
    missing = F.when(F.pmod(F.hour("Time"), F.lit(2)) == 0, "#N/A").otherwise("")
    return extra.select("event_type", "Time", F.when(F.col("low").isNull(), missing).otherwise(F.format_string("%.2f", "low")).alias("extra"))


@query(
    "clean_profiler",
    f"""with raw as (select user_id, value, epoch_us(ts) as u from events union all select user_id, null, epoch_us(ts) from events where event_id % 4 = 0),
      kept as (select user_id, u, case when value < 5 or value > 120 then null else value end as v, (u // 3600000000 + case when u % 3600000000 > 1800000000
              or (u % 3600000000 = 1800000000 and (u // 3600000000) % 2 = 1) then 1 else 0 end) as h from raw),
      user_hourly as (select user_id, make_timestamp(h * 3600000000) as ts, v as value from (
        select *, row_number() over (partition by user_id, h order by u, v is null, v) as nth from kept) where nth = 1),
      {_SQL_INSERTED}, {_sql_line('inserted', 'user_id', 'value')}
      select user_id, epoch_us(ts) as ts, flag as "Interpolated",
        round_even(case when value is not null then value when i0 is null then null when i1 is null then x0 else {_LINE} end, 2) as sensor from near""",
)
def clean_profiler(spark, d):
    raw = events(spark, d).select("user_id", "ts", F.col("value").alias("parm(1)"))
    # some times come twice, once without a reading
    twice = events(spark, d).where("event_id % 4 = 0").select("user_id", "ts", F.lit(None).cast("double").alias("parm(1)"))
    clean = combine.clean_profiler(
        raw.union(twice), BY_USER, names={"parm(1)": "sensor"}, sensors=["sensor"], bounds={"sensor": (5, 120)}, store=stored
    )
    return clean.select("user_id", micros(), "Interpolated", "sensor")


@query(
    "clean_weather",
    f"""with w as (select user_id, ts, value * 8 - 20 as dir, value - 10 as speed, value * 2 - 30 as gust, value * 3 + 850 as pressure,
             value * 10 - 50 as longwave, value * 15 - 60 as short, value - 5 as rain, value - 20 as air, value * 1.5e0 - 10 as humid from events),
      c as (select user_id, ts, {', '.join(f'case when {c} < {lo} or {c} > {hi} then null else {c} end as {c}' for c, lo, hi in
            (('dir', 0, 360), ('speed', 0, 100), ('gust', 0, 100), ('pressure', 860, 1080), ('longwave', 0, 750), ('rain', 0, 50), ('humid', 0, 100)))},
             case when short < 0 then 0 when short > 900 then null else short end as short, air from w)
      select user_id, epoch_us(ts) as ts, {sql_r6('cos(radians(dir)) * speed', 'wind_x')}, {sql_r6('sin(radians(dir)) * speed', 'wind_y')},
        {', '.join(sql_r6(c, c) for c in ('gust', 'pressure', 'longwave', 'short', 'air', 'humid'))},
        {sql_r6('coalesce(sum(rain) over (partition by user_id order by ts range between interval 24 hour preceding and current row), 0)', 'rain')} from c""",
)
def clean_weather(spark, d):
    """Readings spread so that every bound is passed on both sides."""
    v = F.col("value")
    station = [v * 8 - 20, v - 10, v * 2 - 30, v * 3 + 850, v * 10 - 50, v * 15 - 60, v - 5, v - 20, v * 1.5 - 10]
    raw = events(spark, d).select(
        "user_id", F.col("ts").alias("Time"), *[c.alias(n) for n, c in zip(site.WEATHER_NAMES, station)]
    )
    short = ["wind_x", "wind_y", "gust", "pressure", "longwave", "short", "rain", "air", "humid"]
    clean = flows.clean_weather(raw, BY_USER).withColumnsRenamed(dict(zip(site.WEATHER_COLUMNS, short)))
    return clean.select("user_id", micros(), *[r6(c) for c in short])


# --- segments and rolling sums ---------------------------------------------------------------

_SQL_SEGMENTS = """steps as (select *, coalesce(ts - lag(ts) over (partition by {key} order by ts) > interval 1 hour, false) as brk from {source}),
      seg as (select *, cast(1 + sum(case when brk then 1 else 0 end) over (partition by {key} order by ts rows unbounded preceding) as bigint) as segment from steps),
      numbered as (select *, row_number() over (partition by {key} order by ts) as rn,
        row_number() over (partition by {key}, segment order by ts) as pos from seg)"""


@query(
    "segments",
    f"""with {SQL_TYPE_HOURLY}, {_SQL_SEGMENTS.format(key='event_type', source='type_hourly')}
      select event_type, epoch_us(ts) as ts, segment as "Segment", rn, pos,
        lag(pos) over (partition by event_type order by ts) as prev_pos from numbered""",
)
def segments(spark, d):
    df = gaps.segments(type_hourly(spark, d), BY_TYPE, row="rn", position="pos", previous_position="prev_pos")
    return df.select("event_type", micros(), "Segment", "rn", "pos", "prev_pos")


@query(
    "rolling_sum",
    f"""with {SQL_USER_HOURLY} select user_id, epoch_us(ts) as ts,
        {sql_r6('coalesce(sum(high) over (partition by user_id order by ts range between interval 24 hour preceding and current row), 0)', 'total')}
      from user_hourly""",
)
def rolling_sum(spark, d):
    return rolling(user_hourly(spark, d), BY_USER, "high", 24, name="total").select("user_id", micros(), r6("total"))


_SQL_EXTRA = f"""buys as (select event_type, date_trunc('hour', ts) as ts, min(value) as extra from events where value > {_LOW} group by 1, 2),
      merged as (select t.event_type, t.ts, t.value, b.extra from type_hourly t left join buys b using (event_type, ts)),
      {_SQL_RUNS.format(name='kept', key='event_type', source='merged', column='extra', gap=3)},
      {_sql_line('kept', 'event_type', 'extra')},
      dense as (select event_type, ts, value, case when extra is not null then extra when not (coalesce(rn - i0 <= 3, false) or coalesce(i1 - rn <= 3, false)) then null
             when i0 is null then x1 when i1 is null then x0 else {_LINE} end as extra from near)"""


def _dense(spark, d):
    """Three sources: one dropped and filled, one compared with a limit, one as it is."""
    base = type_hourly(spark, d).select("event_type", "ts", "value").withColumn("Interpolated", F.lit(0))
    noon = F.timestamp_micros(F.unix_micros(F.date_trunc("day", "ts")) + F.lit(12 * 3_600_000_000))
    daily = events(spark, d).groupBy("event_type", noon.alias("Time")).agg(F.max("value").alias("lab"), F.min("value").alias("plant"))
    sources = [
        (_dirty_extra(spark, d), {"max_gap": 3}),
        (daily.select("event_type", "Time", "lab"), {"include_missing": True, "limits": {"lab": 100.0}}),
        (daily.select("event_type", "Time", "plant"), {"include_missing": True}),
    ]
    return flows.combine_dense(base, sources, BY_TYPE, store=lambda df: bucketed(df, LAYOUT))


@query(
    "combine_dense",
    f"""with {SQL_TYPE_HOURLY}, {_SQL_EXTRA}, {_SQL_SEGMENTS.format(key='event_type', source='dense').replace('numbered as', 'placed as')},
      lab as (select event_type, date_trunc('day', ts) + interval 12 hour as ts, max(value) as lab, min(value) as plant from events group by 1, 2)
      select n.event_type, epoch_us(n.ts) as ts, segment as "Segment", {sql_r6('value', 'value')}, {sql_r6('extra', 'extra')}, {sql_r6('plant', 'plant')},
        case when lab is null then null when lab > 100 then 1 else 0 end as lab,
        case when lab is null then null when lab > 100 then 1 else 0 end as anomaly
      from placed n left join lab using (event_type, ts)""",
)
def combine_dense(spark, d):
    return _dense(spark, d).select("event_type", micros(), "Segment", r6("value"), r6("extra"), r6("plant"), "lab", "anomaly")


@query(
    "column_order",
    "select event_type, string_agg(c, ',' order by i) as columns from (select distinct event_type from events), "
    "(values (0, 'event_type'), (1, 'Segment'), (2, 'Interpolated'), (3, 'ts'), (4, 'value'), (5, 'extra'), (6, 'lab'), (7, 'anomaly'), (8, 'plant')) as v(i, c) group by 1",
)
def column_order(spark, d):
    """The metadata columns come after the first column."""
    whole = _dense(spark, d)
    return whole.groupBy("event_type").agg(F.lit(",".join(whole.columns)).alias("columns"))


@query(
    "segment_profile",
    f"""with {SQL_HOURLY},
      spine as (select unnest(generate_series(min(ts), max(ts), interval 1 hour)) as ts from hourly),
      m as (select ts, case when click > 52 then null else click end as click, case when view > 52 then null else view end as view,
              row_number() over (order by ts) as rn from spine left join hourly using (ts)),
      n as (select *, {', '.join(f'''last_value(case when {c} is not null then rn end ignore nulls) over (order by ts rows unbounded preceding) as {c}_i0,
            first_value(case when {c} is not null then rn end ignore nulls) over (order by ts rows between current row and unbounded following) as {c}_i1''' for c in ('click', 'view'))} from m),
      f as (select ts, {', '.join(f"{c} is not null or coalesce(rn - {c}_i0 <= 2, false) or coalesce({c}_i1 - rn <= 2, false) as has_{c}" for c in ('click', 'view'))} from n),
      k as (select ts from f where has_click and has_view),
      s as (select *, cast(sum(case when gap then 1 else 0 end) over (order by ts) + 1 as bigint) as segment
            from (select ts, coalesce(ts - lag(ts) over (order by ts) > interval 1 hour, false) as gap from k))
      select segment as "Segment", count(*) as n, epoch_us(min(ts)) as first, epoch_us(max(ts)) as last from s group by 1""",
)
def segment_profile(spark, d):
    """Range rules, continuous spine, limited fill, segments, and the size of each segment."""
    df = combine.clean_ranges(hourly(spark, d).select("ts", "click", "view"), {"click": (None, 52), "view": (None, 52)})
    whole = stored(gaps.align(gaps.hourly_spine([df], PLAIN), df, PLAIN))
    filled = gaps.interpolate(whole, PLAIN, ["click", "view"], limit=2, direction="both")
    numbered = gaps.segments(filled.dropna(subset=["click", "view"]), PLAIN)
    return numbered.groupBy("Segment").agg(
        F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("ts")).alias("first"), F.unix_micros(F.max("ts")).alias("last")
    )
