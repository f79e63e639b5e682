"""Measurement series derived from the given tables, in Spark and as SQL.

Means are taken from sums of whole hundredths, so both engines start from equal numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators.ordered import Axis
from gaugeline.sources.tables import fresh_path as scratch  # noqa: F401

TYPES = ("click", "error", "purchase", "signup", "view")

HORIZON = 4

PLAIN = Axis(time="ts")
BY_USER = Axis(time="ts", keys=("user_id",))
BY_TYPE = Axis(time="ts", keys=("event_type",))


def table(spark: SparkSession, sf_dir: str, name: str, *times: str) -> DataFrame:
    """A given table; the listed columns become timestamps in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({t: F.col(t).cast("timestamp") for t in times}) if times else df


def micros(time: str = "ts") -> Column:
    return F.unix_micros(F.col(time)).alias(time)


def r6(value: Column | str, name: str | None = None, places: int = 6) -> Column:
    """Cut to decimal places for comparison. Written out alike for both engines, whose own rounding
    differs at ties; the shift of 0.37 keeps the steps away from means of hundredths."""
    c = F.col(value) if isinstance(value, str) else value
    cut = F.floor(c * 10.0**places + 0.37) / 10.0**places
    return cut.alias(name or value) if name or isinstance(value, str) else cut


def r3(value: Column | str, name: str | None = None) -> Column:
    """For values in the hundred thousands, where six places are beyond a double's sums."""
    return r6(value, name, 3)


def _mean(value: Column, when: Column | None = None) -> Column:
    cents = F.rint(value * 100).cast("bigint")
    cents = cents if when is None else F.when(when, cents)
    return F.try_divide(F.sum(cents).cast("double"), F.count(cents) * F.lit(100.0))


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events", "ts")


def hourly(spark, sf_dir) -> DataFrame:
    """One row per hour, one column per event type."""
    return events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(
        *[_mean(F.col("value"), F.col("event_type") == t).alias(t) for t in TYPES]
    )


def user_hourly(spark, sf_dir) -> DataFrame:
    """Sparse keyed series: ``(user_id, ts, value, high)``, ``high`` is present above 60 only."""
    df = events(spark, sf_dir).groupBy("user_id", F.date_trunc("hour", "ts").alias("ts")).agg(
        _mean(F.col("value")).alias("value")
    )
    return df.withColumn("high", F.when(F.col("value") > 60, F.col("value")))


def type_hourly(spark, sf_dir) -> DataFrame:
    """Dense keyed series with a few gaps: ``(event_type, ts, value, high)``."""
    df = events(spark, sf_dir).groupBy("event_type", F.date_trunc("hour", "ts").alias("ts")).agg(
        _mean(F.col("value")).alias("value")
    )
    return df.withColumn("high", F.when(F.col("value") > 60, F.col("value")))


def order_hours(spark, sf_dir) -> DataFrame:
    """Several years of history: order totals, at an hour of the day taken from the order key."""
    o = table(spark, sf_dir, "orders", "o_orderdate")
    ts = F.timestamp_micros(F.unix_micros("o_orderdate") + F.pmod("o_orderkey", F.lit(24)) * F.lit(3_600_000_000))
    return o.groupBy(ts.alias("ts")).agg(_mean(F.col("o_totalprice")).alias("value"))


def limits_wide(spark, sf_dir) -> DataFrame:
    """One-row limit table: the mean of each event type."""
    return events(spark, sf_dir).agg(*[_mean(F.col("value"), F.col("event_type") == t).alias(t) for t in TYPES])


def hour_number(time: str = "ts") -> Column:
    return F.floor(F.unix_micros(F.col(time)) / 3_600_000_000).cast("bigint")


def predictions(spark, sf_dir) -> DataFrame:
    """Two forecasts of clicks and purchases by the other columns of the hour; ``HORIZON`` hours make a sample."""
    h = hourly(spark, sf_dir)
    rows = [
        F.struct(F.lit(m).alias("model"), F.lit(p).alias("param"), F.col(a).alias("pred"), F.col(p).alias("target"))
        for m, p, a in (
            ("first", "click", "error"), ("first", "purchase", "signup"),
            ("second", "click", "view"), ("second", "purchase", "error"),
        )
    ]
    hour = hour_number()
    steps = F.lit(HORIZON)
    return h.select(
        F.floor(hour / steps).cast("bigint").alias("sample_id"), F.pmod(hour, steps).cast("int").alias("step"), F.inline(F.array(*rows))
    )


# --- the same in SQL -------------------------------------------------------------------------


def _sql_mean(value: str, when: str | None = None) -> str:
    cents = f"cast(round({value} * 100) as bigint)"
    cents = cents if when is None else f"case when {when} then {cents} end"
    return f"cast(sum({cents}) as double) / nullif(100e0 * count({cents}), 0)"


def sql_r6(value: str, name: str, places: int = 6) -> str:
    return f"(floor(({value}) * 1e{places} + 0.37) / 1e{places}) as {name}"


def sql_r3(value: str, name: str) -> str:
    return sql_r6(value, name, 3)


SQL_HOURLY = "hourly as (select date_trunc('hour', ts) as ts, {} from events group by 1)".format(
    ", ".join(f"{_sql_mean('value', f'event_type = {t!r}')} as {t}" for t in TYPES)
)
SQL_USER_HOURLY = f"""user_base as (
    select user_id, date_trunc('hour', ts) as ts, {_sql_mean('value')} as value from events group by 1, 2),
  user_hourly as (select *, case when value > 60 then value end as high from user_base)"""
SQL_TYPE_HOURLY = f"""type_base as (
    select event_type, date_trunc('hour', ts) as ts, {_sql_mean('value')} as value from events group by 1, 2),
  type_hourly as (select *, case when value > 60 then value end as high from type_base)"""
SQL_ORDER_HOURS = f"""order_hours as (
    select cast(o_orderdate as timestamp) + (o_orderkey % 24) * interval 1 hour as ts,
           {_sql_mean('o_totalprice')} as value
    from orders group by 1)"""
SQL_LIMITS = "limits as (select {} from events)".format(
    ", ".join(f"{_sql_mean('value', f'event_type = {t!r}')} as {t}" for t in TYPES)
)
SQL_LIMITS_LONG = "limits_long as (select param, lim from (unpivot limits on {} into name param value lim))".format(
    ", ".join(TYPES)
)
SQL_PREDICTIONS = f"""predictions as (
    select epoch_us(ts) // 3600000000 // {HORIZON} as sample_id, cast(epoch_us(ts) // 3600000000 % {HORIZON} as int) as step,
      x.model, x.param, x.pred, x.target
    from hourly, lateral (values
      ('first', 'click', error, click), ('first', 'purchase', signup, purchase),
      ('second', 'click', view, click), ('second', 'purchase', error, purchase)) as x(model, param, pred, target))"""
