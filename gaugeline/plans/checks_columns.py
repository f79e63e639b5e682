"""Queries on sources, columns, scaling, limits and calibration logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline import functions as fn
from gaugeline.operators import calibration, combine, scaling
from gaugeline.plans.fixtures import (
    BY_USER, SQL_HOURLY, SQL_LIMITS, SQL_LIMITS_LONG, SQL_ORDER_HOURS, SQL_PREDICTIONS, SQL_USER_HOURLY,
    TYPES, events, hourly, limits_wide, micros, order_hours, predictions, r6, scratch, sql_r6,
    table, user_hourly,
)
from gaugeline.plans import site
from gaugeline.plans.registry import query
from gaugeline.sources import delimited, params
from gaugeline.sources.logs import read_logs
from gaugeline.sources.tables import fresh_path, stored

# --- sources ---------------------------------------------------------------------------------


@query(
    "read_decimal_comma",
    f"""select event_id, epoch_us(date_trunc('second', ts)) as ts,
        case when event_id % 9 < 6 then value end as v, cast(user_id as double) as w from events""",
)
def read_decimal_comma(spark, d):
    e = events(spark, d)
    text = F.format_string("%.2f", F.col("value"))
    kind = F.pmod("event_id", F.lit(9))
    mixed = (
        F.when(kind < 3, F.regexp_replace(text, r"\.", ",")).when(kind < 6, text).when(kind == 6, "#N/A").when(kind == 7, "")
        .otherwise("NA")
    )
    raw = e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("Time"), mixed.alias("v"), F.col("user_id").cast("string").alias("w"),
        F.col("event_id").cast("string").alias("event_id"),
    )
    path = scratch(spark, "comma")
    raw.write.option("header", True).option("sep", ";").csv(path)
    read = delimited.read_measurements(spark, path, raw.columns, decimal="comma", texts=["event_id"])
    return read.select(F.col("event_id").cast("bigint").alias("event_id"), micros("Time").alias("ts"), "v", "w")


@query(
    "read_decimal_point",
    """select event_id, epoch_us(date_trunc('second', ts)) as ts, case when event_id % 5 < 2 then round(value, 2) end as v from events""",
)
def read_decimal_point(spark, d):
    """A table written with commas and decimal points, with marks for missing values, and read back."""
    kind = F.pmod("event_id", F.lit(5))
    text = F.format_string("%.2f", F.col("value"))
    v = F.when(kind < 2, text).when(kind == 2, F.regexp_replace(text, r"\.", ",")).when(kind == 3, "NA").otherwise("")
    raw = events(spark, d).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("Time"), v.alias("v"), F.col("event_id").cast("string").alias("event_id"))
    path = scratch(spark, "point")
    delimited.write_table(raw, path, format="csv")
    read = delimited.read_measurements(spark, path, raw.columns, sep=",", decimal="point", texts=["event_id"])
    return read.select(F.col("event_id").cast("bigint").alias("event_id"), micros("Time").alias("ts"), "v")


@query("read_limits", f"with {SQL_LIMITS}, {SQL_LIMITS_LONG} select param, round(lim, 4) as \"limit\" from limits_long")
def read_limits(spark, d):
    """The limits written as a file with semicolons and a byte-order mark, and read back."""
    values = F.concat_ws(";", *[F.format_string("%.4f", F.col(t)) for t in TYPES])
    path = scratch(spark, "limits")
    limits_wide(spark, d).select(F.concat(F.lit("\ufeff" + ";".join(TYPES) + "\n"), values)).coalesce(1).write.text(path)
    return combine.limits_long(delimited.read_limits(spark, path))


@query("limits_long", f"with {SQL_LIMITS}, {SQL_LIMITS_LONG} select param, {sql_r6('lim', '\"limit\"')} from limits_long")
def limits_long(spark, d):
    return combine.limits_long(limits_wide(spark, d)).select("param", r6("limit"))


@query(
    "norm_params",
    f"with {SQL_HOURLY} "
    + " union all ".join(f"select '{t}' as param, {sql_r6(f'min({t})', 'min')}, {sql_r6(f'max({t})', 'max')} from hourly" for t in TYPES),
)
def norm_params(spark, d):
    path = scratch(spark, "params")
    params.save_params(scaling.measure(hourly(spark, d), TYPES), path)
    return params.load_params(spark, path).select("param", r6("min"), r6("max"))


#: A column of the site for each event type; views have none.
_SITE_COLUMNS = {"purchase": "Sink (Zn)", "signup": "SCADA - pH", "click": "Pfl - pH", "error": "Humidity (%)"}


@query(
    "route_source",
    """with c(param, source, p, w) as (values ('purchase','lab',0,550e0), ('signup','scada',1,3e0),
         ('click','profiler',2,3e0), ('error','weather',3,3e0))
       select user_id, epoch_us(hour) as hour, arg_min(source, p) as source, coalesce(arg_min(w, p), 3) as window_hours
       from (select distinct user_id, date_trunc('hour', ts) as hour, event_type from events) e
       left join c on c.param = e.event_type group by 1, 2""",
)
def route_source(spark, d):
    names = F.create_map(*[F.lit(x) for kv in _SITE_COLUMNS.items() for x in kv])
    param = F.try_element_at(names, F.col("event_type")).alias("param")
    asked = events(spark, d).select("user_id", F.date_trunc("hour", "ts").alias("hour"), param).distinct()
    found = params.route_source(asked, params.catalogue_table(spark, site.SOURCE_CATALOGUE), ["user_id", "hour"])
    return found.select("user_id", micros("hour"), "source", "window_hours")


@query(
    "combined_roundtrip",
    f"with {SQL_USER_HOURLY} select user_id, epoch_us(ts) as ts, {sql_r6('value', 'value')}, {sql_r6('high', 'high')} from user_hourly",
)
def combined_roundtrip(spark, d):
    path = scratch(spark, "combined")
    df = user_hourly(spark, d).withColumn("day", F.to_date("ts"))
    delimited.write_table(df, path, partition_by=["day"])
    return spark.read.parquet(path).select("user_id", micros(), r6("value"), r6("high"))


# --- columns ---------------------------------------------------------------------------------


@query("rename_select", "select l_orderkey as order_id, l_quantity as qty, l_tax from lineitem")
def rename_select(spark, d):
    named = combine.rename(table(spark, d, "lineitem"), {"l_orderkey": "order_id", "l_quantity": "qty", "unknown": "x"})
    return combine.select(named, ["order_id", "qty", "l_tax"])


@query(
    "parse_times",
    "select event_id, case when event_id % 4 < 2 then epoch_us(date_trunc('second', ts)) end as t from events",
)
def parse_times(spark, d):
    kind = F.pmod("event_id", F.lit(4))
    text = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(kind == 1, F.date_format("ts", "M/d/yyyy h:mm:ss a"))
        .when(kind == 2, "<Unknown>").otherwise("")
    )
    parsed = fn.parse_time(F.col("text"), calibration.LOG_TIME_FORMATS)
    return events(spark, d).withColumn("text", text).select("event_id", F.unix_micros(parsed).alias("t"))


@query(
    "round_hour",
    """with u as (select event_id, epoch_us(ts) as u, epoch_us(date_trunc('hour', ts)) + 1800000000 as h from events)
       select event_id,
         (u // 3600000000 + case when u % 3600000000 > 1800000000 then 1 when u % 3600000000 = 1800000000
            and (u // 3600000000) % 2 = 1 then 1 else 0 end) * 3600000000 as rounded,
         (h // 3600000000 + (h // 3600000000) % 2) * 3600000000 as from_half
       from u""",
)
def round_hour(spark, d):
    half = F.timestamp_micros(F.unix_micros(F.date_trunc("hour", "ts")) + 1_800_000_000)
    return events(spark, d).select(
        "event_id", F.unix_micros(fn.round_hour(F.col("ts"))).alias("rounded"), F.unix_micros(fn.round_hour(half)).alias("from_half")
    )


@query(
    "range_clean",
    """select l_orderkey, l_linenumber,
         case when l_extendedprice < 2000 or l_extendedprice > 50000 then null else l_extendedprice end as price,
         case when l_orderkey % 7 = 0 then null when l_quantity < 5 then null else l_quantity end as quantity,
         (floor((case when l_discount - 0.05 < 0 then 0 else l_discount - 0.05 end) * 1e6 + 0.37) / 1e6) as discount,
         case when l_shipdate < timestamp '1996-01-01' or l_shipdate > timestamp '1999-12-31' then null
              else epoch_us(l_shipdate) end as shipped
       from lineitem""",
)
def range_clean(spark, d):
    li = table(spark, d, "lineitem", "l_shipdate").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"),
        F.when(F.pmod("l_orderkey", F.lit(7)) == 0, F.lit(-9999.0)).otherwise(F.col("l_quantity")).alias("quantity"),
        (F.col("l_discount") - 0.05).alias("discount"), F.col("l_shipdate").alias("shipped"),
    )
    day = lambda t: F.lit(t).cast("timestamp")
    bounds = {"price": (2000, 50000), "quantity": (5, None), "shipped": (day("1996-01-01"), day("1999-12-31"))}
    clean = combine.clean_ranges(li, bounds, floored=["discount"], sentinels=[-9999.0])
    return clean.select("l_orderkey", "l_linenumber", "price", "quantity", r6("discount"), micros("shipped"))


@query(
    "to_numeric",
    "select event_id, case when event_id % 8 < 3 then value end as v from events",
)
def to_numeric(spark, d):
    kind = F.pmod("event_id", F.lit(8))
    text = F.format_string("%.2f", F.col("value"))
    dirty = (
        F.when(kind == 0, text).when(kind == 1, F.concat(F.lit(" "), text, F.lit(" "))).when(kind == 2, F.concat(text, F.lit("e0")))
        .when(kind == 3, "").when(kind == 4, "  ").when(kind == 5, F.concat(text, F.lit(" NA")))
        .when(kind == 6, F.regexp_replace(text, r"\.", ",")).otherwise("#N/A")
    )
    raw = events(spark, d).select("event_id", dirty.alias("v"))
    return combine.to_numbers(raw, ["v"])


@query(
    "decompose_direction",
    f"""select event_id, {sql_r6('cos(radians(value % 360)) * user_id', 'deg_x')},
        {sql_r6('sin(radians(value % 360)) * user_id', 'deg_y')}, user_id as mag from events""",
)
def decompose_direction(spark, d):
    df = events(spark, d).select("event_id", (F.col("value") % 360).alias("deg"), F.col("user_id").alias("mag"))
    return combine.decompose_direction(df, "deg", "mag").select("event_id", r6("deg_x"), r6("deg_y"), "mag")


@query(
    "binarize",
    f"""with {SQL_HOURLY}, {SQL_LIMITS},
      b as (select epoch_us(h.ts) as ts, {', '.join(f'case when h.{t} is null then null when h.{t} > l.{t} then 1 else 0 end as {t}' for t in TYPES)}
            from hourly h, limits l)
      select *, greatest({', '.join(TYPES)}) as anomaly from b""",
)
def binarize(spark, d):
    return combine.binarize(hourly(spark, d), TYPES, limits_wide(spark, d)).withColumn("ts", micros())


@query(
    "binarize_predictions",
    f"""with {SQL_HOURLY}, {SQL_LIMITS}, {SQL_LIMITS_LONG}, {SQL_PREDICTIONS}
      select sample_id, step, model, param, case when pred > lim then 1 else 0 end as pred,
             case when target > lim then 1 else 0 end as target
      from predictions join limits_long using (param)""",
)
def binarize_predictions(spark, d):
    from gaugeline.operators import metrics

    return metrics.binarize_predictions(predictions(spark, d), combine.limits_long(limits_wide(spark, d)))


@query(
    "minmax_scale",
    f"with {SQL_HOURLY}, p as (select {', '.join(f'min({t}) as lo_{t}, max({t}) as hi_{t}' for t in TYPES)} from hourly) "
    f"select epoch_us(ts) as ts, {', '.join(sql_r6(f'({t} - lo_{t}) / (hi_{t} - lo_{t})', t) for t in TYPES)}, 0.5e0 as flat from hourly, p",
)
def minmax_scale(spark, d):
    df = hourly(spark, d).withColumn("flat", F.when(F.hour("ts") > 3, F.lit(7.0)))
    scaled = scaling.scale(df, [*TYPES, "flat", "unknown"])
    return scaled.select(micros(), *[r6(t) for t in TYPES], "flat")


@query(
    "apply_scale",
    f"""with {SQL_HOURLY}, p as (select {', '.join(f"min({t}) filter (ts < timestamp '2024-01-16') as lo_{t}, max({t}) filter (ts < timestamp '2024-01-16') as hi_{t}" for t in TYPES[:4])},
        min(view) as lo_view, max(view) as hi_view from hourly)
      select epoch_us(ts) as ts, {', '.join(sql_r6(f'({t} - lo_{t}) / (hi_{t} - lo_{t}) * 2 - 1', t) for t in TYPES)} from hourly, p""",
)
def apply_scale(spark, d):
    df = hourly(spark, d)
    saved = scaling.measure(df.where(fn.in_time_range(F.col("ts"), end=F.lit("2024-01-16").cast("timestamp"))), TYPES[:4])
    table_ = scaling.merge_params(saved, scaling.measure(df, TYPES))
    return scaling.scale(df, TYPES, table_, -1.0, 1.0).select(micros(), *[r6(t) for t in TYPES])


@query(
    "unscale",
    f"""with {SQL_HOURLY}, {SQL_PREDICTIONS},
      p as (select 'click' as param, min(click) as lo, max(click) as hi from hourly
            union all select 'purchase', min(purchase), max(purchase) from hourly)
      select sample_id, step, model, param, {sql_r6('pred / 100 * (hi - lo) + lo', 'pred')}, {sql_r6('target / 100 * (hi - lo) + lo', 'target')}
      from predictions join p using (param)""",
)
def unscale(spark, d):
    saved = scaling.measure(hourly(spark, d), ["click", "purchase"])
    back = scaling.unscale(predictions(spark, d), saved, ["pred", "target"], low=0.0, high=100.0)
    return back.select("sample_id", "step", "model", "param", r6("pred"), r6("target"))


@query(
    "season_keys",
    f"""with {SQL_ORDER_HOURS} select epoch_us(ts) as ts, year(ts) as year, dayofyear(ts) as doy,
        hour(ts) + minute(ts) / 60e0 as hour from order_hours""",
)
def season_keys(spark, d):
    return order_hours(spark, d).select(micros(), *fn.season_keys(F.col("ts")))


@query(
    "season_overlay",
    f"""with {SQL_ORDER_HOURS} select year(ts) as year, (dayofyear(ts) - 1) * 24 + hour(ts) as hour_of_year,
        {sql_r6('value', 'value')} from order_hours""",
)
def season_overlay(spark, d):
    rows = order_hours(spark, d).select(F.year("ts").alias("year"), fn.hour_of_year(F.col("ts")).alias("hour_of_year"), r6("value"))
    return rows.orderBy("year", "hour_of_year")


@query(
    "limit_lines",
    f"""with {SQL_HOURLY}, {SQL_LIMITS}, {SQL_LIMITS_LONG},
      p as (select param, min(v) as lo, max(v) as hi from
            (unpivot (select click, purchase, view from hourly) on click, purchase, view into name param value v) group by 1)
      select param, {sql_r6('case when x > 1 then 1 when x < 0 then 0 else x end', '\"limit\"')}
      from (select param, (lim * 3 - lo) / (hi - lo) as x from limits_long join p using (param))""",
)
def limit_lines(spark, d):
    wide = limits_wide(spark, d).select(*[(F.col(t) * 3).alias(t) for t in TYPES])
    wanted = ["view", "purchase", "click", "unknown"]
    return combine.limit_lines(wide, wanted, scaling.measure(hourly(spark, d), wanted)).select("param", r6("limit"))


@query(
    "safe_name",
    r"""select p_partkey, regexp_replace(p_type || '/' || p_brand || ': "' || p_name || '" <' || p_size || '>?*|\', '[\\/*?:"<>|]', '_', 'g') as name from part""",
)
def safe_name(spark, d):
    name = F.concat("p_type", F.lit("/"), "p_brand", F.lit(': "'), "p_name", F.lit('" <'), "p_size", F.lit(">?*|\\"))
    return table(spark, d, "part").select("p_partkey", fn.file_safe(name).alias("name"))


@query("date_range", f"""with {SQL_HOURLY} select epoch_us(ts) as ts, {sql_r6('click', 'click')} from hourly
    where ts between timestamp '2024-01-05' and timestamp '2024-01-20'""")
def date_range(spark, d):
    a, b = (F.lit(t).cast("timestamp") for t in ("2024-01-05", "2024-01-20"))
    return hourly(spark, d).where(fn.in_time_range(F.col("ts"), a, b, "both")).select(micros(), r6("click"))


@query(
    "melt_values",
    f"with {SQL_USER_HOURLY} select user_id, epoch_us(ts) as ts, 'value' as series, {sql_r6('value', 'value')} from user_hourly "
    f"union all select user_id, epoch_us(ts), 'high', {sql_r6('high', 'value')} from user_hourly",
)
def melt_values(spark, d):
    df = user_hourly(spark, d).withColumn("ts", micros())
    return df.unpivot(["user_id", "ts"], ["value", "high"], "series", "value").withColumn("value", r6("value"))


@query(
    "column_groups",
    f"with {SQL_HOURLY} "
    + " union all ".join(f"select epoch_us(ts) as ts, '{t}' as param, {sql_r6(t, 'value')} from hourly" for t in ("click", "view", "purchase")),
)
def column_groups(spark, d):
    groups = {"inputs": ["click", "view"], "other": ["error", "signup"], "outputs": ["purchase", "missing"]}
    return combine.observed_values(hourly(spark, d), "ts", groups, ["inputs", "outputs"]).select(micros(), "param", r6("value"))


# --- calibration logs ------------------------------------------------------------------------


#: At some 1.1 kB a log, 2.3 MB.
LOGS_OF_A_FILE = 2048

#: Some 3.5 GB in the three places that hold them.
LOGS_OF_A_BATCH = 1 << 20


def event_batches(spark, d):
    """The events in parts of some ``LOGS_OF_A_BATCH`` rows, written once: dealt by place, as keys may repeat or be null."""
    e = events(spark, d)
    n = -(-e.count() // LOGS_OF_A_BATCH)
    if n <= 1:
        return [e]
    path = fresh_path(spark, "events")
    e = e.select("event_id", "ts", "user_id", "event_type", "value")
    dealt = e.withColumn("batch", F.pmod(F.monotonically_increasing_id(), F.lit(n))).repartition(n, "batch")
    dealt.write.partitionBy("batch").parquet(path)
    read = spark.read.parquet(path)
    return [read.where(F.col("batch") == i).drop("batch") for i in range(n)]


def log_texts(spark, d):
    return texts_of(events(spark, d))


def texts_of(e):
    """One log per event with a chapter for each of two sensors, in the export format."""
    # as many logs in many files are spread over tasks
    e = e.repartition(e.sparkSession.sparkContext.defaultParallelism, "event_id")
    v, when = F.col("value"), lambda t: F.date_format(t, "M/d/yyyy h:mm:ss a")
    number = lambda x: F.format_string("%.2f", x)
    earlier = F.timestamp_micros(F.unix_micros("ts") - F.col("user_id") * F.lit(60_000_000))

    def chapter(kind, unit, shift):
        return F.concat(
            F.lit("Last Calibration Time=,"), when(earlier), F.lit("\r\nCalibration Start Time=,"), when(F.col("ts")),
            F.lit("\r\nCalibration End Time=,"), when(F.col("ts")), F.lit("\r\nCalibration Status=, "), F.col("event_type"),
            F.lit(f"\r\nParameter Type=,{kind}\r\n\r\n[Cal Point 1]\r\nStandard=,7.00 {unit}\r\nPre Calibration Value=,"),
            number(v), F.lit(f" {unit}\r\nPost Calibration Value=,"), number(v + shift), F.lit("\r\nno pair here\r\nPre Calibration Value=,"),
            number(v * 2), F.lit("\r\nPost Calibration Value=,n/a\r\nPre Calibration Value=,"), number(v * 3), F.lit("\r\nPost Calibration Value=,"),
            number(v * 3 + 0.25), F.lit("\r\nCalibration Status=,overridden\r\n\r\n\r\n[Cal Point 2]\r\nStandard=,4.00 "),
            F.lit(f"{unit}\r\nPre Calibration Value=,"), number(v + 1), F.lit("\r\n"),
        )

    content = F.concat(
        F.lit("KorEXO Calibration File Export v2\r\n"), chapter("pH", "pH", 1.5), F.lit("----------\r\n"), chapter("Sp Cond (µS/cm)", "µS/cm", -0.5),
    )
    return e.select("event_id", content.alias("content"))


_SQL_LOGS = """rows as (select e.*, c.chapter, c.kind, c.shift, p.paragraph from events e,
     (values (0, 'pH', 1.5e0), (1, 'Sp Cond (µS/cm)', -0.5e0)) as c(chapter, kind, shift), (values (0), (1)) as p(paragraph))"""


@query(
    "parse_calibration_logs",
    f"""with {_SQL_LOGS} select event_id, chapter, paragraph, kind as parameter_type,
          case when paragraph = 0 then 'overridden' else event_type end as status,
          case when paragraph = 0 then printf('%.2f', value) || ' ' || (case chapter when 0 then 'pH' else 'µS/cm' end)
               else printf('%.2f', value + 1) end as pre,
          case when paragraph = 0 then printf('%.2f', value * 2) end as pre2,
          case when paragraph = 0 then 12 else 7 end as n_fields
        from rows""",
)
def parse_calibration_logs(spark, d):
    parsed = calibration.parse_logs(log_texts(spark, d))
    f = lambda k: F.try_element_at("fields", F.lit(k))
    return parsed.select(
        "event_id", "chapter", "paragraph", "parameter_type", f("Calibration Status").alias("status"),
        f("Pre Calibration Value").alias("pre"), f("Pre Calibration Value 2").alias("pre2"), F.size("fields").alias("n_fields"),
    )


@query(
    "log_scan",
    f"""with {_SQL_LOGS} select kind as parameter_type, paragraph, case when paragraph = 1 then '' when chapter = 0 then 'pH' else 'µS/cm' end as unit,
          count(*) as n, sum(floor(round((value + paragraph) * 100))) / 100 as pre
        from rows group by 1, 2, 3""",
)
def log_scan(spark, d):
    """Logs in Latin-1 files, one after the other, beside a text file and a folder of the same logs.  A task
    holds a file, so more logs make more files, not larger ones.  The disk holds a batch: its logs are read and
    summed before those of the next take their place."""
    path, sums = scratch(spark, "logs"), fresh_path(spark, "sums")
    said = F.split(F.try_element_at("fields", F.lit("Pre Calibration Value")), " ")
    for e in event_batches(spark, d):
        texts = texts_of(e).select(F.concat("content", F.lit(f"{calibration.CHAPTER_MARK}")).alias("content"))
        for folder in (path, f"{path}/older"):
            texts.write.mode("overwrite").option("maxRecordsPerFile", LOGS_OF_A_FILE).csv(
                folder, encoding="ISO-8859-1", quote="", escape="", sep="\x01", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
            )
        texts.write.mode("append").text(path)
        parsed = calibration.parse_logs(read_logs(spark, path))
        found = parsed.groupBy("parameter_type", "paragraph", F.coalesce(F.get(said, F.lit(1)), F.lit("")).alias("unit")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.round(F.get(said, F.lit(0)).cast("double") * 100)).alias("cents")
        )
        found.write.mode("append").parquet(sums)
    return spark.read.parquet(sums).groupBy("parameter_type", "paragraph", "unit").agg(
        F.sum("n").alias("n"), (F.sum("cents") / 100).alias("pre")
    )


@query(
    "calibration_summary",
    f"""with {_SQL_LOGS} select event_id, chapter, paragraph, kind as parameter_type, epoch_us(date_trunc('second', ts)) as calibration_end,
          user_id * 60e0 as timespan_seconds,
          case when paragraph = 0 then round(value, 2) else round(value + 1, 2) end as pre1,
          case when paragraph = 0 then {sql_r6('shift', '').rsplit(' as', 1)[0]} end as correction1,
          case when paragraph = 0 then round(value * 2, 2) end as pre2, cast(null as double) as correction2,
          case when paragraph = 0 then round(value * 3, 2) end as pre3, case when paragraph = 0 then 0.25e0 end as correction3
        from rows""",
)
def calibration_summary(spark, d):
    s = calibration.summarize(calibration.parse_logs(log_texts(spark, d)))
    return s.select(
        "event_id", "chapter", "paragraph", "parameter_type", micros("calibration_end"), "timespan_seconds",
        "pre1", r6("correction1"), "pre2", r6("correction2"), "pre3", r6("correction3"),
    )


@query(
    "calibration_tables",
    f"""with {_SQL_LOGS} select regexp_replace(kind, '[\\\\/*?:"<>|]', '_', 'g') as parameter, count(*) as n, count(*) filter (paragraph = 0) as corrected
        from rows group by 1""",
)
def calibration_tables(spark, d):
    """Summaries written as one table with a partition per parameter, and read back."""
    path = scratch(spark, "summaries")
    s = calibration.summarize(calibration.parse_logs(log_texts(spark, d)))
    s = s.drop("timespan").withColumn("parameter", fn.file_safe(F.col("parameter_type")))
    delimited.write_table(s, path, partition_by=["parameter"])
    return spark.read.parquet(path).groupBy("parameter").agg(
        F.count(F.lit(1)).alias("n"), F.count("correction1").alias("corrected")
    )


@query(
    "calibration_jump",
    f"""with {SQL_USER_HOURLY},
      twice as (select user_id, event_id, ts as t from events where event_type = 'signup'
                union all select user_id, event_id, ts from events where event_type = 'signup' and event_id % 3 = 0),
      cal as (select user_id, event_id, t, row_number() over (partition by user_id order by t, event_id) as no,
                lag(t) over (partition by user_id order by t, event_id) as prev from twice),
      j as (select c.user_id, c.event_id, c.no, c.t, c.prev,
              count(*) filter (s.ts > c.prev and s.ts <= c.t) as n,
              max(s.ts) filter (s.ts < c.t and s.ts >= c.t - interval 24 hour) as b,
              min(s.ts) filter (s.ts > c.t and s.ts <= c.t + interval 24 hour) as a
            from cal c left join user_hourly s on s.user_id = c.user_id group by 1, 2, 3, 4, 5),
      k as (select j.*, (prev is not null and n >= 13 and a is not null and b is not null) as ok from j)
      select k.event_id, case when ok then {sql_r6('bv.high', '').rsplit(' as', 1)[0]} end as before,
             case when ok then {sql_r6('av.high', '').rsplit(' as', 1)[0]} end as after,
             case when ok then {sql_r6('abs(av.high - bv.high)', '').rsplit(' as', 1)[0]} end as difference,
             case when prev is null then 0 else n end as between_count
      from k left join user_hourly bv on bv.user_id = k.user_id and bv.ts = k.b
             left join user_hourly av on av.user_id = k.user_id and av.ts = k.a""",
)
def calibration_jump(spark, d):
    return _jumps(spark, d).select("event_id", r6("before"), r6("after"), r6("difference"), "between_count")


def _jumps(spark, d):
    """Some calibrations stand in the logs twice."""
    cal = events(spark, d).where("event_type = 'signup'").select("user_id", "event_id", F.col("ts").alias("t"))
    cal = cal.union(cal.where("event_id % 3 = 0"))
    return calibration.calibration_jumps(cal, stored(user_hourly(spark, d)), BY_USER, "high", time="t")


@query(
    "corrections_table",
    """select case when user_id % 2 = 0 then 'pH' else 'Sp Cond (µS_cm)' end as parameter, count(*) as n
       from (select * from events where event_type = 'signup' union all select * from events where event_type = 'signup' and event_id % 3 = 0) group by 1""",
)
def corrections_table(spark, d):
    """Jumps written as a table with a partition per parameter, and read back."""
    path = scratch(spark, "corrections")
    kind = F.when(F.pmod("user_id", F.lit(2)) == 0, "pH").otherwise("Sp Cond (µS/cm)")
    delimited.write_corrections(_jumps(spark, d).withColumn("parameter_type", kind), path)
    return spark.read.parquet(path).groupBy("parameter").agg(F.count(F.lit(1)).alias("n"))
