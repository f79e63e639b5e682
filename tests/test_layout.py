"""Tables laid out by series and time bucket."""

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import combine, gaps
from gaugeline.operators.ordered import LAYOUT, Axis, Scan, laid_out, scan
from gaugeline.plans import flows
from gaugeline.sources.tables import bucketed, remove_stages

AXIS = Axis(time="ts", keys=("k",), bucket_hours=5)


def _rows(spark):
    hours = spark.range(300).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.col("id").cast("double").alias("v"))
    nulls = spark.createDataFrame([(None, 7200, 1.0), (1, None, 2.0)], "k long, u long, v double").select("k", F.timestamp_seconds("u").alias("ts"), "v")
    return hours.where("id % 7 < 5").unionByName(nulls)


def _sources(spark):
    long = spark.range(300).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 3600).alias("Time"), F.when(F.col("id") % 50 < 20, F.col("id")).alias("a"))
    daily = long.where("hour(Time) = 12").select("k", "Time", F.col("a").alias("b"))
    plain = long.select("k", "Time", (F.col("a") + 1).alias("c"))
    return [(long, {"max_gap": 4}), (daily, {"limits": {"b": 100.0}, "max_gap": 30}), (plain, {"include_missing": True})]


def _one_by_one(df, sources):
    for source, options in sources:
        df = combine.add_source(df, source, AXIS, **options)
    return gaps.segments(df, AXIS)


def test_dense_equals_one_source_after_the_other(spark):
    base, sources = _rows(spark).withColumn("Interpolated", F.lit(0)), _sources(spark)
    want = _one_by_one(base, sources)
    for store in (lambda df: df, lambda df: bucketed(df, LAYOUT)):
        got = flows.combine_dense(base, sources, AXIS, store)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and got.count()


def _moves(df):
    """Shuffles by series and bucket or by time, of rows; those of bucket summaries are left out."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.split("\n") if "Exchange" in line and LAYOUT in line and "REPARTITION" not in line]


def test_scans_of_a_layout_move_no_rows(spark):
    table = bucketed(laid_out(_rows(spark), AXIS), LAYOUT)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        walked = scan(table, AXIS, Scan(total={"t": F.col("v")}), position="rn")
        plain = scan(_rows(spark), AXIS, Scan(total={"t": F.col("v")}), position="rn")
        # what is handed from bucket to bucket goes back to the layout; it is a row per bucket
        assert len(_moves(walked)) == 1 and len(_moves(plain)) >= 2
        filled = combine.fill_joined(table, AXIS, ["v"])
        assert LAYOUT in filled.columns
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(str, walked.drop(LAYOUT).collect())) == sorted(map(str, plain.collect()))


def test_inserted_hours_get_places_of_their_own(spark):
    table = bucketed(laid_out(_rows(spark).drop("v"), AXIS), LAYOUT)
    inserted = gaps.insert_missing_hours(table, AXIS, 6)
    assert LAYOUT not in inserted.columns
    assert inserted.count() == gaps.insert_missing_hours(_rows(spark).drop("v"), AXIS, 6).count()


def test_bucketed_tables_are_dropped(spark):
    table = bucketed(laid_out(_rows(spark), AXIS), LAYOUT)
    names = {t.name for t in spark.catalog.listTables() if t.name.startswith("gaugeline_layout")}
    assert names and table.count()
    remove_stages(spark)
    assert not [t for t in spark.catalog.listTables() if t.name in names]


def test_layouts_have_time_buckets(spark):
    with pytest.raises(ValueError):
        laid_out(_rows(spark), AXIS.with_(parts=4))
