"""Feasible gaps: more rows make more tasks, not larger ones."""

import re

from pyspark.sql import functions as F

from gaugeline.operators import samples
from gaugeline.operators.ordered import LAYOUT, Axis

AXIS = Axis(time="ts", keys=("k",))


def _tasks(spark, n):
    hours = spark.range(n).select((F.col("id") % 5).alias("k"), F.timestamp_seconds(F.col("id") * 3600 * 3).alias("ts"), F.lit(1.0).alias("v"))
    plan = samples.gap_feasibility(hours, AXIS, ["v"], 1)._jdf.queryExecution().executedPlan().toString()
    return [int(x) for x in re.findall(rf"hashpartitioning\({LAYOUT}#\d+, (\d+)\), REPARTITION_BY_NUM", plan)]


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(samples, "ROWS_OF_A_TASK", 350, raising=False)
    for n in (200, 2000):
        found = _tasks(spark, n)
        assert found and min(found) >= n * 35 // 350
