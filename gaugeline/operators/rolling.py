"""Rolling sum over a time interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions import HOUR_US, col
from gaugeline.operators.ordered import Axis, join_keys


def rolling_sum(
    df: DataFrame, axis: Axis, value: str, hours: float, *, name: str | None = None, cells: int = 24
) -> DataFrame:
    """Sum over ``[t - hours, t]``, both ends in; nulls count as 0; a row without time gets 0.

    The interval is cut into ``cells`` equal cells of the time line.  A row's sum is the tail of the
    cell that holds ``t - hours``, the cells between, and the head of its own cell.  Each part
    is a plain running sum, so the cost does not depend on how many readings an interval holds, no
    sum is found by subtracting, and a task sees one cell, or the totals of two intervals, of one
    series at a time.
    """
    name = name or f"rolling {value}"
    length = int(hours * HOUR_US)
    if length % cells:
        raise ValueError("hours must divide into whole microseconds per cell")
    width = length // cells
    us = F.unix_micros(col(axis.time))
    # rows without a time add nothing; a hash spreads them over cells
    x = F.when(us.isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.nanvl(col(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    )
    cell = F.coalesce(F.floor(us / width).cast("bigint"), F.xxhash64(*[col(c) for c in df.columns]))
    base = df.withColumn("__u", us).withColumn("__cell", cell)
    keys = axis.key_cols

    # head of the own cell; equal times all count
    own = Window.partitionBy(*keys, "__cell").orderBy("__u")
    head = F.sum(x).over(own.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = base.withColumn("__head", head)

    # sum of the cells strictly between, listed at the cell of the row; cells stand in blocks as long as
    # the interval, and each block sees its own cells and those of the block before
    totals = base.groupBy(*keys, "__cell").agg(F.sum(x).alias("__s"))
    block = F.floor(F.col("__cell") / cells)
    spread = totals.withColumn("__block", F.explode(F.array(block, block + 1)))
    near = Window.partitionBy(*keys, "__block").orderBy("__cell").rangeBetween(-(cells - 1), -1)
    between = spread.withColumn("__mid", F.sum("__s").over(near)).where(F.col("__block") == block).select(*keys, "__cell", "__mid")

    # tail of the cell that holds t - hours: ask there, carrying the row
    payload = F.struct(*[col(c) for c in df.columns], F.col("__head"), F.coalesce("__mid", F.lit(0.0)).alias("__mid"))
    asked = join_keys(rows, between, [*axis.keys, "__cell"], "left").select(
        *keys,
        (F.col("__u") - length).alias("__u"),
        (F.col("__cell") - cells).alias("__cell"),
        F.lit(0).alias("__o"),
        payload.alias("__p"),
    )
    read = base.select(*keys, "__u", "__cell", F.lit(1).alias("__o"), x.alias("__x"))
    tail = Window.partitionBy(*keys, "__cell").orderBy(F.col("__u").desc(), F.col("__o").desc())
    both = asked.unionByName(read, allowMissingColumns=True).withColumn(
        "__tail", F.coalesce(F.sum("__x").over(tail.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    )
    p = F.col("__p")
    return both.where(F.col("__o") == 0).select(
        *[p[c].alias(c) for c in df.columns],
        F.when(p[axis.time].isNull(), F.lit(0.0))
        .otherwise(p["__head"] + p["__mid"] + F.col("__tail"))
        .alias(name),
    )
