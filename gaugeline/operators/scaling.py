"""Min-max scaling with a reusable parameter table ``(param, min, max)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import col


def measure(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum and maximum of each listed column that exists, from one aggregation."""
    names = [c for c in columns if c in df.columns]
    value = {c: F.nanvl(col(c).try_cast("double"), F.lit(None).cast("double")) for c in names}
    wide = df.agg(
        *[F.min(value[c]).alias(f"lo{i}") for i, c in enumerate(names)],
        *[F.max(value[c]).alias(f"hi{i}") for i, c in enumerate(names)],
    )
    rows = [
        F.struct(F.lit(c).alias("param"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
        for i, c in enumerate(names)
    ]
    return wide.select(F.inline(F.array(*rows)))


def merge_params(saved: DataFrame, measured: DataFrame) -> DataFrame:
    """Saved parameters win; columns they lack take the measured ones."""
    return saved.unionByName(measured.join(saved, "param", "left_anti"))


def scale(
    df: DataFrame, columns: Sequence[str], params: DataFrame | None = None, low: float = 0.0, high: float = 1.0
) -> DataFrame:
    """Scale columns onto [low, high] with ``params``, or with their own range.

    A constant column becomes the midpoint in every row, null rows too; an all-null column stays
    null; columns without parameters stay as they are.  The parameters arrive as one scalar
    subquery, so rows are neither joined nor shuffled.
    """
    names = [c for c in columns if c in df.columns]
    if not names:
        return df
    params = measure(df, names) if params is None else params
    # bounded: at most one entry per listed column
    table = params.where(F.col("param").isin(*names)).agg(
        F.map_from_entries(F.collect_list(F.struct("param", F.struct("min", "max")))).alias("m")
    )
    rows = df.withColumn("__m", table.scalar())
    out = []
    for c in df.columns:
        if c not in names:
            out.append(col(c))
            continue
        entry = F.try_element_at(F.col("__m"), F.lit(c))
        value = col(c).try_cast("double")
        lo, hi = entry["min"], entry["max"]
        scaled = (value - lo) / F.nullif(hi - lo, F.lit(0.0)) * (high - low) + low
        out.append(
            F.when(entry.isNull(), value).when(lo == hi, F.lit((low + high) / 2)).otherwise(scaled).alias(c)
        )
    return rows.select(*out)


def unscale(
    df: DataFrame, params: DataFrame, columns: Sequence[str], *, param: str = "param", low: float = 0.0, high: float = 1.0
) -> DataFrame:
    """Undo the scaling of a long table: ``columns`` are restored by the row's ``param``."""
    found = params.select(col("param").alias(param), F.col("min").alias("__lo"), F.col("max").alias("__hi"))
    joined = df.join(found, param, "left")
    lo, hi = F.col("__lo"), F.col("__hi")
    out = []
    for c in df.columns:
        if c in columns:
            back = (col(c) - low) / (high - low) * (hi - lo) + lo
            out.append(F.when(lo.isNull(), col(c)).when(lo == hi, lo).otherwise(back).alias(c))
        else:
            out.append(col(c))
    return joined.select(*out)
