"""Scaling parameters, split manifests and the catalogue of sources."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAM_SCHEMA = "param string, min double, max double"
MANIFEST_SCHEMA = "sample_id string, split string"


def save_params(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").json(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    """Parameters from JSON lines; an empty table where nothing is stored."""
    try:
        return spark.read.schema(PARAM_SCHEMA).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PARAM_SCHEMA)


def params_from_mapping(spark: SparkSession, text: str) -> DataFrame:
    """Parameters from the form ``{"column": {"min": …, "max": …}}``."""
    rows = [(k, float(v["min"]), float(v["max"])) for k, v in json.loads(text).items()]
    return spark.createDataFrame(rows, PARAM_SCHEMA)


def save_split(split: DataFrame, path: str) -> None:
    split.write.mode("overwrite").parquet(path)


def load_split(spark: SparkSession, path: str) -> DataFrame:
    """A stored split; a missing one raises."""
    return spark.read.parquet(path)


def part_of(samples: DataFrame, split: DataFrame, part: str, keys: Sequence[str] = ()) -> DataFrame:
    """Samples of one part of a split."""
    by = [*keys, "sample_id"]
    return samples.join(split.where(F.col("split") == part).select(*by), by, "left_semi")


def catalogue_table(
    spark: SparkSession, catalogue: Sequence[tuple[str, Sequence[str], float]]
) -> DataFrame:
    """``(param, source, priority, window_hours)`` from sources in order of priority."""
    rows = [(c, name, i, float(w)) for i, (name, columns, w) in enumerate(catalogue) for c in columns]
    return spark.createDataFrame(rows, "param string, source string, priority int, window_hours double")


def route_source(outputs: DataFrame, catalogue: DataFrame, by: Sequence[str], default_window: float = 3) -> DataFrame:
    """For each request in ``by`` with its ``param`` rows: the source that serves it first in the
    catalogue and the window of the linear baseline; no source if none has any of its columns."""
    found = outputs.join(catalogue, "param", "left")
    first = F.min_by(F.struct("source", "window_hours"), "priority")
    return (
        found.groupBy(*by)
        .agg(first.alias("__f"))
        .select(*by, F.col("__f.source").alias("source"),
                F.coalesce(F.col("__f.window_hours"), F.lit(float(default_window))).alias("window_hours"))
    )
