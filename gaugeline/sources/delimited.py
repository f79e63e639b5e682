"""Delimited text with mixed separators, decimal signs and missing marks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from gaugeline.functions import col, file_safe, parse_time, to_number, to_number_comma


def read_text_table(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, *, sep: str = ",", encoding: str = "UTF-8"
) -> DataFrame:
    """All columns as text; a byte-order mark is removed. With ``columns`` no header is sampled."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    if columns is not None:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
    df = reader.csv(path)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})


def typed(
    df: DataFrame,
    *,
    times: Mapping[str, Sequence[str]] | Sequence[str] = (),
    texts: Sequence[str] = (),
    decimal: str = "either",
) -> DataFrame:
    """Text table to times and numbers; what does not parse is null.

    ``decimal`` is ``point``, ``comma`` or ``either``; ``either`` needs no second attempt at
    reading, since both signs are accepted in one pass.
    """
    if decimal not in ("point", "comma", "either"):
        raise ValueError("decimal is point, comma or either")
    formats = dict(times) if isinstance(times, Mapping) else {t: () for t in times}
    number = to_number if decimal == "point" else to_number_comma
    out = []
    for c in df.columns:
        if c in formats:
            out.append(parse_time(col(c), formats[c]).alias(c))
        elif c in texts:
            out.append(col(c))
        else:
            out.append(number(col(c)).alias(c))
    return df.select(*out)


def read_measurements(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    *,
    time: str | Mapping[str, Sequence[str]] = "Time",
    sep: str = ";",
    decimal: str = "either",
    texts: Sequence[str] = (),
) -> DataFrame:
    times = time if isinstance(time, Mapping) else [time]
    return typed(read_text_table(spark, path, columns, sep=sep), times=times, texts=texts, decimal=decimal)


def read_limits(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One-row limit table: semicolons, decimal points, a byte-order mark allowed."""
    return typed(read_text_table(spark, path, columns, sep=";"), decimal="point")


def write_corrections(jumps: DataFrame, path: str, parameter: str = "parameter_type", *, format: str = "parquet") -> None:
    """Overwrite the table of sensor jumps, a partition per parameter; spans are kept in seconds."""
    df = jumps.drop("timespan") if "timespan" in jumps.columns else jumps
    write_table(df.withColumn("parameter", file_safe(col(parameter))), path, format=format, partition_by=["parameter"])


def write_table(df: DataFrame, path: str, *, format: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Overwrite a table; CSV gets a header. Directories are made, and partitions take the place of
    one file per parameter."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(format).save(path)
