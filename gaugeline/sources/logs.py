"""Calibration log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_logs(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, content)`` of the ``.csv`` files in a directory, subdirectories left out.

    The logs are Latin-1, which the text source cannot decode line by line, so files are read as
    binary; a log is a few kilobytes and files are spread over tasks.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", "false")
        .load(directory)
    )
    return files.select("path", F.decode("content", "ISO-8859-1").alias("content"))
