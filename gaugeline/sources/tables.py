"""Tables written between stages."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Store = Callable[[DataFrame], DataFrame]


#: Stage paths and bucketed tables handed out, by application.
_stages: dict[str, list[str]] = {}
_tables: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors share: the checkpoint folder of the session, else a folder in its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stages").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/gaugeline-{name}-{uuid.uuid4().hex}"
    _stages.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_stages(spark: SparkSession) -> None:
    """Delete the stage tables of this session.  Call it when results that read them are written."""
    for name in _tables.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"drop table if exists {name}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in _stages.pop(spark.sparkContext.applicationId, []):
        place = hadoop.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame) -> DataFrame:
    """Write a table and read it back.

    An ordered scan reads its input for the bucket summary and again for the rows; a chain of them
    on one lazy plan would read the source 2, 4, 8 times.  Writing between stages cuts the chain,
    and a lost executor then repeats one stage only.
    """
    path = fresh_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int | None = None, name: str = "layout") -> DataFrame:
    """Write a table bucketed by a column and read it back: what is grouped, joined or ordered within that
    column afterwards moves no rows.  By default there are as many buckets as shuffle partitions."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, table = fresh_path(spark, name), f"gaugeline_{name}_{uuid.uuid4().hex}".replace("-", "_")
    _tables.setdefault(spark.sparkContext.applicationId, []).append(table)
    df.write.bucketBy(buckets, column).option("path", path).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def as_is(df: DataFrame) -> DataFrame:
    return df
