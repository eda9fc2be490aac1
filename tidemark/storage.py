"""Tables in a folder that driver and executors share: written once and read again, deleted when the process ends."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (tests on one machine).
LOCAL_DEFAULT = "file:///tmp/checkpoints"

_made: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a default on one machine and an error on a cluster if that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    path = f"{(named or LOCAL_DEFAULT).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path as text."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def keep(df: DataFrame, name: str) -> DataFrame:
    """df written to a folder of its own and read again, which cuts its lineage and fixes values that differ from run to run."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df as a table of its own whose rows lie in buckets of key, sorted by it: joins of such tables on key need no exchange."""
    spark, name = df.sparkSession, f"kept_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", shared_folder(spark, name)).saveAsTable(name)
    _tables.append((spark, name))
    return spark.table(name)


@atexit.register
def clean_up() -> None:
    while _tables:
        spark, name = _tables.pop()
        if spark.sparkContext._jsc is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    while _made:
        spark, path = _made.pop()
        if spark.sparkContext._jsc is not None:
            fs, at = file_system(spark, path)
            fs.delete(at, True)
