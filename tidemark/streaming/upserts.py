"""A stream of changed rows merged into a partitioned table batch by batch, and visit counts over event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import qualify
from tidemark.operators.tables import upsert_partitioned, write_partitioned


def latest(delta: DataFrame, key: Sequence[str], mark: str) -> DataFrame:
    """The newest row of each key; ties by all columns, so that a retried batch gives the same rows."""
    order = [F.desc(mark), *(F.desc(c) for c in delta.columns if c not in (*key, mark))]
    return qualify(delta, F.row_number().over(Window.partitionBy(*key).orderBy(*order)), lambda r: r == 1)


def stream_upserts(changes: DataFrame, path: str, key: Sequence[str], mark: str, day: str, cluster: Sequence[str], checkpoint: str, staging: str) -> StreamingQuery:
    """Starts a query that merges changes into the table at path and stops when all available rows are in.

    A batch that is run again after a failure replaces the same keys by the same rows.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            upsert_partitioned(spark, path, latest(batch, key, mark), key, day, cluster, f"{staging}/{epoch}")
        else:
            write_partitioned(latest(batch, key, mark), path, day, cluster)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def visits_by_window(events: DataFrame, ts: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows by event-time window and event_type; rows later than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")
