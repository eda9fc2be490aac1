"""Operators on kept tables: upsert, type-2 history, contracts, freshness, partitioned layout."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import month_of, surrogate_key

# Merge.


def newer(source: DataFrame, target: DataFrame, mark: str, lookback: str | None = None) -> DataFrame:
    """Rows of source above the target's largest mark (strictly; lookback, as '3 DAYS', lowers the bound)."""
    top = target.agg(F.coalesce(F.max(mark), F.lit("1970-01-01").cast(source.schema[mark].dataType)).alias("_top"))
    bound = F.expr(f"_top - INTERVAL {lookback}") if lookback else F.col("_top")
    return source.crossJoin(F.broadcast(top)).where(F.col(mark) > bound).drop("_top")  # one row


def merged(target: DataFrame, delta: DataFrame, key: Sequence[str]) -> DataFrame:
    """target with the rows of delta in place of those with equal keys, and the rest of delta beside them.

    Columns that only delta has are null for older rows; delta's key must be unique.
    """
    return target.join(delta.select(*key), list(key), "left_anti").unionByName(delta, allowMissingColumns=True)


def write_partitioned(df: DataFrame, path: str, day: str, cluster: Sequence[str], mode: str = "overwrite", watch: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Parquet by month of day, rows of a file in order of the cluster columns, so row groups can be skipped.

    Tasks take ranges of month and cluster columns, so that a large month is the work of several. watch is applied to the
    rows as they are written.
    """
    month = f"{day}_month"
    watch(df.withColumn(month, month_of(day)).repartitionByRange(month, *cluster).sortWithinPartitions(month, *cluster)).write.mode(mode).partitionBy(month).parquet(path)


def read_days(spark: SparkSession, path: str, day: str, low: dt.date, high: dt.date) -> DataFrame:
    """Rows with low <= day <= high; the same bound on the month lets Spark list only the partitions it needs."""
    month = F.col(f"{day}_month")
    return spark.read.parquet(path).where(month.between(F.lit(low.replace(day=1)), F.lit(high.replace(day=1))) & F.col(day).between(F.lit(low), F.lit(high))).drop(f"{day}_month")


def upsert_partitioned(spark: SparkSession, path: str, delta: DataFrame, key: Sequence[str], day: str, cluster: Sequence[str], staging: str) -> int:
    """Merges delta into a table of write_partitioned and returns how many months were rewritten.

    Only months are rewritten that hold a touched key now or will after the merge, since a row can move between months.
    They are written to staging first, as a plan cannot overwrite what it reads, and then put in place by dynamic
    partition overwrite; a month that ends up empty is deleted.
    """
    month = f"{day}_month"
    target = spark.read.parquet(path)
    delta = delta.withColumn(month, month_of(day))
    touched = target.join(delta.select(*key), list(key), "left_semi").select(month).union(delta.select(month)).distinct()
    touched.write.mode("overwrite").parquet(f"{staging}/months")
    touched = spark.read.parquet(f"{staging}/months")
    out = merged(target.join(touched, month, "left_semi"), delta, key)
    out.write.mode("overwrite").parquet(f"{staging}/rows")
    out = spark.read.parquet(f"{staging}/rows")
    out.repartitionByRange(month, *cluster).sortWithinPartitions(month, *cluster).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for row in touched.join(out.select(month).distinct(), month, "left_anti").collect():  # months, a small number by nature
        at = fs_path(f"{path}/{month}={row[0]}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return touched.count()


# Type-2 history.


def first_versions(rows: DataFrame, key: str, at: Column) -> DataFrame:
    out = rows.withColumns({"dbt_valid_from": at, "dbt_valid_to": F.lit(None).cast("timestamp_ntz"), "dbt_updated_at": at})
    return out.withColumn("dbt_scd_id", surrogate_key(key, "dbt_updated_at"))


def next_versions(history: DataFrame, rows: DataFrame, key: str, checked: Sequence[str], at: Column) -> DataFrame:
    """history after another look at rows: changed keys get a new version and their old one is closed.

    Only the checked columns count, null against null is no change, and keys that are missing from rows stay open.
    """
    current = history.where("dbt_valid_to IS NULL")
    same = F.lit(True)
    for c in checked:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"c.{c}"))
    looked = rows.alias("n").join(current.alias("c"), F.col(f"n.{key}") == F.col(f"c.{key}"), "left").where(F.col(f"c.{key}").isNull() | ~same).select("n.*", F.col(f"c.{key}").isNotNull().alias("_known"))
    closed = looked.where("_known").select(key, F.lit(True).alias("_closes"))
    kept = history.join(closed, key, "left").withColumn("dbt_valid_to", F.when(F.col("_closes") & F.col("dbt_valid_to").isNull(), at).otherwise(F.col("dbt_valid_to"))).drop("_closes")
    return kept.unionByName(first_versions(looked.drop("_known"), key, at), allowMissingColumns=True)


# Contracts and freshness.


def contract_violations(df: DataFrame, expected: T.StructType) -> list[str]:
    """What differs from the expected columns: missing, unexpected, other type."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in expected}
    out = [f"missing column {c}" for c in want if c not in have] + [f"unexpected column {c}" for c in have if c not in want]
    return out + [f"column {c} is {have[c].simpleString()}, not {want[c].simpleString()}" for c in want if c in have and have[c] != want[c]]


def enforce_contract(df: DataFrame, expected: T.StructType) -> DataFrame:
    if found := contract_violations(df, expected):
        raise ValueError("; ".join(found))
    return df.select(*(f.name for f in expected))


def freshness(df: DataFrame, loaded_at: str, now: Column, warn_hours: int = 24, error_hours: int = 48) -> DataFrame:
    """One row (last_loaded, age_hours, state); an empty table is an error."""
    rows = df.agg(F.max(loaded_at).alias("last_loaded")).withColumn("age_hours", F.timestamp_diff("HOUR", "last_loaded", now))
    state = F.when(F.col("age_hours").isNull() | (F.col("age_hours") >= error_hours), "error").when(F.col("age_hours") >= warn_hours, "warn").otherwise("pass")
    return rows.withColumn("state", state)


# The column that tells when each raw table was loaded; tables without one are not checked.
LOADED_AT = {"raw_patients": "created_at", "raw_doctors": "created_at", "raw_appointments": "updated_at", "raw_payments": "updated_at", "raw_leads": "created_at", "raw_specialties": None, "raw_countries": None}


def source_freshness(raw, now: Column, loaded_at: Mapping[str, str | None] = LOADED_AT, limits: Mapping[str, tuple[int, int]] = {}) -> DataFrame:
    """(source, last_loaded, age_hours, state) of each raw table that is checked; limits: its own hours to warn and fail."""
    parts = []
    for table, column in loaded_at.items():
        if column:
            rows = getattr(raw, table).select(F.col(column).cast("timestamp_ntz").alias("at"))
            parts.append(freshness(rows, "at", now, *limits.get(table, ())).withColumn("source", F.lit(table.removeprefix("raw_"))))
    return reduce(DataFrame.unionByName, parts).select("source", "last_loaded", "age_hours", "state")


def partition_sizes(df: DataFrame, day: str) -> DataFrame:
    """Rows by month."""
    return df.groupBy(month_of(day).alias("month")).agg(F.count("*").alias("n_rows"))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of a table's files."""
    meta = F.col("_metadata")
    return spark.read.parquet(path).select(meta["file_path"].alias("file"), meta["file_size"].alias("bytes")).distinct()


def footer_rows(spark: SparkSession, path: str, month: str) -> DataFrame:
    """(month, n_rows) of a table by month from the footers of its files: no column is read.

    The count is pushed down to a reader of the second generation, in a session of its own so that no setting changes.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path).groupBy(F.col(month).alias("month")).agg(F.count("*").alias("n_rows"))


def table_statistics(spark: SparkSession, table: str) -> tuple[int, int]:
    """(bytes, rows) of a catalogue table as ANALYZE TABLE last counted them, without a scan."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Statistics'").select("data_type").collect()
    found = re.fullmatch(r"(\d+) bytes(?:, (\d+) rows)?", rows[0][0]) if rows else None
    if not found or found[2] is None:
        raise ValueError(f"{table} has no statistics; run ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
    return int(found[1]), int(found[2])
