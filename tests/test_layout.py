"""Written layouts: what is read and what is moved."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators import layout
from tidemark.operators.tables import table_statistics
from tidemark.plans.models import Models


@pytest.fixture(scope="module")
def m(spark, small):
    return Models(spark, small)


@pytest.fixture(scope="module")
def visits(m):
    return layout.kept_visits(m)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def scanned_files(df):
    """Files that the partitioned scan has read, from the plan's metrics."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if name.startswith("Scan parquet") and "appointment_date_month" in node.toString():
            found.append(node.metrics().apply("numFiles").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return sum(found)


def test_a_month_reads_its_partition(visits):
    month = visits.where("appointment_date_month = DATE'1996-03-01'")
    files = {f for f in visits.inputFiles() if "month=1996-03-01" in f}
    assert 0 < scanned_files(month) == len(files) < len(visits.inputFiles())


def test_months_known_late_read_their_partitions(spark, visits):
    months = spark.createDataFrame([(m,) for m in ("1996-03-01", "1997-05-01", "1995-03-01")], "d string").select(F.col("d").cast("date").alias("month")).where("day(month) = 1 AND month > DATE'1996-01-01'")
    out = layout.visits_of_months(visits, months)
    files = {f for f in visits.inputFiles() if "month=1996-03-01" in f or "month=1997-05-01" in f}
    assert scanned_files(out) == len(files)  # the first run: a second one resets the numbers of the scan
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString()


def test_a_filter_on_any_cluster_column_skips_row_groups(spark, tmp_path):
    """Bounds of row groups leave out most values of the first, the second and the third column alike."""
    rows = spark.range(64_000).selectExpr("DATE'2024-01-05' AS day", "id % 16 AS a", "concat('s', lpad(id * 7 % 13, 2, '0')) AS b", "concat('t', id * 31 % 8) AS c", "uuid() AS pad")
    spark.conf.set("parquet.block.size", str(64 << 10))
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(64 << 10))
    try:
        layout.write_interleaved(rows, f"file://{tmp_path}/z", "day", ["a", "b", "c"])
    finally:
        spark.conf.unset("parquet.block.size")
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    bounds = []
    for p in (tmp_path / "z").rglob("*.parquet"):
        meta = pq.ParquetFile(p).metadata
        names = meta.schema.names
        bounds += [{c: (g.column(names.index(c)).statistics.min, g.column(names.index(c)).statistics.max) for c in "abc"} for g in (meta.row_group(i) for i in range(meta.num_row_groups))]
    assert len(bounds) >= 16
    for c, value in (("a", 5), ("b", "s07"), ("c", "t3")):
        assert sum(x[c][0] <= value <= x[c][1] for x in bounds) <= 0.6 * len(bounds)
    assert spark.read.parquet(f"file://{tmp_path}/z").count() == 64_000


def test_null_and_large_domains_have_codes(spark):
    rows = spark.range(1000).selectExpr("IF(id % 10 = 0, NULL, id) AS a")
    codes = layout._coded(rows, "a").agg(F.min("_code_a"), F.max("_code_a"), F.count("*")).first()
    assert codes[0] == 0 and codes[1] < 1 << layout.CODE_BITS and codes[2] == 1000


def test_bucketed_facts_join_without_an_exchange(m):
    """Under the merge join of the facts there are scans of buckets and no exchange."""
    plan = plan_of(layout.bucketed_star(m))
    plan = plan[: plan.index("== Initial Plan ==")]
    join = plan[plan.index("SortMergeJoin") :]
    assert "Exchange" not in join.split("BroadcastQueryStage")[0].split("\n+-")[0]
    assert join.count("Bucketed: true") == 2


def test_rows_by_month_come_from_footers(m):
    plan = plan_of(layout.partition_rows(m))
    assert "PushedAggregation: [COUNT(*)]" in plan, plan


def test_statistics_of_a_catalogue_table(spark):
    spark.range(1000).selectExpr("id", "id % 7 AS k").write.mode("overwrite").saveAsTable("stats_of_numbers")
    try:
        with pytest.raises(ValueError, match="ANALYZE"):
            table_statistics(spark, "stats_of_numbers")
        spark.sql("ANALYZE TABLE stats_of_numbers COMPUTE STATISTICS FOR ALL COLUMNS")
        size, rows = table_statistics(spark, "stats_of_numbers")
        assert rows == 1000 and size > 0
    finally:
        spark.sql("DROP TABLE stats_of_numbers")
