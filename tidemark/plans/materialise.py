"""Builds all models in order of their dependencies and keeps those of table layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.tables import enforce_contract, newer, upsert_partitioned, write_partitioned
from tidemark.plans.contracts import CONTRACTS, contract
from tidemark.plans.models import LAYERS, MODELS, Models
from tidemark.plans.quality import Test, test_built, watcher

#: Day and cluster columns of the partitioned facts.
PARTITIONED = {
    "fct_appointments": ("appointment_date", ("country_id", "specialty_id", "status")),
    "fct_payments": ("payment_date", ("country_id", "payment_status", "payment_method")),
    "fct_leads": ("lead_date", ("country_id", "lead_source", "lead_status")),
}
#: Key and mark of the facts of which a later build only takes what is newer than what it has.
INCREMENTAL = {"fct_appointments": (("appointment_id",), "updated_at")}


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def build(models: Models, folder: str, full_refresh: bool = True, tests: Sequence[Test] = ()) -> dict[str, str]:
    """Writes each table model under folder, in its layer's database, and lets later models read the file instead of its
    plan; paths by model.

    Core models have to meet their contracts, else ValueError ends the build before the model is written. Without
    full_refresh, incremental facts that exist already are merged with their newer rows, month by month.

    tests of a model run when it is written: those of single rows are counted by the write itself, the others, which need
    other rows or tables, in one job after it. A test of severity error that fails ends the build with DataTestError,
    before a model that rests on the table is built.
    """
    spark, out = models.spark, {}
    for name in MODELS:
        if LAYERS[name.split("_")[0]] != "table":
            continue
        path, df = f"{folder}/{models.config.database(name)}/{name}", getattr(models, name)
        if name in CONTRACTS:
            df = enforce_contract(df, contract(name))
        watch, seen = watcher([t for t in tests if t.model == name], name)
        if name in PARTITIONED:
            day, cluster = PARTITIONED[name]
            if not full_refresh and name in INCREMENTAL and _exists(spark, path):
                key, mark = INCREMENTAL[name]
                seen = None  # the rows of the table are not those of the plan: its tests read what was merged
                upsert_partitioned(spark, path, newer(df, spark.read.parquet(path), mark), key, day, cluster, f"{folder}/_staging/{name}")
            else:
                write_partitioned(df, path, day, cluster, watch=watch)
            kept: DataFrame = spark.read.parquet(path).drop(f"{day}_month")
        else:
            watch(df).write.mode("overwrite").parquet(path)
            kept = spark.read.parquet(path)
        models._made[name] = kept
        test_built(models, name, seen, tests)
        out[name] = path
    return out
