"""Intermediate tables in the cluster's shared folder: they cut lineage and survive a lost executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (tests on one machine).
LOCAL_DEFAULT = "/tmp/checkpoints"
#: Shuffle files go at the end of the job that made them, not when the driver collects garbage; Python gets texts in
#: small batches.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def shared_dir(spark: SparkSession) -> str:
    """Folder named in spark.checkpoint.dir; where it is unset, a default on one machine and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return named.rstrip("/") if named else _local_dir()


@cache
def _local_dir() -> str:
    """A folder of this process under the default, deleted when it ends."""
    path = f"{LOCAL_DEFAULT}/{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{top.name}_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(archive))
    sc._tidemark_shipped = True


def beside(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A new session with the settings of spark and these."""
    out = spark.newSession()
    for k, v in (spark.conf.getAll | settings).items():
        if spark.conf.isModifiable(k):
            out.conf.set(k, v)
    return out


def fence(df: DataFrame) -> DataFrame:
    """df behind a column that differs from run to run, through which the optimizer pushes no predicate.

    Without it a filter on an array expression is copied below the step that computes it, and its lambdas then compute
    the arrays they refer to once for each element.
    """
    return df.withColumn("_fence", F.monotonically_increasing_id()).where("_fence >= 0").drop("_fence")


_roots: list[tuple[SparkSession, str]] = []


def clean_up() -> None:
    """Deletes the tables of all operator calls so far; results that were not written yet cannot be read after it.

    Runs when the process ends, for the contexts that are still there then.
    """
    while _roots:
        spark, root = _roots.pop()
        if spark.sparkContext._jsc is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(root)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


atexit.register(clean_up)


class Scratch:
    """Tables of one operator call. ``keep`` writes a DataFrame and reads it again; ``drop`` deletes such a table."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n, self._of = 0, {}
        _roots.append((spark, self.root))
        ship(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, by: str | None = None, settings: dict[str, str] | None = None, session: SparkSession | None = None) -> DataFrame:
        """df written and read again, in a session of its own with further settings or in the one given."""
        self._n += 1
        path = self.path(f"t{self._n}")
        self.write(df.write.partitionBy(by) if by else df.write, path)
        reader = beside(self.spark, settings) if settings else session or self.spark
        out = reader.read.schema(df.schema).parquet(path)
        self._of[id(out)] = (path, out)
        return out

    def write(self, writer: DataFrameWriter, path: str, kind: str = "parquet") -> None:
        """Writes under WRITING, then puts the session's settings back. Smaller batches of the session stay."""
        conf = writer._spark.conf
        before = {k: conf.get(k) for k in WRITING}
        try:
            for k, v in WRITING.items():
                if not (v.isdigit() and 0 < int(before[k]) < int(v)):
                    conf.set(k, v)
            writer.format(kind).save(path)
        finally:
            for k, v in before.items():
                conf.set(k, v)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, _ = self._of.pop(id(t))
            self.delete(path)

    def delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
