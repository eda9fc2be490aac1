"""Tables by month that are published version by version.

The rows of a version go to a folder of its own. What the version consists of, a folder for each month, stands in one
small file that is written elsewhere and then renamed to its place, so readers see the version before or after, never
half of one. Months that did not change keep the folder they have. Older versions stay readable.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import month_of
from tidemark.storage import file_system

_NULL = "__HIVE_DEFAULT_PARTITION__"


class VersionConflict(RuntimeError):
    """Another writer has published the version that this one was about to publish."""


class VersionedTable:
    """A table under path whose rows belong to the month of their column day.

    Months are few, so their names may go to the driver; rows never do.
    """

    def __init__(self, spark: SparkSession, path: str, day: str):
        self.spark, self.path, self.day, self.month = spark, path, day, f"{day}_month"

    def versions(self) -> list[int]:
        fs, at = file_system(self.spark, f"{self.path}/_versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()) if fs.exists(at) else []

    def _manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/_versions/{version:08d}", wholetext=True).first()[0])

    def months(self, version: int | None = None) -> list[str]:
        return sorted(self._manifest(self._version(version))["months"])

    def _version(self, version: int | None) -> int:
        have = self.versions()
        if version is None and have:
            return have[-1]
        if version not in have:
            raise ValueError(f"{self.path} has no version {version}")
        return version

    def read(self, version: int | None = None, months: Iterable[str] | None = None) -> DataFrame:
        """The rows of a version, the last by default, or only those of some months, whose folders alone are read."""
        manifest = self._manifest(self._version(version))
        schema = T.StructType.fromJson(manifest["schema"])
        wanted = manifest["months"] if months is None else {m: manifest["months"][m] for m in months if m in manifest["months"]}
        if not wanted:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.path}/data/_v={v}/{self.month}={m}" for m, v in sorted(wanted.items())]
        full = T.StructType([*schema.fields, T.StructField("_v", T.StringType()), T.StructField(self.month, T.DateType())])
        return self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*folders).select(*schema.names)

    def publish(self, rows: DataFrame, replaced: Iterable[str] | None = None, cluster: Sequence[str] = ()) -> int:
        """Makes rows the table's content, or that of the replaced months, and returns the version's number.

        rows may read the table itself: nothing that is published is overwritten. A rename that fails because the
        version exists already is a VersionConflict, and the rows written for it are deleted. Where renaming is not
        atomic, as in some object stores, one writer at a time has to be seen to otherwise.
        """
        have = self.versions()
        version, own = (have[-1] + 1 if have else 1), uuid.uuid4().hex
        folder = f"{self.path}/data/_v={own}"
        with_month = rows.withColumn(self.month, month_of(self.day))
        with_month.repartitionByRange(self.month, *cluster, *([] if cluster else [self.day])).sortWithinPartitions(self.month, *cluster).write.partitionBy(self.month).parquet(folder)
        fs, at = file_system(self.spark, folder)
        written = {s.getPath().getName().split("=", 1)[1]: own for s in fs.listStatus(at) if "=" in s.getPath().getName()}
        before = self._manifest(have[-1]) if have else {"months": {}}
        if stray := set(written) - set(replaced if replaced is not None else written):
            fs.delete(at, True)
            raise ValueError(f"rows of months that are not replaced: {sorted(stray)}")
        left = {} if replaced is None else {m: v for m, v in before["months"].items() if m not in set(replaced)}
        try:
            self._commit(version, {"schema": rows.schema.jsonValue(), "months": left | written})
        except VersionConflict:
            fs.delete(at, True)
            raise
        return version

    def _commit(self, version: int, manifest: dict) -> None:
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        fs, draft = file_system(self.spark, f"{self.path}/_drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions/{version:08d}")
        fs.mkdirs(place.getParent())
        none = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, place, none)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise VersionConflict(f"{self.path} has version {version} already") from e
            raise

    def merge(self, delta: DataFrame, key: Sequence[str], cluster: Sequence[str] = ()) -> int:
        """Publishes the table with the rows of delta in place of those with equal keys; delta's keys are unique.

        Only months that hold a touched key now, or will, are read for it and written.
        """
        here = self.read().join(delta.select(*key), list(key), "left_semi").select(_name(month_of(self.day)).alias("m"))
        touched = [r[0] for r in here.union(delta.select(_name(month_of(self.day)))).distinct().collect()]
        rows = self.read(months=touched).join(delta.select(*key), list(key), "left_anti").unionByName(delta, allowMissingColumns=True)
        return self.publish(rows, touched, cluster)

    def forget(self, keep_last: int) -> None:
        """Deletes all versions but the last ones, and the folders that only they name."""
        fs, _ = file_system(self.spark, self.path)
        have = self.versions()
        used = {v for n in have[-keep_last:] for v in self._manifest(n)["months"].values()}
        for n in have[:-keep_last]:
            fs.delete(file_system(self.spark, f"{self.path}/_versions/{n:08d}")[1], False)
        for s in fs.listStatus(file_system(self.spark, f"{self.path}/data")[1]):
            if s.getPath().getName().removeprefix("_v=") not in used:
                fs.delete(s.getPath(), True)


def _name(month: Column) -> Column:
    return F.coalesce(month.cast("string"), F.lit(_NULL))
