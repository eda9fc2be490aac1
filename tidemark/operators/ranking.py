"""Places in one order of all rows, without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import keep

#: monotonically_increasing_id counts the rows of a partition in its lower bits.
_ROW_BITS = 33


def with_places(df: DataFrame, order: Sequence[Column], ranges: int | None = None) -> DataFrame:
    """df with place, counted from 0 in the given order, and total, the number of rows.

    Rows are dealt by ranges of the order and sorted within each; what counts before a range are the sizes of those before
    it, one row a range. The dealt rows are written, since ranges come from a sample and must be the same for both steps.
    The order has to tell all rows apart where places must not depend on the run: its last column splits rows that are
    equal in the others, nulls too, over several ranges.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), "places")
    part = F.shiftright("_row", _ROW_BITS)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))  # one row a range
    sizes = sizes.select("_part", (upto - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    rows = dealt.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    return rows.withColumn("place", F.col("_before") + F.col("_row").bitwiseAND((1 << _ROW_BITS) - 1)).drop("_part", "_row", "_before")


def tile(place: Column, total: Column, tiles: int) -> Column:
    """NTILE from a row's place: tiles of equal size, the first ones a row larger."""
    size, extra = F.floor(total / tiles), F.pmod(total, F.lit(tiles))
    large = extra * (size + 1)
    return F.when(place < large, F.floor(place / (size + 1)) + 1).otherwise(extra + F.floor(F.try_divide(place - large, size)) + 1).cast("long")
