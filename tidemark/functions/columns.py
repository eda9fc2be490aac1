"""Column helpers: calendar differences, guarded ratios, decimal rounding, money, keys, segments, window filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = [
    "count_where", "cut_round", "euros", "euros_each", "label_segment", "month_of", "months_apart", "pct_growth", "qualify", "rate", "ratio", "sum_where", "surrogate_key", "years_apart",
]

# The bounds of completed visits by segment.
SEGMENTS = (("new", 0, 0), ("active", 1, 2), ("loyal", 3, 6), ("champion", 7, None))


def month_of(d: Column | str) -> Column:
    return F.trunc(d, "MM")


def months_apart(later: Column | str, earlier: Column | str) -> Column:
    """Month borders between two dates: 31 January to 1 February is one."""
    return ((F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)).cast("long")


def years_apart(later: Column | str, earlier: Column | str) -> Column:
    """Year borders between two dates, whatever the day."""
    return (F.year(later) - F.year(earlier)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b in double precision; null if b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def cut_round(x: Column, places: int) -> Column:
    """Half-up rounding of the decimal value, cut at 12 places, so that other engines round alike."""
    return F.round(x.cast("decimal(28,12)"), places).cast("double")


def rate(a: Column, b: Column) -> Column:
    return cut_round(ratio(a, b), 4)


def euros(cents: Column | str) -> Column:
    """Cents stay whole numbers until here."""
    return (F.col(cents) if isinstance(cents, str) else cents).cast("double") / 100


def euros_each(cents: Column, n: Column) -> Column:
    """Euros a head to the cent, half up, in whole numbers; null if n is 0 or null."""
    return euros(F.floor(F.try_divide((cents * 2 + n).cast("decimal(28,0)"), (n * 2).cast("decimal(20,0)"))).cast("long"))


def pct_growth(now: Column, before: Column) -> Column:
    return ratio(now - before, before)


def count_where(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def sum_where(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value).otherwise(F.lit(0))), F.lit(0)).cast("long")


def surrogate_key(*columns: str) -> Column:
    """MD5 of the columns as strings joined by a bar, nulls as the word NULL."""
    return F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns)))


def label_segment(completed: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, low, high in SEGMENTS:
        out = out.when((completed >= low) & (completed <= high) if high is not None else completed >= low, name)
    return out.otherwise("unknown")


def qualify(df: DataFrame, window: Column, keep) -> DataFrame:
    """Rows for which keep(window column) holds."""
    return df.withColumn("_w", window).where(keep(F.col("_w"))).drop("_w")
