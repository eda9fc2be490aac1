"""Named queries: functions of Models that return a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidemark.plans.models import Models

QUERIES: dict[str, Callable[[Models], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f
