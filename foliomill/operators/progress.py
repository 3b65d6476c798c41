"""Weighted rollups and carry-forward over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rollup(tasks: DataFrame, group: str, weight: str, ratio: str) -> DataFrame:
    """Weighted mean of ``ratio`` per group, in percent, rounded: ``group, percent``; no weight gives 0."""
    share = F.sum(F.col(weight) * F.col(ratio)) / F.sum(weight)
    return tasks.groupBy(group).agg(F.coalesce(F.round(100 * share), F.lit(0.0)).cast("int").alias("percent"))


def running_max(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Rows with ``peak``, the greatest value so far in the group."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("peak", F.max(value).over(w))


def carry_forward(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Rows with ``carried``, the last value that isn't null up to this row."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("carried", F.last(value, ignorenulls=True).over(w))
