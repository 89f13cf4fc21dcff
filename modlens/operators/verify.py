"""Data checks that the findings call for, on the tables the modules name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their count ``CNT``."""
    return table.groupBy(*keys).agg(F.count("*").alias("CNT")).filter(F.col("CNT") > 1)


def preview(table: DataFrame, n: int = 100, order_by: list[str | Column] | None = None) -> DataFrame:
    """``n`` rows of a table about to be overwritten; the first ``n`` with an order."""
    return (table.orderBy(*order_by) if order_by else table).limit(n)


def join_inflation(detail: DataFrame, other: DataFrame, on: list[str], measure: str) -> DataFrame:
    """Keys whose sum of ``measure`` grows when ``detail`` is joined to ``other``.

    Both sides are aggregated per key before the join, so the inflated join itself is never
    made and a frequent key is one row on each side.
    """
    sums = detail.groupBy(*on).agg(F.sum(measure).alias("detail_sum"))
    copies = other.groupBy(*on).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    return sums.join(copies, on).withColumn("joined_sum", F.col("detail_sum") * F.col("n"))
