"""Packing by budgets: prefixes, next-fit bins, fixed batches, head and tail cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix(rows: DataFrame, group: str, order: list[str], size: str, budget: float, overshoot: bool = False) -> DataFrame:
    """Rows while the running total stays within the budget; with ``overshoot`` the row that crosses it stays too."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.sum(size).over(w)
    return rows.withColumn("_run", run).filter((F.col("_run") - F.col(size) if overshoot else F.col("_run")) <= budget).drop("_run")


def next_fit(sizes: Column, budget: float) -> Column:
    """Bin number (from 0) of each size of an ordered array: a bin closes before it would exceed the budget."""
    zero = F.struct(F.lit(0).alias("bin"), F.lit(0.0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        opens = (a["used"] > 0) & (a["used"] + x > budget)
        b = a["bin"] + opens.cast("int")
        return F.struct(b.alias("bin"), F.when(opens, x.cast("double")).otherwise(a["used"] + x).alias("used"), F.array_append(a["out"], b).alias("out"))

    return F.aggregate(sizes, zero, step, lambda a: a["out"])


def batches(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / n).cast("int"))


def head_tail(tokens: Column, most: int, mark: str = "...") -> Column:
    """The first and last half of the budget around a mark; short lists stay."""
    half = most // 2
    return F.when(F.size(tokens) > most, F.concat(F.slice(tokens, 1, half), F.array(F.lit(mark)), F.slice(tokens, -half, half))).otherwise(tokens)
