"""File snapshots: differences and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def additions(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    return after.join(before.select(*keys), keys, "left_anti")


def capped_tree(files: DataFrame, path: str, caps: list[int]) -> DataFrame:
    """dir, name, depth, shown, n_other: per folder the first files by name up to the cap of its depth, and how many more."""
    parts = F.split(F.col(path), "/")
    rows = files.select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("dir"), F.element_at(parts, -1).alias("name"), (F.size(parts) - 1).alias("depth"))
    cap = F.element_at(F.array(*map(F.lit, caps)), F.least(F.col("depth") + 1, F.lit(len(caps))))
    w = Window.partitionBy("dir")
    rows = rows.withColumn("_r", F.row_number().over(w.orderBy("name"))).withColumn("_n", F.count(F.lit(1)).over(w))
    return rows.filter(F.col("_r") <= cap).select("dir", "name", "depth", F.greatest(F.col("_n") - cap, F.lit(0)).cast("long").alias("n_other"))


def limited_scan(files: DataFrame, path: str, size: str, deepest: int = 3, most_bytes: int = 10 << 20) -> DataFrame:
    """Files that a repository scan takes: shallow folders only, none of a folder with over 100 files, 5 of one with over 50,
    else 40; ignored and large files go."""
    from ..functions.paths import ignored_by_scan

    parts = F.split(F.col(path), "/")
    rows = files.withColumn("_dir", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")).withColumn("_depth", F.size(parts) - 1)
    n = F.count(F.lit(1)).over(Window.partitionBy("_dir"))
    rows = rows.withColumn("_n", n).filter((F.col("_depth") <= deepest) & (F.col("_n") <= 100) & ~ignored_by_scan(F.col(path)) & (F.col(size) <= most_bytes))
    r = F.row_number().over(Window.partitionBy("_dir").orderBy(path))
    return rows.withColumn("_r", r).filter(F.col("_r") <= F.when(F.col("_n") > 50, 5).otherwise(40)).drop("_dir", "_depth", "_n", "_r")
