"""Profiles of tables, JSON, logs and directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR_LINE, WARNING_LINE = "error|err|exception|fail", "warn"


def columns(df: DataFrame) -> DataFrame:
    """column, type, rows, nulls, n_distinct, low, high (as text): one pass over the table for all columns."""
    each = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        each += [F.count_if(c.isNull()).alias(f"{name}|nulls"), F.count_distinct(c).alias(f"{name}|distinct"), F.min(c).cast("string").alias(f"{name}|low"), F.max(c).cast("string").alias(f"{name}|high")]
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *each)
    rows = [F.struct(F.lit(n).alias("column"), F.lit(k).alias("type"), F.col("_rows").alias("rows"), F.col(f"`{n}|nulls`").alias("nulls"), F.col(f"`{n}|distinct`").alias("n_distinct"), F.col(f"`{n}|low`").alias("low"), F.col(f"`{n}|high`").alias("high")) for n, k in df.dtypes]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def top_values(df: DataFrame, names: list[str], k: int = 4) -> DataFrame:
    """column, value, n, rank: the k commonest values of each column, from one unpivoted aggregation."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).cast("string").alias("value")) for n in names])).alias("e")).select("e.*").filter("value is not null")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def log_counts(text: Column) -> list[Column]:
    lines = F.split(F.lower(text), "\n")
    return [
        F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, lambda x: x.rlike(ERROR_LINE))).cast("long").alias("n_errors"),
        F.size(F.filter(lines, lambda x: x.contains(WARNING_LINE))).cast("long").alias("n_warnings"),
    ]


def text_counts(text: Column) -> list[Column]:
    return [F.when(F.length(text) == 0, 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1).cast("long").alias("n_lines"), F.length(text).cast("long").alias("n_chars")]


def json_shape(text: Column) -> list[Column]:
    v = F.try_parse_json(text)
    kind = F.schema_of_variant(v)
    return [F.json_object_keys(text).alias("keys"), F.size(F.json_object_keys(text)).cast("long").alias("n_keys"), F.json_array_length(text).cast("long").alias("n_items"), kind.alias("shape")]


def json_schema(df: DataFrame, text: str) -> DataFrame:
    """schema: that of all documents merged."""
    return df.agg(F.schema_of_variant_agg(F.try_parse_json(text)).alias("schema"))


def kinds(files: DataFrame, path: str, k: int = 5) -> DataFrame:
    from ..functions.paths import extension

    return files.groupBy(extension(F.col(path)).alias("ext")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "ext").limit(k)
