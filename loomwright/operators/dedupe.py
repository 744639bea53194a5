"""First-wins deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze

FILE_COMMENT = r"#\s*filename:\s*(\S+)"


def first_by(rows: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key.  Wide rows: use :func:`first_ids` and a semi join instead."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_ids(rows: DataFrame, text: str, id_column: str) -> DataFrame:
    """The smallest id of each text up to white space; only digests and ids are shuffled."""
    return rows.groupBy(F.md5(squeeze(F.col(text)).cast("binary")).alias("_k")).agg(F.min(id_column).alias(id_column)).select(id_column)


def commands(rows: DataFrame, group: str, order: str, language: str, code: str) -> DataFrame:
    """Code blocks without repeats: by file name if a comment names one, else by text up to white space.  A named file also
    counts as its run command "language file", wherever that comes later."""
    name = F.nullif(F.regexp_extract(F.col(code), FILE_COMMENT, 1), F.lit(""))
    each = rows.withColumn("_file", name).withColumn("_key", F.coalesce(F.concat(F.lit("file "), name), F.concat(F.lit("text "), squeeze(F.col(code)))))
    runs = each.filter("_file is not null").select(group, F.concat(F.lit("text "), F.col(language), F.lit(" "), F.col("_file")).alias("_key"), F.col(order).alias("_at")).groupBy(group, "_key").agg(F.min("_at").alias("_at"))
    first = each.withColumn("_n", F.row_number().over(Window.partitionBy(group, "_key").orderBy(order))).filter("_n = 1")
    return first.join(runs, [group, "_key"], "left").filter(F.col("_at").isNull() | (F.col(order) <= F.col("_at"))).drop("_n", "_at", "_key", "_file")


def merged(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both tables, the right one's row where a key is in both."""
    return right.unionByName(left.join(right.select(key), key, "left_anti"))
