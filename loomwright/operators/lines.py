"""Lines of texts: numbering, ranges, keyword search with context and per-text hit counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, line_no (from 1), line."""
    return texts.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("_p", "line")).select(*keys, (F.col("_p") + 1).alias("line_no"), "line")


def line_range(texts: DataFrame, keys: list[str], text: str, first: int, count: int) -> DataFrame:
    """Only the wanted lines are ever exploded."""
    part = F.slice(F.split(F.col(text), "\n"), first, count)
    return texts.select(*keys, F.posexplode(part).alias("_p", "line")).select(*keys, (F.col("_p") + F.lit(first)).alias("line_no"), "line")


def numbered_text(text: Column, first: int, count: int) -> Column:
    """Lines with right-aligned numbers, as one text."""
    every = F.split(text, "\n")
    width = F.length(F.least(F.lit(first + count - 1), F.size(every)).cast("string"))
    return F.array_join(F.transform(F.slice(every, first, count), lambda x, i: F.concat(F.lpad((i + first).cast("string"), width, " "), F.lit("\t"), x)), "\n")


def hits(texts: DataFrame, keys: list[str], text: str, keyword: str) -> DataFrame:
    """keys, hits: lines that hold the keyword in any case; texts without hits go.  No line is exploded."""
    count = F.size(F.filter(F.split(F.lower(F.col(text)), "\n"), lambda x: x.contains(keyword.lower())))
    return texts.select(*keys, count.cast("long").alias("hits")).filter("hits > 0")


def search(texts: DataFrame, keys: list[str], text: str, keyword: str, around: int = 2, most: int = 50) -> DataFrame:
    """keys, line_no, line, is_hit: lines within ``around`` of a hit; a text stops after ``most`` + 1 such lines."""
    own = Window.partitionBy(*keys).orderBy("line_no")
    rows = numbered(texts.filter(F.lower(F.col(text)).contains(keyword.lower())), keys, text).withColumn("is_hit", F.lower("line").contains(keyword.lower()))
    near = F.max(F.col("is_hit").cast("int")).over(own.rowsBetween(-around, around))
    rows = rows.withColumn("_near", near).filter("_near = 1").withColumn("_n", F.row_number().over(own))
    return rows.filter(F.col("_n") <= most + 1).select(*keys, "line_no", "line", "is_hit")
