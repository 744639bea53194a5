"""Files as tables: scans, texts, notebooks, snapshots, globs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, root: str, content: bool = True, glob: str | None = None) -> DataFrame:
    """path (below the root), length, modified (and content as bytes).  Without content no file is opened.  Spark's file index leaves
    out names that begin with "_" or "."."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/") + "/"
    bare = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    start = "/" + base.split(":", 1)[-1].lstrip("/") if ":" in base.split("/", 1)[0] else base
    rows = reader.load(root).select(F.substr(bare, F.lit(len(start) + 1)).alias("path"), "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    return rows


def decoded(content: Column) -> Column:
    """UTF-8, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def texts(files: DataFrame) -> DataFrame:
    return files.withColumn("content", decoded(F.col("content")))


def notebook_code(content: Column) -> Column:
    """The code cells of a notebook, a blank line between them; a cell's source may be a list or a text."""
    cells = F.from_json(content, "cells array<struct<cell_type:string,source:string>>")["cells"]
    code = F.filter(cells, lambda c: c["cell_type"] == "code")
    listed = lambda s: F.array_join(F.from_json(s, "array<string>"), "")
    return F.array_join(F.transform(code, lambda c: F.when(c["source"].startswith("["), listed(c["source"])).otherwise(c["source"])), "\n\n")


def newest(files: DataFrame) -> DataFrame:
    return files.orderBy(F.col("modified").desc(), "path")


def modules(files: DataFrame) -> DataFrame:
    """module_id, path, content, language, lines of text files that a repository scan takes."""
    from ..functions.paths import extension, module_id
    from ..operators.snapshots import limited_scan

    rows = texts(limited_scan(files, "path", "length"))
    ext = extension(F.col("path"))
    text = F.when(ext == "ipynb", notebook_code(F.col("content"))).otherwise(F.col("content"))
    return rows.select(module_id(F.col("path")).alias("module_id"), "path", text.alias("content"), ext.alias("language"), (F.regexp_count(text, F.lit("\n")) + 1).alias("lines"))
