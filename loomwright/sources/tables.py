"""Tables from CSV, JSON and spreadsheets, and keyed tables that may not exist yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Store

#: The one table of a keyed table's store.
ROWS = "rows"


def csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return spark.read.options(header="true", inferSchema="true", **options).csv(path)


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, as a variant."""
    return spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("document"))


def spreadsheet(spark: SparkSession, path: str, sheet: str | int = 0, rows: int | None = None) -> DataFrame:
    """A sheet read by pandas on the driver: for small files, and only where pandas has a reader for them."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet, nrows=rows))


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a keyed table in a store of its own, empty with the given schema if nothing is there yet."""
    return Store(spark, path).read(ROWS, schema)


def append_absent(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> int:
    """Insert-if-absent in one commit: another writer, or a retried task, never makes a key come twice."""
    return Store(spark, path).insert_absent(ROWS, rows, keys)
