"""Sinks: entity tables, JSON, typed output files, todo lists, chats with cascading deletes, chunk stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from .versions import Store

# What a todo may be.
STATUSES, PRIORITIES = ["pending", "in_progress", "completed"], ["low", "medium", "high"]


def save_entities(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table per kind of entity."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def save_json(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Rows as JSON documents, text beyond ASCII as it is."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).json(path)


def save_output(data: DataFrame | str, path: str, spark: SparkSession | None = None) -> DataFrame:
    """Tables only as .csv, texts only as .txt; returns the first rows."""
    if isinstance(data, str):
        if not path.endswith(".txt") or spark is None:
            raise ValueError("texts are saved as .txt")
        data = spark.createDataFrame([(data,)], "value string")
        data.write.mode("overwrite").text(path)
    elif path.endswith(".csv"):
        data.write.mode("overwrite").csv(path, header=True)
    else:
        raise ValueError("tables are saved as .csv")
    return data.limit(5)


def write_todos(todos: DataFrame, path: str) -> None:
    """Replaces the list in one commit; a status or priority that is none fails the write and the old list stays."""
    bad = lambda c, known: F.assert_true(F.col(c).isin(known), F.concat(F.lit(f"unknown {c}: "), F.col(c)))
    checked = todos.withColumn("_s", bad("status", STATUSES)).withColumn("_p", bad("priority", PRIORITIES)).filter("_s is null and _p is null")
    Store(todos.sparkSession, path).replace("todos", checked.select("id", "content", "status", "priority"))


def todos(spark: SparkSession, path: str) -> DataFrame:
    return Store(spark, path).read("todos", "id string, content string, status string, priority string")


def without_chat(tables: dict[str, DataFrame], chat: str) -> dict[str, DataFrame]:
    """All chat tables without one chat: its index row, messages and displays go together."""
    return {name: df.filter(~F.col("chat_id").eqNullSafe(F.lit(chat))) for name, df in tables.items()}


def delete_chat(spark: SparkSession, path: str, chat: str, tables: list[str]) -> int:
    """A chat goes from all tables of a store that have it, or, if the commit fails, from none."""
    return Store(spark, path).delete({name: F.col("chat_id").eqNullSafe(F.lit(chat)) for name in tables})


def append_chunks(chunks: DataFrame, embed, path: str) -> None:
    """Chunks with vectors from an injected embedder, appended to a store."""
    import pandas as pd

    def run(batches):
        for b in batches:
            yield b.assign(embedding=pd.Series([[float(x) for x in v] for v in embed(list(b["chunk"]))], index=b.index, dtype=object))

    chunks.mapInPandas(run, StructType([*chunks.schema, StructField("embedding", ArrayType(FloatType()))])).write.mode("append").parquet(path)
