"""Spark session defaults: UTC, ANSI, adaptive execution."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, app: str = "loomwright", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir; in local mode a
    temporary one if it names none, on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        where = f"file://{tempfile.gettempdir()}/loomwright-shared"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def dealt(df: DataFrame, *keys: str, rows: int = 2048) -> DataFrame:
    """Rows dealt by key to tasks of about as many rows each, for work that costs far more than the bytes of a row say: a
    small file is otherwise read by one task or a few."""
    return df.repartition(df.count() // rows + 1, *keys)


def durable(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder, so that what is read several times is computed once."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/loomwright/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
