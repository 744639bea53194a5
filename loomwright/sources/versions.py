"""Stores of named tables with atomic commits.

A store is a folder: ``data`` holds written tables, each under a name of its own, and ``log`` one small file a version, which
says of every table which folders make it up.  A transaction reads the latest version, writes what it adds and then
creates the next log file, which either appears whole under a number that was free or not at all.  So readers see whole
versions only; a failed task or a lost driver leaves folders that no version names; of two writers the second finds its number
taken and does its work again on the version of the first.  Several tables change in one commit, which is what cascades need.

Appending writes new rows alone; replacing and deleting write the table again.  ``vacuum`` removes what no version names.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ATTEMPTS = 20
#: The folder column that tells what one transaction wrote from the rest; no table shows it.
BATCH = "_written"


@dataclass
class Change:
    """What a transaction does to a table: rows that are added, or that take the place of all rows."""

    rows: DataFrame
    replace: bool = False
    partition: list[str] = field(default_factory=list)


class Conflict(RuntimeError):
    pass


class Snapshot:
    """One version of a store."""

    def __init__(self, store: Store, version: int, tables: dict):
        self.store, self.version, self.tables = store, version, tables

    def table(self, name: str, schema: str | StructType | None = None) -> DataFrame:
        """A table's rows; one that is not there yet is empty and needs a schema."""
        spark, known = self.store.spark, self.tables.get(name)
        if known and known["folders"]:
            kind = StructType.fromJson(known["schema"])
            base = f"{self.store.path}/data/{name}"
            rows = spark.read.schema(StructType(list(kind.fields)).add(BATCH, "string")).option("basePath", base).parquet(*[f"{self.store.path}/data/{f}" for f in known["folders"]])
            return rows.select(*[F.col(f"`{f.name}`") for f in kind])
        if known:
            return spark.createDataFrame([], StructType.fromJson(known["schema"]))
        if schema is None:
            raise KeyError(f"no table {name} in version {self.version} of {self.store.path}")
        return spark.createDataFrame([], schema)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._system = self._fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._fs.Path("/".join([self.path, *parts]))

    def versions(self) -> list[int]:
        if not self._system.exists(self._at("log")):
            return []
        names = [f.getPath().getName() for f in self._system.listStatus(self._at("log"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return Snapshot(self, 0, {})
        stream = self._system.open(self._at("log", f"{version:012}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(self, version, json.loads(text))

    def _create(self, version: int, text: str) -> bool:
        """Create a log file whole, or not at all if its number is taken."""
        part, target = self._at("log", f".{uuid.uuid4().hex}.part"), self._at("log", f"{version:012}.json")
        out = self._system.create(part, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if self._system.getUri().getScheme() == "file":  # a local rename would replace what is there
                try:
                    os.link(part.toUri().getPath(), target.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            return not self._system.exists(target) and bool(self._system.rename(part, target))
        finally:
            if self._system.exists(part):
                self._system.delete(part, False)

    def transact(self, work: Callable[[Snapshot], dict[str, Change]], attempts: int = ATTEMPTS) -> int:
        """Apply what ``work`` makes of the latest version; returns the number of the new one.  ``work`` is called again if
        another writer was first, so it reads all that it depends on from the snapshot that it is given."""
        self._system.mkdirs(self._at("log"))
        for _ in range(attempts):
            now = self.snapshot()
            tables, written = {k: dict(v) for k, v in now.tables.items()}, []
            try:
                for name, change in work(now).items():
                    folder = f"{name}/{BATCH}={uuid.uuid4().hex}"
                    written.append(folder)
                    writer = change.rows.write
                    (writer.partitionBy(*change.partition) if change.partition else writer).parquet(f"{self.path}/data/{folder}")
                    schema = StructType([f for f in change.rows.schema if f.name not in change.partition] + [f for f in change.rows.schema if f.name in change.partition])
                    kept = [] if change.replace else tables.get(name, {}).get("folders", [])
                    tables[name] = {"schema": json.loads(schema.json()), "folders": [*kept, folder]}
                if self._create(now.version + 1, json.dumps(tables)):
                    return now.version + 1
            except BaseException:
                self._drop(written)
                raise
            self._drop(written)
        raise Conflict(f"{self.path}: other writers were first {attempts} times")

    def _drop(self, folders: list[str]) -> None:
        for f in folders:
            self._system.delete(self._at("data", f), True)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove data that none of the last ``keep`` versions names, while no one writes or reads an older one."""
        named = {f for v in self.versions()[-keep:] for t in self.snapshot(v).tables.values() for f in t["folders"]}
        tables = self._system.listStatus(self._at("data")) if self._system.exists(self._at("data")) else []
        there = [f"{t.getPath().getName()}/{f.getPath().getName()}" for t in tables for f in self._system.listStatus(t.getPath())]
        gone = [f for f in there if f not in named]
        self._drop(gone)
        return gone

    # ---- what callers do with keyed tables ----
    def read(self, name: str, schema: str | StructType | None = None) -> DataFrame:
        return self.snapshot().table(name, schema)

    def append(self, name: str, rows: DataFrame, partition: list[str] | None = None) -> int:
        return self.transact(lambda now: {name: Change(rows, partition=partition or [])})

    def replace(self, name: str, rows: DataFrame) -> int:
        return self.transact(lambda now: {name: Change(rows, replace=True)})

    def insert_absent(self, name: str, rows: DataFrame, keys: list[str]) -> int:
        """Rows whose keys the table does not have; of rows of one key one is taken.  Null keys equal each other."""

        def work(now: Snapshot) -> dict[str, Change]:
            there = now.table(name, rows.schema).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            return {name: Change(rows.dropDuplicates(keys).join(there, same, "left_anti"))}

        return self.transact(work)

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> int:
        """Rows take the place of those of their keys."""

        def work(now: Snapshot) -> dict[str, Change]:
            new = rows.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
            left = now.table(name, rows.schema).join(new, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
            return {name: Change(left.unionByName(rows.dropDuplicates(keys)), replace=True)}

        return self.transact(work)

    def delete(self, conditions: dict[str, Column]) -> int:
        """Rows for which their table's condition is true go, from all the tables at once."""
        return self.transact(lambda now: {name: Change(now.table(name).filter(~F.coalesce(gone, F.lit(False))), replace=True) for name, gone in conditions.items() if name in now.tables})

