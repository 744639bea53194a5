"""Directory trees as a data source: listed and read by tasks, names that begin with "_" or "." included.

Every partition lists the folders above the split depth, which are few, and walks only those subtrees that the checksum of
their path deals to it; the files of the upper folders are dealt the same way.  So a tree is listed by as many tasks as there are
partitions, nothing is listed on the driver, and a retried task finds the same part.  Folders are pruned by name, by depth and
by a path below which alone rows are wanted, before they are listed.

The root is a path or URI that the file systems of pyarrow reach from executors (a shared mount, an object store); links to
folders are not followed.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PARTITIONS, SPLIT_DEPTH, DEEPEST = 32, 2, 64
SCHEMA = "path string, length long, modified timestamp, content binary"


def opened(root: str):
    """(file system, path) of a root."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(root if ":" in root.split("/", 1)[0] else os.path.abspath(root))
    return system, path.rstrip("/")


class Shard(InputPartition):
    def __init__(self, number: int):
        self.number = number


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        get = lambda name, default: options.get(name.lower(), options.get(name, default))
        self.root = get("path", None)
        if not self.root:
            raise ValueError("a tree needs a path")
        self.shards, self.split, self.deepest = int(get("partitions", PARTITIONS)), int(get("splitDepth", SPLIT_DEPTH)), int(get("deepest", DEEPEST))
        self.pruned = frozenset(x for x in get("prune", "").split("/") if x)
        self.under = get("under", "").strip("/")
        self.content = str(get("content", "true")).lower() == "true"
        self.most_bytes = int(get("mostBytes", 1 << 62))

    def partitions(self) -> list[Shard]:
        return [Shard(k) for k in range(self.shards)]

    def _mine(self, folder: str, shard: int) -> bool:
        return zlib.crc32(folder.encode()) % self.shards == shard

    def _wanted(self, path: str) -> bool:
        """Whether a folder holds, or may lead to, what is wanted."""
        near = (path + "/").startswith(self.under + "/") or (self.under + "/").startswith(path + "/")
        return not self.under or not path or near

    def read(self, partition: Shard) -> Iterator[tuple]:
        from pyarrow import fs

        system, base = opened(self.root)
        local = isinstance(system, fs.LocalFileSystem)
        todo = [("", 0)]
        while todo:
            folder, depth = todo.pop()
            try:
                found = system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base))
            except FileNotFoundError:
                if not folder:
                    raise
                continue  # gone since its parent was listed
            # a subtree belongs to whoever its top is dealt to, an upper folder's own files to whoever that folder is
            own = depth > self.split or self._mine(folder, partition.number)
            for info in sorted(found, key=lambda i: i.path):
                name = info.base_name
                path = f"{folder}/{name}" if folder else name
                if info.type == fs.FileType.Directory:
                    below = depth + 1
                    if name in self.pruned or below > self.deepest or not self._wanted(path) or (local and os.path.islink(info.path)):
                        continue
                    if below < self.split or below > self.split or self._mine(path, partition.number):
                        todo.append((path, below))
                elif info.type == fs.FileType.File and own and (not self.under or path == self.under or path.startswith(self.under + "/")):
                    body = None
                    if self.content and info.size <= self.most_bytes:
                        with system.open_input_stream(info.path) as f:
                            body = f.read()
                    when = datetime.fromtimestamp(info.mtime_ns / 1e9, timezone.utc) if info.mtime_ns is not None else None
                    yield path, info.size, when, body


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomwright_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def scan(spark: SparkSession, root: str, content: bool = True, prune: list[str] | None = None, under: str = "", deepest: int = DEEPEST, most_bytes: int | None = None, partitions: int = PARTITIONS) -> DataFrame:
    """path (below the root), length, modified and, if asked for, content (null of files beyond ``most_bytes``).

    ``prune`` names folders that are not entered wherever they stand; ``under`` is the path below which alone rows are
    wanted; an empty tree gives no rows, a missing root is an error."""
    spark.dataSource.register(Tree)
    reader = spark.read.format("loomwright_tree").options(path=root, content=str(content).lower(), prune="/".join(prune or []), under=under, deepest=str(deepest), partitions=str(partitions))
    rows = (reader.option("mostBytes", str(most_bytes)) if most_bytes is not None else reader).load()
    return rows if content else rows.drop("content")


def write(rows: DataFrame, path: str, content: str, root: str) -> int:
    """One file a row under the root, its text as it is, written by the tasks; returns how many were.

    A file appears under its name when it is whole, so a task that is lost and tried again leaves nothing half done; of rows
    of one path one stays."""

    def run(batches):
        import pandas as pd

        system, base = opened(root)
        for b in batches:
            for p, body in zip(b["path"], b["content"]):
                folder, _, name = f"{base}/{p}".rpartition("/")
                system.create_dir(folder, recursive=True)
                part = f"{folder}/.{name}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as f:
                    f.write(bytes(body))
                system.move(part, f"{folder}/{name}")
            yield pd.DataFrame({"n": [len(b)]})

    out = rows.filter(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("content")).mapInPandas(run, "n long")
    return out.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
