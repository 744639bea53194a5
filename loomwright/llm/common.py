"""Shared helpers: table access, durable intermediate tables, folds and byte-level word splitting."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Java regex of the separators between words; ``bytes.split()`` splits at the same six bytes.
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WRITTEN: dict[int, tuple[DataFrame, str]] = {}


def durable(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, so that a lost executor costs no recomputation
    and both readers of a result see the same rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/loomwright/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = (out, path)
    return out


def discard(df: DataFrame) -> None:
    """Remove the table of :func:`durable` that nothing will read again."""
    _, path = _WRITTEN.pop(id(df), (None, None))
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a partition by the optimizer's estimate, beyond which rows are dealt to more partitions than the session says.
PARTITION_BYTES = 64 << 20


def partitions_for(df: DataFrame) -> int:
    """Partitions to deal the rows of a frame to: the session's number, or more if the optimizer's estimate of the
    frame's size asks for them, so that what a task reads does not grow with the input."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 50 else 0  # what the optimizer says of rows that it knows nothing about
    return max(shuffle_partitions(df.sparkSession), min(known // PARTITION_BYTES, 100_000))


def release() -> None:
    """Hand freed memory back to the system; what an allocator keeps counts against the process."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run):
    """A function for mapInArrow that releases memory when its rows end: workers live on between stages."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def fold_of(doc_id, n: int):
    """crc32 of the decimal text of an id, modulo n (null ids: fold of the empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode()) % n


def fold(doc_id: Column, n: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % F.lit(n)


def only(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns and no others: extra columns of a table, whatever their names, play no part."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def grouped(batches: Iterator, column: str, limit: int) -> Iterator[list]:
    """Lists of slices of record batches whose column holds about ``limit`` bytes together, or what is left."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        at = b.schema.get_field_index(column)
        step = max(1, int(limit / 4 * b.num_rows / max(1, b.column(at).nbytes)))
        for lo in range(0, b.num_rows, step):
            part = b.slice(lo, step)
            held.append(part)
            size += part.column(at).nbytes
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def least_hashed(rows: DataFrame, salt: str, key: str, n: int) -> DataFrame:
    """The rows whose salted 64-bit hash of the key is among the n least (more only if keys are equal).

    On large tables a bound on the hash comes first, under which about 4 n rows are expected, so that the rows that
    are sorted do not grow with the number of partitions; the result is the same with and without it.
    """
    rows = rows.withColumn("_hash", F.xxhash64(F.lit(salt), key))
    total = rows.count()
    near = rows
    if total > 16 * n:
        bound = -(1 << 63) + int((1 << 64) * (4 * n / total))
        near = rows.filter(F.col("_hash") <= F.lit(bound))
    for tried in (near, rows):
        got = tried.select("_hash").orderBy("_hash").limit(n).agg(F.max("_hash").alias("m"), F.count(F.lit(1)).alias("n")).first()
        if got["n"] >= min(n, total):
            break
    return rows.filter(F.col("_hash") <= F.lit(got["m"])).drop("_hash") if got["n"] else rows.limit(0).drop("_hash")
