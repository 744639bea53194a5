"""Next-fit packing of ordered rows without gathering a group, however large one is.

Rows are dealt by ranges of (group, order).  What a part does to the bin that is open where it begins depends on one number,
what is in that bin: it closes at one of the part's first rows, and from there on all is fixed.  So each part says what
would be open at its end for each of these rows; these few steps are put together part by part, and then each part packs its rows
from the bin that is open.

If a budget holds so many rows that the steps are many, bins are few for the rows, and :func:`_by_doubling` finds them:
sums inside a part and of the parts before give every row its number and the
running total of its group.  Where a bin that starts at a row would close follows from the totals alone: the first row whose total
exceeds what lies before the start by more than the budget.  It is looked up among rows of the same stretch of totals, a
budget wide, or is the first row of the next stretch that has rows.  Of these pointers the ones that the first row
reaches are the bins' starts; they are found by doubling, in as many joins as the number of bins has binary digits.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .graphs import _cut


def running(rows: DataFrame, group: str, order: list[str], size: str) -> DataFrame:
    """The rows with ``_i``, their number in the group from 1, and ``_run``, the total of sizes up to them.  Order columns must
    tell the rows of a group apart."""
    parts = rows.withColumn("_z", F.coalesce(F.col(size), F.lit(0)).cast("decimal(38,6)")).repartitionByRange(F.col(group), *[F.col(c) for c in order])
    parts = _cut(parts.withColumn("_part", F.spark_partition_id()))  # the ranges come from samples: cut, so that they hold
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.sum("_z").alias("_s")).withColumnRenamed("_p", "_part")
    totals = totals.select("_g", F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    own = Window.partitionBy(group, "_part").orderBy(*order)
    parts = parts.withColumns({"_j": F.row_number().over(own), "_r": F.sum("_z").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    out = parts.join(totals, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    out = out.withColumns({"_i": F.col("_j") + F.col("_n0"), "_run": (F.col("_r") + F.col("_s0")).cast("decimal(38,6)")})
    return out.drop("_part", "_j", "_r", "_g", "_p", "_n0", "_s0", "_z")


#: Steps that are put together on the driver; more are not.
STEPS = 1 << 20
#: A part's first group, the steps of its first rows, what it leaves open; the same of its last group if that is another one.
_SUMMARY = "part int, first string, at array<decimal(38,0)>, left array<decimal(38,0)>, bins array<long>, total decimal(38,0), zero decimal(38,0), zero_bins long, last string, open decimal(38,0), open_bins long, groups long"


def _pack(sizes: list[int], budget: int, used: int, bins: int) -> tuple[list[int], int, int]:
    """The bin of each row, and what the open one holds and its number after them."""
    out = []
    for x in sizes:
        if used > 0 and used + x > budget:
            bins, used = bins + 1, 0
        used += x
        out.append(bins)
    return out, used, bins


def steps_of(sizes: list[int], budget: int) -> tuple[list[int], list[int], list[int]]:
    """at, left, bins: a bin with ``u`` > 0 in it closes in these rows by the first step of which ``at`` is over budget - u; then
    ``left`` is in the open bin after them, the ``bins``-th from it.  Without such a step it stays open."""
    exact = np.int64 if sum(sizes) + budget < 1 << 62 else object
    p = np.concatenate([np.zeros(1, exact), np.cumsum(np.array(sizes, exact))])
    n = len(sizes)
    # a bin that starts at row k closes at row to[k]; n for one that does not
    to = np.maximum(np.searchsorted(p[1:], p[:-1] + budget, side="right"), np.searchsorted(p[1:], p[:-1], side="right") + 1)
    last, hops = np.arange(n), (to < n).astype(np.int64)
    jump = np.where(to < n, to, last)
    while not np.array_equal(further := jump[jump], jump):
        hops, jump = hops + hops[jump], further
    left = p[n] - p[jump]
    rows = [k for k in range(int(np.searchsorted(p[:-1], budget, side="left"))) if not k or sizes[k]]
    rows = [k for k, then in zip(rows, [*rows[1:], None]) if then is None or (left[k], hops[k]) != (left[then], hops[then])]
    return [int(p[k + 1]) for k in rows], [int(left[k]) for k in rows], [int(hops[k]) + 1 for k in rows]


def _summaries(budget: int):
    """Rows (_part, _key, _z) of sorted parts -> one row of _SUMMARY a part.  The sizes of one group of a part are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, sizes, first, groups = None, None, [], None, 0

        def ended() -> dict:
            at, left, bins = steps_of(sizes, budget)
            _, zero, zero_bins = _pack(sizes, budget, 0, 0)
            return {"first": key, "at": at, "left": left, "bins": bins, "total": sum(sizes), "zero": zero, "zero_bins": zero_bins}

        for b in batches:
            for part, k, z in zip(*(b.column(i).to_pylist() for i in range(3))):
                if k != key or not groups:
                    if groups == 1:
                        first = ended()
                    key, sizes, groups = k, [], groups + 1
                sizes.append(int(z))
        if groups:
            first = first or ended()
            _, left, bins = _pack(sizes, budget, 0, 0)
            row = first | {"part": part, "last": key, "open": left, "open_bins": bins, "groups": groups}
            for c in ("total", "zero", "open"):
                row[c] = Decimal(row[c])
            for c in ("at", "left"):
                row[c] = [Decimal(x) for x in row[c]]
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "decimal(38,0)": pa.decimal128(38, 0), "array<decimal(38,0)>": pa.list_(pa.decimal128(38, 0)), "array<long>": pa.list_(pa.int64())}[t]) for n, t in (x.split(" ", 1) for x in _SUMMARY.split(", "))])
    return run


def _entries(parts: list, budget: int) -> dict[int, tuple[str | None, int, int]]:
    """For each part the group that the bin before it belongs to, what is in it and its number."""
    out, key, used, bins = {}, None, 0, 0
    for r in sorted(parts, key=lambda r: r["part"]):
        if r["first"] != key:
            key, used, bins = r["first"], 0, 0
        out[r["part"]] = (key, used, bins)
        if r["groups"] > 1:
            key, used, bins = r["last"], int(r["open"]), r["open_bins"]
        elif used == 0:
            used, bins = int(r["zero"]), bins + r["zero_bins"]
        elif (k := bisect_right(r["at"], budget - used)) < len(r["at"]):
            used, bins = int(r["left"][k]), bins + r["bins"][k]
        else:
            used += int(r["total"])
    return out


def next_fit(rows: DataFrame, group: str, order: list[str], size: str, budget: float, most: int = STEPS) -> DataFrame:
    """The rows with ``bin``, from 0 in each group: a bin closes before it would exceed the budget.  A row beyond the budget
    has a bin with nothing but rows of size 0 before it.  Null sizes are 0; negative ones are an error.  Up to ``most`` steps
    are put together on the driver, more are not collected."""
    if budget <= 0:
        raise ValueError("a bin needs a budget")
    checked = rows.withColumn(size, F.when(F.col(size) < 0, F.raise_error(F.lit("negative size")).cast("double")).otherwise(F.col(size)))
    z = (F.coalesce(F.col(size), F.lit(0)).cast("decimal(38,6)") * 1000000).cast("decimal(38,0)")
    parts = checked.withColumns({"_z": z, "_key": F.col(group).cast("string")}).repartitionByRange(F.col(group), *[F.col(c) for c in order])
    parts = _cut(parts.withColumn("_part", F.spark_partition_id()).sortWithinPartitions(group, *order))
    room = int(round(Decimal(str(budget)), 6) * 10**6)
    found = _cut(parts.select("_part", "_key", "_z").mapInArrow(_summaries(room), _SUMMARY))
    if (found.agg(F.sum(F.size("at")).alias("n")).first()["n"] or 0) > most:
        return _by_doubling(checked, group, order, size, budget)
    entries = _entries(found.collect(), room)  # a part's steps: the rows of about one bin
    names = rows.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used, bins, begun = None, 0, 0, False
        for b in batches:
            if not b.num_rows:
                continue
            if not begun:
                (key, used, bins), begun = entries[b.column("_part")[0].as_py()], True
            out, keys, sizes = [], b.column("_key").to_pylist(), [int(x) for x in b.column("_z").to_pylist()]
            lo = 0
            while lo < len(keys):
                if keys[lo] != key:
                    key, used, bins = keys[lo], 0, 0
                hi = next((k for k in range(lo, len(keys)) if keys[k] != key), len(keys))
                each, used, bins = _pack(sizes[lo:hi], room, used, bins)
                out += each
                lo = hi
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(out, pa.int32())], names=[*names, "bin"])

    return parts.mapInArrow(pack, StructType([*parts.select(names).schema, StructField("bin", IntegerType())]))


def _by_doubling(checked: DataFrame, group: str, order: list[str], size: str, budget: float) -> DataFrame:
    """:func:`next_fit` by joins alone."""
    named = running(checked, group, order, size)
    every = _cut(named)
    at = every.select(F.struct(group).alias("_g"), "_i", "_run")  # a struct compares nulls as equal values
    wide = F.lit(budget).cast("decimal(38,6)")
    stretch = lambda x: F.floor(x / wide).cast("long")
    # the least number whose total is over a bound: rows of the bound's own stretch, else the first row of a later one
    heads = at.withColumn("_b", stretch(F.col("_run"))).groupBy("_g", "_b").agg(F.min("_i").alias("_head"))

    def first_over(probes: DataFrame) -> DataFrame:
        """probes (_g, _i, _over) -> _g, _i, _hit: the first row whose total is greater, null if none."""
        both = at.select("_g", F.col("_run").alias("_x"), F.lit(1).alias("_kind"), F.col("_i").alias("_row"), F.lit(None).cast("long").alias("_i"))
        both = both.unionByName(probes.select("_g", F.col("_over").alias("_x"), F.lit(2).alias("_kind"), F.lit(None).cast("long").alias("_row"), "_i"))
        both = both.withColumn("_b", stretch(F.col("_x")))
        # going down, rows come before the probes that they are over; a probe equal to a total is not under it
        down = Window.partitionBy("_g", "_b").orderBy(F.col("_x").desc(), F.col("_kind").desc(), F.col("_row").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = both.withColumn("_near", F.min("_row").over(down)).filter("_kind = 2")
        # a stretch without rows: its successor is looked up below the next one that has some
        after = Window.partitionBy("_g").orderBy("_b", "_kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        asked = found.filter("_near is null").select("_g", "_b").distinct().select("_g", "_b", F.lit(2).alias("_kind"), F.lit(None).cast("long").alias("_head"))
        later = heads.select("_g", "_b", F.lit(1).alias("_kind"), "_head").unionByName(asked)
        later = later.withColumn("_later", F.min("_head").over(after)).filter("_kind = 2").select("_g", "_b", "_later")
        return found.join(later, ["_g", "_b"], "left").select("_g", "_i", F.coalesce("_near", "_later").alias("_hit"))

    sized = at.join(every.select(F.struct(group).alias("_g"), "_i", F.coalesce(F.col(size), F.lit(0)).cast("decimal(38,6)").alias("_z")), ["_g", "_i"])
    start = sized.withColumn("_from", (F.col("_run") - F.col("_z")).cast("decimal(38,6)"))
    over = first_over(start.select("_g", "_i", (F.col("_from") + wide).cast("decimal(38,6)").alias("_over"))).withColumnRenamed("_hit", "_full")
    some = first_over(start.select("_g", "_i", F.col("_from").alias("_over"))).withColumnRenamed("_hit", "_some")
    jump = over.join(some, ["_g", "_i"]).select("_g", "_i", F.when(F.col("_full").isNotNull(), F.greatest("_full", F.col("_some") + 1)).alias("_to")).filter("_to is not null")
    last = at.groupBy("_g").agg(F.max("_i").alias("_n"))
    jump = _cut(jump.join(last, "_g").filter("_to <= _n").select("_g", "_i", "_to"))
    starts = _cut(last.select("_g", F.lit(1).cast("long").alias("_i")))
    while not jump.isEmpty():
        reached = starts.join(jump, ["_g", "_i"]).select("_g", F.col("_to").alias("_i"))
        if reached.isEmpty():
            break
        starts = _cut(starts.unionByName(reached).distinct())
        jump = _cut(jump.join(jump.select("_g", F.col("_i").alias("_to"), F.col("_to").alias("_then")), ["_g", "_to"]).select("_g", "_i", F.col("_then").alias("_to")))
    # bins are numbered in order of their starts; a row is in the last bin that starts at or before it
    marked = every.withColumn("_g", F.struct(group)).join(starts.withColumn("_start", F.lit(1)), ["_g", "_i"], "left")
    ranked = running(marked.withColumn("_one", F.coalesce("_start", F.lit(0))).drop("_run", "_g").withColumnRenamed("_i", "_at"), group, ["_at"], "_one")
    return ranked.withColumn("bin", (F.col("_run") - 1).cast("int")).drop("_at", "_start", "_one", "_i", "_run")
