"""A persisted vector store: cells around pivots on disk, appended to, searched by reading only the cells that can matter.

Vectors are normalised and filed under the nearest of a bounded number of pivots, the sample of the first batch with the
least digests.  A cell is a partition folder, so a search names the cells that it reads and Spark's scan prunes the rest;
each append also files how far the cell reaches from its pivot.  Since the angle between a query and a vector is at least the
angle to the pivot less the cell's reach, an exact search reads the nearest cells first and then only those whose bound
beats the k-th score found; with ``probes`` it reads that many cells and no more.

The store commits through :mod:`..sources.versions`: an append is whole or not there.  Null, zero and non-finite vectors
are left out; vectors of one id are all kept; an empty store answers nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.versions import Change, Snapshot, Store

CELLS = 64
#: Cells read before the bound is known, and slack for rounding in angles.
FIRST, SLACK = 4, 1e-6
NOTHING = "query long, `{}` long, score double, rank int"


class VectorStore:
    def __init__(self, spark: SparkSession, path: str, cells: int = CELLS):
        self.spark, self.store, self.cells = spark, Store(spark, path), cells

    def _pivots(self, now: Snapshot) -> np.ndarray | None:
        """The pivots, at most ``cells`` vectors."""
        if "pivots" not in now.tables:
            return None
        rows = now.table("pivots").orderBy("cell").collect()
        return np.array([r["pivot"] for r in rows], np.float64) if rows else None

    def append(self, rows: DataFrame, item: str = "id", vector: str = "embedding") -> int:
        """File the vectors of rows; the columns beside the vector are kept as they are."""
        finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
        length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        good = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).filter(finite).withColumn("_l", length).filter("_l > 0")
        good = good.withColumn(vector, F.transform(vector, lambda x: x.cast("double") / F.col("_l"))).drop("_l")

        def work(now: Snapshot) -> dict[str, Change]:
            pivots, changes = self._pivots(now), {}
            if pivots is None:
                chosen = good.select(vector, F.md5(F.col(item).cast("string").cast("binary")).alias("_d"), F.xxhash64(vector).alias("_h")).orderBy("_d", "_h").limit(self.cells).collect()
                if not chosen:
                    return {}
                pivots = np.array([r[vector] for r in chosen], np.float64)
                changes["pivots"] = Change(self.spark.createDataFrame([(k, p) for k, p in enumerate(pivots.tolist())], "cell int, pivot array<double>"), replace=True)
            shared = self.spark.sparkContext.broadcast(pivots)  # at most ``cells`` vectors

            def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    dots = np.stack(b[vector].to_list()) @ shared.value.T if len(b) else np.zeros((0, 1))
                    cell = dots.argmax(axis=1) if len(b) else np.zeros(0, int)
                    yield b.assign(angle=np.arccos(np.clip(dots[np.arange(len(b)), cell], -1, 1)) if len(b) else [], cell=cell.astype(np.int32))

            kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in good.schema.fields)
            filed = good.mapInPandas(file, f"{kind}, angle double, cell int")
            changes["vectors"] = Change(filed, partition=["cell"])
            return changes

        version = self.store.transact(work)
        self._reach()
        return version

    def _reach(self) -> None:
        """How far each cell reaches, from the angles alone, and of how many appends that is known."""

        def work(now: Snapshot) -> dict[str, Change]:
            if "vectors" not in now.tables:
                return {}
            found = now.table("vectors").groupBy("cell").agg(F.max("angle").alias("reach"), F.count(F.lit(1)).alias("n"))
            return {"cells": Change(found.withColumn("appends", F.lit(len(now.tables["vectors"]["folders"]))), replace=True)}

        self.store.transact(work)

    def _cells(self, now: Snapshot) -> tuple[Snapshot, dict[int, float]]:
        """A snapshot and the reach of its cells, made anew if an append ended before it was known."""
        while True:
            rows = now.table("cells").collect() if "cells" in now.tables else []  # at most one row a cell
            if rows and rows[0]["appends"] == len(now.tables["vectors"]["folders"]):
                return now, {r["cell"]: r["reach"] for r in rows}
            if "vectors" not in now.tables or not (rows or now.table("vectors").take(1)):
                return now, {}
            self._reach()
            now = self.store.snapshot()

    def scan(self, now: Snapshot, cells: list[int]) -> DataFrame:
        """The vectors of some cells: no other partition is read."""
        return now.table("vectors").filter(F.col("cell").isin(cells))

    def search(self, queries: dict[int, list[float]], k: int = 10, item: str = "id", vector: str = "embedding", probes: int | None = None) -> DataFrame:
        """query, item, score (cosine), rank, for a few stated query vectors; exact unless ``probes`` is given.  Ties go to
        the smaller item."""
        now = self.store.snapshot()
        pivots = self._pivots(now)
        if pivots is None:
            return self.spark.createDataFrame([], NOTHING.format(item))
        asked = {q: np.array(v, np.float64) / np.linalg.norm(v) for q, v in queries.items() if v is not None and np.all(np.isfinite(v)) and np.linalg.norm(v) > 0}
        now, cells = self._cells(now)
        if not cells or not asked:
            return self.spark.createDataFrame([], NOTHING.format(item))
        angle = {q: np.arccos(np.clip(pivots @ v, -1, 1)) for q, v in asked.items()}
        near = {q: sorted(cells, key=lambda c: (a[c], c))[: probes or FIRST] for q, a in angle.items()}
        first = self._scored(now, asked, near, k, item, vector)
        if probes:
            return first
        found = {q: [] for q in asked}
        for r in first.select("query", "score").collect():  # k rows a query
            found[r["query"]].append(r["score"])
        wanted = {}
        for q, a in angle.items():
            least = min(found[q]) if len(found[q]) >= k else -2.0
            wanted[q] = sorted(c for c, reach in cells.items() if c in near[q] or np.cos(max(0.0, a[c] - reach - SLACK)) >= least - SLACK)
        return first if all(set(wanted[q]) == set(near[q]) for q in asked) else self._scored(now, asked, wanted, k, item, vector)

    def _scored(self, now: Snapshot, asked: dict, cells: dict[int, list[int]], k: int, item: str, vector: str) -> DataFrame:
        rows = self.scan(now, sorted({c for own in cells.values() for c in own}))
        each = []
        for q, v in asked.items():
            literal = F.array(*[F.lit(float(x)) for x in v])
            score = F.aggregate(F.zip_with(F.col(vector), literal, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
            each.append(F.when(F.col("cell").isin(cells[q]), F.struct(F.lit(q).cast("long").alias("query"), F.round(score, 9).alias("score"))))
        rows = rows.select(item, F.explode(F.array_compact(F.array(*each))).alias("e")).select("e.query", item, "e.score")
        w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col(item))
        return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
