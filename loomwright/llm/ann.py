"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner products are nearest Euclidean neighbours on a sphere: vectors are split into ranges of their length (a
factor of two each), and in a range whose longest vector has length M a vector x becomes (x, sqrt(M^2 - |x|^2)) / M and a
query q becomes (q, 0) / |q|.  Within a range the added coordinate stays below one cell, so one long vector moves no others.

Each of L tables has k Gaussian (2-stable) projections; a vector's key is the k numbers floor((a.x + b) / w).  A query
visits its own bucket of each table and perturbed buckets, those that differ by one step up or down in some projections, in
the order of their estimated success (Lv et al. 2007): a neighbour at distance r projects to a normal distribution of
deviation r around the query's own projection, and a bucket's success is the product of the shares of that distribution
that fall in its cells.  How far the k-th neighbour can be is learned from scouts, a sample of the vectors: no answer is
farther.  A query stops as soon as the buckets visited find a neighbour at that distance with probability TARGET; ranges in
which no vector can be among the answers are not visited at all.  Candidates of all tables are merged and ranked by exact
inner products.

Equal vectors are one entry with its smallest ids, which is exact: no more than k + 1 of them can be among the answers.
Buckets are dealt to tasks, very large ones in slices.  A task holds the queries that visit it, reads its vectors in chunks,
and multiplies a query with the members of the buckets that it visits, each once.  Queries that meet fewer vectors than
asked for are answered by an exact pass over all, in blocks of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, only, shuffle_partitions, trimmed

TABLES, PROJECTIONS = 8, 10
#: Width of a cell; projections of the unit sphere have a deviation of 1.
WIDTH = 2.0
#: Probability with which a neighbour is to be met, and the most buckets that a query visits in a table.
TARGET, PROBES = 0.97, 700
SEED = 11
#: Vectors by which a query learns how near its neighbours are at least (a bound of the sample).
SCOUTS = 1 << 14
#: Members of a bucket from which it is dealt out in slices; vectors read at once, queries at once: bounds of memory.
SLICE, CHUNK, BLOCK = 1 << 16, 1 << 14, 64
#: Queries of an exact pass sent to all tasks at once.
EXACT_BLOCK = 1024


def _phi(x: np.ndarray) -> np.ndarray:
    """The normal distribution function (Abramowitz and Stegun 26.2.17, to 1e-7)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x > 0, 1 - tail, tail)


class Hashes:
    """The hash functions for vectors of ``size`` components, and the longest vector of each range of lengths."""

    def __init__(self, size: int, longest: dict[int, float], tables: int = TABLES, projections: int = PROJECTIONS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.longest, self.tables, self.projections = longest, tables, projections
        self.directions = rng.normal(size=(tables, projections, size + 1))
        self.offsets = rng.uniform(0, WIDTH, size=(tables, projections))

    def _projected(self, on_sphere: np.ndarray) -> np.ndarray:
        """(n, L, k) places in cells."""
        flat = on_sphere @ self.directions.reshape(-1, on_sphere.shape[1]).T
        return (flat.reshape(len(on_sphere), self.tables, self.projections) + self.offsets) / WIDTH

    def keys(self, vectors: np.ndarray, ranges: np.ndarray) -> np.ndarray:
        """(n, L) bucket keys of data vectors."""
        scaled = vectors / np.array([self.longest[r] for r in ranges.tolist()])[:, None]
        rest = np.sqrt(np.maximum(0.0, 1 - (scaled**2).sum(axis=1)))
        cells = np.floor(self._projected(np.concatenate([scaled, rest[:, None]], axis=1))).astype(np.int64)
        return _pack(cells, np.arange(self.tables), ranges[:, None])

    def probe_keys(self, queries: np.ndarray, floors: np.ndarray, target: float = TARGET, most: int = PROBES) -> list[np.ndarray]:
        """Of each query the keys of the buckets that it visits, likeliest first within a table and a range.  ``floors``:
        inner products that all answers reach."""
        lengths = np.sqrt((queries**2).sum(axis=1))
        at = self._projected(np.concatenate([queries / lengths[:, None], np.zeros((len(queries), 1))], axis=1))
        cell = np.floor(at)
        out: list[list[np.ndarray]] = [[] for _ in queries]
        for r, longest in sorted(self.longest.items()):
            nearest = floors / (lengths * longest)
            live = np.flatnonzero(nearest <= 1 + 1e-9)
            if not len(live):
                continue
            distance = np.sqrt(np.clip(2 - 2 * np.maximum(nearest[live], -1.0), 1e-4, 4.0))
            moves, chance = best_moves(((at - cell)[live]).reshape(-1, self.projections), np.repeat(distance, self.tables), most)
            found = 1 - np.prod(1 - np.minimum(np.cumsum(chance.reshape(len(live), self.tables, -1), axis=2), 1 - 1e-12), axis=1)
            probes = (found < target).sum(axis=1) + 1
            for n, i in enumerate(live.tolist()):
                own = moves[n * self.tables : (n + 1) * self.tables, : probes[n]]
                out[i].append(_pack(cell[i].astype(np.int64)[:, None, :] + own, np.arange(self.tables)[:, None], r).ravel())
        return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def best_moves(within: np.ndarray, distance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """within (n, k): places inside the own cell, 0 to 1; distance (n).  The ``most`` likeliest sets of steps (n, most, k),
    -1, 0 or 1 in each projection, and the probability of each, falling."""
    n, k = within.shape
    spread = (distance / WIDTH)[:, None]
    edges = [_phi((e - within) / spread) for e in (-1, 0, 1, 2)]
    log = np.log(np.maximum(np.stack([edges[2] - edges[1], edges[1] - edges[0], edges[3] - edges[2]]), 1e-30))  # stay, down, up
    total, code = np.zeros((n, 1)), np.zeros((n, 1), np.int64)
    for j in range(k):  # the best sets of the first projections hold the best of all
        total = np.concatenate([total + log[s, :, j, None] for s in range(3)], axis=1)
        code = np.concatenate([code + s * 3**j for s in range(3)], axis=1)
        if total.shape[1] > most:
            keep = np.argpartition(-total, most - 1, axis=1)[:, :most]
            total, code = np.take_along_axis(total, keep, axis=1), np.take_along_axis(code, keep, axis=1)
    order = np.argsort(-total, axis=1, kind="stable")
    total, code = np.take_along_axis(total, order, axis=1), np.take_along_axis(code, order, axis=1)
    return np.array([0, -1, 1])[(code[:, :, None] // 3 ** np.arange(k)) % 3], np.exp(total)


def _pack(cells: np.ndarray, table: np.ndarray, ranges) -> np.ndarray:
    """A 64-bit key of the k cell numbers, the table and the range (mixed, so that key collisions only add candidates)."""
    key = np.zeros(cells.shape[:-1], np.uint64) + (np.asarray(ranges, np.int64) * 64 + table).astype(np.uint64)
    for j in range(cells.shape[-1]):
        key = (key ^ cells[..., j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of rows that can take part: an id, a non-empty vector without null, NaN or infinite components,
    not all zero, and as long as the longest-established one (that of the smallest usable id).  Components keep their
    precision."""
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = only(vectors, ["vec_id", "embedding"]).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.coalesce(fine, F.lit(False)))
    size = rows.agg(F.min_by(F.size("v"), "vec_id").alias("d")).first()["d"]
    return rows.filter(F.size("v") == F.lit(size if size is not None else -1))


def _range() -> "F.Column":
    """The range of a vector's length: a binary logarithm, rounded so that lengths of about 1 share one."""
    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.floor(F.log2(F.sqrt(squared)) + 0.5).cast("int")


def fit(rows: DataFrame, tables: int = TABLES, projections: int = PROJECTIONS, seed: int = SEED) -> Hashes | None:
    """Hash functions for rows (vec_id, v) of :func:`usable`: one pass for the longest vector of each range (there are
    no more ranges than a number has exponents)."""
    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    got = rows.groupBy(_range().alias("r")).agg(F.max(squared).alias("most"), F.max(F.size("v")).alias("d")).collect()
    if not got:
        return None
    return Hashes(int(got[0]["d"]), {r["r"]: float(np.sqrt(r["most"])) * (1 + 1e-12) for r in got}, tables, projections, seed)


def _distinct(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids, r): each distinct vector with its ``keep`` smallest distinct ids, and its range.  The limit within a
    window's group is applied before the shuffle too, so a vector with very many copies sends few rows."""
    ranked = rows.withColumn("_r", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("_r") <= keep)
    return ranked.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("r", _range())


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, hashes: Hashes | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of largest inner product found for every usable query, itself
    excluded, ties to the smaller id.

    ``queries`` are rows of ``vectors`` (vec_id, embedding).  Rows that :func:`usable` leaves out neither ask nor answer;
    extra columns play no part; an empty table gives an empty result.  Repeated rows count once.  An id with several
    vectors is as near as its nearest, and asks with all of them.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    hashes = hashes or fit(rows)
    if hashes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = rows.schema["v"].dataType.simpleString()
    n = shuffle_partitions(spark)
    asked = rows.join(only(queries, ["vec_id"]).distinct(), "vec_id", "left_semi").distinct()
    entries = durable(_distinct(rows, k + 1), "ann-entries")
    questions = durable(asked.groupBy("v").agg(F.min("vec_id").alias("first")).repartition(n, "v"), "ann-questions")
    sample = entries.select("v", F.element_at("ids", 1).alias("id")).orderBy(F.xxhash64("v"), "v").limit(SCOUTS).toArrow()
    scouts = _matrix_of(sample.column("v"))[np.unique(sample.column("id").to_numpy(), return_index=True)[1]]  # one vector of an id
    shared = spark.sparkContext.broadcast((hashes, scouts))  # directions and a bounded sample
    found = _probed(entries, questions, shared, kind, k, n)
    best = _best(found, k)
    # a query that is a copy of another shares its answers; its own id goes, then the first k are left
    to = asked.join(questions, "v").select(F.col("vec_id").alias("query_id"), F.col("first").alias("query"))
    every = rows.select("vec_id").distinct().limit(k + 2).count()  # what there is to find, if less than k + 1
    best = durable(best, "ann-best")
    met = best.groupBy(F.col("query").alias("first")).agg(F.count(F.lit(1)).alias("_n"))
    few = durable(questions.join(met, "first", "left").filter(F.coalesce("_n", F.lit(0)) < min(k + 1, every)).select("v", "first"), "ann-few")
    if not few.isEmpty():
        answered = best.join(few.select(F.col("first").alias("query")), "query", "left_anti")
        best = answered.unionByName(_best(_exact(entries, few, k), k))
    own = to.join(best, "query").filter("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return own.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query, vec_id, score) -> the k + 1 best ids of each query."""
    found = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1).select("query", "vec_id", "score")


def _probed(entries: DataFrame, questions: DataFrame, shared, kind: str, k: int, n: int) -> DataFrame:
    """(query, vec_id, score) among the buckets that each query visits.

    A bucket's members go to the task that its key names, and from SLICE of them on to several; a query goes once to each
    task that holds a bucket of its own, with the keys of those."""
    spark = entries.sparkSession
    places = _places(spark, n)

    def only_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value[0].keys(_matrix(b.column(0)), b.column(1).to_numpy()).ravel())], names=["key"])

    sizes = entries.select("v", "r").mapInArrow(only_keys, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SLICE)
    # at most TABLES * vectors / SLICE rows
    slices = spark.sparkContext.broadcast({r["key"]: -(-r["n"] // SLICE) for r in sizes.collect()})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                keys = shared.value[0].keys(_matrix(b.column(0)), b.column(2).to_numpy())
                row = np.repeat(np.arange(len(keys)), keys.shape[1])
                keys = keys.ravel()
                to = (keys.view(np.uint64) % np.uint64(n)).astype(np.int64)
                begin, _, ids = _lists(b.column(1))
                for key, parts in slices.value.items():
                    here = np.flatnonzero(keys == key)
                    to[here] = (to[here] + ids[begin[row[here]]] % parts) % n
                take = pa.array(row)
                nothing = pa.array(np.zeros(len(row)))
                yield pa.RecordBatch.from_arrays([pa.array(places[to]), pa.array(np.full(len(row), -1)), pa.array(keys), b.column(0).take(take), b.column(1).take(take), nothing], names=["task", "query", "key", "v", "ids", "floor"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, scouts = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                q, first = _matrix(b.column(0)), b.column(1).to_numpy()
                floors = np.full(len(q), -np.inf)
                if len(scouts) > k:
                    floors = np.partition(q @ scouts.T, len(scouts) - k - 1, axis=1)[:, len(scouts) - k - 1]
                for i, keys in enumerate(hashes.probe_keys(q, floors)):
                    to, keys = _visited(keys)
                    if len(to):
                        cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                        lists = pa.ListArray.from_arrays(pa.array(np.r_[cut, len(to)].astype(np.int32)), pa.array(keys))
                        m = len(cut)
                        yield pa.RecordBatch.from_arrays([pa.array(places[to[cut]]), pa.array(np.full(m, first[i])), pa.array(np.zeros(m, np.int64)), b.column(0).take(pa.array(np.full(m, i))), lists, pa.array(np.full(m, floors[i]))], names=["task", "query", "key", "v", "ids", "floor"])

    def _visited(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = (keys.view(np.uint64) % np.uint64(n)).astype(np.int64)
        hot = [(key, parts) for key, parts in slices.value.items() if (keys == key).any()] if slices.value else []
        for key, parts in hot:  # the other slices of a large bucket
            more = (key % (1 << 64) % n + np.arange(1, min(parts, n))) % n
            to, keys = np.r_[to, more], np.r_[keys, np.full(len(more), key)]
        order = np.lexsort((keys, to))
        return to[order], keys[order]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks: list[pa.RecordBatch] = []
        members: list[pa.RecordBatch] = []
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held = 0
        for b in batches:  # all queries come first
            cut = int((b.column(1).to_numpy() >= 0).sum())
            if cut:
                asks.append(b.slice(0, cut))
            if cut < b.num_rows:
                members.append(b.slice(cut))
                held += b.num_rows - cut
                if held >= CHUNK:
                    _meet(asks, members, k, best)
                    members, held = [], 0
        _meet(asks, members, k, best)
        for query, (ids, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), query)), pa.array(ids), pa.array(scores)], names=["query", "vec_id", "score"])

    sent = f"task int, query long, key long, v {kind}, ids array<long>, floor double"
    both = entries.select("v", "ids", "r").mapInArrow(index, sent).unionByName(questions.select("v", "first").mapInArrow(probe, sent))
    return both.repartition(n, "task").sortWithinPartitions(F.col("query") < 0).mapInArrow(trimmed(visit), "query long, vec_id long, score double")


def _exact(entries: DataFrame, few: DataFrame, k: int) -> DataFrame:
    """(query, vec_id, score): the best of each query among all entries, a block of queries at a time."""
    spark = entries.sparkSession
    out, block = None, []

    def passed(block: list) -> DataFrame:
        asked = spark.sparkContext.broadcast((np.array([r["first"] for r in block]), np.array([r["v"] for r in block], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, q = asked.value
            for whole in batches:
                for at in range(0, whole.num_rows, CHUNK):
                    b = whole.slice(at, CHUNK)
                    data, (begin, end, flat) = _matrix(b.column(0)), _lists(b.column(1))
                    for i in range(len(q)):
                        ids, scores = _ranked(q[i], data, np.arange(len(data)), begin, end, flat, k)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), first[i])), pa.array(ids), pa.array(scores)], names=["query", "vec_id", "score"])

        return durable(entries.select("v", "ids").mapInArrow(trimmed(run), "query long, vec_id long, score double"), "ann-exact")

    for row in few.toLocalIterator():
        block.append(row)
        if len(block) == EXACT_BLOCK:
            part = passed(block)
            out, block = part if out is None else out.unionByName(part), []
    if block:
        part = passed(block)
        out = part if out is None else out.unionByName(part)
    return out


def _places(spark, n: int) -> np.ndarray:
    """For each of n partitions a number that hash partitioning sends there, so that tasks are dealt out one each."""
    tried = spark.range(64 * n).select(F.col("id").cast("int").alias("i")).groupBy(F.pmod(F.hash("i"), F.lit(n)).alias("p")).agg(F.min("i").alias("i")).collect()
    found = {r["p"]: r["i"] for r in tried}
    return np.array([found.get(p, p) for p in range(n)], np.int32)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _matrix_of(column: pa.ChunkedArray) -> np.ndarray:
    parts = [_matrix(c) for c in column.chunks if len(c)]
    return np.concatenate(parts) if parts else np.zeros((0, 0))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end) of each list within the flat values."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets[:-1], offsets[1:], column.values.to_numpy(zero_copy_only=False)


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best distinct ids, best first, ties to the smaller; fewer if there are no more."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[first], scores[first]


def _ranked(q: np.ndarray, data: np.ndarray, mine: np.ndarray, begin: np.ndarray, end: np.ndarray, flat: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores): the k + 1 best distinct ids among the rows ``mine`` of the data; what is under the floor may be left out."""
    rough = data[mine] @ q
    near = rough >= floor - 1e-9 * max(1.0, abs(floor)) if np.isfinite(floor) else np.ones(len(rough), bool)
    mine, rough = mine[near], rough[near]
    rows = k + 1
    while len(mine):  # rows of one id may take several places
        least = np.partition(rough, len(rough) - rows)[len(rough) - rows] if len(rough) > rows else -np.inf
        kept = mine[rough >= least - 1e-9 * max(1.0, abs(least))] if np.isfinite(least) else mine
        score = (data[kept] * q).sum(axis=1)  # one way of adding for all, whatever block a row stands in
        size = end[kept] - begin[kept]
        ids = flat[np.repeat(begin[kept], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        top = _top(ids, np.repeat(score, size), k + 1)
        if len(top[0]) > k or len(kept) == len(mine):
            return top
        rows *= 2
    return np.zeros(0, np.int64), np.zeros(0)


def _meet(asks: list[pa.RecordBatch], members: list[pa.RecordBatch], k: int, best: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
    """Bring the best k + 1 ids of each query up to date with the members of the buckets that it visits here."""
    if not members or not asks:
        return
    table = pa.Table.from_batches(members).combine_chunks().to_batches()[0]
    key = table.column(2).to_numpy()
    order = np.argsort(key, kind="stable")
    key, data = key[order], _matrix(table.column(3))[order]
    begin, end, flat = _lists(table.column(4))
    begin, end = begin[order], end[order]
    # a vector's entries of several tables meet here at times: they count as one
    odd = np.random.default_rng(SEED).integers(0, 1 << 62, data.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    _, entry = np.unique(((data + 0.0).view(np.uint64) * odd).sum(axis=1, dtype=np.uint64), return_inverse=True)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    bucket, stop = key[start], np.r_[start[1:], len(key)]
    for b in asks:
        first, q, floors = b.column(1).to_numpy(), _matrix(b.column(3)), b.column(5).to_numpy()
        lo, hi, visits = _lists(b.column(4))
        for i in range(b.num_rows):
            wanted = visits[lo[i] : hi[i]]
            at = np.searchsorted(bucket, wanted)
            at = at[(at < len(bucket)) & (bucket[np.minimum(at, len(bucket) - 1)] == wanted)]
            if not len(at):
                continue
            size = stop[at] - start[at]
            mine = np.repeat(start[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            mine = mine[np.unique(entry[mine], return_index=True)[1]]
            own = best.get(int(first[i]))
            floor = max(floors[i], own[1][-1]) if own is not None and len(own[0]) > k else floors[i]
            ids, scores = _ranked(q[i], data, mine, begin, end, flat, k, floor)
            if len(ids):
                best[int(first[i])] = (ids, scores) if own is None else _top(np.r_[own[0], ids], np.r_[own[1], scores], k + 1)
