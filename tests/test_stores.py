"""Atomic commits, the vector store and the postings."""

from __future__ import annotations

import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from loomwright.operators import postings, retrieval, vector_store
from loomwright.sources import sinks, versions

ROWS = "k long, v string"


def rows(spark, pairs):
    return spark.createDataFrame(pairs, ROWS)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_failing_task_leaves_the_table_as_it_was(spark, tmp_path):
    store = versions.Store(spark, f"{tmp_path}/s")
    store.append("t", rows(spark, [(1, "a"), (2, "b")]))
    bad = rows(spark, [(n, "x") for n in range(50)]).repartition(8).select("k", F.when(F.col("k") == 37, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).alias("v"))
    for change in (lambda: store.append("t", bad), lambda: store.replace("t", bad), lambda: store.upsert("t", bad, ["k"])):
        with pytest.raises(Exception, match="lost"):
            change()
        assert got(store.read("t")) == [(1, "a"), (2, "b")] and store.versions() == [1]
    assert store.vacuum() == [] and got(store.read("t")) == [(1, "a"), (2, "b")]


def test_two_writers_insert_every_key_once(spark, tmp_path):
    path, failed = f"{tmp_path}/s", []

    def write(who):
        try:
            for n in range(4):
                versions.Store(spark, path).insert_absent("t", rows(spark, [(k, who) for k in range(5 * n, 5 * n + 10)]), ["k"])
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in ("a", "b", "c")]
    [t.start() for t in threads], [t.join() for t in threads]
    store = versions.Store(spark, path)
    assert not failed and sorted(r["k"] for r in store.read("t").collect()) == list(range(25))
    assert store.versions() == list(range(1, 13))


def test_a_taken_number_makes_the_work_be_done_again(spark, tmp_path):
    store, seen = versions.Store(spark, f"{tmp_path}/s"), []

    def work(now):
        seen.append(now.version)
        if len(seen) == 1:  # another writer comes first
            versions.Store(spark, f"{tmp_path}/s").append("t", rows(spark, [(1, "other")]))
        return {"t": versions.Change(rows(spark, [(now.table("t", ROWS).count() + 1, "own")]))}

    assert store.transact(work) == 2 and seen == [0, 1]
    assert got(store.read("t")) == [(1, "other"), (2, "own")]
    with pytest.raises(versions.Conflict):
        store.transact(lambda now: versions.Store(spark, store.path).append("t", rows(spark, [])) and {}, attempts=2)


def test_upsert_delete_nulls_and_old_versions(spark, tmp_path):
    store = versions.Store(spark, f"{tmp_path}/s")
    assert got(store.read("t", ROWS)) == []
    with pytest.raises(KeyError):
        store.read("t")
    store.append("t", rows(spark, [(1, "a"), (None, "n"), (2, "b")]))
    store.upsert("t", rows(spark, [(2, "c"), (None, "m"), (3, "d"), (3, "d")]), ["k"])
    assert got(store.read("t")) == sorted([(1, "a"), (2, "c"), (3, "d"), (None, "m")], key=str)
    store.insert_absent("t", rows(spark, [(None, "z"), (4, "e")]), ["k"])
    store.delete({"t": F.col("k") > 2, "none": F.lit(True)})
    assert got(store.read("t")) == sorted([(1, "a"), (2, "c"), (None, "m")], key=str)
    assert got(store.snapshot(1).table("t")) == sorted([(1, "a"), (2, "b"), (None, "n")], key=str)
    assert len(store.vacuum()) == 3 and store.read("t").count() == 3


def test_a_chat_goes_from_all_tables_or_none(spark, tmp_path):
    store = versions.Store(spark, f"{tmp_path}/s")
    index = spark.createDataFrame([("a", 1), ("b", 2)], "chat_id string, n int")
    store.transact(lambda now: {"index": versions.Change(index), "messages": versions.Change(index.unionByName(index))})
    sinks.delete_chat(spark, f"{tmp_path}/s", "a", ["index", "messages"])
    now = store.snapshot()
    assert now.version == 2 and {n: {r["chat_id"] for r in now.table(n).collect()} for n in now.tables} == {"index": {"b"}, "messages": {"b"}}


# ---- vectors ----
def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)


def brute(vectors, queries, k):
    out = set()
    for q, v in queries.items():
        near = sorted((-round(cosine(x, v), 7), i) for i, x in vectors)[:k]
        out |= {(q, i, rank) for rank, (_, i) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize("clusters", [0, 12])
def test_search_is_exact_over_several_appends(spark, tmp_path, clusters):
    r = random.Random(clusters)
    gauss = lambda s: [r.gauss(0, s) for _ in range(8)]
    centres = [gauss(1) for _ in range(clusters)]
    point = lambda: [a + b for a, b in zip(r.choice(centres), gauss(0.05))] if clusters else gauss(1)
    vectors = [(i, [x * r.choice([0.1, 30]) for x in point()]) for i in range(600)]
    odd = [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0, None] * 4), (1004, [])]
    store = vector_store.VectorStore(spark, f"{tmp_path}/v", 16)
    queries = {q: point() for q in range(4)} | {9: [0.0] * 8}
    assert store.search(queries, 3).collect() == []
    for lo in range(0, 600, 200):
        store.append(spark.createDataFrame(vectors[lo : lo + 200] + odd, "id long, embedding array<double>").withColumn("cells", F.lit("kept")))
        got = store.search(queries, 7)
        assert {(x["query"], x["id"], x["rank"]) for x in got.collect()} == brute(vectors[: lo + 200], {q: v for q, v in queries.items() if any(v)}, 7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    few = store.search({0: queries[0]}, 7, probes=2)
    assert len(few.inputFiles()) and len({f.split("/cell=")[1].split("/")[0] for f in scanned(few)}) <= 2
    if clusters:  # the bound leaves most cells unread
        near = store.search({0: queries[0]}, 7)
        assert len({f.split("/cell=")[1].split("/")[0] for f in scanned(near)}) <= 8


def scanned(df):
    """The files that the scans of a plan list after pruning."""
    import re

    cells = re.findall(r"cell#\d+ IN \(([\d,]+)\)", df._jdf.queryExecution().optimizedPlan().toString()) or re.findall(r"cell#\d+ = (\d+)", df._jdf.queryExecution().optimizedPlan().toString())
    wanted = {c for x in cells for c in x.split(",")}
    return [f for f in df.inputFiles() if f.split("/cell=")[1].split("/")[0] in wanted]


def test_an_append_that_ended_early_is_made_good(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    vectors = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    df = lambda part: spark.createDataFrame(part, "id long, embedding array<double>")
    store = vector_store.VectorStore(spark, f"{tmp_path}/v", 8)
    store.append(df(vectors[:50]))
    monkeypatch.setattr(vector_store.VectorStore, "_reach", lambda self: None)
    store.append(df(vectors[50:]))
    monkeypatch.undo()
    assert {(x["query"], x["id"], x["rank"]) for x in store.search({0: vectors[0][1]}, 5).collect()} == brute(vectors, {0: vectors[0][1]}, 5)


# ---- postings ----
@pytest.mark.parametrize("block", [4, 64])
def test_postings_give_the_ranks_of_a_scan(spark, tmp_path, block):
    r = random.Random(block)
    vocabulary = ["The", "and"] * 20 + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randrange(0, 60)))) for i in range(300)] + [(900, None), (901, ""), (902, "the " * 500)]
    docs += [(910 + i, docs[7][1]) for i in range(12)]  # ties
    df = spark.createDataFrame([(*x, "clash") for x in docs], "id long, t string, term string")
    index = postings.Postings(spark, f"{tmp_path}/p", block)
    queries = {0: "the and", 1: "w1 w2 w3", 2: "w5 nowhere", 3: "nowhere", 4: "The w9 the"}
    assert index.search(queries).collect() == []
    index.append(df.filter("id % 3 = 0"), "id", "t")
    index.append(df.filter("id % 3 != 0"), "id", "t")
    want = retrieval.bm25(df.fillna("", ["t"]).select("id", "t"), "id", "t", queries)
    found = index.search(queries)
    assert [tuple(x) for x in found.orderBy("query", "rank").collect()] == [tuple(x) for x in want.orderBy("query", "rank").collect()]
    every = index.rows(index.store.snapshot(), ["w1", "w2", "w3"]).select("segment", "block").distinct().count()
    if block == 4:
        assert index.blocks.filter("query = 1").count() < 0.85 * every  # blocks that cannot reach the ranks are not read
    assert "PartitionFilters: [bucket" in found._jdf.queryExecution().executedPlan().toString()
