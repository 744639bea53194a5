"""Streams against the same results in batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomwright.sources import tables
from loomwright.streaming import sessions


@pytest.fixture
def feed(spark, tmp_path):
    """A folder of small files, one per micro-batch."""

    def write(batches, schema):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
        return f"{tmp_path}/in"

    return write


def run(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination(180)
    return stream.sparkSession.table(name).collect()


def test_repeats_across_batches(spark, feed, tmp_path):
    schema = "conv_id long, turn long, text string"
    root = feed([[(1, 0, "a"), (1, 1, "a"), (2, 0, "x")], [(1, 2, "a"), (1, 3, "b"), (2, 1, "y")], [(1, 4, "a")]], schema)
    got = run(sessions.without_repeats(sessions.new_files(spark, root, schema, per_batch=1)), "repeats", tmp_path)
    assert {(1, 4), (1, 3), (2, 0), (2, 1)} <= {(r["conv_id"], r["turn"]) for r in got} and len(got) in (5, 6)


def test_overflow_restarts(spark, feed, tmp_path):
    schema = "conv_id long, turn long, tokens long"
    root = feed([[(1, i, 40) for i in range(9)]], schema)
    got = sorted((r["turn"], r["used"], r["restarts"], r["restarted"]) for r in run(sessions.overflow(sessions.new_files(spark, root, schema), 100, 2), "overflow", tmp_path))
    assert [g[0] for g in got if g[3]] == [2, 5] and got[-1][1:3] == (120, 2)


def test_windowed_counts(spark, feed, tmp_path):
    schema = "ts timestamp, kind string"
    base = spark.sql("select timestamp'2024-01-01 00:00:00' as t").first()["t"]
    import datetime as dt

    root = feed([[(base + dt.timedelta(minutes=m), "a") for m in (0, 10, 70)], [(base + dt.timedelta(hours=9), "b")]], schema)
    got = run(sessions.windowed_counts(sessions.new_files(spark, root, schema, per_batch=1), "ts", "kind"), "windows", tmp_path)
    assert sorted(r["n"] for r in got if r["kind"] == "a") in ([1, 2], [])


def test_running_text(spark, feed, tmp_path):
    root = feed([[(1, "ab")], [(1, "cd")]], "s long, t string")
    got = run(sessions.running_text(sessions.new_files(spark, root, "s long, t string"), "s", "t"), "texts", tmp_path, "complete")
    assert sorted(got[0]["text"]) == ["a", "b", "c", "d"]


def test_upsert_sink(spark, feed, tmp_path):
    schema = "id long, v string"
    root = feed([[(1, "a"), (2, "b")], [(2, "c"), (3, "d")]], schema)
    out = f"{tmp_path}/out"
    q = sessions.new_files(spark, root, schema, per_batch=1).writeStream.foreachBatch(sessions.upsert_sink(["id"], out)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert tables.stored(spark, out, schema).select(F.sort_array(F.collect_list("id"))).first()[0] == [1, 2, 3]
