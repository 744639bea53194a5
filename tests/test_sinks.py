"""Sinks and table sources, written and read again."""

from __future__ import annotations

import pytest

from loomwright.sources import sinks, tables


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, "b")], "n int, s string")
    assert sinks.save_output(df, f"{tmp_path}/a.csv").count() == 2
    got = tables.csv(spark, f"{tmp_path}/a.csv")
    assert got.dtypes == [("n", "int"), ("s", "string")] and {tuple(r) for r in got.collect()} == {(1, "é"), (2, "b")}
    sinks.save_output("text", f"{tmp_path}/a.txt", spark)
    assert spark.read.text(f"{tmp_path}/a.txt").first()[0] == "text"
    for data, name in ((df, "a.txt"), ("text", "a.csv")):
        with pytest.raises(ValueError):
            sinks.save_output(data, f"{tmp_path}/{name}", spark)


def test_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, "b")], "task int, s string")
    sinks.save_json(df, f"{tmp_path}/j", "task")
    assert spark.read.json(f"{tmp_path}/j").filter("task = 1").first()["s"] == "é"
    assert tables.json_documents(spark, f"{tmp_path}/j/task=1").count() == 1


def test_entities(spark, tmp_path):
    sinks.save_entities({"a": spark.range(2), "b": spark.range(3)}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/b").count() == 3


def test_todos(spark, tmp_path):
    good = spark.createDataFrame([("1", "x", "pending", "low")], "id string, content string, status string, priority string")
    sinks.write_todos(good, f"{tmp_path}/t")
    assert sinks.todos(spark, f"{tmp_path}/t").count() == 1 and sinks.todos(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="unknown status"):
        sinks.write_todos(good.selectExpr("id", "content", "'lost' as status", "priority"), f"{tmp_path}/t")
    assert sinks.todos(spark, f"{tmp_path}/t").count() == 1


def test_chunk_store(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "ab"), (2, "c")], "id long, chunk string")
    for _ in range(2):
        sinks.append_chunks(chunks, lambda texts: [[len(t)] for t in texts], f"{tmp_path}/store")
    assert sorted(r["embedding"] for r in spark.read.parquet(f"{tmp_path}/store").collect()) == [[1.0], [1.0], [2.0], [2.0]]
