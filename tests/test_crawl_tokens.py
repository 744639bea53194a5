"""Crawls that go on where they were cut off, link streams, and token counts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomwright.functions import tokens
from loomwright.operators import views
from loomwright.sources.versions import Store
from loomwright.streaming import crawl, sessions


def site(seed=1, n=40):
    r = random.Random(seed)
    return {f"http://h{i % 3}/p{i}": [f"http://h{j % 3}/p{j}" + r.choice(["", "/", "#x"]) for j in r.sample(range(n), 2)] for i in range(n)}


def plain(pages, seeds, rounds):
    out, front = {u: (None, 0) for u in seeds}, seeds
    for k in range(1, rounds + 1):
        new = {}
        for u in front:
            for v in pages.get(u, []):
                v = v.split("#")[0].rstrip("/")
                if v not in out:
                    new[v] = min(new.get(v, u), u)
        out |= {v: (p, k) for v, p in new.items()}
        front = list(new)
    return out


@pytest.mark.parametrize("rounds", [0, 3, 50])
def test_a_crawl_finds_each_page_once(spark, tmp_path, rounds):
    pages = site()
    table = spark.createDataFrame([(u, v) for u, own in pages.items() for v in own] + [("http://h0/p0", None), ("http://h0/p0", "")], "page string, url string")
    links = lambda front: table.withColumnRenamed("url", "to").join(front, F.col("page") == F.col("url")).select(F.col("page").alias("parent"), F.col("to").alias("url"))
    seeds = spark.createDataFrame([("http://h0/p0/",), ("http://h0/p0#a",), (None,)], "url string")
    want = plain(pages, ["http://h0/p0"], rounds)
    got = crawl.crawl(spark, f"{tmp_path}/c", seeds, links, rounds).collect()
    assert len(got) == len(want) and {r["url"]: (r["parent"], r["round"]) for r in got} == want
    if rounds == 3:  # cut off in the third round, and taken up again
        store, calls = Store(spark, f"{tmp_path}/c"), []

        def lost(front):
            calls.append(1)
            if len(calls) == 3:
                return links(front).withColumn("url", F.raise_error(F.lit("executor lost")).cast("string"))
            return links(front)

        with pytest.raises(Exception, match="executor lost"):
            crawl.crawl(spark, f"{tmp_path}/again", seeds, lost, rounds)
        again = Store(spark, f"{tmp_path}/again")
        assert again.versions() == [1, 2, 3] and again.read("seen").agg(F.max("round")).first()[0] == 2
        assert {tuple(r) for r in crawl.crawl(spark, again.path, seeds, lost, rounds).collect()} == {tuple(r) for r in store.read("seen").collect()}
    only = crawl.crawl(spark, f"{tmp_path}/only", seeds, links, rounds, wanted=lambda u: u.startswith("http://h0"))
    assert all(r["url"].startswith("http://h0") for r in only.collect())


def test_a_link_stream_gives_each_address_once_and_survives_a_restart(spark, tmp_path):
    schema, root = "url string, parent string", str(tmp_path / "in")

    def arrive(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(root)

    def run():
        stream = crawl.unseen_links(sessions.new_files(spark, root, spark.createDataFrame([], schema).schema, per_batch=1))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return sorted(r["url"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    arrive(1, [("http://a/1", None), ("http://a/1#x", "p"), ("http://b/1/", None), (None, "p"), ("", "p")])
    assert run() == ["http://a/1", "http://b/1"]
    arrive(2, [("http://a/1", "q"), ("http://a/2", "q"), ("http://b/1", "q")])
    assert run() == ["http://a/1", "http://a/2", "http://b/1"]
    assert run() == ["http://a/1", "http://a/2", "http://b/1"]


def test_token_counts_are_those_of_the_public_tokenizer(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_50k.tiktoken")
    count = tokens.counter(spark, path, public.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=tokens.ranks_of(path), special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "<|endoftext|> é漢😀"), (-4, "x" * 20_000)], docs.schema))
    got = docs.select("text", count(F.col("text")).alias("n")).collect()
    assert len(got) > 100 and all(r["n"] == len(own.encode_ordinary(r["text"] or "")) for r in got)
    # any budget takes the counter
    code = spark.createDataFrame([("import os\n" + "\n".join(f"def f{i}(a, b):\n    return a" for i in range(80)),)], "c string")
    n = code.select(count(F.col("c")).alias("n")).first()["n"]
    shown = lambda budget: code.select(views.adaptive(F.col("c"), F.lit("skeleton"), budget, count).alias("o")).first()["o"]
    assert shown(n + 1) == code.first()["c"] and shown(n) != code.first()["c"] and shown(5) == "skeleton"
    (tmp_path / "large").write_bytes(b"x" * 100)
    tokens_most, tokens.MOST_BYTES = tokens.MOST_BYTES, 10
    try:
        with pytest.raises(ValueError):
            tokens.ranks_of(str(tmp_path / "large"))
    finally:
        tokens.MOST_BYTES = tokens_most
