"""A persisted inverted index: texts are read once, searches read the postings of their terms and skip blocks.

Documents of a segment (one build or append) are dealt to blocks by the hash of their id.  The postings table has a row for each
(term, block): the documents with frequency and length, their number, and the greatest frequency and least length, from
which a bound of the term's BM25 score in the block follows whatever the statistics become.  It is partitioned by a
hash of the term and sorted by term and block.

A search sums the bounds of a query's terms for every block from the narrow columns alone, scores the best few blocks,
and then only those blocks whose bound reaches the k-th score found.  Ranks are those of a scan.  Null texts are empty;
documents of one id are told apart by nothing, so ids are unique within the store; empty documents count in the
statistics; a term's postings are never in one row, whatever its frequency.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Change, Snapshot, Store
from .retrieval import K1, B, top_k, words

BUCKETS, BLOCK = 32, 256
#: Documents that a task indexes, and the parts by terms that a bucket is written in at most.
DOCUMENTS, PARTS = 1 << 12, 8
#: Blocks of a query that are scored before the bound is known.
FIRST = 8


class Postings:
    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK):
        self.spark, self.store, self.block = spark, Store(spark, path), block

    def append(self, docs: DataFrame, doc: str, text: str) -> int:
        """Index documents as a segment."""
        segment = uuid.uuid4().hex

        def work(now: Snapshot) -> dict[str, Change]:
            read = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
            n = docs.count()
            read = read.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(max(1, -(-n // self.block)))))
            # texts are dealt by block, once: documents and their words, and the postings of a block, are then in one task, so
            # that neither counting nor gathering moves them again
            read = read.repartition(max(partitions(self.spark), -(-n // DOCUMENTS)), "block").select("doc", "block", words(F.col("text")).alias("w"))
            # the empty word stands for the document, so that its length is known without another reading
            each = read.select("doc", F.size("w").alias("len"), "block", F.explode(F.concat(F.array(F.lit("")), "w")).alias("term"))
            counted = each.groupBy("doc", "len", "block", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
            rows = counted.groupBy("term", "block").agg(
                F.sort_array(F.collect_list(F.struct("doc", "tf", "len"))).alias("docs"), F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), F.sum("len").alias("total")
            )
            rows = rows.withColumns({"segment": F.lit(segment), "bucket": bucket(F.col("term"))})
            # a bucket is cut by terms, so that no task sorts more than its share
            rows = rows.repartition(partitions(self.spark), "bucket", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(PARTS))).sortWithinPartitions("bucket", "term", "block")
            return {"postings": Change(rows, partition=["bucket"])}

        return self.store.transact(work)

    def rows(self, now: Snapshot, terms: list[str]) -> DataFrame:
        """The postings of some terms: partitions by hash, then row groups by term."""
        wanted = [F.lit(t) for t in terms]
        buckets = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*[bucket(t) for t in wanted]))).distinct().collect()]
        return now.table("postings").filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def search(self, queries: dict[int, str], k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
        """query, doc, score, rank as :func:`.retrieval.bm25` gives them."""
        now = self.store.snapshot()
        asked = {q: list(dict.fromkeys(x.lower().split())) for q, x in queries.items()}
        terms = sorted({t for x in asked.values() for t in x})
        if "postings" not in now.tables or not terms:
            return self.spark.createDataFrame([], "query long, doc long, score double, rank int")
        whole = self.rows(now, [""]).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
        n, average = whole["n"] or 0, (whole["total"] or 0) / max(1, whole["n"] or 0)
        narrow = self.rows(now, terms).select("term", "segment", "block", "n", "max_tf", "min_len")
        df = {r["term"]: r["df"] for r in narrow.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # the queries' terms
        rows = [(q, t, df[t]) for q, own in asked.items() for t in own if t in df]
        if not rows:
            return self.spark.createDataFrame([], "query long, doc long, score double, rank int")
        weights = F.broadcast(self.spark.createDataFrame(rows, "query long, term string, df long"))  # a row a query and term

        def part(tf: Column, length: Column) -> Column:
            idf = F.log(F.lit(1.0) + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
            return idf * tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * length / F.lit(average)))

        bounds = narrow.join(weights, "term").groupBy("query", "segment", "block").agg(F.sum(part(F.col("max_tf"), F.col("min_len"))).alias("bound"))

        def scored(blocks: DataFrame) -> DataFrame:
            chosen = self.rows(now, terms).join(weights, "term").join(blocks.select("query", "segment", "block"), ["query", "segment", "block"], "left_semi")
            each = chosen.select("query", "df", F.explode("docs").alias("d")).select("query", "d.doc", part(F.col("d.tf"), F.col("d.len")).alias("s"))
            return top_k(each.groupBy("query", "doc").agg(F.round(F.sum("s"), 6).alias("score")), "query", "score", "doc", k)

        first = top_k(bounds.withColumn("_at", F.struct("segment", "block")), "query", "bound", "_at", FIRST).drop("rank", "_at")
        found: dict[int, list[float]] = {}
        for r in scored(first).select("query", "score").collect():  # k rows a query
            found.setdefault(r["query"], []).append(r["score"])
        reached = [(q, min(s) if len(s) >= k else 0.0) for q, s in found.items()]
        least = F.broadcast(self.spark.createDataFrame(reached, "query long, least double"))
        # scores are rounded, and equal ones go by id, so a block that could just reach the k-th score is read as well
        self.blocks = bounds.join(least, "query").filter(F.col("bound") >= F.col("least") - 1e-5)
        return scored(self.blocks)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")
