"""Retrieval: exact vector top-k for stated queries, BM25, weighted reciprocal-rank fusion, chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

K1, B, FUSION, WEIGHT = 1.5, 0.75, 60, 0.6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(scored: DataFrame, group: str, score: str, item: str, k: int) -> DataFrame:
    """The k best of each group, ties to the smaller item; the limit is applied before the shuffle as well."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def vector_top_k(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int = 10, cosine: bool = True, digits: int | None = None) -> DataFrame:
    """query, vec_id, score, rank for a few stated query vectors, kept as literals: one scan, no join."""
    norm = lambda v: F.sqrt(dot(v, v))
    each = []
    for q, v in queries:
        lit = F.array(*[F.lit(float(x)) for x in v])
        s = dot(F.col("embedding"), lit)
        each.append(F.struct(F.lit(q).cast("long").alias("query"), (s / (norm(F.col("embedding")) * norm(lit)) if cosine else s).alias("score")))
    scored = vectors.select("vec_id", F.explode(F.array(*each)).alias("e")).select(F.col("e.query").alias("query"), "vec_id", F.col("e.score").alias("score"))
    if digits is not None:  # scores that agree to so many digits are ties
        scored = scored.withColumn("score", F.round("score", digits))
    return top_k(scored, "query", "score", "vec_id", k)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def bm25(docs: DataFrame, doc: str, text: str, queries: dict[int, str], k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """query, doc, score, rank.  Only terms of the queries leave the documents; lengths are one number each."""
    terms = sorted({t for q in queries.values() for t in q.lower().split()})
    lexicon = F.array(*map(F.lit, terms))
    sized = docs.select(doc, words(F.col(text)).alias("_w")).select(doc, F.size("_w").alias("_len"), F.filter("_w", lambda x: F.array_contains(lexicon, x)).alias("_t"))
    sized = durable(sized, "bm25-terms")  # read for statistics, for how many have a term and for scores: texts are split once
    stats = sized.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"))
    tf = sized.select(doc, "_len", F.explode("_t").alias("term")).groupBy(doc, "_len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asked = docs.sparkSession.createDataFrame([(q, t) for q, x in queries.items() for t in dict.fromkeys(x.lower().split())], "query long, term string")
    idf = F.log(F.lit(1.0) + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("_len") / F.col("_avg")))
    # the terms of the queries and one row of statistics are few, whatever the corpus
    scored = tf.join(F.broadcast(df.join(F.broadcast(stats))), "term").join(F.broadcast(asked), "term").groupBy("query", doc).agg(F.sum(part).alias("score"))
    return top_k(scored.withColumn("score", F.round("score", 6)), "query", "score", doc, k)


def fuse(lists: list[tuple[DataFrame, float]], item: str, k: int = 10, constant: int = FUSION) -> DataFrame:
    """query, item, score, rank from ranked lists (query, item, rank) with weights."""
    every = None
    for ranked, weight in lists:
        part = ranked.select("query", item, (F.lit(weight) / (F.lit(float(constant)) + F.col("rank"))).alias("s"))
        every = part if every is None else every.unionByName(part)
    return top_k(every.groupBy("query", item).agg(F.round(F.sum("s"), 9).alias("score")), "query", "score", item, k)


def chunks(docs: DataFrame, keys: list[str], text: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """keys, chunk_pos, chunk: windows of ``size`` characters, each ``overlap`` into the one before."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step)).cast("int")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(F.col(text), i * step + 1, F.lit(size)))
    return docs.filter(F.length(text) > 0).select(*keys, F.posexplode(each).alias("chunk_pos", "chunk"))


def branch(weight: Column) -> Column:
    """Which search answers: vectors alone from a weight of 1 on, else vectors and words together."""
    return F.when(weight < 1, "hybrid").otherwise("vector")


@dataclass
class Question:
    """A stated question: a vector, words, and how much the vectors count."""

    query: int
    vector: list[float]
    words: str
    weight: float = WEIGHT


def answer(vectors: DataFrame, docs: DataFrame, questions: list[Question], k: int, doc: str, text: str) -> DataFrame:
    """query, branch, item, score, rank: questions of weight 1 by vectors alone, scored by cosine; the others by vectors and
    words, fused by rank.  A search runs only if a question needs it; vectors and documents share their ids."""
    if not questions:
        return docs.sparkSession.createDataFrame([], "query long, branch string, item long, score double, rank int")
    near = vector_top_k(vectors, [(q.query, q.vector) for q in questions], k, digits=9).select("query", F.col("vec_id").alias("item"), "score", "rank")
    alone, mixed = [q for q in questions if q.weight >= 1], [q for q in questions if q.weight < 1]
    out = [near.filter(F.col("query").isin([q.query for q in alone])).withColumn("branch", F.lit("vector"))] if alone else []
    if mixed:
        words = bm25(docs, doc, text, {q.query: q.words for q in mixed}, k).select("query", F.col(doc).alias("item"), "rank")
        share = F.element_at(F.create_map(*[F.lit(x) for q in mixed for x in (q.query, q.weight)]), F.col("query").cast("int"))
        part = lambda rows, weight: rows.filter(F.col("query").isin([q.query for q in mixed])).select("query", "item", (weight / (F.lit(float(FUSION)) + F.col("rank"))).alias("s"))
        both = part(near, share).unionByName(part(words, 1 - share)).groupBy("query", "item").agg(F.round(F.sum("s"), 9).alias("score"))
        out.append(top_k(both, "query", "score", "item", k).withColumn("branch", F.lit("hybrid")))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every.select("query", "branch", "item", "score", "rank")


def by_relevance(rows: DataFrame, group: str, score: str, item: str, k: int) -> DataFrame:
    """The k best of each group, with ``confidence``, the score as a share of the group's best."""
    best = F.max(score).over(Window.partitionBy(group))
    return top_k(rows.withColumn("confidence", F.col(score) / best), group, score, item, k)
