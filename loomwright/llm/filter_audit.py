"""Filter interaction audit: what each of five quality filters removes, alone and in every order.

Relational throughout.  Words are exploded and aggregated by (document, word), then by document, for totals and distinct
words; the flags that need no words come from the texts directly and are outer-joined; then each part aggregates 32
conditional counts, one for each combination of failed filters.  All 120 orders follow from those counts.

Texts are dealt by document before they are exploded, so that both aggregations run without moving a word.  A document is
an id and two 64-bit hashes of its text; rows that share them are told apart no further, since they are equal in all that is
counted but the source.  The dealing is salted by the scan's partition, so that a row repeated very often is spread; the row
that stands for the document itself (word null) says how many copies a group holds.

Defined results: a null text is empty; rows of one id and text count each; a row without an id has no smaller or greater id,
so it never repeats another and is never repeated; a label counts if any row of the id has it; an empty table has no parts;
extra columns play no part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WORD_BREAK, durable, only, shuffle_partitions

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 200, 50, 2, "[#$%&*|]"
#: Bytes of a partition of texts, by the optimizer's estimate, and the most partitions to deal them to.
TEXT_BYTES, MOST_PARTITIONS = 8 << 20, 100_000
COMBINATIONS = 1 << len(FILTERS)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, source and text (nulls as empty texts) with the two hashes ``h`` and ``g`` of the text."""
    rows = only(docs, ["doc_id", "source", "text"])
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumns({"h": F.xxhash64("text"), "g": F.xxhash64(F.lit(1), "text")})


def word_totals(docs: DataFrame) -> DataFrame:
    """doc_id, h, g, n_words, n_distinct: one row for each id and text."""
    rows = _keyed(docs)
    spark = docs.sparkSession
    size = int(str(only(docs, ["doc_id", "text"])._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(shuffle_partitions(spark), min(size // TEXT_BYTES if size < 1 << 50 else 0, MOST_PARTITIONS))
    dealt = rows.withColumn("salt", F.spark_partition_id()).repartition(n, "doc_id", "h", "g", "salt")
    words = F.array_remove(F.split("text", WORD_BREAK), "")
    exploded = dealt.select("doc_id", "h", "g", "salt", F.explode(F.concat(F.array(F.lit(None).cast("string")), words)).alias("word"))
    by_word = exploded.groupBy("doc_id", "h", "g", "salt", "word").agg(F.count(F.lit(1)).alias("n"))
    word = F.col("word").isNotNull()
    by_doc = by_word.groupBy("doc_id", "h", "g", "salt").agg(
        F.coalesce(F.sum(F.when(word, F.col("n"))), F.lit(0)).alias("all"), F.count("word").alias("n_distinct"), F.max(F.when(~word, F.col("n"))).alias("copies")
    )
    # every copy has the same words: groups of different salts agree
    return by_doc.groupBy("doc_id", "h", "g").agg(F.max(F.expr("all div copies")).alias("n_words"), F.max("n_distinct").alias("n_distinct"))


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, n (rows of one id, text and source) and ``mask``: bit k is set if the document fails filter k."""
    text = F.col("text")
    flags = _keyed(docs).select(
        "doc_id", "part", "h", "g", F.sha2(text.cast("binary"), 256).alias("sha"),
        (100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MAX_CAPITALS * F.length(text).cast("long")).alias("c"), text.rlike(MARKS).alias("d"),
    )
    flags = durable(flags.groupBy("doc_id", "part", "h", "g", "sha", "c", "d").agg(F.count(F.lit(1)).alias("n")), "filter-flags")
    # written, so that both sides of the join are plain shuffles and a text with very many copies can be split
    first = durable(flags.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select(F.col("sha").alias("same"), "first"), "filter-first")
    totals = word_totals(docs).select(F.col("doc_id").alias("id"), F.col("h").alias("h1"), F.col("g").alias("g1"), "n_words", "n_distinct")
    both = flags.join(totals, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("h1")) & (F.col("g") == F.col("g1")), "left_outer")
    both = both.join(first, F.col("sha") == F.col("same"), "left_outer")
    fails = [F.col("n_words") < MIN_WORDS, 100 * F.col("n_distinct") < MIN_DISTINCT * F.col("n_words"), F.col("c"), F.col("d"), F.col("doc_id") > F.col("first")]
    mask = sum((F.when(x, F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(fails)), F.lit(0))
    return both.select("doc_id", "part", "n", mask.alias("mask"))


def combination_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part and three arrays of 32 counts, by the combination of failed filters: documents, good ones, toxic ones."""
    marks = only(labels, ["doc_id", "quality", "toxic"]).filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled"))
    marks = durable(marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")), "filter-labels")
    rows = failures(docs).join(marks, F.col("doc_id") == F.col("labelled"), "left_outer")

    def counts(name: str, extra: Column | None = None) -> Column:
        at = [F.col("mask") == m if extra is None else (F.col("mask") == m) & extra for m in range(COMBINATIONS)]
        return F.array(*[F.sum(F.when(x, F.col("n")).otherwise(F.lit(0).cast("long"))) for x in at]).alias(name)

    return rows.groupBy("part").agg(counts("docs"), counts("good", F.col("good") == 1), counts("toxic", F.col("toxic") == 1))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of every step of every order of the filters."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    rows = combination_counts(docs, labels).withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
    rows = rows.withColumn("step", F.explode(F.array(*[F.lit(k + 1) for k in range(len(FILTERS))])))
    letter, before = F.expr("substring(filter_order, step, 1)"), F.expr("substring(filter_order, 1, step - 1)")

    def bits(letters: Column) -> Column:
        return sum((F.when(letters.contains(x), F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(FILTERS)), F.lit(0))

    rows = rows.withColumns({"own": bits(letter), "before": bits(before)})
    own, earlier = F.col("own"), F.col("before")

    def total(column: str, holds, weight=lambda m: F.lit(1)) -> Column:
        masks = F.filter(F.sequence(F.lit(0), F.lit(COMBINATIONS - 1)), holds)
        return F.aggregate(masks, F.lit(0).cast("long"), lambda s, m: s + F.get(F.col(column), m) * weight(m))

    fails = lambda m: m.bitwiseAND(own) != 0
    here = lambda m: fails(m) & (m.bitwiseAND(earlier) == 0)
    # of the orders in which k filters fail a document, each of them comes first equally often
    share = lambda m: (F.lit(len(orders)) / F.bit_count(m)).cast("int")
    return rows.select(
        "part", "filter_order", "step",
        total("docs", lambda m: m.bitwiseAND(own.bitwiseOR(earlier)) == 0).alias("kept"),
        total("docs", here).alias("removed"),
        total("docs", lambda m: fails(m) & (m.bitwiseAND(earlier) != 0)).alias("redundant"),
        F.get("docs", own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        total("docs", fails, share).alias("shapley"),
    )


#: DuckDB text of the op12 query.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
s AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS words FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, (len(words) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(words)) < {MIN_DISTINCT} * len(words))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(t))::INT + 8 * regexp_matches(t, '{MARKS}')::INT + 16 * coalesce(doc_id > first, FALSE)::INT AS mask,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w JOIN s USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(letter, bit)),
orders AS (SELECT v.letter || w.letter || x.letter || y.letter || z.letter AS filter_order FROM letters v, letters w, letters x, letters y, letters z WHERE v.bit + w.bit + x.bit + y.bit + z.bit = 31 AND v.bit | w.bit | x.bit | y.bit | z.bit = 31),
steps AS (SELECT filter_order, step::INT AS step, letter, bit AS own, coalesce((SELECT sum(bit) FROM letters e WHERE contains(filter_order[: step - 1], e.letter)), 0)::BIGINT AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step) JOIN letters ON letter = filter_order[step]),
r AS (SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (mask & (own | earlier) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & own <> 0 AND mask & earlier <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
  FROM c, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
