"""Source divergence audit: how far the sources of a language lie apart in the terms they use.

Plain relational: matches of the term pattern are exploded and counted by (language, source, term); terms in enough documents
of their language are kept; every group is crossed with its language's kept terms, so that absent ones count zero; a self-join
on language and term compares two groups term by term; sums and ranks follow.  Each document gives its matches and then its distinct
terms, so that one pass counts occurrences and documents.

Groups are joined to kept terms on the language and one of ``SPREAD`` parts of the terms, since a language alone would be a hot
key; of two groups' comparisons one is computed and read in both directions, the measure being symmetric.

Defined results: nulls in text, lang and source are empty strings; rows of one doc_id are documents of their own; a group
without terms, or in a language that keeps none, still has its pairs; an empty table gives no rows; a very long text is one
row's array of words; extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, durable, only

#: Runs of A-Z, a-z and all that is not ASCII.
TERM = r"[A-Za-z\x{80}-\x{10FFFF}]+"
MIN_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
SPREAD = 64


def _lowered(text: Column) -> Column:
    """Only A-Z in lower case; a text of ASCII alone goes the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def term_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source) of every group, and lang, source, term, count, docs: its terms with occurrences and documents."""
    rows = only(docs, ["lang", "source", "text"]).select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms = rows.select("lang", "source", F.regexp_extract_all(_lowered(F.col("text")), F.lit(TERM), F.lit(0)).alias("terms"))
    # all matches of a document, then its distinct ones: one pass counts occurrences and documents
    both = terms.select("lang", "source", F.size("terms").alias("n"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("at", "term"))
    again = (F.col("at") >= F.col("n")).cast("long")
    return rows.select("lang", "source").distinct(), both.groupBy("lang", "source", "term").agg(F.sum(1 - again).alias("count"), F.sum(again).alias("docs"))


def probabilities(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """The groups, and lang, source, term, count, p, q: dense over the kept terms; q is the whole language's p."""
    groups, counts = term_counts(docs)
    # a term has at most one entry for each source of its language
    entry = F.struct("source", "count")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(entry).alias("counts"))
    kept = durable(kept.filter(F.col("docs") >= min_docs).select("lang", "term", "counts"), "kept-terms")
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sums = kept.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("count").alias("total"))
    whole = sums.groupBy("lang").agg(F.sum("total").alias("all"))
    groups = durable(groups, "language-groups")
    every = groups.join(sums, ["lang", "source"], "left_outer").join(size, "lang").join(whole, "lang")
    every = every.select("lang", "source", (F.coalesce("total", F.lit(0)) + 2 * F.col("v")).alias("below"), (F.col("all") + 2 * F.col("v")).alias("below_all"))
    every = every.withColumn("part", F.explode(F.array(*map(F.lit, range(SPREAD)))))
    dense = kept.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(SPREAD)).cast("int"))
    dense = dense.withColumns({"all": F.aggregate("counts", F.lit(0).cast("long"), lambda n, x: n + x["count"]), "counts": F.map_from_entries("counts")}).join(every, ["lang", "part"])
    dense = dense.withColumn("count", F.coalesce(F.try_element_at("counts", F.col("source")), F.lit(0)))
    scaled = lambda n: (F.col(n).cast("decimal(20,0)") + 2) * F.lit(SCALE).cast("decimal(10,0)")
    dense = dense.withColumns({"above": scaled("count"), "above_all": scaled("all")})
    dense = dense.select("lang", "source", "term", "count", F.expr("1 + above div below").alias("p"), F.expr("1 + above_all div below_all").alias("q"))
    return groups, durable(dense, "dense-terms")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` ranks the other sources of the language by their distance,
    ``term`` the terms by which a source stands out from its language."""
    groups, dense = probabilities(docs, min_docs)
    # the same rows on both sides, so that one shuffle serves both
    own = dense.select("lang", "source", "term", "p")
    x, y = own.alias("x"), own.alias("y")
    both = x.join(y, (F.col("x.lang") == F.col("y.lang")) & (F.col("x.term") == F.col("y.term")) & (F.col("x.source") < F.col("y.source")))
    apart = F.expr("(x.p - y.p) * (x.p - y.p) div (x.p + y.p)")
    sums = both.groupBy(F.col("x.lang").alias("lang"), F.col("x.source").alias("source"), F.col("y.source").alias("item")).agg(F.sum(apart).alias("value"))
    sums = durable(sums, "source-distances")
    sums = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    # sources of a language that keeps no terms have pairs as well
    pairs = groups.join(groups.withColumnRenamed("source", "item"), "lang").filter("source != item").join(sums, ["lang", "source", "item"], "left_outer")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = dense.filter("count > 0 and p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP_TERMS)
    return pairs.unionByName(terms)


#: DuckDB text of the op13 query.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), '{UPPER}', '{LOWER}') AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
kept AS (SELECT lang, term FROM (SELECT DISTINCT r, lang, term FROM w) GROUP BY ALL HAVING count(*) >= {MIN_DOCS}),
k AS (SELECT c.* FROM c JOIN kept USING (lang, term)),
g AS (SELECT DISTINCT lang, source, FALSE AS whole FROM d UNION ALL SELECT DISTINCT lang, '', TRUE FROM d),
kk AS (SELECT lang, source, FALSE AS whole, term, n FROM k UNION ALL SELECT lang, '', TRUE, term, sum(n) FROM k GROUP BY lang, term),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
t AS (SELECT lang, source, whole, sum(n) AS total FROM kk GROUP BY ALL),
p AS (SELECT g.lang, g.source, g.whole, kept.term, coalesce(n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(n, 0) + 2)) // (coalesce(total, 0) + 2 * v) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source, whole) LEFT JOIN kk ON kk.lang = g.lang AND kk.source = g.source AND kk.whole = g.whole AND kk.term = kept.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source AND NOT a.whole AND NOT b.whole GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source AND NOT x.whole AND NOT y.whole LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
terms AS (SELECT a.lang, a.source, 'term' AS part, a.term AS item, (((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND NOT a.whole AND b.whole AND a.n > 0 AND a.p > b.p)
SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms) WHERE rank <= {TOP_TERMS}
"""
