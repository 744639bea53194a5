"""SimHash document fingerprints (DataFrame operations only).

Terms are words; a term votes with its hash on 64 signed bits, once for each occurrence, weighted by its length (long
words are rare and say more).  Votes are summed as 32 columns that each hold two counters of 32 bits, so that one hash
aggregate with map-side sums suffices and no document's words ever meet before they are summed.

:func:`near_pairs` finds all fingerprints within a Hamming radius r by permuted block tables: 64 bits are cut into
r + 2 blocks, each table holds the fingerprints with two of the blocks moved to the front, and two fingerprints within
r agree on the front of some table at least.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BREAK, durable, only, shuffle_partitions

LANES = 32
#: One counter's bit in either half of a lane.
LANE_BITS = (1 << 32) | 1
LOW = (1 << 32) - 1
MAX_TERM_WEIGHT_LENGTH = 16


def term_weight(term: Column) -> Column:
    """0 for the empty term, else 1 + floor(length^2 / 16), the length counted up to 16: at most 17, and no more than
    the bytes of the term and its separator, so that a text under 4 GB cannot overflow a counter."""
    n = F.least(F.length(term), F.lit(MAX_TERM_WEIGHT_LENGTH))
    return F.when(n == 0, F.lit(0)).otherwise(F.lit(1) + F.floor(n * n / F.lit(16))).cast("long")


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys -> fingerprint (long).  Null and blank texts have fingerprint 0.  Keys must tell the rows apart."""
    terms = texts.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), WORD_BREAK)).alias("_t"))
    terms = terms.select(*keys, F.xxhash64("_t").alias("_h"), term_weight(F.col("_t")).alias("_w"))
    lane = lambda i: F.sum(F.shiftrightunsigned(F.col("_h"), i).bitwiseAND(F.lit(LANE_BITS)) * F.col("_w")).alias(f"_s{i}")
    votes = terms.groupBy(*keys).agg(F.sum("_w").alias("_all"), *[lane(i) for i in range(LANES)])
    bits = None
    for i in range(LANES):
        low, high = F.col(f"_s{i}").bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(F.col(f"_s{i}"), 32)
        for count, at in ((low, i), (high, i + 32)):
            bit = F.when(count * 2 > F.col("_all"), F.lit(1 << at if at < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
            bits = bit if bits is None else bits.bitwiseOR(bit)
    return votes.select(*keys, bits.alias("fingerprint"))


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """1 minus the share of differing bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def near_pairs(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b) with a < b for every two distinct fingerprints that differ in 1 to ``radius`` bits; equal fingerprints are
    one class and are not expanded.  Complete: of r + 2 blocks, r differences leave two at least untouched, and there is a
    table for every two.

    Two blocks of 64 / (r + 2) bits make keys that few unrelated fingerprints share; what a group of near copies shares is
    compared within the join, whose large partitions Spark splits.
    """
    distinct = prints.select(F.col("fingerprint").alias("f")).filter(F.col("f").isNotNull()).distinct()
    cuts = [round(i * 64 / (radius + 2)) for i in range(radius + 3)]
    block = [F.shiftrightunsigned(F.col("f"), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:])]
    front = F.array(*[F.struct(F.lit(n).alias("t"), block[i].alias("k"), block[j].alias("l")) for n, (i, j) in enumerate(combinations(range(radius + 2), 2))])
    tables = distinct.select("f", F.explode(front).alias("e")).select("f", "e.*")
    left, right = tables.withColumnRenamed("f", "a"), tables.withColumnRenamed("f", "b")
    found = left.join(right, ["t", "k", "l"]).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    return found.select("a", "b").distinct()


def _bounds(docs: DataFrame, n: int) -> list[int]:
    """Ids that cut the documents into about n runs of equal length (a bounded number of longs)."""
    probs = [i / n for i in range(1, n)]
    got = docs.agg(F.percentile_approx("doc_id", probs, 100 * n).alias("q")).first()["q"]
    return sorted(set(got or []))


def with_next(docs: DataFrame) -> DataFrame:
    """(_uid, _next, doc_id, text, next_text): each document with the next in descending (doc_id, text), the first
    after the last.  Null ids come last, null texts count as empty.

    The ids are cut into runs at approximate quantiles; a window orders each run on its own and the first documents of
    the runs are handed to the run before, so that no task sees more than a run.
    """
    rows = only(docs, ["doc_id", "text"]).withColumn("text", F.coalesce("text", F.lit("")))
    bounds = _bounds(rows, min(2048, max(64, 8 * shuffle_partitions(docs.sparkSession))))
    run = F.lit(0)
    if bounds:
        run = F.coalesce(F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda x: x <= F.col("doc_id"))), F.lit(-1))
    rows = rows.withColumn("_run", run)
    order = Window.partitionBy("_run").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    placed = rows.withColumn("_rn", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))
    firsts = rows.groupBy("_run").agg(F.max(F.struct("doc_id", "text"))["text"].alias("_first"))
    every = Window.partitionBy()
    chain = firsts.select("_run").withColumn("_to", F.coalesce(F.lead("_run").over(Window.orderBy(F.col("_run").desc())), F.max("_run").over(every)))
    after = chain.join(firsts.select(F.col("_run").alias("_to"), "_first"), "_to")
    joined = placed.join(after, "_run", "left")
    uid = F.shiftleft((F.col("_run") + 1).cast("long"), 40) + F.col("_rn")
    to = F.when(F.col("next_text").isNull(), F.shiftleft((F.col("_to") + 1).cast("long"), 40) + 1).otherwise(uid + 1)
    return joined.select(uid.alias("_uid"), to.alias("_next"), "doc_id", "text", F.coalesce("next_text", "_first").alias("next_text"))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many of the next document
    (all of them, if it has fewer).  An empty table gives an empty result; a single document is its own next one.
    """
    rows = with_next(docs)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    both = rows.select(
        "_uid", "_next", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("text").alias("t")), F.struct(F.lit(1).alias("e"), F.col("edited").alias("t")))).alias("_x"),
    ).select("_uid", "_next", "doc_id", "n_chars", "edited_sha256", F.col("_x.e").alias("_e"), F.col("_x.t").alias("_text"))
    prints = durable(fingerprints(both, ["_uid", "_next", "doc_id", "n_chars", "edited_sha256", "_e"], "_text"), "fingerprints")
    own = prints.filter("_e = 0").drop("_e")
    edited = prints.filter("_e = 1").select("_uid", F.col("fingerprint").alias("_ef"))
    following = own.select(F.col("_uid").alias("_next"), F.col("fingerprint").alias("_nf"))
    out = own.join(edited, "_uid").join(following, "_next")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("fingerprint")).alias("fingerprint"), as_hex(F.col("_ef")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("_ef")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_nf")).alias("near_next"),
    )
