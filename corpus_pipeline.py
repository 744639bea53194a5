"""Corpus pipeline: language ID, SimHash near-dedup, substring dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import bpe, langid, mixing, near_dedup, substring_dedup
from loomwright.llm.common import discard, durable, only, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; those without letters and of no clear language go."""
    return langid.accepted_documents(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays: the one of the smallest doc_id (a null one last), and of rows that
    share it the one whose text has the smallest hash.  Near copies are texts whose 5-word shingles have a Jaccard
    similarity of about 0.8 or more, by wide fingerprints.  Rows are told apart by id and text, so rows without an id and
    different texts of one id are documents of their own.

    Who stays is decided on rows without texts; then texts move once."""
    rows = only(docs, COLUMNS).withColumn("_h", F.xxhash64("text"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_k", "_n")
    kept = near_dedup.near_copy_classes(docs).groupBy("class").agg(F.min(order).alias("x"))
    kept = durable(kept.select(F.col("x.doc_id").alias("_id"), F.col("x._k").alias("_k"), F.col("x._n").alias("_n")), "pipeline-kept")
    here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_k"))
    out = rows.join(kept.filter("_n = 1"), here, "left_semi").select(*COLUMNS)
    repeated = kept.filter("_n > 1")
    if repeated.isEmpty():
        return out
    # repeated rows of one id and text: one stands for all
    one = rows.join(repeated, here, "left_semi").groupBy("doc_id", "_h").agg(F.min(F.struct(*COLUMNS[1:])).alias("_r"))
    return out.unionByName(one.select("doc_id", *[F.col(f"_r.{c}").alias(c) for c in COLUMNS[1:]]))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that start earlier elsewhere are cut out; a text may become empty."""
    return substring_dedup.stripped_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: rows of documents taken twice come twice."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids."""
    return bpe.encoded_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mixing", source_mix),
    ("byte_bpe", tokens),
]

#: The trained stage and byte-pair merging have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs, f"pipeline-{name}")
            discard(before)
    return docs
