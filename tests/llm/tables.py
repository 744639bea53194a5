"""Small tables for the operator tests."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, rows: list[tuple], extra: bool = False) -> DataFrame:
    """rows: (doc_id, text[, lang[, source]]); with ``extra``, columns whose names clash with those used inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCUMENTS)
    if extra:
        for name in ("key", "uid", "fp", "size", "_h", "hits", "score", "shard", "_run", "dh", "a.b"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
    return df


def words(seed: int, n: int, vocabulary: int = 300) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


#: Nulls, blanks, repeats, ties, white space of all kinds, scripts beyond ASCII, a long text.
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one two"), (6, "One  two x"), (7, words(1, 60)), (8, words(1, 60)), (8, words(1, 60)),
    (None, words(1, 60)), (None, None), (9, words(1, 60) + " tail"), (10, "éà ü 漢字 😀 it's 're 12½"), (11, words(2, 5000)), (12, "x" * 3000), (13, words(3, 80), None, None),
]
