"""Token counts by the ranks of a byte-pair vocabulary, as a column function.

The rank file is a parameter: lines of a base64 token and its rank.  It is read once on the driver, refused if it is larger
than a vocabulary is, and broadcast; each worker builds one encoder from it.  Any budget takes the counter, see
:mod:`..operators.views`.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Largest rank file that is broadcast.
MOST_BYTES = 64 << 20


def ranks_of(path: str) -> dict[bytes, int]:
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary of {MOST_BYTES} bytes")
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Ranks:
    """What travels to the workers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern


@lru_cache(4)
def _encoder(shared):
    import tiktoken

    own = shared.value
    return tiktoken.Encoding("ranks", pat_str=own.pattern, mergeable_ranks=own.ranks, special_tokens={})


def counter(spark: SparkSession, path: str, pattern: str) -> Callable[[Column], Column]:
    """A function of a text column: its number of tokens, 0 of null and empty texts, special tokens read as text."""
    shared = spark.sparkContext.broadcast(Ranks(ranks_of(path), pattern))

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoder(shared).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int32")

    return lambda text: count(text)
