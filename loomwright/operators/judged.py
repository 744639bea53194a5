"""Judgements of texts by an injected model: a callable from texts to replies, read leniently, null where it fails."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import reply

Judge = Callable[[list[str]], list[str]]


def judged(rows: DataFrame, text: str, judge: Judge, schema: str, batch: int = 64, retries: int = 2) -> DataFrame:
    """The rows with ``judgement``, a struct of ``schema`` read from the judge's reply to the text.

    Texts go in batches; a batch that fails is tried again, then one text at a time, and what still fails is null, so that
    one bad text costs no others and callers can fall back to what they have.
    """

    def ask(texts: list[str]) -> list[str | None]:
        for _ in range(retries):
            try:
                got = judge(texts)
                if len(got) == len(texts):
                    return list(got)
            except Exception:  # an injected transport may fail in any way
                continue
        return [None] if len(texts) == 1 else [x for t in texts for x in ask([t])]

    @F.pandas_udf("string")
    def replies(raw: pd.Series) -> pd.Series:
        known, out = raw.dropna(), pd.Series(None, index=raw.index, dtype=object)
        for at in range(0, len(known), batch):
            part = known.iloc[at : at + batch]
            out[part.index] = [None if x is None else json.dumps(reply(x), default=str) for x in ask(part.tolist())]
        return out

    return rows.withColumn("judgement", F.from_json(replies(F.col(text)), schema))
