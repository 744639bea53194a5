"""Stateful streams: directory additions, repeats, counters, overflow, running texts.

Event tables come without zones; callers cast event time to timestamp before setting watermarks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RESTART_TOKENS, RESTARTS = 80_000, 2


def new_files(spark: SparkSession, root: str, schema: str, kind: str = "parquet", per_batch: int = 100) -> DataFrame:
    """Rows of files as they appear; the checkpoint remembers which were seen."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(per_batch)).option("recursiveFileLookup", "true").format(kind).load(root)


def windowed_counts(events: DataFrame, time: str, key: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def running_text(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """Pieces of a session joined in order of arrival (update mode)."""
    return chunks.groupBy(key).agg(F.listagg(text).alias("text"))


class Repeats(StatefulProcessor):
    """Drops a message that equals the last of its conversation."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        for frame in rows:
            kept = []
            for r in frame.sort_values("turn").itertuples():
                seen = self.last.get()[0] if self.last.exists() else None
                if seen != r.text:
                    kept.append((key[0], r.turn, r.text))
                    self.last.update((r.text,))
            yield pd.DataFrame(kept, columns=["conv_id", "turn", "text"])

    def close(self) -> None:
        pass


def without_repeats(messages: DataFrame) -> DataFrame:
    """(conv_id long, turn long, text string) without consecutive repeats."""
    return messages.groupBy("conv_id").transformWithStateInPandas(Repeats(), "conv_id long, turn long, text string", "append", "none")


class Overflow(StatefulProcessor):
    """Sums tokens of a session; when they pass the budget it restarts, at most so many times."""

    def __init__(self, budget: int = RESTART_TOKENS, restarts: int = RESTARTS):
        self.budget, self.most = budget, restarts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "used long, restarts int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        used, restarts = self.state.get() if self.state.exists() else (0, 0)
        out = []
        for frame in rows:
            for r in frame.sort_values("turn").itertuples():
                used += int(r.tokens)
                over = used > self.budget and restarts < self.most
                if over:
                    used, restarts = 0, restarts + 1
                out.append((key[0], r.turn, used, restarts, over))
        self.state.update((used, restarts))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "used", "restarts", "restarted"])

    def close(self) -> None:
        pass


def overflow(messages: DataFrame, budget: int = RESTART_TOKENS, restarts: int = RESTARTS) -> DataFrame:
    """(conv_id, turn, tokens) -> conv_id, turn, used, restarts, restarted."""
    return messages.groupBy("conv_id").transformWithStateInPandas(Overflow(budget, restarts), "conv_id long, turn long, used long, restarts int, restarted boolean", "append", "none")


def upsert_sink(keys: list[str], path: str):
    """A foreachBatch function that appends rows whose keys the table does not have."""
    from ..sources.tables import append_absent

    return lambda batch, _: append_absent(batch.sparkSession, path, batch, keys)
