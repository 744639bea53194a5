"""Crawl frontiers: pages found by links, round by round, each once.

:func:`crawl` keeps what was seen in a store (:mod:`..sources.versions`): a round's new addresses are committed before the next
round starts from them, so a crawl that was cut off goes on with the round after the last that is whole and ends with the
same rows.  :class:`Frontier` is the same for a stream of links: its state has the addresses of a host that were seen, which
may be forgotten after a while.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.versions import Change, Snapshot, Store
from ..sources.web import host

SEEN = "url string, parent string, round int"


def normal(url):
    """An address without its fragment and the slash at its end."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"/+$", "")


def crawl(spark: SparkSession, path: str, seeds: DataFrame, links: Callable[[DataFrame], DataFrame], rounds: int, wanted: Callable | None = None) -> DataFrame:
    """url, parent (the least page of the round before that links to it), round of all addresses within ``rounds`` rounds.

    ``links`` takes the addresses of a round (url) and gives the links of their pages (parent, url), fetched or joined;
    ``wanted`` is a condition on an address.  Seeds are round 0.  Null and empty addresses are none."""
    store = Store(spark, path)

    def found(rows: DataFrame) -> DataFrame:
        rows = rows.select(normal(F.col("url")).alias("url"), "parent").filter("url is not null and url != ''")
        return rows.filter(wanted(F.col("url"))) if wanted else rows

    def work(now: Snapshot) -> dict[str, Change]:
        if "seen" not in now.tables:
            first = found(seeds.select("url", F.lit(None).cast("string").alias("parent"))).select("url").distinct()
            return {"seen": Change(first.select("url", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("round")))}
        seen = now.table("seen")
        last = len(now.tables["seen"]["folders"]) - 1  # a folder a round
        new = found(links(seen.filter(F.col("round") == last).select("url"))).groupBy("url").agg(F.min("parent").alias("parent"))
        new = new.join(seen.select("url"), "url", "left_anti")
        return {"seen": Change(new.select("url", "parent", F.lit(last + 1).alias("round")))}

    while True:
        now = store.snapshot()
        done = len(now.tables["seen"]["folders"]) - 1 if "seen" in now.tables else -1
        if done >= rounds or (done >= 0 and now.table("seen").filter(F.col("round") == done).isEmpty()):
            return now.table("seen")
        store.transact(work)


class Frontier(StatefulProcessor):
    """Of a host's links those whose address was not seen before, or not within ``expiry_ms`` if that is given."""

    def __init__(self, expiry_ms: int | None = None):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "url string", "times long", self.expiry_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        new = []
        for frame in rows:
            for url, parent in sorted(zip(frame["url"], frame["parent"].fillna(""))):
                if not self.seen.containsKey((url,)):
                    self.seen.updateValue((url,), (1,))
                    new.append((key[0], url, parent or None))
        yield pd.DataFrame(new, columns=["host", "url", "parent"])

    def close(self) -> None:
        pass


def unseen_links(links: DataFrame, expiry_ms: int | None = None) -> DataFrame:
    """(url, parent) -> host, url, parent of a stream: every address once, or again when it was forgotten."""
    rows = links.select(normal(F.col("url")).alias("url"), "parent").filter("url is not null and url != ''").withColumn("host", host(F.col("url")))
    mode = "processingTime" if expiry_ms else "none"
    return rows.groupBy("host").transformWithStateInPandas(Frontier(expiry_ms), "host string, url string, parent string", "append", mode)
