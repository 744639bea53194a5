"""Web sources.  Transport and search are callables that the caller injects; nothing here opens a connection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_page

RESULT = "title string, snippet string, link string"


def search(queries: DataFrame, engine: Callable[[str, int], list[dict]], most: int = 10) -> DataFrame:
    """query, title, snippet, link; rows without title or snippet go."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"query": q, **r} for q in b["query"] for r in engine(q, most)[:most]]
            yield pd.DataFrame(rows, columns=["query", "title", "snippet", "link"])

    return queries.select("query").mapInPandas(run, f"query string, {RESULT}").filter("title is not null and snippet is not null")


def fetched(links: DataFrame, link: str, fetch: Callable[[str], str | None]) -> DataFrame:
    """The rows with ``content``, the cleaned page; a page that cannot be had is empty, the row stays."""
    @F.pandas_udf("string")
    def get(urls: pd.Series) -> pd.Series:
        def one(u):
            try:
                return fetch(u)
            except Exception:  # any failure of an injected transport means an empty page
                return None

        return urls.map(one)

    return links.withColumn("content", F.coalesce(clean_page(get(F.col(link))), F.lit("")))


def unseen(results: DataFrame, seen: DataFrame, most: int, order: list[Column] | None = None) -> DataFrame:
    """Results whose link is not among the seen ones, the first ``most`` in the given order."""
    rows = results.join(seen.select("link"), "link", "left_anti")
    return (rows.orderBy(*order) if order else rows).limit(most)


# Links and images in pages.
LINK, IMAGE = r'(?is)<a[^>]+href="([^"]+)"[^>]*>([^<]+)</a>', r"(?i)<img\b"


def scraped(pages: DataFrame, html: str, keys: list[str]) -> DataFrame:
    """keys, link, title of the links in result pages; those without a title go."""
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)).alias("link"), F.regexp_extract_all(html, F.lit(LINK), F.lit(2)).alias("title"))
    return pages.select(*keys, F.explode(found).alias("r")).select(*keys, "r.link", F.trim("r.title").alias("title")).filter("title != ''")


def crawled(url: Column, html: Column) -> Column:
    """The record of a crawled page; a page that could not be had has its error."""
    there = F.coalesce(F.length(html) > 0, F.lit(False))
    return F.struct(
        there.alias("success"), url.alias("url"), F.length(html).cast("long").alias("content_length"), clean_page(html).alias("extracted_content"),
        F.regexp_count(html, F.lit(r"(?i)<a[^>]+href=")).cast("long").alias("n_links"), F.regexp_count(html, F.lit(IMAGE)).cast("long").alias("n_images"), F.when(~there, "empty page").alias("error"),
    )


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1))


def path(url: Column) -> Column:
    """The path of a URL without query and fragment and without its first slash."""
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+/?([^?#]*)", 1)
