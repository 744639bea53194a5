"""Recursive text splitting: segments by a hierarchy of separators, packed into chunks of bounded length with overlap.

A text is cut before every occurrence of the first separator that it holds.  Neighbouring segments shorter than the chunk
size are packed greedily; a segment as long as that or longer is split by the separators that follow, the empty one
between any two characters.  Since a separator stays with the segment that it opens, every chunk is a stretch of the text,
and packing is a walk over prefix sums: a chunk ends at the last segment end within the size of its start, and the next
one starts at the first segment that keeps both the overlap and the room for one more segment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", " ", "")


def _packed(edges: np.ndarray, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the chunks of segments between consecutive edges, each shorter than the size."""
    i, last = 0, len(edges) - 1
    while i < last:
        j = int(np.searchsorted(edges, edges[i] + size, "right")) - 1
        yield int(edges[i]), int(edges[j])
        if j == last:
            return
        i = int(np.searchsorted(edges, max(edges[j] - overlap, edges[j + 1] - size), "left"))


def spans(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text, before white space at their ends goes."""
    out, todo = [], [(0, len(text), 0)]
    while todo:
        lo, hi, level = todo.pop()
        if level < 0:  # packed before
            out.append((lo, hi))
            continue
        while level < len(separators) and separators[level] and text.find(separators[level], lo, hi) < 0:
            level += 1
        if level == len(separators):
            out.append((lo, hi))
            continue
        if separators[level]:
            inner = [m.start() for m in re.compile(re.escape(separators[level])).finditer(text, lo, hi)]
            edges = np.array([lo, *inner, hi] if inner[0] > lo else [*inner, hi])
        else:
            edges = np.arange(lo, hi + 1)
        long = np.diff(edges) >= size
        ends = np.flatnonzero(np.diff(np.r_[True, long, True].astype(np.int8)))  # runs of short segments begin and end
        parts: list[tuple[int, int, int]] = [(int(edges[k]), int(edges[k + 1]), level + 1) for k in np.flatnonzero(long)]
        for a, b in zip(ends[::2].tolist(), ends[1::2].tolist()):
            parts += [(x, y, -1) for x, y in _packed(edges[a : b + 1], size, overlap)]
        todo += sorted(parts, reverse=True)
    return out


def split(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[dict]:
    """start (of the stretch, from 0) and chunk (without white space at its ends), blank ones left out."""
    return [{"start": a, "chunk": c} for a, b in spans(text, size, overlap, separators) if (c := text[a:b].strip())]


def splits(text: Column, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """array<struct<start, chunk>> of a text column; null and empty texts have none."""
    if not 0 <= overlap < size or size < 2:
        raise ValueError("chunks need 0 <= overlap < size and a size of 2 or more")

    @F.pandas_udf("array<struct<start:int,chunk:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split(t, size, overlap, separators) if t else [])

    return run(text)


def recursive_chunks(docs: DataFrame, keys: list[str], text: str, size: int = 1000, overlap: int = 100, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """keys, chunk_pos, start, chunk."""
    each = docs.select(*keys, F.posexplode(splits(F.col(text), size, overlap, separators)).alias("chunk_pos", "e"))
    return each.select(*keys, "chunk_pos", "e.start", "e.chunk")
