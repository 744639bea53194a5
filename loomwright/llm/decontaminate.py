"""Benchmark decontamination with a generalised suffix automaton of the test items.

All normalised items are put into one suffix automaton over words.  Each document is streamed through it once; the
length of the longest match that ends at a word tells whether one or more windows end there, and the state tells whose
windows they are.  A window is ``window`` consecutive words of an item, or a shorter item as a whole.

The automaton is what is broadcast, so its size is bounded: items are cut into overlapping pieces (every window stays
whole in one of them) and dealt to as many automata as ``automaton_words`` asks for.  Documents go through one automaton
after the other; with a single one, the usual case, that is one scan and no shuffle.

Defined results: null and empty texts have no words and are clean; items without words have no windows; an item id
counts once however many rows bear it, a null one as the empty string; repeated documents are judged row by row; very
long documents are streamed; extra columns of either table play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, only

WINDOW = 10
#: Words of items in one automaton: bounds what is collected and broadcast (about 30 MB), not the work.
AUTOMATON_WORDS = 1 << 17
#: Words of a piece that an item is cut into.
PIECE = 1 << 12

#: Words are runs of 0-9, A-Z, a-z and all that is not ASCII; the bytes of other characters become blanks.
FOLDED = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def normalised(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


class Automaton:
    """Suffix automaton of several word sequences.

    A state stands for a class of sequences with equal occurrences; ``size`` is the longest one's length and ``link`` the
    state of the longest suffix with more occurrences.  ``owners[s]`` are the items of which the state holds a window of
    the full length, ``whole[s]`` the (length, item) of shorter items that end in it, ``next_whole[s]`` the first state
    with such on the way along the links, itself included (0: none).
    """

    def __init__(self, pieces: list[tuple[str, list[bytes], bool]], window: int):
        """pieces: (item, words, whether these are all its words)."""
        self.window = window
        self.ids: dict[bytes, int] = {}
        step: list[dict[int, int]] = [{}]
        size, link = [0], [-1]
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words], whole) for item, words, whole in pieces]

        def split(state: int, w: int) -> int:
            """The state behind ``state`` by ``w``, holding nothing longer than what comes through ``state``."""
            to = step[state][w]
            if size[to] == size[state] + 1:
                return to
            part = len(size)
            size.append(size[state] + 1)
            link.append(link[to])
            step.append(dict(step[to]))
            link[to] = part
            while state >= 0 and step[state].get(w) == to:
                step[state][w] = part
                state = link[state]
            return part

        for _, sequence, _ in coded:
            last = 0
            for w in sequence:
                if w in step[last]:
                    last = split(last, w)
                    continue
                new = len(size)
                size.append(size[last] + 1)
                link.append(0)
                step.append({})
                back = last
                while back >= 0 and w not in step[back]:
                    step[back][w] = new
                    back = link[back]
                if back >= 0:
                    link[new] = split(back, w)
                last = new
        self.size, self.link = size, link
        self.stride = max(1, len(self.ids))
        self.step = {s * self.stride + w: t for s, out in enumerate(step) for w, t in out.items()}
        owners: dict[int, set[str]] = {}
        self.whole: dict[int, list[tuple[int, str]]] = {}
        shortest = window
        for item, sequence, whole in coded:
            if len(sequence) < window:
                if whole and sequence:
                    state = 0
                    for w in sequence:
                        state = step[state][w]
                    self.whole.setdefault(state, []).append((len(sequence), item))
                    shortest = min(shortest, len(sequence))
                continue
            for _, state, length in self.run(sequence):
                if length >= window:
                    owners.setdefault(self._at(state, window), set()).add(item)
        self.owners = {s: frozenset(o) for s, o in owners.items()}
        self.shortest = shortest
        self.next_whole = [0] * len(size)
        for s in sorted(range(1, len(size)), key=size.__getitem__):
            self.next_whole[s] = s if s in self.whole else self.next_whole[link[s]] if link[s] > 0 else 0

    def _at(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of a match."""
        while self.size[self.link[state]] >= length:
            state = self.link[state]
        return state

    def run(self, sequence) -> Iterator[tuple[int, int, int]]:
        """(position, state, length of the longest match that ends there) of known words."""
        step, size, link, stride = self.step, self.size, self.link, self.stride
        state = length = 0
        for i, w in enumerate(sequence):
            to = step.get(state * stride + w)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = step.get(state * stride + w)
            state, length = (to, length + 1) if to is not None else (0, 0)
            yield i, state, length

    def found(self, words: list[bytes]) -> tuple[list[int], list[int], set[str]]:
        """Hit spans of a document (starts, ends; apart and in order) and the items with occurring windows."""
        known = np.fromiter(map(self.ids.get, words, (-1,) * len(words)), np.int64, len(words))
        # a word that no item has ends every match: runs of known words are independent of each other
        edge = np.flatnonzero(np.diff(np.r_[False, known >= 0, False].astype(np.int8)))
        starts, ends, items = [], [], set()
        window, next_whole, whole, link = self.window, self.next_whole, self.whole, self.link

        def hit(lo: int, hi: int) -> None:
            while starts and lo <= ends[-1]:
                lo, hi = min(lo, starts.pop()), max(hi, ends.pop())
            starts.append(lo)
            ends.append(hi)

        seen: set[int] = set()
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if hi - lo < self.shortest:
                continue
            for i, state, length in self.run(known[lo:hi].tolist()):
                if length >= window:
                    at = self._at(state, window)
                    if at not in seen:
                        seen.add(at)
                        items |= self.owners[at]
                    hit(lo + i + 1 - length, lo + i + 1)
                short = next_whole[state]
                while short:
                    for n, item in whole[short]:
                        if n <= length:
                            items.add(item)
                            hit(lo + i + 1 - n, lo + i + 1)
                    short = next_whole[link[short]] if link[short] > 0 else 0
        return starts, ends, items


def _pieces(items: DataFrame, window: int) -> DataFrame:
    """item, part, whole, words (joined by blanks): distinct items cut into overlapping pieces of bounded length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = normalised(text.as_py())
                for part, lo in enumerate(range(0, max(1, len(words) - window + 1), PIECE) if words else ()):
                    own = words[lo : lo + PIECE + window - 1]
                    yield pa.RecordBatch.from_pydict({"item": [item], "part": [part], "whole": [len(own) == len(words)], "n": [len(own)], "words": [b" ".join(own)]}, PIECES)

    rows = only(items, ["item_id", "text"]).filter("text is not null")
    rows = rows.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(cut, "item string, part int, whole boolean, n int, words binary").distinct()


PIECES = pa.schema([("item", pa.string()), ("part", pa.int32()), ("whole", pa.bool_()), ("n", pa.int32()), ("words", pa.binary())])
SPANS = "n_words long, starts array<int>, ends array<int>, items array<string>"


def with_hits(docs: DataFrame, items: DataFrame, columns: list[str], window: int = WINDOW, automaton_words: int = AUTOMATON_WORDS, text: bool = False) -> DataFrame:
    """The named columns, n_words, hit spans ``starts`` and ``ends`` in words (apart and in order) and the distinct
    ``items`` with occurring windows; with ``text`` also the text as bytes."""
    spark = docs.sparkSession
    pieces = durable(_pieces(items, window), "benchmark-pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    passes = max(1, -(-total // automaton_words))
    state = only(docs, list(dict.fromkeys([*columns, "text"]))).select(*[F.col(f"`{c}`") for c in columns if c != "text"], F.col("text").cast("binary").alias("_text"))
    kept = [f for f in state.schema.fields if f.name != "_text"]
    names = [f.name for f in kept]
    written = None
    for k in range(passes):
        # pieces are distinct, so a hash deals them evenly; each part holds about automaton_words words
        part = pieces.filter(F.pmod(F.xxhash64("item", "part", "words"), F.lit(passes)) == k)
        automaton = Automaton([(r["item"], bytes(r["words"]).split(), r["whole"]) for r in part.orderBy("item", "part", "words").toLocalIterator()], window)
        shared = spark.sparkContext.broadcast(automaton)
        del automaton
        carry = text or k < passes - 1
        out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(["_text binary"] if carry else []), SPANS])
        before, state = written, state.mapInArrow(_streamed(shared, len(names), k > 0, carry), out)
        if k < passes - 1:
            state = written = durable(state, "decontaminate-pass")
            shared.unpersist()
        if before is not None and k < passes - 1:
            discard(before)
    discard(pieces)
    return state.withColumnRenamed("_text", "text") if text else state


def _streamed(shared, n_kept: int, again: bool, carry: bool):
    """The function of one pass: rows of kept columns, the text and, if ``again``, what passes before found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for b in batches:
            n_words, starts, ends, items = [], [], [], []
            old = [b.column(n_kept + 2 + i).to_pylist() for i in range(3)] if again else None
            for r, text in enumerate(b.column(n_kept)):
                words = normalised(text.as_py() or b"")
                lo, hi, found = automaton.found(words)
                if again:
                    lo, hi = merged(lo + old[0][r], hi + old[1][r])
                    found |= set(old[2][r])
                n_words.append(len(words))
                starts.append(lo)
                ends.append(hi)
                items.append(sorted(found, key=str.encode))
            arrays = [pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            own = [b.column(i) for i in range(n_kept + carry)]
            names = [*b.schema.names[: n_kept + carry], "n_words", "starts", "ends", "items"]
            yield pa.RecordBatch.from_arrays([*own, *arrays], names=names)

    return run


def merged(starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """The same words as spans that lie apart and in order."""
    lo: list[int] = []
    hi: list[int] = []
    for a, b in sorted(zip(starts, ends)):
        if hi and a <= hi[-1]:
            hi[-1] = max(hi[-1], b)
        else:
            lo.append(a)
            hi.append(b)
    return lo, hi


def _n_hit() -> Column:
    return F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda n, x: n + x)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs."""
    found = with_hits(docs, items, ["doc_id"], window, automaton_words)
    return found.select(
        "doc_id", "n_words", _n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_span: int = 0, max_coverage: float = 0.5) -> DataFrame:
    """documents columns without what the test items gave away: hit spans of more than ``max_span`` words are cut out
    of the text (the bytes around them stay as they are), and documents of which more than the share ``max_coverage`` of
    their words is hit are dropped.  Texts without such spans, nulls included, stay as they are."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes = [], []
            for text, n, starts, ends in zip(b.column(4), b.column(3).to_pylist(), b.column(6).to_pylist(), b.column(7).to_pylist()):
                spans = [(x, y) for x, y in zip(starts, ends) if y - x > max_span]
                raw = text.as_py()
                if spans:
                    places = [m.span() for m in WORD_BYTES.finditer(raw)]
                    at, left = 0, []
                    for x, y in spans:
                        left.append(raw[at : places[x][0]])
                        at = places[y - 1][1]
                    raw = b"".join([*left, raw[at:]])
                    n = len(raw.decode("utf-8", "replace"))
                texts.append(None if raw is None else raw.decode("utf-8", "replace"))
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), b.column(1), b.column(2), pa.array(sizes, pa.int64())], names=["doc_id", "text", "lang", "source", "n_chars"])

    found = with_hits(docs, items, ["doc_id", "lang", "source", "n_chars"], window, text=True)
    found = found.filter(_n_hit() <= F.lit(max_coverage) * F.col("n_words"))
    return found.mapInArrow(cut, "doc_id long, text string, lang string, source string, n_chars long")


#: DuckDB text of the op11 query.
ORACLE = f"""
WITH i AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
s AS (SELECT item, words, least(len(words), {WINDOW}) AS size FROM i WHERE len(words) > 0),
win AS (SELECT DISTINCT item, size, array_to_string(words[o : o + size - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS o FROM s)),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
sizes AS (SELECT DISTINCT size FROM s),
places AS (SELECT r, size, start, array_to_string(words[start : start + size - 1], ' ') AS w FROM (SELECT r, size, words, unnest(range(1, len(words) - size + 2)) AS start FROM d, sizes WHERE len(words) >= size)),
hit AS (SELECT r, size, start, item FROM places JOIN win USING (size, w)),
pos AS (SELECT DISTINCT r, start + o AS p FROM hit, (SELECT unnest(range(0, {WINDOW})) AS o) WHERE o < size),
n AS (SELECT r, count(*) AS n_hit FROM pos GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
