"""Byte-level BPE encoding and decoding with DuckDB recursive queries in each partition.

A text is cut into pieces by the public pattern; the cuts follow from the classes of neighbouring characters, so they
are found for millions of characters at once.  The distinct pieces of a block that are no tokens themselves become
token-position rows of a recursive query: neighbours join the merge table, each piece's leftmost pair of least rank is
contracted, and pieces leave when none of their pairs can merge.  Ordered aggregation gives a piece's ids; their decimal
texts and bytes are taken from the vocabulary by id, for all pieces of a block at once.

Neighbours and aggregates are ordered by position, whatever order the rows come in; a last pass checks that every piece has
reached its fixpoint and decodes to its own bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, only, trimmed

#: Characters handled at once, pieces remembered by a worker: bounds of memory, not of work.
BLOCK_CHARS, REMEMBERED = 3 << 19, 200_000
#: Longer pieces (in bytes) are contracted with a heap instead: one contraction a round would be quadratic in them.
LONG_PIECE = 1 << 10
OTHER, SPACE, LETTER, NUMBER = range(4)

CONTRACT = """
WITH RECURSIVE step(wp, id, done) AS (
  SELECT wp, id, false FROM tok
  UNION ALL
  (WITH p AS (SELECT wp, id, lead(wp) OVER w AS nwp, lead(id) OVER w AS nid, lag(wp) OVER w AS pwp FROM step WHERE NOT done WINDOW w AS (ORDER BY wp)),
        b AS (SELECT wp >> 10 AS word, min((m << 10) | (wp & 1023)) AS best
              FROM p JOIN merges ON pair = (id << 20) | nid AND (nwp >> 10) = (wp >> 10) GROUP BY 1)
   SELECT p.wp, CASE WHEN wp = (((wp >> 10) << 10) | (best & 1023)) THEN best >> 10 ELSE id END, best IS NULL
   FROM p LEFT JOIN b ON word = wp >> 10
   WHERE best IS NULL OR pwp IS NULL OR pwp <> (((wp >> 10) << 10) | (best & 1023)))
)
SELECT wp, id FROM step WHERE done
"""
IDS = "SELECT wp >> 10 AS word, list(id ORDER BY wp) AS ids FROM ended GROUP BY 1 ORDER BY 1"
#: The same with texts and bytes by a join, to which tests hold the arrays.
GATHER = """
SELECT wp >> 10 AS word, string_agg(dec, ' ' ORDER BY wp) AS ids, count(*) AS n, string_agg(hex, '' ORDER BY wp) AS decoded
FROM ended JOIN vocabulary USING (id) GROUP BY 1 ORDER BY 1
"""
UNSETTLED = """
SELECT count(*) FROM (SELECT wp, id, lead(wp) OVER (ORDER BY wp) AS nwp, lead(id) OVER (ORDER BY wp) AS nid FROM ended)
JOIN merges ON pair = (id << 20) | nid AND (nwp >> 10) = (wp >> 10)
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(1)
def _classes() -> np.ndarray:
    """Of every code point, its class in the pattern."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x110000))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    out[0xD800:0xE000] = OTHER
    return out


def piece_starts(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pieces of concatenated texts begin.  ``codes``: code points; ``ends``: where each text ends, ascending,
    no text empty."""
    n = len(codes)
    kind = _classes()[codes]
    first = np.zeros(n + 1, bool)
    first[0] = True
    first[ends] = True  # texts begin here
    edge = first[:n].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(edge)
    run_end = np.r_[runs[1:], n]
    run_kind = kind[runs]
    start = np.zeros(n + 1, bool)
    start[runs] = True
    # the last character of white space that another run follows stands alone, or joins that run if it is a blank
    gaps = np.flatnonzero((run_kind == SPACE) & ~first[run_end])
    last = run_end[gaps] - 1
    start[last] = True
    blank = codes[last] == 32
    start[last[blank] + 1] = False
    # an apostrophe that begins a piece takes the letters of a contraction with it
    sign = runs[(run_kind == OTHER) & (run_end - runs == 1) & ~first[run_end] & (codes[runs] == 39)]
    sign = sign[start[sign]]
    if len(sign):
        padded = np.r_[codes, 0, 0]
        a, b = padded[sign + 1], padded[sign + 2]
        b = np.where(first[np.minimum(sign + 2, n)], 0, b)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = np.zeros(len(sign), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        for which, length in ((one, 2), (two & ~one, 3)):
            start[sign[which] + 1] = False
            start[sign[which] + length] = True
    start[0] = True
    return np.flatnonzero(start[:n])


def distinct_pieces(joined: str, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of pieces that stand for all, which of them each piece equals).

    Pieces are grouped by a 64-bit polynomial of their code points and their length; then every piece is compared with the
    one that stands for it, and if any differs the pieces themselves are the keys.
    """
    values = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    power = np.full(len(codes) + 1, 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(values * power[:-1], out=prefix[1:])
    size = stops - starts
    keys = (prefix[stops] - prefix[starts]) * power[len(codes) - starts] + size.astype(np.uint64)
    del values, power, prefix
    _, sample, which = np.unique(keys, return_index=True, return_inverse=True)
    if (size == size[sample][which]).all():
        twin = np.repeat(starts[sample][which] - starts, size) + np.arange(len(codes))
        if (codes[twin] == codes).all():
            return sample, which
    seen: dict[str, int] = {}
    which = np.array([seen.setdefault(joined[a:b], len(seen)) for a, b in zip(starts.tolist(), stops.tolist())])
    return np.unique(which, return_index=True)[1], which


class Tokenizer:
    """Encodes and decodes pieces with a DuckDB connection of its own."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.known: dict[bytes, tuple[bytes, int, bytes]] = {}
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.pairs = dict(zip(zip(left, right), merged))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        self.db.execute("SET enable_progress_bar = false")
        self.db.register("m", pa.table({"pair": (np.array(left, np.int64) << 20) | np.array(right, np.int64), "m": np.array(merged, np.int64)}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.db.register("v", pa.table({"id": np.array(list(self.tokens), np.int64), "hex": [t.hex() for t in self.tokens.values()], "dec": [str(r) for r in self.tokens]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM v")
        every = range(max(self.tokens) + 1)
        self.decimal, self.bytes = pa.array([str(i).encode() for i in every], pa.binary()), pa.array([self.tokens.get(i) for i in every], pa.binary())

    def _contract(self, pieces: list[bytes]) -> list[tuple[bytes, int, bytes]]:
        text = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        word = np.repeat(np.arange(len(pieces)), lengths)
        position = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.db.register("tok", pa.table({"wp": (word << 10) | position, "id": self.byte_ids[text]}))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE ended AS {CONTRACT}")
        if self.db.execute(UNSETTLED).fetchall()[0][0]:
            raise RuntimeError("pieces were left before their fixpoint")
        lists = self.db.execute(IDS).to_arrow_table()["ids"].combine_chunks()
        self.db.execute("DROP TABLE ended")
        joined = lambda column, by: pc.binary_join(pa.ListArray.from_arrays(lists.offsets, column.take(lists.values)), by)
        if not joined(self.bytes, b"").equals(pa.array(pieces, pa.binary())):
            raise RuntimeError("a piece was lost or its tokens were out of order")
        return list(zip(joined(self.decimal, b" ").to_pylist(), np.diff(lists.offsets).tolist(), pieces))

    def _contract_long(self, piece: bytes) -> tuple[bytes, int, bytes]:
        """The same contractions with a heap of (rank, position) over a linked list."""
        ids: list[int] = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or self.pairs.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.pairs.get((rank, ids[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (p := before[i]) >= 0 and (r := self.pairs.get((ids[p], rank))) is not None:
                heapq.heappush(heap, (r, p))
        left = [x for x in ids if x >= 0]
        return b" ".join(str(x).encode() for x in left), len(left), b"".join(map(self.tokens.__getitem__, left))

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[bytes, int, bytes]]:
        """Of each piece: its ids as decimal text joined by blanks, their number, the bytes they decode to."""
        out: list = [None] * len(pieces)
        todo: dict[bytes, list[int]] = {}
        for i, p in enumerate(pieces):
            if (hit := self.known.get(p)) is not None:
                out[i] = hit
            elif (rank := self.ranks.get(p)) is not None:
                out[i] = self.known[p] = (str(rank).encode(), 1, self.tokens[rank])
            elif len(p) > LONG_PIECE:
                out[i] = self._contract_long(p)
            else:
                todo.setdefault(p, []).append(i)
        if todo:
            new = list(todo)
            for p, got in zip(new, self._contract(new)):
                for i in todo[p]:
                    out[i] = got
                if len(self.known) < REMEMBERED:
                    self.known[p] = got
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of a sequence of ids, by ordered aggregation."""
        if not len(ids):
            return b""
        self.db.register("tok_in", pa.table({"pos": np.arange(len(ids)), "id": np.array(ids, np.int64)}))
        got, n = self.db.execute("SELECT unhex(string_agg(hex, '' ORDER BY pos)), count(*) FROM tok_in JOIN vocabulary USING (id)").fetchall()[0]
        if n != len(ids):
            raise ValueError("an id is not in the vocabulary")
        return bytes(got)

    def encode_block(self, texts: list[str]) -> list[tuple[list[bytes], int, list[bytes]]]:
        """Of each text: the ids' texts and decoded bytes, piece by piece, and the number of ids."""
        at = [i for i, t in enumerate(texts) if t]
        out: list = [([], 0, [])] * len(texts)
        if not at:
            return out
        joined = "".join(texts[i] for i in at)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(texts[i]) for i in at])
        starts = piece_starts(codes, ends)
        stops = np.r_[starts[1:], len(codes)]
        sample, which = distinct_pieces(joined, codes, starts, stops)
        pieces = [joined[a:b].encode("utf-8", "surrogatepass") for a, b in zip(starts[sample].tolist(), stops[sample].tolist())]
        got = self.encode_pieces(pieces)
        ids, decoded = np.empty(len(got), object), np.empty(len(got), object)
        ids[:], decoded[:] = [g[0] for g in got], [g[2] for g in got]
        counts = np.fromiter((g[1] for g in got), np.int64, len(got))[which]
        bounds = np.searchsorted(starts, np.r_[0, ends])
        total = np.r_[0, np.cumsum(counts)][bounds]
        for k, i in enumerate(at):
            own = which[bounds[k] : bounds[k + 1]]
            out[i] = (ids[own].tolist(), int(total[k + 1] - total[k]), decoded[own].tolist())
        return out


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The worker's tokenizer of a rank file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(read_ranks(path))
    return _TOKENIZERS[path]


def segments(text: str, size: int | None = None) -> Iterator[str]:
    """Cut a long text before white space that follows other text, where no piece goes on, into parts of about ``size``
    characters (longer where there is no such place)."""
    import regex

    at, size = 0, size or BLOCK_CHARS
    while len(text) - at > 2 * size:
        m = regex.compile(r"(?<=\P{White_Space})\p{White_Space}").search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode_texts(coder: Tokenizer, texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """(number of the text, ids' texts, decoded bytes) for each part of each text, in order."""
    held, owners, size = [], [], 0

    def flush():
        for owner, (ids, _, decoded) in zip(owners, coder.encode_block(held)):
            yield owner, ids, decoded

    for i, raw in enumerate(texts):
        for part in segments((raw or b"").decode("utf-8", "replace")):
            held.append(part)
            owners.append(i)
            size += len(part)
            if size >= BLOCK_CHARS:
                yield from flush()
                held, owners, size = [], [], 0
    yield from flush()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of record batches of about as much text as a block, so that few texts are Python objects at once."""
    for held in grouped(batches, "text", BLOCK_CHARS):
        yield from held


def _rank_path(path: str | None) -> str:
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoded_digests(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; null texts count as empty.

    ``ranks`` names a rank file that every executor has; bytes that are not UTF-8 are read as U+FFFD.  Texts of any length
    are encoded whole, in parts that end where no piece goes on; repeated rows give repeated rows; an empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(_rank_path(ranks))
        for b in slices(batches):
            n = b.num_rows
            counts, ids, decoded = [0] * n, [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            for i, ours, back in encode_texts(coder, b.column(1).to_pylist()):
                if ours:
                    text = b" ".join(ours)
                    if counts[i]:
                        ids[i].update(b" ")
                    ids[i].update(text)
                    counts[i] += text.count(b" ") + 1
                    decoded[i].update(b"".join(back))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array([x.hexdigest() for x in ids]), pa.array([x.hexdigest() for x in decoded])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = only(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded_documents(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids (array<int>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(_rank_path(ranks))
        for b in slices(batches):
            parts: list[list[bytes]] = [[] for _ in range(b.num_rows)]
            for i, ours, _ in encode_texts(coder, b.column(3).to_pylist()):
                parts[i].append(b" ".join(ours))
            arrays = [np.array(b" ".join(filter(None, p)).split(), np.int32) for p in parts]
            offsets = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
            flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "lang", "source", "n_tokens", "ids"])

    rows = only(docs, ["doc_id", "lang", "source", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, lang string, source string, n_tokens long, ids array<int>")


def decoded_documents(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id and text (bytes) of rows with ids; a null list decodes to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(_rank_path(ranks))
        for b in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    return only(encoded, ["doc_id", "ids"]).mapInArrow(run, "doc_id long, text binary")
