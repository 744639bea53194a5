"""Duplicate spans by relative Lempel-Ziv parsing against every indexed reference block.

Documents are read in blocks.  Each block is its own reference first: an index of all its 20-word windows gives every
window's earliest start, and documents are parsed greedily into factors, maximal runs of windows whose sources advance
with them.  Then blocks are parsed against each other.  A window is filed under its minimizer (the least hash of its
6-word grams), so equal windows of all blocks meet in one reference block however the text around them differs, and only
a block's earliest start of each window travels.  Where a factor ends, the next window is looked up on its own, so the
windows that straddle factor boundaries are judged too; with every window looked up, the factors cover exactly the words
of the windows that start earlier elsewhere.

Keys are 48-bit window hashes within 64-bit minimizer hashes: two different windows are confused only if both agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, only, partitions_for, trimmed
from .hashing import mixed, span_hashes

WINDOW = 20
GRAM = 6
#: Bytes of text in a block, and words hashed at once: bounds of memory, not of work.
BLOCK_BYTES, HASH_WORDS = 12 << 20, 1 << 18

#: What travels: under a minimizer its windows of one stretch of a document, packed as the first one's start (4 bytes)
#: and the hashes (6 bytes each); or, with an odd length, a finished factor.
SENT = "key long, doc_id long, dh int, body binary"
FACTOR = "doc_id long, dh int, start int, words int, source_doc long, source_start int"
HASH_BYTES = 6
DONE = np.dtype([("start", "<i4"), ("words", "<i4"), ("source_doc", "<i8"), ("source_start", "<i4"), ("end", "u1")])


def _window_keys(text: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of words: its hash and its minimizer."""
    n = len(begin) - window + 1
    hashes, minimizers = np.empty(max(n, 0), np.uint64), np.empty(max(n, 0), np.uint64)
    for at in range(0, n, HASH_WORDS):
        to = min(n, at + HASH_WORDS)
        b, e = begin[at : to + window - 1], end[at : to + window - 1]
        hashes[at:to] = span_hashes(text, b[: to - at], e[window - 1 :])
        grams = span_hashes(text, b[: len(b) - gram + 1], e[gram - 1 :])
        width, least = 1, grams
        while 2 * width <= window - gram + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = window - gram + 1 - width
        minimizers[at:to] = np.minimum(least[: to - at], least[rest : rest + to - at])
    return hashes, minimizers


def _earliest(order_keys: tuple[np.ndarray, ...], groups: tuple[np.ndarray, ...]) -> np.ndarray:
    """For each entry the number of the entry of its group that is least by the order keys."""
    order = np.lexsort((*reversed(order_keys), *reversed(groups)))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for g in groups:
        s = g[order]
        new[1:] |= s[1:] != s[:-1]
    source = np.empty(len(order), np.int64)
    source[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else 0
    return source


def _factors(doc: np.ndarray, dh: np.ndarray, start: np.ndarray, source_doc: np.ndarray, source_start: np.ndarray, window: int) -> list[np.ndarray]:
    """Greedy parse of duplicate windows, sorted by (doc, dh, start): maximal runs on one diagonal of one source."""
    if not len(doc):
        return [doc, dh, start.astype(np.int32), start.astype(np.int32), source_doc, source_start.astype(np.int32)]
    goes_on = (doc[1:] == doc[:-1]) & (dh[1:] == dh[:-1]) & (start[1:] == start[:-1] + 1) & (source_doc[1:] == source_doc[:-1]) & (source_start[1:] == source_start[:-1] + 1)
    at = np.flatnonzero(np.r_[True, ~goes_on])
    length = np.diff(np.r_[at, len(doc)]) + window - 1
    return [doc[at], dh[at], start[at].astype(np.int32), length.astype(np.int32), source_doc[at], source_start[at].astype(np.int32)]


def _parse_block(doc_ids: np.ndarray, hashes: np.ndarray, texts: list[bytes], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((hashes, doc_ids))
    norms, docs, counts = [], [], []
    for i in order.tolist():
        norm = b" ".join(texts[i].split())
        if norm and (n := norm.count(b" ") + 1) >= window:
            norms.append(norm)
            docs.append(i)
            counts.append(n)
    if not norms:
        return
    text = np.frombuffer(b" ".join(norms), np.uint8)
    del norms
    narrow = np.int32 if len(text) < 1 << 31 else np.int64
    gaps = np.flatnonzero(text == 32).astype(narrow)
    begin, end = np.r_[narrow(0), gaps + narrow(1)], np.r_[gaps, narrow(len(text))]
    counts = np.array(counts)
    word_doc = np.repeat(np.arange(len(docs), dtype=np.int32), counts)
    position = (np.arange(len(begin)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
    keys, minimizers = _window_keys(text, begin, end, window, gram)
    valid = np.flatnonzero(position[: len(keys)] + window <= counts[word_doc[: len(keys)]])
    del begin, end, gaps
    keys, minimizers, position, word_doc = keys[valid], minimizers[valid], position[valid], word_doc[valid]
    docs = np.array(docs)
    doc, dh = doc_ids[docs][word_doc], hashes[docs][word_doc]
    del text, word_doc, valid
    # windows stand in order of (doc_id, dh, position); of one id's rows with different texts the earlier start counts
    source = _earliest((doc, position), (keys, minimizers))
    later = (doc[source] != doc) | (position[source] != position)
    found = _factors(doc[later], dh[later], position[later], doc[source[later]], position[source[later]], window)
    names = [x.split()[0] for x in SENT.split(", ")]
    if len(found[0]):
        packed = np.zeros(len(found[0]), DONE)
        packed["start"], packed["words"], packed["source_doc"], packed["source_start"] = found[2:]
        key = mixed(found[0].view(np.uint64) + found[2].astype(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(found[0]), pa.array(found[1]), _binary(packed.view(np.uint8), np.arange(len(packed) + 1) * DONE.itemsize)], names=names)
    first = np.flatnonzero(source == np.arange(len(source)))
    del source, later, found
    if not len(first):
        return
    doc, dh, position, keys, minimizers = doc[first], dh[first], position[first], keys[first], minimizers[first]
    goes_on = (doc[1:] == doc[:-1]) & (dh[1:] == dh[:-1]) & (position[1:] == position[:-1] + 1) & (minimizers[1:] == minimizers[:-1])
    at = np.flatnonzero(np.r_[True, ~goes_on])
    stops = np.r_[at[1:], len(doc)]
    for lo in range(0, len(at), 1 << 16):
        own, stop = at[lo : lo + (1 << 16)], stops[lo : lo + (1 << 16)]
        offsets = np.r_[0, np.cumsum(4 + (stop - own) * HASH_BYTES)]
        body = np.empty(offsets[-1], np.uint8)
        head = (offsets[:-1, None] + np.arange(4)).ravel()
        rest = np.ones(len(body), bool)
        rest[head] = False
        body[head] = position[own].astype("<i4").view(np.uint8)
        body[rest] = keys[own[0] : stop[-1]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].ravel()
        yield pa.RecordBatch.from_arrays([pa.array(minimizers[own].view(np.int64)), pa.array(doc[own]), pa.array(dh[own]), _binary(body, offsets)], names=names)


def _binary(body: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body))])


def _bodies(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the bodies of a batch."""
    column = batch.column(3)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return offsets.astype(np.int64), np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, dh (hash of the text), start, words, source_doc, source_start: factors of ``window`` words or more
    whose windows all start earlier at the source (a smaller doc_id, or the same id and an earlier start).

    Rows with null ids or texts, or fewer words than the window, have none.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in grouped(batches, "text", BLOCK_BYTES):
            ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held])
            dh = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in held])
            texts = [t for b in held for t in b.column(2).to_pylist()]
            del held
            yield from _parse_block(ids.astype(np.int64), dh.astype(np.int32), texts, window, gram)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FACTOR.split(", ")]
        held = []
        for b in batches:
            offsets, _ = _bodies(b)
            done = np.diff(offsets) % 2 == 1
            if done.any():
                part = b.filter(pa.array(done))
                offsets, data = _bodies(part)
                rows = data[offsets[0] : offsets[-1]].view(DONE)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), *(pa.array(np.ascontiguousarray(rows[x])) for x in names[2:])], names=names)
            if not done.all():
                held.append(b.filter(pa.array(~done)))
        if not held:
            return
        # most minimizers have one start and cannot repeat
        minimizer = np.concatenate([b.column(0).to_numpy() for b in held])
        _, which, times = np.unique(minimizer, return_inverse=True, return_counts=True)
        shared = times[which] > 1
        del minimizer, times
        ends = np.cumsum([b.num_rows for b in held])
        held = [b.filter(pa.array(m)) for b, m in zip(held, np.split(shared, ends[:-1]))]
        which = which[shared]
        if not len(which):
            return
        starts, sizes, hashes = [], [], []
        for b in held:
            offsets, data = _bodies(b)
            starts.append(data[(offsets[:-1, None] + np.arange(4)).ravel()].view("<i4"))
            sizes.append((np.diff(offsets) - 4) // HASH_BYTES)
            rest = np.ones(offsets[-1], bool)
            rest[: offsets[0]] = False
            rest[(offsets[:-1, None] + np.arange(4)).ravel()] = False
            wide = np.zeros((int(sizes[-1].sum()), 8), np.uint8)
            wide[:, :HASH_BYTES] = data[: offsets[-1]][rest].reshape(-1, HASH_BYTES)
            hashes.append(wide.view("<u8").ravel())
        doc, dh = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (1, 2))
        start, sizes, keys = np.concatenate(starts), np.concatenate(sizes), np.concatenate(hashes)
        del held, starts, hashes
        run = np.repeat(np.arange(len(sizes)), sizes)
        position = start[run] + np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        source = _earliest((doc[run], position), (which[run], keys))
        later = np.flatnonzero((doc[run][source] != doc[run]) | (position[source] != position))
        later = later[np.lexsort((position[later], dh[run[later]], doc[run[later]]))]
        found = _factors(doc[run[later]], dh[run[later]], position[later], doc[run[source[later]]], position[source[later]], window)
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([*map(pa.array, found)], names=names)

    rows = only(docs, ["doc_id", "text"]).filter("doc_id is not null and text is not null")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("dh"), F.col("text").cast("binary").alias("text"))
    sent = rows.mapInArrow(trimmed(parse), SENT)
    return sent.repartition(partitions_for(sent), "key").mapInArrow(trimmed(cross), FACTOR)


def _kept(text: bytes | None, starts, lengths) -> tuple[list[bytes], int]:
    """Words kept, and how many went."""
    words = (text or b"").split()
    if starts is None or not len(starts):
        return words, 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.asarray(starts), 1)
    np.add.at(edge, np.asarray(starts) + np.asarray(lengths), -1)
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g], int(gone.sum())


def with_factors(docs: DataFrame, columns: list[str], window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The columns, the text as bytes, and ``starts`` and ``lengths`` of the document's factors (null if none)."""
    # repeated rows of a document have the same factors: as a set they are no more than those of one
    found = factors(docs, window, gram).groupBy("doc_id", "dh").agg(F.collect_set(F.struct("start", "words")).alias("_f"))
    found = found.select("doc_id", "dh", F.col("_f.start").alias("starts"), F.col("_f.words").alias("lengths"))
    rows = only(docs, list(dict.fromkeys([*columns, "doc_id", "text"]))).withColumn("dh", F.hash("text"))
    out = rows.join(found, ["doc_id", "dh"], "left")
    return out.select(*[F.col(c) for c in columns if c != "text"], F.col("text").cast("binary").alias("text"), "starts", "lengths")


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, digests = [], [], []
            for text, starts, lengths in zip(b.column(1), b.column(2), b.column(3)):
                kept, gone = _kept(text.as_py(), starts.values if starts.is_valid else None, lengths.values if lengths.is_valid else None)
                n_words.append(len(kept) + gone)
                n_removed.append(gone)
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_factors(docs, ["doc_id", "text"], window).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def stripped_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents columns with the repeated words cut out; texts that lose none stay as they are, byte for byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes = [], []
            for text, n, starts, lengths in zip(b.column(4), b.column(3).to_pylist(), b.column(5), b.column(6)):
                text = text.as_py()
                if starts.is_valid:
                    text = b" ".join(_kept(text, starts.values, lengths.values)[0])
                    n = len(text.decode("utf-8", "replace"))
                texts.append(None if text is None else text.decode("utf-8", "replace"))
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), b.column(1), b.column(2), pa.array(sizes, pa.int64())], names=["doc_id", "text", "lang", "source", "n_chars"])

    out = with_factors(docs, ["doc_id", "lang", "source", "n_chars", "text"], window)
    return out.mapInArrow(run, "doc_id long, text string, lang string, source string, n_chars long")


#: DuckDB text of the op8 query.
ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - {WINDOW} + 2)) AS start, words FROM d WHERE len(words) >= {WINDOW}),
k AS (SELECT doc_id, start, md5(array_to_string(words[start : start + {WINDOW - 1}], ' ')) AS h FROM w),
f AS (SELECT doc_id, start, row_number() OVER (PARTITION BY h ORDER BY doc_id, start) AS nth FROM k),
gone AS (SELECT DISTINCT doc_id, start + o AS pos FROM f, (SELECT unnest(range(0, {WINDOW})) AS o) WHERE nth > 1),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.pos) AS kept, count(*) AS n FROM p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY 1)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
