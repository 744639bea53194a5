"""SimHash near-duplicate classes by a Gray-order hierarchical index.

Fingerprints are majority votes of the hashes of word shingles.  Equal fingerprints are one class from the start.
Distinct fingerprints are dealt by shared bit patterns, the upper nodes of the index; inside a task the members of each
upper node are sorted by Gray rank, which puts patterns that differ in few bits side by side, and nodes of 2, 4, 8 ...
neighbours keep the bits on which all their members agree (mask and pattern).  Pairs of nodes are opened from the top
down.  A pair whose shared masked patterns already differ in more than ``radius`` bits is dropped with everything below
it; a pair whose members cannot differ in more is tied as a whole, and what is tied already is not opened.

There are two kinds of fingerprints.  The narrow one has 64 bits of 3-word shingles and a radius of 2 (op6); its 64 bits
are cut into radius + 1 blocks, of which two fingerprints within the radius share one, so the search is exact.  The wide
one, of the pipeline, has 256 bits of 5-word shingles and a radius that reaches texts of a Jaccard similarity of 0.8.  It
is cut into 12 blocks of 21 bits, and a fingerprint stands under each block's value and under those that arise if the
least certain bits of the block, those with the narrowest votes, are turned.  Two near copies differ in such bits above
all, so nearly all of them (README has the measured share) meet under one value at least.

A task ties the fingerprints that it links into stars, so a group of m near copies leaves at most m links an upper node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, only, partitions_for, trimmed
from .components import components
from .hashing import span_hashes

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Hashes voted on at once, node pairs opened at once, rows searched at once: bounds of memory, not of work.
VOTES, PAIRS, CHUNK = 1 << 18, 1 << 20, 1 << 18

#: The wide fingerprint: words in a shingle, 64-bit words, blocks of a word and their bits, uncertain bits of a block, radius.
WIDE_SHINGLE, WIDE_WORDS, WIDE_CUTS, WIDE_BITS, UNSURE = 5, 4, 3, 21, 2
#: Bits of 256 in which near copies differ at most: about 39 are expected at a Jaccard similarity of 0.8, 49 at 0.7.
WIDE_RADIUS = 46
WIDE = [f"f{i}" for i in range(WIDE_WORDS)]
#: Odd numbers that make the bits of each word of a wide fingerprint from a shingle's hash.
SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Rounds in which the members of an upper node are tied to a first one before pairs are opened.
LEADERS = 8


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - shingle + 1
    votes = np.zeros(64, np.int64)
    for at in range(0, n, VOTES):
        to = min(n, at + VOTES)
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist())]
        votes += _bit_sums(np.array(hashes, ">u8"))
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, in the order of their bytes, each byte's most significant bit first."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    total = np.zeros(64, np.int64)
    for at in range(0, len(bits), 255):  # sums of 255 bits fit a byte
        total += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return total


def wide_fingerprint(text: bytes | None, shingle: int = WIDE_SHINGLE) -> tuple[np.ndarray, bytes]:
    """(the words of the wide fingerprint, the places of the least certain bits of each block) of one text, from its
    distinct shingles; all zero without words."""
    joined = b" ".join((text or b"").lower().split())
    if not joined:
        return np.zeros(WIDE_WORDS, np.uint64), bytes(range(UNSURE)) * (WIDE_WORDS * WIDE_CUTS)
    flat = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(flat == 32)
    begin, end = np.zeros(len(gaps) + 1, np.int64), np.full(len(gaps) + 1, len(flat))
    begin[1:], end[:-1] = gaps + 1, gaps
    n = max(1, len(begin) - shingle + 1)
    last = end[min(shingle, len(begin)) - 1 :]
    hashes = np.concatenate([span_hashes(flat, begin[at : min(n, at + VOTES)], last[at : min(n, at + VOTES)]) for at in range(0, n, VOTES)])
    hashes.sort()
    fresh = np.ones(len(hashes), bool)
    np.not_equal(hashes[1:], hashes[:-1], out=fresh[1:])
    hashes = hashes[fresh]
    margins = np.empty((WIDE_WORDS, 64), np.int64)
    for w in range(WIDE_WORDS):
        margins[w] = 0
        for at in range(0, len(hashes), VOTES):
            salted = hashes[at : at + VOTES] * np.uint64(SALTS[w])
            salted ^= salted >> np.uint64(32)
            margins[w] += _bit_sums(salted)
    margins = 2 * margins - len(hashes)  # the least significant byte first, its most significant bit first
    codes = np.packbits(margins > 0, axis=1).view("<u8").ravel()
    places = np.abs(margins).reshape(WIDE_WORDS, 8, 8)[:, :, ::-1].reshape(WIDE_WORDS, 64)[:, : WIDE_CUTS * WIDE_BITS]
    unsure = np.argsort(places.reshape(-1, WIDE_BITS), axis=1, kind="stable")[:, :UNSURE].astype(np.uint8).tobytes()
    return codes, unsure


def wide_keys(codes: np.ndarray, unsure: np.ndarray) -> np.ndarray:
    """(n, keys) upper nodes of wide fingerprints: the block's number and a value of the block, with each set of its
    ``UNSURE`` least certain bits turned.  ``codes`` (n, words), ``unsure`` (n, blocks, UNSURE)."""
    n = len(codes)
    shift = np.arange(WIDE_CUTS, dtype=np.uint64) * np.uint64(WIDE_BITS)
    value = ((codes[:, :, None] >> shift) & np.uint64((1 << WIDE_BITS) - 1)).reshape(n, -1).astype(np.int64)
    bit = np.int64(1) << unsure.astype(np.int64)
    turned = np.zeros((n, value.shape[1], 1 << UNSURE), np.int64)
    for s in range(1 << UNSURE):
        for j in range(UNSURE):
            if s >> j & 1:
                turned[:, :, s] ^= bit[:, :, j]
    block = np.arange(value.shape[1], dtype=np.int64) << 32
    return ((value[:, :, None] ^ turned) | block[None, :, None]).reshape(n, -1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the narrow fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], names=["doc_id", "fp"])

    rows = only(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, fp long")


def wide_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, _k (the hash of the text), f0 to f3 (the wide fingerprint), unsure of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [wide_fingerprint(t.as_py()) for t in b.column(2)]
            codes = np.array([c for c, _ in got], np.uint64).reshape(-1, WIDE_WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(codes[:, w])) for w in range(WIDE_WORDS)), pa.array([u for _, u in got], pa.binary())], names=["doc_id", "_k", *WIDE, "unsure"])

    rows = only(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_k"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(trimmed(run), f"doc_id long, _k long, {', '.join(f'{f} long' for f in WIDE)}, unsure binary")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order; codes of several words, the first the most significant, have
    a place of as many words."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    if codes.ndim > 1:
        for w in range(1, codes.shape[1]):  # an odd number of ones before a word turns it around
            rank[:, w] ^= np.uint64(0) - (rank[:, w - 1] & np.uint64(1))
    return rank


def _bits(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=1, dtype=np.int64)


class GrayIndex:
    """Hierarchical index over fingerprints (n, words), in groups that are searched apart.

    ``first[j]`` are the nodes of level j - 1 at which the nodes of level j begin, ``leaf[j]`` the leaves; ``ones`` and
    ``zeros`` hold the bits set in all, and in none, of a node's members; ``low`` and ``high`` the least and the greatest
    label of a member: members of one label are tied already.
    """

    def __init__(self, groups: np.ndarray, codes: np.ndarray, labels: np.ndarray | None = None):
        """``groups`` must be sorted, ``codes`` sorted by Gray rank within each group (and label)."""
        codes = codes.reshape(len(codes), -1)
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(codes) else np.zeros(0, np.int64)
        labels = np.arange(len(codes)) if labels is None else labels
        self.first, self.leaf, self.ones, self.zeros, self.roots = [np.arange(len(codes))], [np.arange(len(codes))], [codes], [~codes], len(starts)
        self.low, self.high, self.bits = [labels], [labels], 64 * codes.shape[1]
        counts = np.diff(np.r_[starts, len(codes)])
        while len(counts) and counts.max() > 1:
            up = (counts + 1) // 2
            own = np.repeat(np.cumsum(counts) - counts, up)  # where each group's nodes begin
            child = own + 2 * (np.arange(up.sum()) - np.repeat(np.cumsum(up) - up, up))
            self.first.append(child)
            self.leaf.append(self.leaf[-1][child])
            self.ones.append(np.bitwise_and.reduceat(self.ones[-1], child, axis=0))
            self.zeros.append(np.bitwise_and.reduceat(self.zeros[-1], child, axis=0))
            self.low.append(np.minimum.reduceat(self.low[-1], child))
            self.high.append(np.maximum.reduceat(self.high[-1], child))
            counts = up
        self.counts = [len(x) for x in self.ones]

    def _children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = self.first[level]
        end = np.r_[begin[1:], self.counts[level - 1]]
        return begin[nodes], end[nodes]

    def _star(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves that tie all members of the nodes a and b to the first one of a."""
        begin = self.leaf[level]
        end = np.r_[begin[1:], self.counts[0]]
        hub, lo, hi = np.r_[begin[a], begin[a]], np.r_[begin[a], begin[b]], np.r_[end[a], end[b]]
        size = hi - lo
        return np.repeat(hub, size), np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)

    def pairs(self, radius: int, tied: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Leaf numbers (i, j), i < j, within the radius of each other and of one group.  With ``tied``, pairs that
        connect the same leaves, but not all: nodes within the radius as a whole give stars, tied ones nothing."""
        top = len(self.first) - 1
        roots = np.arange(self.roots)
        stack = [(top, roots[at : at + PAIRS], roots[at : at + PAIRS]) for at in range(0, self.roots, PAIRS)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > PAIRS:
                half = len(a) // 2
                stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            if level == 0:
                apart = a < b
                if apart.any():
                    yield a[apart], b[apart]
                continue
            a0, a1 = self._children(level, a)
            b0, b1 = self._children(level, b)
            a, b = np.concatenate([a0, a0, a0 + 1, a0 + 1]), np.concatenate([b0, b0 + 1, b0, b0 + 1])
            there = (a < np.tile(a1, 4)) & (b < np.tile(b1, 4)) & (a <= b)
            down = level - 1
            if tied:
                at, bt = np.where(there, a, 0), np.where(there, b, 0)
                there &= (self.low[down][at] != self.high[down][at]) | (self.low[down][bt] != self.high[down][bt]) | (self.low[down][at] != self.low[down][bt])
            a, b = a[there], b[there]
            ones, zeros = (x[down] for x in (self.ones, self.zeros))
            near = (_bits((ones[a] & zeros[b]) | (zeros[a] & ones[b])) <= radius) & ((a < b) | (down > 0))
            a, b = a[near], b[near]
            if tied and down:
                whole = self.bits - _bits((ones[a] & ones[b]) | (zeros[a] & zeros[b])) <= radius
                if whole.any():
                    yield self._star(down, a[whole], b[whole])
                    a, b = a[~whole], b[~whole]
            if len(a):
                stack.append((down, a, b))


def _tie(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all leaves that the pairs connect the least label among them, in place.  A label is the number of a leaf
    that has itself as label; only such leaves are hung under others, so that what is tied stays tied."""
    while True:
        of_a, of_b = labels[a], labels[b]
        apart = of_a != of_b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(of_a, of_b)[apart], np.minimum(of_a, of_b)[apart])
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped


def stars(groups: np.ndarray, node: np.ndarray, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) links that tie all nodes of a group that the radius connects; ``groups`` sorted."""
    codes = codes.reshape(len(codes), -1)
    # a node that is alone in its group has nothing to be tied to
    fresh = np.r_[True, groups[1:] != groups[:-1]]
    shared = ~(fresh & np.r_[fresh[1:], True])
    groups, node, codes = groups[shared], node[shared], codes[shared]
    if not len(groups):
        return node[:0], node[:0]
    rank = gray_rank(codes)
    order = np.lexsort((*rank.T[::-1], groups))
    groups, node, codes = groups[order], node[order], codes[order]
    # members are tied to the first of their group, then the rest to the first of the rest, before pairs are opened
    labels, free = np.arange(len(codes)), np.arange(len(codes))
    for _ in range(LEADERS):
        begin = np.r_[True, groups[free][1:] != groups[free][:-1]]
        lead = free[np.flatnonzero(begin)[np.cumsum(begin) - 1]]
        near = _bits(codes[free] ^ codes[lead]) <= radius
        labels[free[near]] = lead[near]
        free = free[~near]
        if not len(free):
            break
    order = np.lexsort((labels, groups))  # stable: the Gray order stays within a label
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    groups, node, codes, labels = groups[order], node[order], codes[order], place[labels[order]]
    for a, b in GrayIndex(groups, codes, labels.copy()).pairs(radius, tied=True):
        _tie(labels, a, b)
    order = np.argsort(labels, kind="stable")
    begin = np.flatnonzero(np.r_[True, labels[order][1:] != labels[order][:-1]])
    hub = np.empty(len(order), np.int64)
    hub[order] = np.repeat(np.minimum.reduceat(node[order], begin), np.diff(np.r_[begin, len(order)]))
    tied = node != hub
    return node[tied], hub[tied]


def _searcher(words: int, radius: int):
    """A function from batches (key, node, f0, f1 ...), sorted by key, to links (u, v) between the nodes of a key.  Whole
    keys of about CHUNK rows are searched together, so a task holds no more than those or the largest key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, limit = [], 0, CHUNK

        def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            u, v = stars(columns[0], columns[1], np.stack(columns[2:], axis=1).view(np.uint64), radius)
            if len(u):
                both = np.unique(np.stack([u, v], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=["u", "v"])

        def joined() -> list[np.ndarray]:
            return [np.concatenate([x[i] for x in held]) for i in range(2 + words)]

        for b in batches:
            if b.num_rows:
                held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(2 + words)])
                size += b.num_rows
            if size >= limit:
                columns = joined()
                cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last key may go on
                if cut:
                    yield from found([c[:cut] for c in columns])
                held = [[c[cut:].copy() for c in columns]]
                size -= cut
                limit = max(CHUNK, 2 * size)
        if size:
            yield from found(joined())

    return run


def _search(dealt: DataFrame, words: int, radius: int) -> DataFrame:
    """dealt (key, node, f0, f1 ...) -> (u, v) links between the nodes of a key."""
    n = partitions_for(dealt)
    return dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(trimmed(_searcher(words, radius)), "u long, v long")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints (fp, node), fp distinct -> (u, v) links between nodes that tie all within the radius of each other."""
    cuts = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    spans = list(zip(cuts, cuts[1:]))
    value = lambda lo, hi: F.shiftrightunsigned(F.col("fp"), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1))
    if radius:
        upper = F.explode(F.array(*[value(lo, hi).bitwiseOR(F.lit(i << 56)) for i, (lo, hi) in enumerate(spans)]))
    else:
        upper = F.col("fp")
    return _search(prints.select(upper.alias("key"), "node", F.col("fp").alias("f0")), 1, radius)


def wide_links(nodes: DataFrame, radius: int = WIDE_RADIUS) -> DataFrame:
    """nodes (node, f0 to f3, unsure), fingerprints distinct -> (u, v) links that tie near ones."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                codes = np.stack([b.column(1 + w).to_numpy() for w in range(WIDE_WORDS)], axis=1)
                unsure = np.frombuffer(b"".join(b.column(1 + WIDE_WORDS).to_pylist()), np.uint8).reshape(len(codes), -1, UNSURE)
                keys = wide_keys(codes.view(np.uint64), unsure)
                row = np.repeat(np.arange(len(codes)), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(b.column(0).to_numpy()[row]), *(pa.array(codes[row, w]) for w in range(WIDE_WORDS))], names=["key", "node", *WIDE])

    dealt = nodes.select("node", *WIDE, "unsure").mapInArrow(deal, f"key long, node long, {', '.join(f'{f} long' for f in WIDE)}")
    return _search(dealt, WIDE_WORDS, radius)


def near_duplicate_classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row.

    Null and blank texts have fingerprint zero and are linked like any other.  Rows with a null doc_id take no part in
    links; their component is that of their fingerprint.  Equal rows give equal rows; texts of any length are hashed
    whole; an empty table gives an empty result.
    """
    prints = durable(fingerprints(docs), "simhash")
    distinct = prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    tied = components(links(distinct, radius))
    classes = distinct.join(tied, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = prints.join(classes, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copy_classes(docs: DataFrame, radius: int = WIDE_RADIUS) -> DataFrame:
    """doc_id, _k (the hash of the text), _n (its rows), class: every distinct (doc_id, text) with its class of near
    copies by wide fingerprints.  Rows are told apart by id and text, whether or not they have an id."""
    prints = durable(wide_fingerprints(docs).groupBy("doc_id", "_k", *WIDE).agg(F.min("unsure").alias("unsure"), F.count(F.lit(1)).alias("_n")), "wide-simhash")
    # numbers of a written table do not change when it is read again
    nodes = durable(prints.groupBy(*WIDE).agg(F.min("unsure").alias("unsure")).withColumn("node", F.monotonically_increasing_id()), "wide-nodes")
    tied = components(wide_links(nodes, radius))
    classes = nodes.join(tied, "node", "left").select(*WIDE, F.coalesce("component", "node").alias("class"))
    return prints.join(classes, WIDE).select("doc_id", "_k", "_n", "class")
