"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a seed lexicon and of a lexicon learned from labelled rows, nearness of lexicon
words to second-person words, shares of capitals, punctuation, digits and symbols, and how much is written in disguise
(symbols inside words, letters set apart, words that enter the lexicon only once digits and symbols are undone).
Trees are grown on histograms in numpy; scores are calibrated on labelled rows that the trees have not seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fold, fold_of, grouped, least_hashed, only, release, trimmed

#: Labelled rows fitted on: a bound of the sample.
SAMPLE = 12_000
LEXICON, LEAST_TEXTS, LEAST_ODDS = 256, 5, 1.5
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 80, 3, 0.15, 64, 20, 1.0
NEAR = 5
#: Bytes of text of a slice of rows: a bound of memory.
BLOCK_BYTES = 4 << 20

# Insults and second-person words of the four languages.
INSULTS = """idiot idiots moron morons stupid dumb loser losers clown clowns worthless pathetic trash garbage scum jerk
fool fools imbecile disgusting hate shut ugly liar coward freak dimwit crap damn hell bastard bitch shit fuck fucking
asshole dumbass retard
imbécile crétin crétins débile abruti connard connasse salaud ordure merde ta gueule nul minable stupide
dumm dummkopf trottel arschloch scheiße scheisse schwachkopf depp versager widerlich abschaum
idiota idiotas estúpido estúpida imbécil tonto basura mierda pendejo cabrón asqueroso perdedor inútil payaso""".split()
SECOND_PERSON = """you your yours yourself ur u tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer
tú ti tus usted ustedes vosotros vuestro""".split()

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACED = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))
_UNDONE = bytes.maketrans(b"0134578@$!|+", b"oieastbasiit")
_DROPPED = b"*._-#^~"
_INSIDE = re.compile(rb"[a-z\x80-\xff][0-9@$!|+*._#^~-]+[a-z\x80-\xff]")
_APART = re.compile(rb"(?:(?<![a-z\x80-\xff])[a-z][ ._*-]){3,}[a-z](?![a-z\x80-\xff])")
_KIND = np.zeros(256, np.uint8)
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3), (b"!", 4), (b"?", 5), (b".,;:'\"()-", 6), (b"#$%&*+/<=>@[\\]^_`{|}~", 7), (b" \t\n\r\x0b\x0c", 8)):
    _KIND[list(_chars)] = _k
FEATURES = (
    "seed_density learned_density learned_weight learned_peak learned_kinds near_second_person second_person_density nearest capitals capital_words "
    "exclaims questions stops symbols digits inside apart disguised words length mean_word non_ascii"
).split()
_SHOUTED = re.compile(rb"(?<![A-Za-z\x80-\xff])[A-Z]{2,}(?![A-Za-z\x80-\xff])")


def lexicon_words(text: bytes) -> list[bytes]:
    return text.lower().translate(_SPACED).split()


class Lexicon:
    """Word -> (seed, second person, learned weight)."""

    def __init__(self, learned: dict[bytes, float]):
        self.words: dict[bytes, tuple[bool, bool, float]] = {}
        seeds, persons = {w.encode() for w in INSULTS}, {w.encode() for w in SECOND_PERSON}
        for w in seeds | persons | set(learned):
            self.words[w] = (w in seeds and w not in persons, w in persons, learned.get(w, 0.0))


def features(text: bytes | None, lexicon: Lexicon) -> list[float]:
    text = text or b""
    words = lexicon_words(text)
    n, get = max(1, len(words)), lexicon.words.get
    seeds, persons, hits, kinds, weight, peak = 0, [], [], set(), 0.0, 0.0
    for i, hit in enumerate(map(get, words)):
        if hit is not None:
            seed, person, learned = hit
            seeds += seed
            if person:
                persons.append(i)
            if seed or learned > 0:
                hits.append(i)
            if learned > 0:
                kinds.add(words[i])
                weight += learned
                peak = max(peak, learned)
    near, nearest = 0, 99.0
    if hits and persons:
        at = np.array(persons)
        where = np.searchsorted(at, hits)
        gap = np.minimum(np.abs(at[np.minimum(where, len(at) - 1)] - hits), np.abs(at[np.maximum(where - 1, 0)] - hits))
        near, nearest = int((gap <= NEAR).sum()), float(min(gap.min(), 99))
    kind = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=9)
    letters, size = max(1, int(kind[1] + kind[2])), max(1, len(text))
    disguised, lower = 0, text.lower()
    inside = len(_INSIDE.findall(lower)) if kind[3] + kind[4] + kind[6] + kind[7] else 0
    apart = len(_APART.findall(lower))
    if inside or apart:
        undone = _APART.sub(lambda m: re.sub(rb"[ ._*-]", b"", m[0]), lower) if apart else lower
        again = undone.translate(_UNDONE, _DROPPED).translate(_SPACED).split()
        disguised = max(0, sum(1 for w in map(get, again) if w is not None and (w[0] or w[2] > 0)) - len(hits))
    shouted = len(_SHOUTED.findall(text)) if kind[1] else 0
    return [
        seeds / n, len(hits) / n, weight / n, peak, float(len(kinds)), near / n, len(persons) / n, nearest, kind[1] / letters, shouted / n,
        kind[4] / size, kind[5] / size, kind[6] / size, kind[7] / size, kind[3] / size, inside / n, apart / n, disguised / n,
        math.log1p(len(words)), math.log1p(len(text)), letters / n, kind[0] / size,
    ]


class Boosted:
    """Boosted regression trees on the logistic loss, grown level by level on histograms."""

    def __init__(self):
        self.base, self.cuts, self.trees = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, k = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
        binned = self._binned(x)
        rate = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        margin = np.full(n, self.base)
        for _ in range(TREES if n else 0):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += self._follow(tree, binned)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1).astype(np.int16)

    @staticmethod
    def _grow(binned: np.ndarray, g: np.ndarray, h: np.ndarray):
        """(feature, last bin that goes left) of each inner node in heap order, values of the leaves."""
        n, k = binned.shape
        inner = (1 << DEPTH) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            best, gains = np.zeros((width, 2), np.int64), np.full(width, 1e-6)
            best[:, 1] = BINS
            for j in range(k):
                cell = (node - first) * BINS + binned[:, j]
                sums = [np.bincount(cell, w, width * BINS).reshape(width, BINS).cumsum(axis=1) for w in (g, h, None)]
                (gl, hl, cl), (gt, ht, ct) = sums, (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(cl < LEAST_ROWS) | (ct - cl < LEAST_ROWS)] = 0
                at = gain.argmax(axis=1)
                more = gain[np.arange(width), at] > gains
                gains[more], best[more, 0], best[more, 1] = gain[np.arange(width), at][more], j, at[more]
            feature[first : first + width], cut[first : first + width] = best[:, 0], best[:, 1]
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, 1 << DEPTH) / (np.bincount(leaf, h, 1 << DEPTH) + RIDGE)
        return feature, cut, value

    @staticmethod
    def _follow(tree, binned: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        return value[node - len(feature)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        return self.base + sum((self._follow(t, binned) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (scores ascending, non-decreasing rates) by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weight, mean, sum of scores
    for s, t in zip(score[order].tolist(), y[order].tolist()):
        blocks.append([1.0, float(t), s])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w, m, total = blocks.pop()
            last = blocks[-1]
            last[1] = (last[0] * last[1] + w * m) / (last[0] + w)
            last[0] += w
            last[2] += total
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] for b in blocks])


class Model:
    def __init__(self, lexicon: Lexicon, boosted: Boosted, knots: tuple[np.ndarray, np.ndarray]):
        self.lexicon, self.boosted, self.knots = lexicon, boosted, knots

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        margin = self.boosted.margin(np.array([features(t, self.lexicon) for t in texts]))
        at, rate = self.knots
        # a trace of the margin keeps the order of texts within a step of the calibration
        return np.clip(0.999 * np.interp(margin, at, rate) + 0.001 / (1 + np.exp(-margin)), 0.0, 1.0)


def learned_lexicon(sample: DataFrame) -> dict[bytes, float]:
    """Words that far more toxic texts hold than others, with their log odds; at most ``LEXICON`` words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                seen[toxic].update(set(lexicon_words(text or b"")))
            words = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([seen[1][w] for w in words], pa.int64()), pa.array([seen[0][w] for w in words], pa.int64())], names=["word", "toxic", "clean"])

    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    words = sample.select("doc_id", "text", "toxic").mapInArrow(count, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    # of equal odds the words of more toxic texts come first
    top = words.filter(F.col("toxic") >= LEAST_TEXTS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS).orderBy((F.col("odds") * F.log("toxic")).desc(), "word").limit(LEXICON)
    return {bytes(r["word"]): float(r["odds"]) for r in top.collect()}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of at most ``sample`` labelled rows outside the held-out fold, those of least hash."""
    marked = only(labels, ["doc_id", "toxic"]).filter("doc_id is not null and toxic is not null").filter(fold(F.col("doc_id"), 5) != 0)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    chosen = least_hashed(marked, "toxicity", "doc_id", sample)
    rows = only(docs, ["doc_id", "text"]).join(chosen, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "toxic")
    # repeated rows of one id count once, so that the sample's bound holds for what is learned from
    rows = durable(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic"), "labelled")
    # the lexicon's rows and the trees' are apart, else the trees would trust it too much
    first = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    lexicon = Lexicon(learned_lexicon(rows.filter(first)))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t, shared.value) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    got = sorted((r["doc_id"], r["toxic"], tuple(r["x"])) for r in rows.filter(~first).mapInArrow(run, "doc_id long, toxic int, x array<double>").toLocalIterator())
    x, y = np.array([r[2] for r in got]).reshape(-1, len(FEATURES)), np.array([r[1] for r in got], float)
    held = np.array([fold_of(r[0], 20) // 5 == 1 for r in got], bool)  # a fold of its own, apart from the one held out
    if not len(y) or not held.any() or held.all():
        return Model(lexicon, Boosted().fit(x, y), (np.array([0.0]), np.array([y.mean() if len(y) else 0.0])))
    boosted = Boosted().fit(x[~held], y[~held])
    release()
    return Model(lexicon, boosted, isotonic(boosted.margin(x[held]), y[held]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null texts are scored as empty ones.  Repeated rows give repeated
    rows, texts of any length are scored whole, an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # trees, knots and at most a few hundred words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for held in grouped(batches, "text", BLOCK_BYTES) for part in held):
            score = shared.value.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([fold_of(i, 5) == 0 for i in b.column(0).to_pylist()], pa.bool_()), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = only(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, held_out boolean, score double, predicted int")
