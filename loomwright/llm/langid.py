"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased; runs of anything but letters and marks are one blank.  Its subwords are all character n-grams of
2, 3 and 4 code points, blanks included, hashed into a table of embeddings; their mean goes through a linear softmax.
Both layers are trained together by stochastic gradient descent in numpy.

Rejection is calibrated.  Beside the languages the softmax has a class for anything else, trained on what no text of the
sample is: texts of the sample whose letters are exchanged by a random permutation, so that words keep their lengths and
repeats but have the subwords of no language learned.  The sample is held back in turns, so that every text and its
exchanged form get a score of a model that has not seen them; on these scores a temperature is fitted, and the
probability below which a text is rejected is put between those of exchanged and of known texts.  ``Model.errors`` has
both error rates.

After training, embedding and softmax are folded into one score per subword and language, so that scoring a text is a
sum over its n-grams; texts are scored whole, millions of characters at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, fold_of, grouped, only, release, trimmed

ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
DIMENSION = 16
#: Labelled rows fitted on, whole texts, in equal parts of each language: a bound of the sample (of more languages than
#: that, one row of each).
SAMPLE = 1200
STEPS, BATCH, RATE = 200, 32, 0.5
#: Bound of what a step moves, in units of the rate.
MOST = 8.0
#: Share of the exchanged texts that are learned from; shares of held-back texts of known languages that may be rejected,
#: and of exchanged ones that may be accepted.  The first counts if both cannot be kept.
FOREIGN, TURNED_AWAY, LET_IN = 0.25, 0.01, 0.01
#: Parts of the sample that are held back in turn; how far from what known texts reach towards what exchanged ones stay
#: under the threshold lies, in log-odds, and its least distance from the former.
FOLDS, NEARER, MARGIN = 2, 0.75, 1.0
BLOCK_BYTES = 4 << 20
UNDETERMINED = "und"


@lru_cache(1)
def _plane() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: what it counts as (lower case; blank unless letter or mark), and whether it is a letter."""
    import regex

    every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x110000))
    keep, letter = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for pattern, out in ((r"[\p{L}\p{M}]+", keep), (r"\p{L}+", letter)):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = True
    lower = np.fromiter((ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(0x110000)), np.uint32, 0x110000)
    return np.where(keep, lower, 32).astype(np.uint32), letter


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, where each text's n-grams begin (one more than texts), texts with letters)."""
    joined = "".join(f" {t} " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 2 for t in texts])
    plane, letter = _plane()
    has_letter = np.add.reduceat(letter[codes], np.r_[0, ends[:-1]]).astype(bool) if len(texts) else np.zeros(0, bool)
    codes = plane[codes]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    new = np.ones(len(codes), bool)  # a blank after a blank of the same text goes
    new[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (owner[1:] != owner[:-1])
    codes, owner = codes[new].astype(np.uint32), owner[new].astype(np.int32)
    buckets, owners = [], []
    rolled = codes * np.uint32(0x9E3779B1)
    for n in range(2, max(ORDERS) + 1):
        rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + codes[n - 1 :] * np.uint32(0x9E3779B1)
        if n in ORDERS:
            same = owner[n - 1 :] == owner[: len(owner) - n + 1]
            h = rolled ^ (rolled >> np.uint32(13))
            h = (h * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
            buckets.append(h[same].astype(np.int32) & (BUCKETS - 1))
            owners.append(owner[: len(owner) - n + 1][same])
    at = np.concatenate(owners)
    order = np.argsort(at, kind="stable")
    return np.concatenate(buckets)[order], np.searchsorted(at[order], np.arange(len(texts) + 1)), has_letter


class Model:
    """``table``: scores of each subword for each language and, last, for anything else; ``bias``; ``temperature``;
    ``threshold`` below which a text is rejected; ``errors``: shares of held-back texts rejected, exchanged ones accepted."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.languages, self.table, self.bias, self.temperature, self.threshold = languages, table, bias, temperature, threshold
        self.errors = (0.0, 0.0)

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(one row of logits per text, texts with letters).  Sums go order by order: only one n-gram size at a time."""
        joined = "".join(f" {t} " for t in texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
        plane, letter = _plane()
        has_letter = np.add.reduceat(letter[codes], np.cumsum(sizes) - sizes) > 0
        codes = plane[codes]
        starts = np.zeros(len(codes), bool)
        starts[np.cumsum(sizes) - sizes] = True
        new = starts.copy()
        new[1:] |= (codes[1:] != 32) | (codes[:-1] != 32)
        codes = codes[new]
        begin = np.flatnonzero(starts[new])
        size = np.diff(np.r_[begin, len(codes)])
        total, count = np.zeros((len(texts), len(self.bias))), np.zeros(len(texts))
        rolled = codes * np.uint32(0x9E3779B1)
        for n in range(2, max(ORDERS) + 1):
            rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + codes[n - 1 :] * np.uint32(0x9E3779B1)
            if n not in ORDERS or not len(rolled):
                continue
            h = rolled ^ (rolled >> np.uint32(13))
            h = ((h * np.uint32(0xC2B2AE3D)) >> np.uint32(16)) & np.uint32(BUCKETS - 1)
            own = np.maximum(size - n + 1, 0)
            edges = np.empty(2 * len(begin), np.int64)  # n-grams of a text, then those across its end
            edges[0::2], edges[1::2] = begin, begin + own
            for c in range(len(self.bias)):
                values = np.r_[self.table[:, c][h], np.float32(0)]
                sums = np.add.reduceat(values, np.minimum(edges, len(values) - 1), dtype=np.float64)[0::2]
                total[:, c] += np.where(own > 0, sums, 0)
            count += own
        return total / np.maximum(count, 1)[:, None] + self.bias, has_letter

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each language, the rest being that of anything else; texts with letters)."""
        z, letters = self.logits(texts)
        return _softmax(z / self.temperature)[:, : len(self.languages)], letters


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def exchanged(text: str, rng: np.random.Generator) -> str:
    """The text with its letters exchanged by a random permutation of the letters that it has, as lower case."""
    text = text.lower()
    letters = sorted({c for c in text if c.isalpha()})
    return text.translate(dict(zip(map(ord, letters), (letters[i] for i in rng.permutation(len(letters))))))


class _Features:
    """Texts as their distinct subwords and the shares of these, so that long texts cost no more than what they say."""

    def __init__(self, texts: list[str]):
        self.ids, self.parts = [], []
        for at in range(0, len(texts), 64):
            buckets, begin, _ = subwords(texts[at : at + 64])
            for lo, hi in zip(begin, begin[1:]):
                own, times = np.unique(buckets[lo:hi], return_counts=True)
                self.ids.append(own.astype(np.int32))
                self.parts.append((times / max(1, hi - lo)).astype(np.float32))

    def means(self, rows, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows: the shares' mean of the table's rows; and the subwords, their shares and whose they are."""
        ids, part = np.concatenate([self.ids[i] for i in rows]), np.concatenate([self.parts[i] for i in rows])
        which = np.repeat(np.arange(len(rows)), [len(self.ids[i]) for i in rows])
        return _by_row(which, table[ids] * part[:, None], len(rows)), ids, part, which


def _by_row(which: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(which):
        first = np.flatnonzero(np.diff(which, prepend=-1))
        out[which[first]] = np.add.reduceat(values, first)
    return out


def _bounded(x: np.ndarray, most: float) -> np.ndarray:
    """``x``, scaled down if a row of it is longer than ``most``."""
    longest = float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=-1)).max(initial=0))
    return x * np.float32(most / longest) if longest > most else x


def _descend(features: _Features, y: np.ndarray, rows: np.ndarray, classes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores of each subword for each class, bias) by stochastic gradient descent over the rows.

    No step moves a text's mean or a column of the softmax by more than ``MOST`` times the rate, however few subwords a
    text has and however many texts of a batch share them, so weights stay finite on any corpus."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    weight, bias = rng.normal(0, 0.1, (DIMENSION, classes)).astype(np.float32), np.zeros(classes, np.float32)
    rows, step = rows.copy(), 0
    while step < STEPS and len(rows):
        rng.shuffle(rows)
        for at in range(0, len(rows), BATCH):
            rate = RATE * max(0.0, 1 - step / STEPS)
            step += 1
            batch = rows[at : at + BATCH]
            mean, ids, part, which = features.means(batch, embed)
            grad = _softmax(mean @ weight + bias)
            grad[np.arange(len(batch)), y[batch]] -= 1
            back = grad @ weight.T
            weight -= np.float32(rate) * _bounded((mean.T @ grad / len(batch)).T, MOST).T
            bias -= np.float32(0.1 * rate) * grad.mean(axis=0)
            if not len(ids):
                continue
            # the embedding's step is large, since each n-gram is a small part of a mean
            change = np.empty_like(embed)
            for d in range(DIMENSION):
                change[:, d] = np.bincount(ids, 20 * back[which, d] * part, BUCKETS)
            length = np.sqrt(np.einsum("ij,ij->i", change, change))  # a mean moves no further than the mean of these
            longest = float(np.bincount(which, length[ids] * part).max())
            change *= np.float32(rate * min(1.0, MOST / max(longest, 1e-9)))
            embed -= change
    table = np.ascontiguousarray(embed @ weight)
    if not (np.isfinite(table).all() and np.isfinite(bias).all()):
        raise FloatingPointError("language model: training left the range of finite numbers")
    return table, bias.astype(np.float64)


def train(texts: list[str], labels: list[str], seed: int = 3) -> Model:
    """Fit on whole texts.  Temperature and threshold come from all texts, each judged by a model that has not seen it
    (``FOLDS`` of them), beside the same texts with exchanged letters.

    The threshold lies, in log-odds, between the score that all but ``LET_IN`` of the exchanged texts stay under and the
    score that all but ``TURNED_AWAY`` of the known ones reach, nearer to the former since a text lost is worse than one
    let in, and at least ``MARGIN`` under the latter, whatever a few odd texts score; where exchanged texts cannot be told
    from known ones, nearly all are accepted."""
    languages = sorted(set(labels)) or [UNDETERMINED]
    if not texts:
        return Model(languages, np.zeros((BUCKETS, 2), np.float32), np.zeros(2))
    rng = np.random.default_rng(seed)
    n, other = len(texts), len(languages)
    changed = [exchanged(t, rng) for t in texts]
    # a text whose letters were all exchanged for themselves is no other text
    foreign = np.array([i for i in range(n) if changed[i] != texts[i].lower()], np.int64)
    features = _Features(texts + [changed[i] for i in foreign])
    y = np.r_[[languages.index(x) for x in labels], np.full(len(foreign), other, np.int64)].astype(np.int64)
    order = rng.permutation(n)
    source = np.r_[np.arange(n), foreign]  # which text a row comes from
    learned = np.r_[np.ones(n, bool), rng.random(len(foreign)) < FOREIGN]
    fold = np.empty(n, np.int64)
    fold[order] = np.arange(n) % FOLDS
    z = np.zeros((len(y), other + 1))
    if n >= 2 * FOLDS:
        for k in range(FOLDS):
            there = fold[source] == k
            table, bias = _descend(features, y, np.flatnonzero(~there & learned), other + 1, seed + 1 + k)
            held = np.flatnonzero(there)
            for at in range(0, len(held), 64):
                z[held[at : at + 64]] = features.means(held[at : at + 64], table)[0] + bias
    model = Model(languages, *_descend(features, y, np.flatnonzero(learned), other + 1, seed))
    if n < 2 * FOLDS:
        return model
    # as in Platt's scaling a label counts as a little less than certain, else texts that are all told apart rightly
    # would ask for certainty
    target = np.full(z.shape, 1 / (n + 2) / z.shape[1])
    target[np.arange(len(y)), y] += 1 - 1 / (n + 2)
    loss = lambda t: -(target * np.log(np.maximum(_softmax(z / t), 1e-300))).sum(axis=1).mean()
    model.temperature = float(min(np.geomspace(0.001, 100, 240), key=loss))
    best = _softmax(z / model.temperature)[:, :other].max(axis=1)
    known, strange = best[:n], best[n:]
    odds = lambda p: float(np.log(max(p, 1e-12)) - np.log(max(1 - p, 1e-12)))
    reached = odds(np.quantile(known, TURNED_AWAY, method="lower"))
    # a text of unknown subwords alone has no more than what the bias gives it
    under = float(_softmax(model.bias / model.temperature)[:other].max())
    if len(strange):
        under = max(under, float(np.quantile(strange, 1 - LET_IN, method="higher")))
    low = min(odds(under), reached - MARGIN / NEARER)
    model.threshold = float(1 / (1 + np.exp(-(low + (1 - NEARER) * (reached - low)))))
    model.errors = (float((known < model.threshold).mean()), float((strange >= model.threshold).mean()) if len(strange) else 0.0)
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the table's labelled texts outside the held-out fold: at most ``sample`` rows, whole, as many of each
    language, those of least hash of their id and text, so that the choice does not depend on partitions and every
    language is learned.  Repeated rows count once."""
    rows = only(docs, ["doc_id", "text", "lang"]).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), 4) != 2))
    rows = rows.withColumn("_h", F.xxhash64(F.lit("langid"), "doc_id", "text"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    languages = counts.count()  # a row a language
    each = max(1, sample // max(1, languages))
    # a bound on the hash, under which four times as many rows are expected, comes before they are sorted
    bound = F.lit(float(-(1 << 63))) + F.lit(float(1 << 64)) * F.least(F.lit(1.0), F.lit(4.0 * each) / F.col("_n"))
    for near in (rows.join(counts, "lang").filter(F.col("_h") <= bound), rows):
        kinds = near.groupBy("lang", "_h").agg(F.min("doc_id").alias("doc_id"))
        ranked = kinds.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).filter(F.col("_r") <= each)
        chosen = {(r["lang"], r["_h"]) for r in ranked.select("lang", "_h").collect()}
        if len({lang for lang, _ in chosen}) == languages:
            break
    if not chosen:
        return train([], [])
    wanted = docs.sparkSession.createDataFrame(sorted(chosen), "lang string, _h long")
    got = rows.join(F.broadcast(wanted), ["lang", "_h"]).groupBy("lang", "_h").agg(F.min("text").alias("text")).collect()  # ``sample`` rows, or one a language
    got = sorted((r["_h"], r["text"], r["lang"]) for r in got)
    model = train([t for _, t, _ in got], [x for _, _, x in got])
    release()
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every row.

    Null texts and texts without letters are `und` with score 0 and are rejected; so are texts whose best language has
    a calibrated probability under the model's threshold, though ``lang_pred`` still names it.  Repeated rows give
    repeated rows; texts of any length are read whole; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 65,536 x languages numbers: bounded by parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for held in grouped(batches, "text", BLOCK_BYTES):
            ids = [i for b in held for i in b.column(0).to_pylist()]
            texts = [(t or b"").decode("utf-8", "replace") for b in held for t in b.column(1).to_pylist()]
            best, score, letters = score_texts(model, texts)
            names = [model.languages[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), letters.tolist())]
            score = np.where(letters, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([fold_of(i, 4) == 2 for i in ids]), pa.array(names), pa.array(score), pa.array(letters & (score >= shared.value.threshold))],
                names=["doc_id", "held_out", "lang_pred", "score", "accepted"],
            )

    rows = only(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def score_texts(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its probability, has letters) of each text, in runs of a bounded number of characters."""
    best, score, letters, at = [], [], [], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < BLOCK_BYTES // 2):
            size += len(texts[to])
            to += 1
        p, ok = model.probabilities(texts[at:to])
        best.append(p.argmax(axis=1)), score.append(p.max(axis=1)), letters.append(ok)
        at = to
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(best, np.int64), join(score, float), join(letters, bool)


def accepted_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language the model accepts, columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = only(docs, ["doc_id", "text", "lang", "source", "n_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in grouped(batches, "text", BLOCK_BYTES // 4):
            for b in held:
                _, score, letters = score_texts(shared.value, [t or "" for t in b.column(1).to_pylist()])
                yield b.filter(pa.array(letters & (score >= shared.value.threshold)))

    return rows.mapInArrow(trimmed(run), rows.schema)
