"""Language-model scores of whole documents: a gated recurrent network over word symbols with a class-factored softmax.

Counts of all training words give smoothed unigram probabilities.  Every word has one of 256 symbols: the document end
and the most frequent words have one each, other words share one by their ending.  A gated recurrent unit, trained in
numpy by truncated backpropagation, predicts the next symbol in two softmax steps (a class of 16 symbols, then the
symbol), and within a symbol words keep their unigram shares, an unseen word that of one unseen word.  A document's
log-likelihood is the sum over its words and its end, with the state carried across windows, so that it is that of
the complete document.

Counting and the network cover the whole training fold.  The network starts from a fit on a bounded sample of whole
documents.  Then every training document gives all its windows (one in SHARE), so that what is learned from is the whole
fold: they are dealt to shards of about SHARD symbols, a task trains a copy on its
shard, and after each of ROUNDS rounds the copies are averaged by the symbols they saw.  A window's state comes from the
window before it.  Words are looked up in a bounded table of the most frequent ones; all others are joined with the
counts, so no vocabulary is ever broadcast.
"""

from __future__ import annotations

import ctypes
import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, fold, fold_of, grouped, least_hashed, only, release, shuffle_partitions, trimmed

SYMBOLS, OWN, CLASS = 256, 160, 16
END = 0
#: Words in the table that every task holds: a bound whatever the corpus.
FREQUENT = 1 << 17
#: Training documents of which the first weights are learned (a start: windows of all training documents follow).
SAMPLE = 3000
#: One in so many windows of every training document is learned from: all of them.
SHARE = 1
#: Symbols that a copy of the network is trained on between averages, and the rounds that all windows are dealt to.
SHARD, ROUNDS, SUMS = 1 << 20, 4, 16
HIDDEN, EMBEDDING = 24, 16
WINDOW, EPOCHS, BATCH, RATE = 32, 4, 128, 0.01
PRIOR = 0.1
#: Bytes of text scored together, words counted before they are sent on, the most steps and about the most states whose losses are
#: computed together.
BLOCK_BYTES, COUNTED, STEPS, STATES = 12 << 20, 1 << 20, 32, 1 << 14
FOLDS = 10


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def ending_symbol(word: bytes) -> int:
    return OWN + 1 + zlib.crc32(word[-2:]) % (SYMBOLS - OWN - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.maximum(x, -30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _log_softmax_at(z: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Log-probability of row ``to`` of each column (z is overwritten)."""
    z -= z.max(axis=0)
    own = z[to, np.arange(z.shape[1])]
    np.exp(z, out=z)
    return own - np.log(np.ones(len(z), np.float32) @ z)


def _softmax_gradient(z: np.ndarray, to: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of column ``to`` of each row, and the scaled gradient of the loss by z (z is overwritten)."""
    rows = np.arange(len(z))
    np.clip(z, -80, 80, out=z)
    own = z[rows, to]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], np.float32)
    z *= (scale / total)[:, None]
    z[rows, to] -= scale
    return own - np.log(total), z


class Adam:
    def __init__(self, weights: list[np.ndarray]):
        self.weights, self.step = weights, 0
        self.first, self.second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def take(self, grads: list[np.ndarray], rate: float) -> None:
        self.step += 1
        for w, g, m, v in zip(self.weights, grads, self.first, self.second):
            np.clip(g, -1, 1, out=g)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-6)


class Network:
    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)
        self.embed, self.wx, self.b = draw(SYMBOLS, EMBEDDING), draw(EMBEDDING, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32)
        self.wh = draw(HIDDEN, 3 * HIDDEN)
        self.wc, self.bc = draw(HIDDEN, SYMBOLS // CLASS) * 0.1, np.zeros(SYMBOLS // CLASS, np.float32)
        self.wm, self.bm = draw(SYMBOLS // CLASS, HIDDEN, CLASS) * 0.1, np.zeros((SYMBOLS // CLASS, CLASS), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.wx, self.b, self.wh, self.wc, self.bc, self.wm, self.bm]

    def log_probabilities(self, h: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each symbol after each state."""
        return self._log_probabilities(np.ascontiguousarray(h.T), symbols)

    def _log_probabilities(self, h: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The same of states (units, states)."""
        klass, member = np.divmod(symbols.astype(np.uint8), np.uint8(CLASS))
        z = np.ascontiguousarray(self.wc.T) @ h
        z += self.bc[:, None]
        out = _log_softmax_at(z, klass)
        order = np.argsort(klass, kind="stable")
        cuts = np.searchsorted(klass[order], np.arange(SYMBOLS // CLASS + 1))
        mine = np.take(h, order, axis=1)
        for k in range(SYMBOLS // CLASS):
            lo, hi = cuts[k], cuts[k + 1]
            z[:, lo:hi] = self.wm[k].T @ mine[:, lo:hi]
            z[:, lo:hi] += self.bm[k][:, None]
        out[order] += _log_softmax_at(z, member[order])
        return out

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of each sequence of symbols; sequences of any length, longest first inside."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order])
        total = np.zeros(len(texts))
        if not len(texts):
            return total
        flat, begin = np.concatenate([texts[i] for i in order]).astype(np.uint8), np.cumsum(sizes) - sizes
        # inside, the units come first and the sequences second, so that the gates are whole blocks of memory
        table, wh = self.embed @ self.wx + self.b, np.ascontiguousarray(self.wh.T)
        h, at, longest = np.zeros((HIDDEN, len(texts)), np.float32), 0, int(sizes[0])
        while at < longest:
            states, seen, owners = [], [], []
            while at < longest and len(owners) < STEPS and (not owners or sum(owners) < STATES):
                live = int(np.searchsorted(-sizes, -at, side="left"))  # sequences longer than this come first
                s = flat[begin[:live] + at]
                if live < h.shape[1]:
                    h = np.ascontiguousarray(h[:, :live])
                states.append(h)
                seen.append(s)
                owners.append(live)
                h = self._advance(h, np.ascontiguousarray(table[s].T), wh)
                at += 1
            p = self._log_probabilities(np.concatenate(states, axis=1), np.concatenate(seen))
            lo = 0
            for live in owners:
                total[:live] += p[lo : lo + live]
                lo += live
        out = np.empty(len(texts))
        out[order] = total / np.log(10)
        return out

    def _advance(self, h: np.ndarray, x: np.ndarray, wh: np.ndarray) -> np.ndarray:
        """The states (units, lanes) after a step; x: the input's part of the gates, wh: the transposed weights of the states."""
        u = wh @ h
        gates = _sigmoid(x[: 2 * HIDDEN] + u[: 2 * HIDDEN])
        n = gates[HIDDEN:] * u[2 * HIDDEN :]
        n += x[2 * HIDDEN :]
        np.tanh(n, out=n)
        h = h - n
        h *= gates[:HIDDEN]
        h += n
        return h

    def _window(self, symbols: np.ndarray, mask: np.ndarray, h: np.ndarray, begins: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, float]:
        """Gradients of one window (T, B) from the state h, the state after it, and the summed loss.  Where ``begins`` is
        set a text begins and the state is cleared."""
        steps, batch = symbols.shape
        flat_s, flat_m = symbols.ravel(), mask.ravel()
        two = 2 * HIDDEN
        # inside, the units come first and the lanes second, so that the gates are whole blocks of memory
        xw = np.ascontiguousarray((self.embed @ self.wx + self.b)[flat_s].reshape(steps, batch, 3 * HIDDEN).transpose(0, 2, 1))
        keep = None if begins is None else (~begins).astype(np.float32)
        whole = np.ones(steps, bool) if begins is None else ~begins.any(axis=1)
        states, un, ns = (np.empty((steps, HIDDEN, batch), np.float32) for _ in range(3))
        gates, wh, h = np.empty((steps, two, batch), np.float32), np.ascontiguousarray(self.wh.T), h.T
        for t in range(steps):
            states[t] = h if whole[t] else h * keep[t]
            h, g, n = states[t], gates[t], ns[t]
            u = wh @ h
            np.add(xw[t, :two], u[:two], out=g)
            _sigmoid(g)
            un[t] = u[two:]
            np.multiply(g[HIDDEN:], un[t], out=n)
            n += xw[t, two:]
            np.tanh(n, out=n)
            h = n + g[:HIDDEN] * (h - n)
        zs, rs = gates[:, :HIDDEN], gates[:, HIDDEN:]
        flat_h = np.ascontiguousarray(states.transpose(0, 2, 1)).reshape(-1, HIDDEN)
        klass, member = flat_s // CLASS, flat_s % CLASS
        scale = (flat_m / max(1.0, flat_m.sum())).astype(np.float32)
        logc, dc = _softmax_gradient(flat_h @ self.wc + self.bc, klass, scale)
        dh_out = dc @ self.wc.T
        # the members' softmax, in the order of the classes; what is masked comes last and has no part
        sorted_by = np.where(flat_m > 0, klass, SYMBOLS // CLASS).astype(np.uint8)
        order = np.argsort(sorted_by, kind="stable")
        cuts = np.searchsorted(sorted_by[order], np.arange(SYMBOLS // CLASS + 1))
        order = order[: cuts[-1]]
        mine, z = flat_h[order], np.empty((len(order), CLASS), np.float32)
        spans = list(zip(cuts.tolist(), cuts[1:].tolist()))
        for k, (lo, hi) in enumerate(spans):
            np.matmul(mine[lo:hi], self.wm[k], out=z[lo:hi])
            z[lo:hi] += self.bm[k]
        logm, dm = _softmax_gradient(z, member[order], scale[order])
        loss = -float((logc * flat_m).sum()) - float(logm.sum())
        wm, bm, dmine = np.zeros_like(self.wm), np.zeros_like(self.bm), np.empty_like(mine)
        for k, (lo, hi) in enumerate(spans):
            wm[k], bm[k] = mine[lo:hi].T @ dm[lo:hi], dm[lo:hi].sum(axis=0)
            np.matmul(dm[lo:hi], self.wm[k].T, out=dmine[lo:hi])
        dh_out[order] += dmine
        dh_out = np.ascontiguousarray(dh_out.reshape(steps, batch, HIDDEN).transpose(0, 2, 1))
        dx = np.empty((steps, 4 * HIDDEN, batch), np.float32)  # by z, r, n with r, and n, so that the first three are those of the states
        by_n, by_z, by_r = (1 - zs) * (1 - ns * ns), (states - ns) * zs * (1 - zs), un * rs * (1 - rs)
        dh = np.zeros((HIDDEN, batch), np.float32)  # nothing comes back from later windows: truncated
        for t in range(steps - 1, -1, -1):
            d = dx[t]
            dn = d[3 * HIDDEN :]
            np.multiply(dh, by_n[t], out=dn)
            np.multiply(dh, by_z[t], out=d[:HIDDEN])
            np.multiply(dn, by_r[t], out=d[HIDDEN:two])
            np.multiply(dn, rs[t], out=d[two : 3 * HIDDEN])
            dh = dh * zs[t]
            dh += self.wh @ d[: 3 * HIDDEN]
            dh += dh_out[t]
            if not whole[t]:
                dh *= keep[t]
        # what the rows of the table embed @ wx + b get, summed by symbol
        order = np.argsort(flat_s.astype(np.uint8), kind="stable")
        there, first = np.unique(flat_s[order], return_index=True)
        flat_d = np.ascontiguousarray(dx.transpose(0, 2, 1)).reshape(-1, 4 * HIDDEN)
        table, summed = np.zeros((SYMBOLS, 3 * HIDDEN), np.float32), np.add.reduceat(flat_d[order], first, axis=0)
        table[there, :two], table[there, two:] = summed[:, :two], summed[:, 3 * HIDDEN :]
        dwh = flat_h.T @ flat_d[:, : 3 * HIDDEN]
        return [table @ self.wx.T, self.embed.T @ table, table.sum(axis=0), dwh, flat_h.T @ dc, dc.sum(axis=0), wm, bm], h.T, loss

    def fit(self, texts: list[np.ndarray], seed: int = 10, epochs: int = EPOCHS) -> list[float]:
        """Train on whole sequences of symbols; returns the mean loss of each epoch.

        The sequences are dealt to BATCH lanes, one after the other; the state is carried over the windows of a lane and
        cleared where a sequence begins.
        """
        rng, losses, adam = np.random.default_rng(seed), [], Adam(self.weights())
        for _ in range(epochs if texts else 0):
            loss, count = 0.0, 0
            symbols, begins, sizes = _lanes([texts[i] for i in rng.permutation(len(texts))])
            h = np.zeros((len(sizes), HIDDEN), np.float32)
            for lo in range(0, int(sizes[0]), WINDOW):
                live = int(np.searchsorted(-sizes, -lo, side="left"))  # longer lanes come first
                mask = (np.arange(lo, min(lo + WINDOW, int(sizes[0])))[:, None] < sizes[:live]).astype(np.float32)
                part = slice(lo, lo + WINDOW)
                grads, h, own = self._window(symbols[:live, part].T.astype(np.int64), mask, h[:live], begins[:live, part].T)
                loss, count = loss + own, count + mask.sum()
                adam.take(grads, RATE * live / len(sizes))  # what few lanes say moves the weights less
            losses.append(loss / max(1, count))
        return losses

    def fit_windows(self, records: np.ndarray, seed: int = 10) -> float:
        """Train once on records of :func:`windows_of`; returns the mean loss."""
        order, adam, loss, count = np.random.default_rng(seed).permutation(len(records)), Adam(self.weights()), 0.0, 0.0
        for lo in range(0, len(order), BATCH):
            rows = records[order[lo : lo + BATCH]]
            h, symbols = np.zeros((HIDDEN, len(rows)), np.float32), rows[:, 2:].astype(np.int64)
            before = np.ascontiguousarray((self.embed @ self.wx + self.b)[symbols[:, :WINDOW].T].transpose(0, 2, 1))
            wh = np.ascontiguousarray(self.wh.T)
            for t in range(WINDOW):
                h = self._advance(h, before[t], wh)
            h[:, rows[:, 0] == 0] = 0  # a text begins here
            mask = (np.arange(WINDOW)[:, None] < rows[:, 1]).astype(np.float32)
            grads, _, own = self._window(np.ascontiguousarray(symbols[:, WINDOW:].T), mask, h.T)
            adam.take(grads, RATE * len(rows) / min(BATCH, len(order)))
            loss, count = loss + own, count + float(mask.sum())
        return loss / max(1.0, count)

    def packed(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights()])

    def unpack(self, flat: np.ndarray) -> Network:
        at = 0
        for w in self.weights():
            w[...] = flat[at : at + w.size].reshape(w.shape)
            at += w.size
        return self


def _lanes(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lanes, longest) symbols and where a text begins, and the lanes' sizes, longest first: each text goes whole to the
    lane that is shortest by then."""
    heap = [(0, j) for j in range(min(BATCH, len(texts)))]
    dealt: list[list[np.ndarray]] = [[] for _ in heap]
    for s in texts:
        n, j = heap[0]
        dealt[j].append(s)
        heapq.heapreplace(heap, (n + len(s), j))
    dealt.sort(key=lambda lane: -sum(map(len, lane)))
    sizes = np.array([sum(map(len, lane)) for lane in dealt])
    symbols, begins = np.zeros((len(dealt), sizes[0]), np.uint8), np.zeros((len(dealt), sizes[0]), bool)
    for j, lane in enumerate(dealt):
        symbols[j, : sizes[j]] = np.concatenate(lane)
        begins[j, np.cumsum([0, *map(len, lane[:-1])])] = True
    return symbols, begins, sizes


class Model:
    """``frequent``: word -> place; ``symbol`` and ``base`` (log10) by place; ``mass`` (log10) of each symbol."""

    def __init__(self, frequent: list[bytes], counts: np.ndarray, tokens: int, types: int, ends: int, masses: dict[int, float], network: Network | None = None):
        self.places = {w: i for i, w in enumerate(frequent)}
        self.tokens, self.types, self.ends = tokens, types, ends
        self.weight = tokens + PRIOR * (types + 1)
        self.base = np.log10((counts + PRIOR) / self.weight)
        self.symbol = np.array([i + 1 if i < OWN else ending_symbol(w) for i, w in enumerate(frequent)], np.int64)
        self.end_base = float(np.log10((ends + PRIOR) / self.weight))
        self.mass = np.full(SYMBOLS, np.log10(PRIOR / self.weight))
        for s, m in masses.items():
            self.mass[s] = np.log10(m + PRIOR / self.weight)
        own = min(OWN, len(frequent))
        self.mass[1 : own + 1] = self.base[:own]
        self.mass[END] = self.end_base
        self.network = network or Network()

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, the end last; places, -1 for words that are not frequent)."""
        get = self.places.get
        places = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        out = np.empty(len(words) + 1, np.int64)
        if len(words):
            out[:-1] = self.symbol[places] if len(self.symbol) else -1
            for i in np.flatnonzero(places < 0).tolist():
                out[i] = ending_symbol(words[i])
        out[-1] = END
        return out, places


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all words of the training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for held in grouped(batches, "text", BLOCK_BYTES // 4):
            for b in held:
                for text in b.column(0).to_pylist():
                    seen.update(words_of(text))
            if len(seen) > COUNTED // 4:
                yield out()
                seen.clear()
        if seen:
            yield out()

    rows = docs.select(F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(trimmed(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, its network untrained, and the table (word, c) of the training words that its table of frequent words leaves out."""
    rows = only(docs, ["doc_id", "text"]).filter(fold(F.col("doc_id"), FOLDS) != 0)
    counts = durable(count_words(rows), "words")
    ends = rows.count()
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    # how many words have each count tells which count the most frequent ones reach; no sort of all words is needed
    reached, floor = 0, None
    for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("c").desc()).limit(FREQUENT).collect():
        if (reached := reached + r["n"]) > FREQUENT:
            break
        floor = r["c"]
    top = counts.filter(F.col("c") >= F.lit(floor)).toArrow() if floor is not None else counts.limit(0).toArrow()
    frequent, frequencies = top.column("word").to_pylist(), top.column("c").to_numpy()
    order = sorted(range(len(frequent)), key=lambda i: (-int(frequencies[i]), frequent[i]))
    frequent, frequencies = [frequent[i] for i in order], frequencies[order]
    tokens, types = int(totals["n"] or 0) + ends, int(totals["v"]) + (ends > 0)
    ending = F.lit(OWN + 1) + F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(SYMBOLS - OWN - 1))
    rest = counts.filter(~F.col("word").isin(frequent[:OWN])) if frequent[:OWN] else counts
    masses = rest.groupBy(ending.cast("int").alias("symbol")).agg(F.sum(F.col("c") + F.lit(PRIOR)).alias("m")).collect()
    model = Model(frequent, frequencies, tokens, types, ends, {r["symbol"]: r["m"] / (tokens + PRIOR * (types + 1)) for r in masses})
    return model, counts.filter(F.col("c") < F.lit(floor)) if floor is not None else counts


def train(network: Network, rows: DataFrame) -> None:
    """Fit the network on rows (doc_id, n_tokens, symbols) of the training fold, in place."""
    # one document of each id, so that no more than SAMPLE come and which ones does not depend on partitions
    chosen = least_hashed(rows, "lm", "doc_id", SAMPLE).groupBy("doc_id").agg(F.min("symbols").alias("symbols"))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, bytes(r["symbols"])) for r in chosen.collect())
    if not got:
        return
    network.fit([np.frombuffer(s, np.uint8) for _, s in got])
    del got
    release()
    total, share = rows.agg(F.sum("n_tokens").alias("n")).first()["n"], SHARE
    shards = ROUNDS * max(1, round(total / share / ROUNDS / SHARD))
    schema = "shard int, records binary"
    dealt = durable(rows.select("doc_id", "symbols").mapInArrow(trimmed(_deal(share, shards)), schema), "lm-windows")
    n = shuffle_partitions(rows.sparkSession)
    for k in range(ROUNDS):
        now = rows.sparkSession.sparkContext.broadcast(network)
        fitted = dealt.filter(F.col("shard") % ROUNDS == k).repartition(max(n, shards // ROUNDS), "shard").sortWithinPartitions("shard").mapInArrow(trimmed(_fit_shards(now)), "part int, n double, w array<double>")
        sums = fitted.repartition(min(n, SUMS), "part").mapInArrow(_add, "part int, n double, w array<double>").collect()
        if sums:
            sums.sort(key=lambda r: r["part"])
            network.unpack(sum(np.array(r["w"]) for r in sums) / sum(r["n"] for r in sums))
        now.unpersist()
    discard(dealt)


def windows_of(symbols: np.ndarray, share: int) -> np.ndarray:
    """Records of one in ``share`` windows of a document, the first by a hash of the document: whether a window comes
    before (its symbols stand first), the symbols of the window, then both windows' symbols, padded."""
    chosen = np.arange(zlib.crc32(symbols.tobytes()) % share, -(-len(symbols) // WINDOW), share) * WINDOW
    out = np.zeros((len(chosen), 2 + 2 * WINDOW), np.uint8)
    if len(chosen):
        padded = np.zeros(len(symbols) + 2 * WINDOW, np.uint8)
        padded[WINDOW : WINDOW + len(symbols)] = symbols
        out[:, 0], out[:, 1] = chosen > 0, np.minimum(WINDOW, len(symbols) - chosen)
        out[:, 2:] = padded[chosen[:, None] + np.arange(2 * WINDOW)]
    return out


def shards_of(doc_id: int | None, symbols: bytes, n: int, shards: int) -> np.ndarray:
    """The shard of each of n windows of a document, by its id (without one, by its symbols) and the window's number: copies
    of a passage in many documents go to as many shards."""
    key = zlib.crc32(symbols if doc_id is None else str(doc_id).encode())
    x = (np.arange(n, dtype=np.uint64) + np.uint64(key << 32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _deal(share: int, shards: int):
    """Rows (doc_id, symbols) -> rows (shard, records): the chosen windows of all documents, each dealt by :func:`shards_of`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in grouped(batches, "symbols", BLOCK_BYTES):
            rows = [(i, s) for b in held for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            chosen = [windows_of(np.frombuffer(s, np.uint8), share) for _, s in rows]
            to = np.concatenate([shards_of(i, s, len(w), shards) for (i, s), w in zip(rows, chosen)])
            records = np.concatenate(chosen)
            del chosen, rows
            order = np.argsort(to, kind="stable")
            there, first = np.unique(to[order], return_index=True)
            parts = [p.tobytes() for p in np.split(records[order], first[1:])] if len(there) else []
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(parts, pa.binary())], names=["shard", "records"])

    return run


def _rows_of(part: list[int], n: list[float], w: list[np.ndarray]) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, w)]).astype(np.int32)), pa.array(np.concatenate(w)))
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(n, pa.float64()), lists], names=["part", "n", "w"])


def _fit_shards(shared):
    """Rows (shard, records) in order of shards -> one row a shard: the symbols seen and the weights of its copy times their
    number.  One shard is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _hold_memory()
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for shard, held in groupby(rows, itemgetter(0)):
            records = np.frombuffer(b"".join(r for _, r in held), np.uint8).reshape(-1, 2 + 2 * WINDOW)
            # in an order that does not depend on how the rows came
            records = records[np.lexsort((np.fromiter(map(zlib.adler32, records), np.int64, len(records)), np.fromiter(map(zlib.crc32, records), np.int64, len(records))))]
            network = Network().unpack(shared.value.packed())
            network.fit_windows(records, seed=shard)
            n = float(records[:, 1].sum(dtype=np.int64))
            yield _rows_of([shard // ROUNDS % SUMS], [n], [n * network.packed().astype(np.float64)])

    return run


def _hold_memory() -> None:
    """Arrays of a window are freed and asked for again at once: let the allocator keep up to 64 MB instead of handing them
    back to the system each time."""
    try:
        ctypes.CDLL(None).mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
        ctypes.CDLL(None).mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):
        pass


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the rows of each part, added in one order."""
    held: dict[int, list[tuple[float, list[float]]]] = {}
    for b in batches:
        for part, n, w in zip(*(b.column(i).to_pylist() for i in range(3))):
            held.setdefault(part, []).append((n, w))
    for part in sorted(held):
        rows = sorted(held[part])
        total = np.zeros(len(rows[0][1]))
        for _, w in rows:
            total += w
        yield _rows_of([part], [sum(n for n, _ in rows)], [total])


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Null and blank texts are their end alone.  Rows whose fold is 0 are held out of all learning.  Without training rows
    every token is unseen and the base score is 0; an empty table gives an empty result.  Repeated rows and equal ids are
    documents of their own, counted and scored as often as they come.  A text of any length is scored whole, window by
    window.  Other columns play no part, whatever their names.
    """
    model, infrequent = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FREQUENT words: bounded by parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        uid = TaskContext.get().partitionId() << 40
        for held in grouped(batches, "text", BLOCK_BYTES):
            ids, base, mass, known, sizes, symbols, rare, rare_n = [], [], [], [], [], [], [], []
            for b in held:
                ids += b.column(0).to_pylist()
                for text in b.column(1):
                    words = words_of(text.as_py())
                    s, places = model.symbols(words)
                    there = places[places >= 0]
                    base.append(model.base[there].sum() + model.end_base)
                    mass.append(model.mass[s].sum())
                    known.append(len(there) + (model.ends > 0))
                    sizes.append(len(s))
                    symbols.append(s.astype(np.uint8).tobytes())
                    missing = np.flatnonzero(places < 0).tolist()
                    rare += [words[i] for i in missing]
                    rare_n.append(len(missing))
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(uid, uid + n)), pa.array(ids, pa.int64()), pa.array([fold_of(i, FOLDS) == 0 for i in ids]), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(mass, pa.float64()), pa.array(symbols, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(rare_n)].astype(np.int32)), pa.array(rare, pa.binary()))],
                names=["uid", "doc_id", "held_out", "n_tokens", "known", "base", "mass", "symbols", "rare"],
            )
            uid += n

    rows = only(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    passed = durable(rows.mapInArrow(trimmed(run), "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, mass double, symbols binary, rare array<binary>"), "lm-passed")
    train(model.network, passed.filter(~F.col("held_out")).select("doc_id", "n_tokens", "symbols"))
    trained = docs.sparkSession.sparkContext.broadcast(model.network)

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _hold_memory()
        for held in grouped(batches, "symbols", BLOCK_BYTES // 3):
            b = pa.Table.from_batches(held).combine_chunks()
            score = trained.value.score([np.frombuffer(s, np.uint8) for s in b.column("symbols").to_pylist()])
            yield from b.drop(["symbols", "mass"]).append_column("gain", pa.array(score - b.column("mass").to_numpy())).to_batches()

    own = passed.drop("rare").select("uid", "doc_id", "held_out", "n_tokens", "known", "base", "mass", "symbols")
    scored = own.mapInArrow(trimmed(gains), "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, gain double")
    looked = passed.select("uid", F.explode("rare").alias("word")).join(infrequent, "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    looked = looked.groupBy("uid").agg(F.sum(F.log10((c + PRIOR) / F.lit(float(model.weight)))).alias("_b"), F.sum(F.when(c > 0, 1).otherwise(0)).alias("_k"))
    out = scored.join(looked, "uid", "left")
    total = F.col("base") + F.coalesce("_b", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("_k", F.lit(0))).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), total.alias("base_score"), (total + F.col("gain")).alias("score"))

