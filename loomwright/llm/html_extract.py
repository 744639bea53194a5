"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks (text between block-level tags).  Each block has the hashed names, classes
and ids on its tag path, its hashed words, and a few measures (length, links, stops, place).  A bidirectional LSTM in
numpy reads the whole sequence and labels every block; blocks labelled as article text are joined by line breaks.

The labeller is trained on pages that are generated here from a grammar of layouts with known labels; it sees no page of
the corpus.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, only, release, trimmed

PATH_BUCKETS, WORD_BUCKETS = 1 << 10, 1 << 10
PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 16, 6, 8, 16
PAGES, EPOCHS, BATCH, RATE = 700, 6, 16, 0.01
KEEP = 0.5
BLOCK_BYTES = 8 << 20

# How elements behave.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe label legend li main menu nav object ol optgroup option p pre section select
    summary table tbody td textarea tfoot th thead tr ul""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key ends an open element of the values that nothing else separates from it.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}

#: Elements whose content is not text of the page, up to their own end tag.
HIDDEN_TAGS = frozenset("noscript template title svg math iframe object".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ENDS = {tag: re.compile(rf"<(/?){tag}\b[^>]*(?:>|\Z)", re.I) for tag in HIDDEN_TAGS}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


class Block:
    __slots__ = ("path", "text", "link_share")

    def __init__(self, path: tuple[str, ...], text: str, link_share: float):
        self.path, self.text, self.link_share = path, text, link_share


@lru_cache(1 << 14)
def _names(attributes: str) -> tuple[str, ...]:
    return tuple("." + part.lower() for m in _NAMES.finditer(attributes) for part in _NAME_PART.findall(m[1] or m[2] or m[3] or ""))


def _end_of(tag: str, page: str, at: int, last: dict[str, int]) -> int | None:
    """Where the hidden element that was opened before ``at`` ends, elements of its name inside it included; None if it
    is never closed.  ``last`` remembers where a name's last end tag stands, so that unclosed ones cost one search."""
    if tag not in last:
        last[tag] = max((m.start() for m in re.finditer(rf"</{tag}\b", page, re.I)), default=-1)
    depth = 1
    if last[tag] >= at:
        for m in _ENDS[tag].finditer(page, at):
            depth += -1 if m[1] else 0 if m[0].endswith("/>") else 1
            if not depth:
                return m.end()
        return page.find(">", last[tag]) + 1 or len(page)  # one of several inside is not closed
    return None


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order.  Comments, scripts and styles that are never closed end with the page, other
    hidden elements at the next block; those that close themselves hide nothing."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, total, in_link, link_depth, at, skip, hidden = 0, 0, False, 0, 0, 0, False
    last: dict[str, int] = {}

    def add(raw: str) -> None:
        nonlocal linked, total
        parts.append(raw)
        total += len(raw)
        linked += len(raw) if in_link else 0

    def flush() -> None:
        nonlocal linked, total
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                path = tuple(name for tag, names in stack for name in (tag, *names))
                out.append(Block(path or ("html",), text, linked / max(1, total)))
            parts.clear()
        linked = total = 0

    for m in _TOKEN.finditer(page):
        if m.start() < skip:
            at = max(skip, m.end()) if m.end() > skip else skip
            continue
        if m.start() > at and not hidden:
            add(page[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag in HIDDEN_TAGS:
            if tag == "object":
                flush()
            if closing:
                hidden = False
            elif not attributes.endswith("/"):
                end = _end_of(tag, page, at, last)
                if end is None:
                    hidden = True  # until the next block
                else:
                    at = skip = end
        elif tag in BLOCK_TAGS:
            hidden = False
            flush()
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            else:
                ends = ENDS.get(tag, {"p"})
                if stack and stack[-1][0] in ends:
                    stack.pop()
            if len(stack) < link_depth:  # the block in which the link began is over
                in_link = False
            if not closing:
                if tag not in VOID_TAGS and not attributes.endswith("/"):
                    stack.append((tag, _names(attributes) if attributes else ()))
        elif tag == "a":
            in_link, link_depth = not closing, len(stack)  # blocks inside a link are linked
            add(" ") if closing else None
        elif tag == "br":
            add("\n")
    at = max(at, skip)
    if at < len(page) and not hidden:
        add(page[at:])
    flush()
    return out


@lru_cache(1 << 16)
def _path_bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % PATH_BUCKETS


@lru_cache(1 << 17)
def _word_bucket(word: bytes) -> int:
    return zlib.crc32(word) % WORD_BUCKETS


_MARKS = b".,;:!?\"'()[]{}|"


class Coded:
    """Pages as flat arrays: buckets of paths and words with offsets per block, measures, blocks per page."""

    def __init__(self, pages: list[list[Block]]):
        path, word, measures = [], [], []
        path_n, word_n = [], []
        for page in pages:
            n = len(page)
            for i, b in enumerate(page):
                names = [_path_bucket(x) for x in b.path]
                names.append(_path_bucket("leaf " + next((x for x in reversed(b.path) if x[0] != "."), "html")))
                path += names
                path_n.append(len(names))
                words = list(map(_word_bucket, b.text.lower().encode("utf-8", "replace").translate(None, _MARKS).split())) or [0]
                word += words
                word_n.append(len(words))
                size = len(b.text)
                stops = b.text.count(".") + b.text.count("!") + b.text.count("?")
                measures.append((
                    np.log1p(len(words)) / 4, np.log1p(size) / 6, b.link_share, stops / len(words), b.text.count(",") / len(words),
                    i / n, 1.0 if b.text[-1] in ".!?…:;\"'»”" else 0.0, 1.0 if "©" in b.text or "|" in b.text else 0.0,
                ))
        self.path, self.word = np.array(path, np.int64), np.array(word, np.int64)
        self.path_n, self.word_n = np.array(path_n, np.int64), np.array(word_n, np.int64)
        self.measures = np.array(measures, np.float32).reshape(-1, MEASURES)
        self.sizes = np.array([len(p) for p in pages], np.int64)


def _mean(table: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.add.reduceat(table[ids], np.cumsum(n) - n, axis=0) / n[:, None] if len(n) else np.zeros((0, table.shape[1]), np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction, batch of sequences (T, B, D) with a mask (T, B)."""

    def __init__(self, rng: np.random.Generator, d: int, h: int):
        self.w = (rng.normal(size=(d + h, 4 * h)) / np.sqrt(d + h)).astype(np.float32)
        self.b = np.zeros(4 * h, np.float32)
        self.b[h : 2 * h] = 1
        self.h = h

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        steps, batch, _ = x.shape
        h, c, n = np.zeros((batch, self.h), np.float32), np.zeros((batch, self.h), np.float32), self.h
        out, tape = np.zeros((steps, batch, n), np.float32), []
        wx = x @ self.w[: x.shape[2]] + self.b
        wh = self.w[x.shape[2] :]
        for t in range(steps):
            z = wx[t] + h @ wh
            s = _sigmoid(z[:, : 3 * n])
            i, f, o, g = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(z[:, 3 * n :])
            m = mask[t][:, None]
            c2 = (f * c + i * g) * m + c * (1 - m)
            tc = np.tanh(c2)
            h2 = (o * tc) * m + h * (1 - m)
            if keep:
                tape.append((h, c, i, f, o, g, tc))
            h, c = h2, c2
            out[t] = h
        return out, tape

    def backward(self, x: np.ndarray, mask: np.ndarray, tape: list, dout: np.ndarray):
        steps, batch, d = x.shape
        n = self.h
        dw, db, dx = np.zeros_like(self.w), np.zeros_like(self.b), np.zeros_like(x)
        dh, dc = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, tc = tape[t]
            m = mask[t][:, None]
            dh = dh + dout[t]
            live = dh * m
            dc_all = dc * m + live * o * (1 - tc**2)
            dz = np.concatenate([dc_all * g * i * (1 - i), dc_all * c * f * (1 - f), live * tc * o * (1 - o), dc_all * i * (1 - g**2)], axis=1)
            dw[:d] += x[t].T @ dz
            dw[d:] += h.T @ dz
            db += dz.sum(axis=0)
            dx[t] = dz @ self.w[:d].T
            dh = dz @ self.w[d:].T + dh * (1 - m)
            dc = dc_all * f + dc * (1 - m)
        return dw, db, dx


class Labeller:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + MEASURES
        self.path = rng.normal(0, 0.3, (PATH_BUCKETS, PATH_DIM)).astype(np.float32)
        self.word = rng.normal(0, 0.05, (WORD_BUCKETS, WORD_DIM)).astype(np.float32)
        self.ahead, self.back = Lstm(rng, d, HIDDEN), Lstm(rng, d, HIDDEN)
        self.out, self.bias = rng.normal(0, 0.3, (2 * HIDDEN + d, 1)).astype(np.float32), np.zeros(1, np.float32)

    def _inputs(self, coded: Coded) -> np.ndarray:
        return np.concatenate([_mean(self.path, coded.path, coded.path_n), _mean(self.word, coded.word, coded.word_n), coded.measures], axis=1).astype(np.float32)

    @staticmethod
    def _places(sizes: np.ndarray):
        """Row numbers of blocks by (step, page), forwards and backwards, and the mask."""
        steps = int(sizes.max())
        begin = np.cumsum(sizes) - sizes
        t = np.arange(steps)[:, None]
        mask = (t < sizes).astype(np.float32)
        there = np.minimum(t, sizes - 1)
        return begin + there, begin + sizes - 1 - there, mask

    def probabilities(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Of each block, that it is article text.  Pages of like length are read together."""
        full = [i for i, p in enumerate(pages) if p]
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        full.sort(key=lambda i: len(pages[i]))
        at = 0
        while at < len(full):
            to = at
            while to < len(full) and to - at < 512 and (to == at or (to - at + 1) * len(pages[full[to]]) <= 1 << 15):
                to += 1
            group = full[at:to]
            coded = Coded([pages[i] for i in group])
            p = _sigmoid(self._logits(coded)[0])
            for i, own in zip(group, np.split(p, np.cumsum(coded.sizes)[:-1])):
                out[i] = own
            at = to
        return out

    def _logits(self, coded: Coded, keep: bool = False):
        x = self._inputs(coded)
        ahead, back, mask = self._places(coded.sizes)
        fwd, tape_f = self.ahead.forward(x[ahead], mask, keep)
        bwd, tape_b = self.back.forward(x[back], mask, keep)
        live = mask.astype(bool)
        h = np.zeros((len(x), 2 * HIDDEN), np.float32)
        h[ahead[live], :HIDDEN], h[back[live], HIDDEN:] = fwd[live], bwd[live]
        joined = np.concatenate([h, x], axis=1)
        return (joined @ self.out)[:, 0] + self.bias[0], (x, ahead, back, mask, live, tape_f, tape_b, joined)

    def _step(self, coded: Coded, labels: np.ndarray) -> list[np.ndarray]:
        z, (x, ahead, back, mask, live, tape_f, tape_b, joined) = self._logits(coded, True)
        dz = ((_sigmoid(z) - labels) / len(coded.sizes)).astype(np.float32)[:, None]
        dout, dbias = joined.T @ dz, dz.sum(axis=0)
        dj = dz @ self.out.T
        d_f, d_b = np.zeros((*mask.shape, HIDDEN), np.float32), np.zeros((*mask.shape, HIDDEN), np.float32)
        d_f[live], d_b[live] = dj[ahead[live], :HIDDEN], dj[back[live], HIDDEN : 2 * HIDDEN]
        dx = dj[:, 2 * HIDDEN :].copy()
        dwf, dbf, dxf = self.ahead.backward(x[ahead], mask, tape_f, d_f)
        dwb, dbb, dxb = self.back.backward(x[back], mask, tape_b, d_b)
        np.add.at(dx, ahead[live], dxf[live])
        np.add.at(dx, back[live], dxb[live])
        dpath, dword = np.zeros_like(self.path), np.zeros_like(self.word)
        np.add.at(dpath, coded.path, np.repeat(dx[:, :PATH_DIM] / coded.path_n[:, None], coded.path_n, axis=0))
        np.add.at(dword, coded.word, np.repeat(dx[:, PATH_DIM : PATH_DIM + WORD_DIM] / coded.word_n[:, None], coded.word_n, axis=0))
        return [dpath, dword, dwf, dbf, dwb, dbb, dout, dbias]

    def fit(self, pages: list[list[Block]], labels: list[np.ndarray], seed: int = 6) -> Labeller:
        rng = np.random.default_rng(seed)
        weights = [self.path, self.word, self.ahead.w, self.ahead.b, self.back.w, self.back.b, self.out, self.bias]
        first, second, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                grads = self._step(Coded([pages[i] for i in rows]), np.concatenate([labels[i] for i in rows]))
                t += 1
                for w, g, m, v in zip(weights, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        return self


# What the generated pages are made of.
_BAD_NAMES = {
    "menu": "nav navbar menu main-menu topnav breadcrumb breadcrumbs sidebar-nav toc pagination pager tabs skip-link",
    "header": "header site-header masthead topbar branding logo banner page-header",
    "footer": "footer site-footer bottom colophon copyright legal credits footnav",
    "side": "sidebar side aside widget related related-posts recommended popular trending rail archive tags tagcloud more-stories",
    "notice": "cookie cookie-notice consent gdpr notice alert alert-info modal popup overlay banner-message paywall subscribe-box warning",
    "advert": "ad ads advert advertisement sponsor sponsored promo promoted adsense banner-ad ad-slot outbrain",
    "form": "form search search-form newsletter signup subscribe login contact-form subscribe-form",
    "comments": "comments comment comment-list comment-body discussion replies responses reviews disqus respond reader-comments",
    "share": "share social social-links sharing follow share-buttons toolbar tools byline-tools",
}
_GOOD_NAMES = "content article article-body post post-body post-content entry entry-content story story-body main main-content text body-text page-content".split()
_BAD_WORDS = {
    "menu": "home about contact news sports world business next previous products services blog login menu skip to content",
    "header": "welcome official site search menu sign in subscribe your source for daily",
    "footer": "© copyright 2021 2023 all rights reserved privacy policy terms of use powered by contact imprint sitemap ·",
    "side": "related articles read more popular trending recent posts latest see also archive most read categories tags",
    "notice": "we use cookies accept this site uses agree consent privacy settings decline subscribe to continue notice",
    "advert": "advertisement sponsored buy now save off best price limited offer click here deal shop",
    "form": "name email password submit search enter your address sign up send message subscribe required",
    "comments": "reply said says posted by great post thanks i agree comment comments likes share report ago user",
    "share": "share tweet facebook email print like follow us pin whatsapp copy link",
}
_BAD_TAGS = {"menu": ("nav", "div", "ul", "menu"), "header": ("header", "div"), "footer": ("footer", "div"), "side": ("aside", "div", "section"), "notice": ("div", "section", "dialog", "aside"), "advert": ("div", "aside", "section"), "form": ("form", "div"), "comments": ("div", "section", "ol"), "share": ("div", "ul")}


class Layouts:
    """Pages with known labels.  Words of articles and boilerplate are mostly invented, so that the labeller must rely on
    structure and measures; set phrases of boilerplate are mixed in."""

    def __init__(self, seed: int = 7):
        self.rng = np.random.default_rng(seed)

    def _pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def _chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def _word(self) -> str:
        syllables = ("an", "th", "er", "on", "le", "que", "ch", "ment", "sch", "ung", "ci", "ón", "os", "re", "ti", "ou", "é", "ein", "la", "st", "ä", "do", "mi", "ka", "wo", "zu", "pra", "lin")
        return "".join(self._pick(syllables) for _ in range(int(self.rng.integers(1, 5))))

    def _sentence(self, least: int = 3, most: int = 22) -> str:
        words = [self._word() for _ in range(int(self.rng.integers(least, most)))]
        if self._chance(0.1):
            words = [w + self._pick(("%%%", "***", "&&&", "$$$", "###")) for w in words]
        return " ".join(words).capitalize() + self._pick(".....!?")

    def _paragraph(self) -> str:
        n = self._pick((1, 1, 2, 3, 5, 8))
        if self._chance(0.05):
            return " | ".join(self._word() for _ in range(int(self.rng.integers(1, 30)))).capitalize() + self._pick((".", " |", ""))
        if self._chance(0.03):
            return self._word().capitalize()
        return " ".join(self._sentence(1 if n == 1 else 3) for _ in range(n))

    def _phrase(self, kind: str) -> str:
        words = _BAD_WORDS[kind].split()
        if self._chance(0.5):
            return self._sentence(1, 10) if self._chance(0.6) else self._word().capitalize()
        at = int(self.rng.integers(len(words)))
        return " ".join(words[at : at + int(self.rng.integers(1, 7))] + ([self._word()] if self._chance(0.4) else [])).capitalize()

    def _bad(self, kind: str) -> tuple[str, int]:
        """(markup, number of blocks) of a piece of boilerplate."""
        tag = self._pick(_BAD_TAGS[kind])
        named = "" if tag in ("nav", "header", "footer", "aside", "form") and self._chance(0.5) else f' {self._pick(("class", "class", "id"))}="{self._pick(_BAD_NAMES[kind].split())}"'
        n = int(self.rng.integers(1, 7 if kind in ("menu", "side", "comments", "form") else 4))
        if kind in ("menu", "share") or (kind in ("side", "footer", "header") and self._chance(0.5)):
            items = "".join(f'<li><a href="/{self._word()}">{self._phrase(kind)}</a></li>' for _ in range(n))
            inner = items if tag in ("ul", "menu") else f"<ul>{items}</ul>"
        elif kind == "form":
            inner = "".join(f"<label>{self._phrase(kind)}</label><input name=q>" for _ in range(n - 1)) + f"<button>{self._phrase(kind)}</button>"
        elif kind == "comments":
            inner = "".join(f"<{x}>{self._sentence(2, 18)}</{x}>" for x in (self._pick(("li", "p", "div")) for _ in range(n)))
        elif self._chance(0.4):
            n, inner = 1, self._phrase(kind) if self._chance(0.4) else self._sentence(2, 16)
        else:
            inner = "".join(f"<{x}>{self._phrase(kind) if self._chance(0.5) else self._sentence(2, 14)}</{x}>" for x in (self._pick(("p", "div", "h3")) for _ in range(n)))
        return f"<{tag}{named}>{inner}</{tag}>", n

    def _article(self) -> tuple[str, list[int]]:
        markup, labels = [], []
        if self._chance(0.8):
            markup.append(f"<h1>{self._sentence(2, 10)[: int(self.rng.integers(15, 70))]}</h1>")
            labels.append(1)
        for _ in range(self._pick((1, 1, 2, 3, 5, 8, 13, 20))):
            roll = self.rng.random()
            if roll < 0.07:
                piece, n = self._bad(self._pick(("advert", "side", "share", "notice", "form")))
                markup.append(piece)
                labels += [0] * n
            elif roll < 0.13:
                markup.append(f"<{(h := self._pick(('h2', 'h3')))}>{self._sentence(1, 8).rstrip('.')}</{h}>")
                labels.append(1)
            elif roll < 0.18:
                n = int(self.rng.integers(1, 5))
                markup.append("<ul>" + "".join(f"<li>{self._sentence(1, 12)}</li>" for _ in range(n)) + "</ul>")
                labels += [1] * n
            elif roll < 0.22:
                markup.append(f"<blockquote><p>{self._paragraph()}</p></blockquote>")
                labels.append(1)
            elif roll < 0.25:
                markup.append(f"<div>{self._paragraph()}</div>")
                labels.append(1)
            else:
                text = self._paragraph()
                if self._chance(0.1):
                    text = f'{text} <a href="#">{self._word()}</a> {self._word()}.'
                markup.append(f"<p><b>{text}<br>" if self._chance(0.1) else f"<p>{text}</p>")
                labels.append(1)
        return "".join(markup), labels

    def page(self) -> tuple[str, np.ndarray]:
        markup, labels = ["<html><head><title>x</title></head><body>"], []

        def bad(*kinds: str) -> None:
            piece, n = self._bad(self._pick(kinds))
            markup.append(piece)
            labels.extend([0] * n)

        for kinds, p in ((("header",), 0.5), (("menu",), 0.8), (("notice",), 0.3), (("advert",), 0.5), (("share", "form", "side"), 0.3)):
            if self._chance(p):
                bad(*kinds)
        wrap = self._chance(0.3)
        if wrap:
            markup.append(self._pick(("<main>", '<div class="wrapper">', '<div id="page">', "<section>")))
        inner, marks = self._article()
        if self._chance(0.6):
            tag, named = "article", f' class="{self._pick(_GOOD_NAMES)}"' if self._chance(0.3) else ""
        else:
            tag, named = self._pick(("div", "section", "main", "div")), f' {self._pick(("class", "id"))}="{self._pick(_GOOD_NAMES)}"' if self._chance(0.9) else ""
        markup.append(f"<{tag}{named}>{inner}")
        labels += marks
        if self._chance(0.15):
            bad("comments", "share", "side")
        markup.append(f"</{tag}>")
        for kinds, p in ((("comments",), 0.45), (("side",), 0.45), (("advert", "notice", "share", "form"), 0.4), (("footer",), 0.85)):
            if self._chance(p):
                bad(*kinds)
        return "".join(markup) + "</body></html>", np.array(labels, np.float32)


_TRAINED: dict[int, Labeller] = {}


def train(pages: int = PAGES) -> Labeller:
    """A labeller fitted on ``pages`` generated pages; remembered, as it depends on nothing else."""
    if pages not in _TRAINED:
        made, coded, labels = Layouts(), [], []
        while len(coded) < pages:
            page, marks = made.page()
            got = blocks(page)
            if len(got) == len(marks):  # a generated block may come out blank
                coded.append(got)
                labels.append(marks)
        _TRAINED[pages] = Labeller().fit(coded, labels)
        release()
    return _TRAINED[pages]


def main_texts(labeller: Labeller, pages: list[str | None]) -> list[str]:
    parsed = [blocks(p) for p in pages]
    return ["\n".join(b.text for b, p in zip(page, keep.tolist()) if p >= KEEP) for page, keep in zip(parsed, labeller.probabilities(parsed))]


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page; text is empty for null, empty and article-less pages.

    Pages of any length are read whole; bytes that are not UTF-8 are read as U+FFFD.  Repeated rows give repeated rows,
    extra columns play no part whatever their names, an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(labeller or train())  # some hundred kilobytes, by parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in grouped(batches, "html", BLOCK_BYTES):
            raw = [x for b in held for x in b.column(2).to_pylist()]
            texts = main_texts(shared.value, [None if x is None else x.decode("utf-8", "replace") for x in raw])
            ids, urls = (pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = only(pages, ["page_id", "url", "html"]).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    return rows.mapInArrow(trimmed(run), "page_id long, url string, text string, n_chars long")
