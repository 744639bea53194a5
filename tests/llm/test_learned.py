"""Models: held-out accuracy, gradients, calibration, exact counts, odd inputs."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from loomwright.llm import ann, gru_lm, html_extract, langid, toxicity
from loomwright.llm.common import fold_of

from .tables import DOCUMENTS, ODD, documents

SYLLABLES = {"en": "the ing er tion th an of re".split(), "de": "sch ung ein ich der ä ß ge".split(), "fr": "que ment é eau le ou è ai".split()}


def text_of(lang: str, seed: int, n: int = 40) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    return [(i, text_of(lang, i), lang, "s") for i, lang in enumerate(random.Random(1).choices(list(SYLLABLES), k=400))]


# ---- language ----
def test_language_of_held_out_texts(spark, corpus):
    rows = corpus + [(900, None, None), (901, "12 34 !?", "en"), (902, "", None), (903, text_of("de", 5, 4000), None)]
    df = documents(spark, rows, extra=True)
    got = {r["doc_id"]: r for r in langid.predict(df, langid.fit(df)).collect()}
    held = [r for r in corpus if fold_of(r[0], 4) == 2]
    assert len(held) > 50 and np.mean([got[i]["lang_pred"] == lang for i, _, lang, _ in held]) > 0.95
    assert all(got[i]["held_out"] == (fold_of(i, 4) == 2) for i in got)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and not got[i]["accepted"] for i in (900, 901, 902))
    assert got[903]["lang_pred"] == "de" and got[903]["accepted"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.accepted_documents(df, langid.fit(df)).count() == len(corpus) + 1


def test_rejection_is_calibrated(corpus):
    """Texts of no language learned and strings of none go, texts of the languages stay."""
    known = [(t, lang) for _, t, lang, _ in corpus]
    m = langid.train([t for t, _ in known], [lang for _, lang in known])
    assert 0.001 < m.temperature < 100 and m.errors[0] <= 0.01 and m.errors[1] <= 0.05
    r = random.Random(7)
    foreign = [" ".join("".join(r.choice(["pii", "llo", "vää", "ky", "uo", "jo", "mu"]) for _ in range(3)) for _ in range(40)) for _ in range(40)] + ["x", "Q1", "Привет как дела", "漢字かな"]
    fresh = [text_of(lang, 9000 + i) for i in range(60) for lang in SYLLABLES]
    accepted = lambda texts: [bool(ok and s >= m.threshold) for _, s, ok in zip(*langid.score_texts(m, texts))]
    assert sum(accepted(foreign)) <= 2 and sum(accepted(fresh)) >= 0.99 * len(fresh)


def id_list(seed, n=50):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(999)}" for _ in range(n))


@pytest.mark.parametrize("texts", [[id_list(i) for i in range(300)], ["w1 w2 w3"] * 40, ["x"] * 30, [text_of("en", i) for i in range(200)], ["a b", "c"]])
def test_training_stays_finite_and_one_language_is_kept(texts):
    """Texts of few subwords, one repeated text, one language: every number is finite and nearly all texts are accepted."""
    m = langid.train(texts, ["en"] * len(texts))
    _, score, letters = langid.score_texts(m, texts)
    assert np.isfinite(m.table).all() and np.isfinite(m.threshold) and np.isfinite(m.temperature)
    assert ((score >= 0) & (score <= 1)).all() and (letters & (score >= m.threshold)).mean() >= 0.99


def test_threshold_hardly_depends_on_the_seed_or_on_odd_texts(corpus):
    texts, labels = [t for _, t, _, _ in corpus], [lang for _, _, lang, _ in corpus]
    fresh = [text_of(lang, 9000 + i) for i in range(60) for lang in SYLLABLES]
    r = random.Random(7)
    foreign = [" ".join("".join(r.choice(["pii", "llo", "vää", "ky", "uo", "jo", "mu"]) for _ in range(3)) for _ in range(40)) for _ in range(40)]
    for odd, seed in itertools.product((0, 1, 3), (3, 4)):
        m = langid.train(texts + [id_list(k) for k in range(odd)], labels + ["en"] * odd, seed)
        assert 0.1 < m.threshold < 0.95 and m.errors[0] <= 0.02 and m.errors[1] <= 0.02
        accepted = lambda t: np.mean(langid.score_texts(m, t)[1] >= m.threshold)  # noqa: E731, B023
        assert accepted(fresh) >= 0.99 and accepted(foreign) <= 0.1


def test_training_that_leaves_finite_numbers_raises(monkeypatch):
    monkeypatch.setattr(langid, "RATE", float("inf"))
    with pytest.raises(FloatingPointError), np.errstate(all="ignore"):
        langid.train(["the thing", "der schein"] * 20, ["en", "de"] * 20)


def test_rare_languages_and_repeated_rows_are_learned(spark, corpus):
    rare = [(5000 + i, "zzq qzz zqz " * 8, "xx", "s") for i in range(3)]
    repeated = [(7000, text_of("en", 1), "en", "s")] * 300 + [(None, text_of("fr", 2), "fr", "s")] * 300
    m = langid.fit(documents(spark, corpus + rare + repeated), 80)
    assert m.languages == ["de", "en", "fr", "xx"]
    assert langid.fit(documents(spark, corpus + rare + repeated).repartition(5), 80).table.tolist() == m.table.tolist()


def test_language_learns_nothing_from_the_held_out_fold(spark, corpus):
    wrong = [(i, t, "fr" if fold_of(i, 4) == 2 else lang, s) for i, t, lang, s in corpus]
    a, b = langid.fit(documents(spark, corpus)), langid.fit(documents(spark, wrong))
    assert a.languages == b.languages and np.array_equal(a.table, b.table)


def test_logits_are_the_mean_of_subword_scores():
    m = langid.train(["the thing", "der schein", "le eau"] * 20, ["en", "de", "fr"] * 20)
    texts = ["Hello  world", "a", "É9é", "x"]
    buckets, begin, _ = langid.subwords(texts)
    want = np.stack([m.table[buckets[a:b]].mean(axis=0) + m.bias for a, b in zip(begin, begin[1:])])
    assert m.table.shape[1] == 4  # the last is anything else
    assert np.allclose(m.logits(texts)[0], want, atol=1e-4)


@pytest.mark.parametrize("f", [lambda d: langid.predict(d, langid.fit(d)), lambda d: gru_lm.scores(d)])
def test_odd_and_empty_documents(spark, f):
    assert f(documents(spark, ODD, extra=True)).count() == len(ODD)
    assert f(spark.createDataFrame([], DOCUMENTS)).collect() == []


# ---- toxicity ----
def test_toxicity_of_held_out_texts(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(1200):
        w, toxic = text_of("en", i, 60).split(), int(r.random() < 0.3)
        for _ in range(4 * toxic):
            w.insert(r.randrange(60), r.choice(["you idiot", "moron,", "zorgle", "W0RTHLESS"]))
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    df = documents(spark, rows + [(5000, None), (5001, ""), (5002, "you " * 20_000)], extra=True)
    lab = spark.createDataFrame(labels + [(None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.predict(df, toxicity.fit(df, lab)).collect()}
    held = [(i, t) for i, t in labels if fold_of(i, 5) == 0]
    assert np.mean([got[i]["predicted"] == t for i, t in held]) > 0.95
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got.values())
    assert len(got) == 1203 and got[5000]["score"] == got[5001]["score"]


def test_toxicity_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.predict(documents(spark, ODD), toxicity.fit(documents(spark, ODD), none)).count() == len(ODD)
    empty = spark.createDataFrame([], DOCUMENTS)
    assert toxicity.predict(empty, toxicity.fit(empty, none)).collect() == []


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(0)
    s = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-s))).astype(float)
    at, rate = toxicity.isotonic(s, y)
    assert (np.diff(rate) > 0).all() and (np.diff(at) > 0).all()


def test_disguises_are_counted():
    lex = toxicity.Lexicon({})
    f = lambda t: dict(zip(toxicity.FEATURES, toxicity.features(t.encode(), lex)))
    assert f("you 1d10t and m*o*r*o*n")["disguised"] > 0 and f("i d i o t now")["apart"] > 0
    assert f("you idiot")["near_second_person"] > 0 and f("STOP IT")["capital_words"] == 1


# ---- language model ----
def test_base_scores_and_counts_are_exact(spark, corpus):
    rows = corpus + [(800, None), (801, " "), (802, "Unseen WORDS the")]
    got = {r["doc_id"]: r for r in gru_lm.scores(documents(spark, rows, extra=True)).collect()}
    c, ends = Counter(), 0
    for i, t, *_ in rows:
        if fold_of(i, 10):
            c.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    logp = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert math.isclose(got[i]["base_score"], sum(logp(c[x]) for x in w) + logp(ends), rel_tol=1e-9, abs_tol=1e-9)
        assert got[i]["held_out"] == (fold_of(i, 10) == 0) and got[i]["score"] < 0
    held = [got[i] for i, *_ in corpus if fold_of(i, 10) == 0]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_rare_words_are_looked_up(spark, corpus, monkeypatch):
    df = documents(spark, corpus)
    want = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in gru_lm.scores(df).collect()}
    monkeypatch.setattr(gru_lm, "FREQUENT", 170)
    got = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in gru_lm.scores(df).collect()}
    assert got == want


def test_symbol_probabilities_sum_to_one():
    net = gru_lm.Network()
    h = np.random.default_rng(1).normal(size=(3, gru_lm.HIDDEN)).astype(np.float32)
    total = sum(np.exp(net.log_probabilities(h, np.full(3, s))) for s in range(gru_lm.SYMBOLS))
    assert np.allclose(total, 1, atol=1e-4)


def test_state_is_carried_and_batches_do_not_matter(monkeypatch):
    net, rng = gru_lm.Network(), np.random.default_rng(2)
    texts = [rng.integers(0, 256, n) for n in (1, 200, 3, 77)]
    together = net.score(texts)
    assert np.allclose(together, [net.score([t])[0] for t in texts], rtol=1e-4)
    monkeypatch.setattr(gru_lm, "STEPS", 7)
    assert np.allclose(together, net.score(texts), rtol=1e-4)


def _numeric(f, w, at, eps=1e-2):
    old = w[at]
    w[at] = old + eps
    up = f()
    w[at] = old - eps
    down = f()
    w[at] = old
    return (up - down) / (2 * eps)


def test_gradients_of_the_language_model():
    net, rng = gru_lm.Network(), np.random.default_rng(3)
    symbols, mask = rng.integers(0, 256, (6, 4)), np.ones((6, 4), np.float32)
    h = np.zeros((4, gru_lm.HIDDEN), np.float32)
    grads, _, _ = net._window(symbols, mask, h)
    loss = lambda: net._window(symbols, mask, h)[2] / mask.sum()
    for w, g in zip(net.weights(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        assert math.isclose(_numeric(loss, w, at), g[at], rel_tol=0.05, abs_tol=2e-3)


def test_the_start_is_of_whole_documents_with_one_end_each(spark, monkeypatch):
    seen = []
    fit = gru_lm.Network.fit
    monkeypatch.setattr(gru_lm.Network, "fit", lambda self, texts, **k: seen.append([t.copy() for t in texts]) or fit(self, texts, **k))
    monkeypatch.setattr(gru_lm, "SAMPLE", 20)
    rows = [(i, " ".join(["start"] * 400 + ["late", "later"] * 200)) for i in range(60)]
    rows += [(100 + i, " ".join(["late", "later"] * 200)) for i in range(40)]
    got = {r["doc_id"]: r for r in gru_lm.scores(documents(spark, rows)).collect()}
    assert len(seen) == 1 and len(seen[0]) == 20
    assert {len(t) for t in seen[0]} <= {801, 401} and all((t == gru_lm.END).sum() == 1 and t[-1] == gru_lm.END for t in seen[0])
    held = [got[i] for i, _ in rows if got[i]["held_out"]]
    assert held and all(r["score"] > 0.8 * r["base_score"] for r in held)


def test_windows_are_spread_over_whole_documents():
    rng = np.random.default_rng(6)
    w = gru_lm.WINDOW
    for size in (1, 31, 32, 33, 64, 1000):
        s = rng.integers(1, 250, size).astype(np.uint8)
        every = gru_lm.windows_of(s, 1)
        assert np.array_equal(np.concatenate([r[2 + w : 2 + w + r[1]] for r in every]), s)  # each symbol once
        for at, r in enumerate(every):
            assert r[0] == (at > 0) and (at == 0 or np.array_equal(r[2 : 2 + w], s[(at - 1) * w : at * w]))
    s = rng.integers(1, 250, 32 * 4000).astype(np.uint8)
    some = {r.tobytes() for r in gru_lm.windows_of(s, 8)}
    at = [k for k, r in enumerate(gru_lm.windows_of(s, 1)) if r.tobytes() in some]
    assert len(at) == 500 and set(np.diff(at)) == {8}


def test_every_training_document_gives_windows(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "SHARD", 500)
    monkeypatch.setattr(gru_lm, "SHARE", 1)
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(1, 250, int(rng.integers(1, 120))).astype(np.uint8)) + b"\0" for _ in range(120)]
    df = spark.createDataFrame([(i if i % 9 else None, len(t), t) for i, t in enumerate(texts)], "doc_id long, n_tokens long, symbols binary")
    frames = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: frames.append(collect(self)) or frames[-1])
    net = gru_lm.Network()
    before = net.packed()
    gru_lm.train(net, df)
    sums = [f for f in frames if f and "w" in f[0].__fields__]
    assert len(sums) == gru_lm.ROUNDS and sum(r["n"] for f in sums for r in f) == sum(map(len, texts))
    assert not np.array_equal(before, net.packed()) and np.isfinite(net.packed()).all()


def test_windows_teach():
    rng = np.random.default_rng(4)
    cycle = np.tile(np.arange(1, 9, dtype=np.uint8), 40)
    records = np.concatenate([gru_lm.windows_of(np.roll(cycle, int(rng.integers(8))), 1) for _ in range(200)])
    net = gru_lm.Network()
    losses = [net.fit_windows(records, seed=i) for i in range(10)]
    assert losses[-1] < 0.3 < losses[0]


def test_states_are_cleared_where_a_text_begins():
    net, rng = gru_lm.Network(), np.random.default_rng(7)
    texts = [rng.integers(0, 256, n) for n in (5, 9)]
    together, begins = np.concatenate(texts)[:, None], np.zeros((14, 1), bool)
    begins[[0, 5]] = True
    zero = np.zeros((1, gru_lm.HIDDEN), np.float32)
    got, _, loss = net._window(together, np.ones((14, 1), np.float32), zero, begins)
    want = [net._window(t[:, None], np.ones((len(t), 1), np.float32), zero) for t in texts]
    assert math.isclose(loss, sum(w[2] for w in want), rel_tol=1e-5)
    assert all(np.allclose(g * 14, a * 5 + b * 9, atol=1e-4) for g, a, b in zip(got, want[0][0], want[1][0]))


# ---- pages ----
def test_gradients_of_the_labeller():
    pages, labels = [], []
    made = html_extract.Layouts(1)
    while len(pages) < 3:
        page, marks = made.page()
        got = html_extract.blocks(page)
        if len(got) == len(marks):
            pages.append(got), labels.append(marks)
    lab, coded, y = html_extract.Labeller(), html_extract.Coded(pages), np.concatenate(labels)

    def loss():
        p = np.clip(html_extract._sigmoid(lab._logits(coded)[0]).astype(float), 1e-7, 1 - 1e-7)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() / len(pages)

    grads = lab._step(coded, y)
    for w, g in zip([lab.path, lab.word, lab.ahead.w, lab.ahead.b, lab.back.w, lab.back.b, lab.out, lab.bias], grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        assert math.isclose(_numeric(loss, w, at), g[at], rel_tol=0.08, abs_tol=2e-3)


def test_labels_of_unseen_layouts():
    lab, made, right, total = html_extract.train(), html_extract.Layouts(99), 0, 0
    for _ in range(150):
        page, marks = made.page()
        got = html_extract.blocks(page)
        if len(got) == len(marks):
            right += ((lab.probabilities([got])[0] >= 0.5) == marks).sum()
            total += len(marks)
    assert right / total > 0.97


def test_blocks_and_references():
    page = "<body><p>A &amp; B&nbsp;&#233;<br>c<p>two <b>x<br><p>three</p><script>var t='</p>';</script><!-- <p>no</p> --><ul><li>i<li>j</ul><style>p{}</style>tail"
    assert [b.text for b in html_extract.blocks(page)] == ["A & B é c", "two x", "three", "i", "j", "tail"]
    assert html_extract.blocks(None) == [] and html_extract.blocks("<p") == [] and html_extract.blocks("<!-- open") == []


def test_markup_that_hides_no_more_than_itself():
    texts = lambda page: [b.text for b in html_extract.blocks(page)]
    assert texts("<p>one <svg class=x /> two</p><p>three</p>") == ["one two", "three"]
    assert texts("<p>one<svg><title>t</title><svg><text>in</text></svg>out</svg> two</p>") == ["one two"]
    assert texts("<object data=x /><p>one</p><template/><p>two</p>") == ["one", "two"]
    assert texts("<p>one <iframe src=x> lost</p><p>two</p>") == ["one", "two"]
    assert texts("<title>lost<body><p>one</p>") == ["one"] and texts("<head><title>t</title></head><p>one</p>") == ["one"]
    assert texts("<p>a</p><noscript><p>no</p><div>no</div></noscript><p>b</p><template><p>no</p></template><p>c</p>") == ["a", "b", "c"]
    assert texts("<svg>" * 2000 + "<p>one</p>") == ["one"] and texts("<p>x</p><svg><!-- </svg> --><text>t</text></svg><p>y</p>")[0] == "x"
    linked = html_extract.blocks("<a href=/x><div>all of it</div></a><div>none</div><ul><li><a href=/y>it<li>free</ul>")
    assert [round(b.link_share) for b in linked] == [1, 0, 1, 0]


#: Pages that the grammar of the labeller's training does not make, and their articles.
HAND_MADE = [
    (
        """<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>Harbour news</title><style>p{color:red}</style></head><body>
        <a class="skip-link" href="#main">Skip to content</a><header class="site-header"><div class="logo"><svg viewBox="0 0 1 1"><path d="M0"/></svg>The Harbour</div>
        <nav><ul><li><a href="/">Home</a></li><li><a href="/sport">Sport</a></li><li><a href="/contact">Contact</a></li></ul></nav></header>
        <main id=main><article><h1>Ferry service returns after the storm</h1><p>The ferry between the two islands was running again on Monday, three days after a storm
        had closed the port and left hundreds of travellers waiting.</p><p>&ldquo;We checked every cable twice,&rdquo; the captain said, adding that the first crossing had been calm.</p>
        <p>Officials expect a normal timetable from next week, when the last repairs to the pier are done.</p></article></main>
        <aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten walks</a></li><li><a href="/2">Old boats</a></li></ul></aside>
        <footer><p>&copy; 2023 The Harbour. All rights reserved.</p></footer><script>track("x")</script></body></html>""",
        ["Ferry service returns after the storm", "The ferry between the two islands was running again on Monday, three days after a storm had closed the port and left hundreds of travellers waiting.", "“We checked every cable twice,” the captain said, adding that the first crossing had been calm.", "Officials expect a normal timetable from next week, when the last repairs to the pier are done."],
    ),
    (
        """<html><body><div id="cookie-notice">We use cookies. <button>Accept</button></div><div class="menu"><a href=/a>Recipes</a> <a href=/b>Drinks</a></div>
        <div class="post"><h2>Bread without kneading</h2><p>Mix the flour, the water and a little yeast in the evening, and cover the bowl with a cloth.<p>In the morning fold the dough
        twice, let it rest for an hour, and bake it in a hot pot for forty minutes.</div>
        <div id="comments"><h3>Comments</h3><div class="comment"><b>Ann</b>: Great post, thanks!</div><div class="comment">Mine was too wet.</div></div>
        <form class=newsletter><label>Email</label><input name=e><button>Subscribe</button></form></body></html>""",
        ["Bread without kneading", "Mix the flour, the water and a little yeast in the evening, and cover the bowl with a cloth.", "In the morning fold the dough twice, let it rest for an hour, and bake it in a hot pot for forty minutes."],
    ),
]


@pytest.mark.parametrize("page, want", HAND_MADE)
def test_hand_made_pages(page, want):
    assert html_extract.main_texts(html_extract.train(), [page]) == ["\n".join(want)]


def test_pages_of_any_kind(spark):
    article = "<article><h1>Title of it</h1>" + "".join(f"<p>{text_of('en', i, 25).capitalize()}.</p>" for i in range(6)) + "</article>"
    html = f"<html><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class=ad>Buy now cheap.</div>{article}<footer>&copy; example.com &middot; all rights.</footer></body></html>"
    rows = [(1, "u", html), (2, "u", None), (3, None, ""), (4, "u", "<p"), (1, "u", html), (None, "v", html), (6, "u", f"<div>{article * 300}</div>")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"].startswith("Title of it\n") and by[1]["text"].count("\n") == 6 and "Home" not in by[1]["text"] and "Buy" not in by[1]["text"] and "©" not in by[1]["text"]
    assert by[2]["text"] == "" and by[3]["n_chars"] == 0 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# ---- neighbours ----
def slow_neighbours(rows, queries, k):
    usable = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 16}
    out = {}
    for q in queries:
        if q in usable:
            scored = sorted((-float((usable[i] * usable[q]).sum()), i) for i in usable if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def vector_rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 20] + 0.4 * rng.normal(size=16)]) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # copies
    return rows + [(2000, None), (2001, [0.0] * 16), (2002, [1.0] * 15 + [float("nan")]), (2003, [1.0] * 15 + [None]), (2004, [1.0] * 15 + [float("inf")]), (2005, [1.0, 2.0]), (None, rows[1][1]), (2006, [])]


def test_neighbours_are_found(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = slow_neighbours(rows, [i for i, _ in rows if i is not None and i % 20 == 0], 20)
    assert got.keys() == want.keys()
    hit = 0
    exact = dict(rows)
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1)) and q not in [i for _, i, _ in found]
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(math.isclose(s, float((np.array(exact[i], float) * np.array(exact[q], float)).sum()), rel_tol=1e-12) for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert hit / sum(map(len, want.values())) >= 0.9


def test_few_or_no_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = make([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5])])
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, df.filter("vec_id % 20 = 0"), 20).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 3, 0.5), (20, 1, 0, 1.0), (20, 2, 3, 0.5)]
    empty = make([])
    assert ann.search(empty, empty, 20).collect() == []
    rng = np.random.default_rng(5)
    few = make([(i, [float(x) for x in rng.normal(size=32)]) for i in range(15)])
    assert ann.search(few, few.filter("vec_id = 0"), 20).count() == 14
    one = make([(0, [1.0])])
    assert ann.search(one, one, 20).collect() == []


def test_moves_come_in_order_of_success():
    rng = np.random.default_rng(2)
    within, distance = rng.random((5, 4)), np.array([0.1, 0.5, 1.0, 1.5, 2.0])
    moves, chance = ann.best_moves(within, distance, 30)
    for i in range(5):
        cdf = lambda x: (1 + math.erf(x / math.sqrt(2))) / 2
        share = lambda j, s: cdf((s + 1 - within[i, j]) * ann.WIDTH / distance[i]) - cdf((s - within[i, j]) * ann.WIDTH / distance[i])
        want = sorted((math.prod(share(j, s) for j, s in enumerate(m)) for m in itertools.product((-1, 0, 1), repeat=4)), reverse=True)[:30]
        assert np.allclose(chance[i], want, atol=1e-6) and len(set(map(tuple, moves[i].tolist()))) == 30
        assert np.allclose(chance[i], [math.prod(share(j, s) for j, s in enumerate(m)) for m in moves[i].tolist()], atol=1e-6)


def found_by(spark, rows, kind="float", k=20, parts=3):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(parts)
    out = {}
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), k).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [(i, s) for _, i, s in sorted(x)] for q, x in out.items()}


def test_repeated_rows_of_one_id_take_one_place(spark):
    # many equal rows of one id, a copy under another id, an id with two vectors
    rows = [(1, [1.0, 0.0])] * 25 + [(2, [1.0, 0.0]), (3, [0.6, 0.6]), (20, [1.0, 0.1]), (4, [0.1, 0.9]), (4, [0.9, 0.1])]
    got = found_by(spark, rows)
    assert [i for i, _ in got[20]] == [1, 2, 4, 3] and [round(s, 6) for _, s in got[20]] == [1.0, 1.0, 0.91, 0.66]


def test_a_few_long_vectors_hide_no_others(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16))
    rows = [(i, [float(np.float32(x)) for x in (centres[i % 30] + 0.3 * rng.normal(size=16)) * (1 if i % 150 else 10 + i / 10)]) for i in range(1500)]
    got, exact = found_by(spark, rows), slow_neighbours(rows, [i for i, _ in rows if i % 20 == 0], 20)
    assert got.keys() == exact.keys() and all(len(x) == 20 for x in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in exact[q]}) for q in exact) / (20 * len(exact)) >= 0.9


def test_double_vectors_are_scored_as_they_are(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(100)]
    vectors = dict(rows)
    got = found_by(spark, rows, "double")
    assert len(got) == 5 and all(math.isclose(s, float(np.dot(vectors[q], vectors[i])), rel_tol=1e-12) for q, x in got.items() for i, s in x)


def test_large_buckets_are_dealt_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(10)
    rows = [(i, [float(np.float32(x)) for x in np.ones(16) + 0.02 * rng.normal(size=16)]) for i in range(900)]
    want = found_by(spark, rows)
    monkeypatch.setattr(ann, "SLICE", 50)
    assert found_by(spark, rows) == want and all(len(x) == 20 for x in want.values())


def test_copies_of_a_window_are_spread_over_shards():
    """A passage that all documents share is dealt to all shards, about as often to each; the deal does not depend on batches."""
    import pyarrow as pa

    passage = np.arange(gru_lm.WINDOW * 2, dtype=np.uint8).tobytes()

    def dealt(batches):
        got = {}
        for b in gru_lm._deal(1, 8)(iter(batches)):
            for shard, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got[shard] = got.get(shard, 0) + len(records) // (2 + 2 * gru_lm.WINDOW)
        return got

    ids = [*range(2000), None]
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([passage] * len(some), pa.binary())], names=["doc_id", "symbols"])
    got = dealt([batch(ids)])
    assert sum(got.values()) == 2 * len(ids) and len(got) == 8
    assert max(got.values()) < 1.25 * min(got.values())
    assert got == dealt([batch(ids[k : k + 37]) for k in range(0, len(ids), 37)])


def test_shards_are_trained_one_after_the_other():
    """Rows of a shard come together; each gives one row with the symbols that it saw."""
    import pyarrow as pa

    class Shared:
        value = gru_lm.Network()

    records = gru_lm.windows_of(np.arange(gru_lm.WINDOW * 3, dtype=np.uint8) % 7, 1)
    rows = [(k, records[j : j + 1].tobytes()) for k in (1, 5, 9) for j in range(len(records))]
    batches = [pa.RecordBatch.from_arrays([pa.array([s for s, _ in part], pa.int32()), pa.array([r for _, r in part], pa.binary())], names=["shard", "records"]) for part in (rows[:4], rows[4:])]
    got = [b.to_pylist()[0] for b in gru_lm._fit_shards(Shared)(iter(batches))]
    assert [r["n"] for r in got] == [3.0 * gru_lm.WINDOW] * 3


def test_every_window_is_learned_from():
    """One window in eight was, whatever the corpus."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "symbols": [bytes(range(1, 201)) * 5, b"abc"]})
    parts = [r for b in gru_lm._deal(gru_lm.SHARE, 4)(iter([batch])) for r in b.column(1).to_pylist()]
    assert sum(len(r) for r in parts) // (2 + 2 * gru_lm.WINDOW) == -(-1000 // gru_lm.WINDOW) + 1


def test_long_and_short_texts_are_scored_by_plain_steps(monkeypatch):
    """op7: states of a step were laid out by text, and losses put together over all texts at once, however many."""
    from loomwright.llm import gru_lm

    draw, net = np.random.default_rng(4), gru_lm.Network()
    texts = [draw.integers(0, 256, n).astype(np.uint8) for n in (0, 1, 2, 33, 70, 300, 70)]

    def plain(text):
        h, total = np.zeros(gru_lm.HIDDEN), 0.0
        for s in text.tolist():
            k, m = divmod(s, gru_lm.CLASS)
            for z, own in ((h @ net.wc + net.bc, k), (h @ net.wm[k] + net.bm[k], m)):
                total += z[own] - np.log(np.exp(z).sum())
            x, u = net.embed[s] @ net.wx + net.b, h @ net.wh
            z, r = np.split(1 / (1 + np.exp(-(x + u)[: 2 * gru_lm.HIDDEN])), 2)
            h = (1 - z) * np.tanh(x[2 * gru_lm.HIDDEN :] + r * u[2 * gru_lm.HIDDEN :]) + z * h
        return total / np.log(10)

    assert np.allclose(net.score(texts), [plain(t) for t in texts], rtol=1e-4)
    seen, own = [], net._log_probabilities
    monkeypatch.setattr(net, "_log_probabilities", lambda h, s: seen.append(len(s)) or own(h, s))
    monkeypatch.setattr(gru_lm, "STATES", 8)
    assert np.allclose(net.score(texts), [plain(t) for t in texts], rtol=1e-4) and max(seen) < 8 + len(texts)
