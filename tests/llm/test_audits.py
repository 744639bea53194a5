"""Benchmark decontamination, filter audit and source divergence against plain Python, and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from loomwright.llm import decontaminate, divergence, filter_audit

from .tables import DOCUMENTS, ODD, documents

ITEMS = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- decontamination ----
def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(text))


def slow_contamination(docs, items, window=10):
    wanted = defaultdict(set)
    for i, t in items:
        w = item_words(t)
        n = min(len(w), window)
        for at in range(len(w) - n + 1 if w else 0):
            wanted[tuple(w[at : at + n])].add("" if i is None else str(i))
    sizes = {len(k) for k in wanted}
    out = []
    for i, t, *_ in docs:
        w = item_words(t)
        hit, found = set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if own := wanted.get(tuple(w[at : at + n])):
                    hit |= set(range(at, at + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, bool(hit)))
    return Counter(out)


def random_case(seed, vocabulary, n_items=25, n_docs=40):
    """Few words, so that windows overlap, repeat and are parts of each other in every way."""
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(["W{}", "w{}", "é{}"]).format(r.randrange(vocabulary)) for _ in range(n))
    items = [(r.choice([n, n, 3, None]), say(r.choice([0, 1, 2, 5, 9, 10, 11, 14, 30]) if n % 3 else r.randrange(10, 40))) for n in range(n_items)]
    items += [(100 + k, t) for k, (_, t) in enumerate(items[:5])] + [(7, None), (8, ""), (9, "--- ,")]
    docs = []
    for n in range(n_docs):
        parts = [say(r.randrange(0, 30))]
        for _ in range(r.randrange(4)):
            w = (r.choice(items)[1] or "").split()
            lo = r.randrange(max(1, len(w) // 2))
            parts += [", ".join(w[lo : lo + r.randrange(1, 25)]), say(r.randrange(0, 8))]
        docs.append((n, r.choice([" ", "\n", "; "]).join(parts)))
    return docs, items


@pytest.mark.parametrize("vocabulary", [2, 6, 400])
@pytest.mark.parametrize("automaton_words", [decontaminate.AUTOMATON_WORDS, 150])
def test_contamination_is_what_plain_windows_find(spark, vocabulary, automaton_words):
    docs, items = random_case(vocabulary, vocabulary)
    docs += ODD + ODD[6:8]
    got = decontaminate.contamination(documents(spark, docs, extra=True), spark.createDataFrame([(*x, "clash") for x in items], ITEMS + ", words string"), automaton_words=automaton_words)
    assert Counter(map(tuple, got.collect())) == slow_contamination(docs, items)


def test_long_items_are_cut_into_pieces_that_keep_every_window(spark, monkeypatch):
    r = random.Random(4)
    long = [f"v{r.randrange(50)}" for _ in range(3000)]
    monkeypatch.setattr(decontaminate, "PIECE", 64)
    items = [(1, " ".join(long)), (2, " ".join(long[100:109]))]
    docs = [(n, " ".join(long[n * 97 : n * 97 + 40])) for n in range(30)] + [(99, " ".join(long))]
    got = decontaminate.contamination(documents(spark, docs), spark.createDataFrame(items, ITEMS), automaton_words=500)
    assert Counter(map(tuple, got.collect())) == slow_contamination(docs, items)


def test_longest_matches_are_those_of_plain_search():
    r = random.Random(9)
    pieces = [(str(k), [str(r.randrange(3)).encode() for _ in range(r.randrange(1, 30))], True) for k in range(12)]
    a = decontaminate.Automaton(pieces, 4)
    every = {tuple(w[i:j]) for _, w, _ in pieces for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    text = [str(r.randrange(3)).encode() for _ in range(300)]
    for i, _, length in a.run([a.ids[w] for w in text]):
        assert length == max(n for n in range(i + 2) if not n or tuple(text[i + 1 - n : i + 1]) in every)


def test_clean_documents_lose_spans_or_go(spark):
    item = "One, two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before it - {item}! After, all of this stays as it was written here."), (2, item), (3, "clean  text\n"), (4, None), (5, "")]
    clean = decontaminate.clean_documents(documents(spark, docs, extra=True), spark.createDataFrame([(1, item)], ITEMS))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean.collect()}
    want = "Before it - ! After, all of this stays as it was written here."
    assert got == {1: (want, len(want)), 3: ("clean  text\n", 12), 4: (None, None), 5: ("", 0)}
    assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = decontaminate.clean_documents(documents(spark, docs), spark.createDataFrame([(1, item)], ITEMS), max_span=11, max_coverage=1.0)
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {i: t for i, t in docs}


def test_contamination_of_empty_tables(spark):
    none, no_items = spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], ITEMS)
    assert decontaminate.contamination(none, no_items).collect() == []
    assert Counter(map(tuple, decontaminate.contamination(documents(spark, ODD), no_items).collect())) == slow_contamination(ODD, [])


# ---- filter audit ----
def slow_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, t, _, source in docs:
        t, words = t or "", re.findall(r"[^\x20\x09-\x0D]+", t or "")
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i,
        }
        rows.append((source or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out, shapley = {}, Counter()
    parts = {p for p, *_ in rows}
    for part, order in itertools.product(parts, itertools.permutations("ABCDE")):
        left = [r for r in rows if r[0] == part]
        for step, f in enumerate(order, 1):
            every, gone = [r for r in rows if r[0] == part], [r for r in left if f in r[1]]
            left = [r for r in left if f not in r[1]]
            shapley[part, f] += len(gone)
            unique = sum(r[1] == {f} for r in every)
            redundant = sum(f in r[1] for r in every) - len(gone)
            out[part, "".join(order), step] = [len(left), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(rows):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rows.collect()}


def test_audit_is_what_the_filters_do_in_turn(spark):
    r = random.Random(6)
    docs = []
    for n in range(160):
        body = [r.choice(["word", "Word", "x"]) + str(r.randrange(r.choice([30, 400]))) for _ in range(r.choice([0, 20, 199, 200, 260]))]
        body += ["a|b"] * (r.random() < 0.2) + ["LOUD"] * r.choice([0, 0, 8])
        docs.append((r.choice([n, n, n, 5, None]), r.choice([" ", "\n", " \t "]).join(body), "en", r.choice(["a", "b", None, ""])))
    docs += [(r.choice([n, 300 + (n or 0), None]), t, "en", s) for n, t, _, s in r.choices(docs, k=60)] + [(*x, "en", "odd")[:4] if len(x) < 4 else x for x in ODD]
    labels = [(r.choice([d[0], d[0], None]), r.choice([0, 1, None]), r.choice([0, 1, None])) for d in r.choices(docs, k=150)]
    got = audited(filter_audit.audit(documents(spark, docs, extra=True).repartition(5), spark.createDataFrame([(*x, "c") for x in labels], LABELS + ", mask string")))
    assert got == slow_audit(docs, labels)


def test_very_often_repeated_rows_count_once_each(spark):
    docs = [(7, "a b a", "en", "s")] * 500 + [(9, "a b a", "en", "s")] * 3 + [(None, "LOUD", "en", "s")] * 50
    got = audited(filter_audit.audit(documents(spark, docs).repartition(6), spark.createDataFrame([(7, 1, 0)], LABELS)))
    assert got == slow_audit(docs, [(7, 1, 0)])


def test_audit_of_empty_tables(spark):
    none, no_labels = spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(none, no_labels).collect() == []
    assert filter_audit.audit(documents(spark, ODD), no_labels).count() == 600 * len({r[3] or "" if len(r) > 3 else "s" for r in ODD})


# ---- divergence ----
def slow_divergence(docs, min_docs):
    count, seen, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, t, lang, source in docs:
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        terms = [folded(x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
        count[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        p = {}
        for group in [*sources, None]:
            c = {t: sum(count[lang, s][t] for s in sources) if group is None else count[lang, group][t] for t in kept}
            p[group] = {t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(far(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(far(p[s][t], p[None][t]), t) for t in kept if count[lang, s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return Counter(out)


def test_divergence_is_what_plain_counts_give(spark):
    r = random.Random(8)
    vocabulary = [r.choice(["t", "É", "é", "漢", "Zz"]) + "".join(r.choice("abcXYé") for _ in range(r.randrange(1, 4))) for _ in range(120)]
    docs = []
    for n in range(400):
        lang, source = r.choice(["en", "en", "fr", None, ""]), r.choice(["a", "b", "c", "é", None, ""])
        own = vocabulary[:40] if source == "a" else vocabulary[20:]
        docs.append((r.choice([n, 5, None]), r.choice(["", ", ", "9 "]).join(r.choices(own, k=r.randrange(30))) if r.random() < 0.95 else None, lang, source))
    docs += [(1, "rare words alone", "xx", "a"), (2, None, "xx", "b"), (3, "", "yy", "a")] + [(i, t, "zz", "odd") for i, t, *_ in ODD]
    for min_docs in (10, 1):
        got = divergence.divergence(documents(spark, docs, extra=True), min_docs)
        assert Counter(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == slow_divergence(docs, min_docs)


def test_divergence_of_an_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCUMENTS)).collect() == []
