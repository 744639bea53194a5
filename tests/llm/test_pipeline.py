"""The pipeline against a plain version of its stages."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline as P
from loomwright.llm import mixing
from loomwright.llm.common import durable

from .tables import DOCUMENTS, ODD, documents, words
from .test_pairs_and_spans import slow_copy_classes

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")


def corpus():
    passage = words(500, 70, 5000)
    rows = [(i, words(i, 60 + i, 4000), "en", f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(10)]
    rows += [(200 + i, words(300 + i, 20, 4000) + " " + passage + " " + words(400 + i, 20, 4000), "en", "s1") for i in range(8)]
    return rows + [(300, None), (301, "1234 5678"), (302, "")]


def test_run_matches_plain_stages(spark, tmp_path):
    rows = corpus()
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    # plain stages
    docs = [(i, t, s) for i, t, _, s in [(r + ("en", "s"))[:4] for r in rows] if t and any(c.isalpha() for c in t)]
    classes = slow_copy_classes([(i, t) for i, t, _ in docs])
    docs = [(i, t, s) for i, t, s in docs if classes[i] == i]
    seen, stripped = set(), []
    for i, t, s in sorted(docs):
        w = t.split()
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if (key := tuple(w[p : p + 20])) in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        stripped.append((i, " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else t, "en", s))
    taken = {r["doc_id"]: r["times"] for r in mixing.mix(documents(spark, stripped)).collect()}
    ranks = {}
    import base64

    for line in open(public.path("byte_bpe_50k.tiktoken"), "rb"):
        a, b = line.split()
        ranks[base64.b64decode(a)] = int(b)
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t, *_ in stripped:
        if taken[i]:
            want[(i, tuple(enc.encode_ordinary(t)))] += taken[i]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert not {100 + i for i in range(10)} & {r["doc_id"] for r in got}


def test_stages_keep_the_columns_and_bear_odd_rows(spark):
    docs = documents(spark, ODD, extra=True)
    letters = [t for _, t, *_ in ODD if t and any(c.isalpha() for c in t)]
    left = {"language_id": len(letters), "simhash_near_dedup": len({*slow_copy_classes(list(enumerate(letters))).values()})}
    for k, (name, stage) in enumerate(P.STAGES):
        before, docs = docs, durable(stage(spark, docs, ""), f"test-{name}")
        if k < len(P.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name in left:
            assert docs.count() == left[name]
        elif name != "source_mixing":
            assert docs.count() == before.count()
        assert docs.count()


def test_near_dedup_keeps_one_row_of_each_class(spark):
    def kept(rows):
        return sorted(((r["doc_id"], r["text"]) for r in P.near_duplicates(spark, documents(spark, rows, extra=True), "").collect()), key=str)

    a, b, c = words(21, 80), words(22, 80), words(23, 80)
    # without an id, and different texts of one id
    assert kept([(None, a), (None, a), (None, b), (5, c), (5, words(24, 80))]) == sorted([(None, a), (None, b), (5, c), (5, words(24, 80))], key=str)
    # a copy under a smaller id stands for the class, the other text of the shared id stays
    assert kept([(1, a), (5, a), (5, b), (None, b), (None, a)]) == sorted([(1, a), (5, b)], key=str)
    odd = kept(ODD)
    classes = slow_copy_classes([(n, t) for n, (_, t, *_) in enumerate(ODD)])
    members = {}
    for n, (i, t, *_) in enumerate(ODD):
        members.setdefault(classes[n], []).append((i, t))
    assert len(odd) == len(members) and {x[0] for x in odd} == {min((i for i, _ in m if i is not None), default=None) for m in members.values()}


def test_near_dedup_finds_planted_near_copies(spark):
    """Copies with words replaced, of similarity 0.8 to 0.95, go; texts that share a part alone stay."""
    r = random.Random(12)
    rows, copies, shared = [(i, words(i, 300, 4000)) for i in range(150)], [], words(999, 120, 4000)
    for i in range(150):
        w = rows[i][1].split()
        while (similarity := jaccard(rows[i][1], " ".join(w))) > r.uniform(0.8, 0.95):
            w[r.randrange(len(w))] = f"new{r.randrange(10_000)}"
        if similarity >= 0.8:
            copies.append((1000 + i, " ".join(w)))
    parts = [(2000 + i, words(3000 + i, 180, 4000) + " " + shared) for i in range(30)]
    kept = {x["doc_id"] for x in P.near_duplicates(spark, documents(spark, rows + copies + parts), "").collect()}
    assert len(copies) > 100 and {i for i, _ in rows + parts} <= kept
    assert len({i for i, _ in copies} & kept) <= 0.03 * len(copies)


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_stages_bear_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCUMENTS)
    for name, stage in P.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14)) and "pipeline" in entry.queries()
    assert len(P.STAGES) == 5
