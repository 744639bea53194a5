"""Fingerprints, near-duplicate classes, duplicate spans and mixing against brute force."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm import fingerprints, mixing, near_dedup, substring_dedup
from loomwright.llm.components import components

from .tables import DOCUMENTS, ODD, documents, words


# ---- near-duplicates ----
def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc, _) in enumerate(prints):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {doc: least[root(i)] for i, (doc, _) in enumerate(prints)}


def slow_copy_classes(rows, radius=near_dedup.WIDE_RADIUS):
    """Classes of rows (number, text) by wide fingerprints that share an upper node and differ in few bits."""
    nodes = {}
    for i, t in rows:
        code, unsure = near_dedup.wide_fingerprint(None if t is None else t.encode())
        keys = near_dedup.wide_keys(code[None], np.frombuffer(unsure, np.uint8).reshape(1, -1, near_dedup.UNSURE))[0].tolist()
        nodes.setdefault(code.tobytes(), (code, set(keys), []))[2].append(i)
    nodes = list(nodes.values())
    parent = list(range(len(nodes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if nodes[i][1] & nodes[j][1] and np.bitwise_count(nodes[i][0] ^ nodes[j][0]).sum() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for k, (_, _, members) in enumerate(nodes):
        least[root(k)] = min([least.get(root(k), 1 << 60), *members])
    return {i: least[root(k)] for k, (_, _, members) in enumerate(nodes) for i in members}


def test_xxh64_is_sparks(spark):
    got = spark.sql("select xxhash64('a b c') as h").first()["h"]
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(5)
    base = [words(i, 400) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(60):
        w = base[r.randrange(12)].split()
        w[r.randrange(400)] = "changed"
        rows.append((100 + k, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "one"), (303, "ONE"), (304, "one two")]
    got = {x["doc_id"]: x for x in near_dedup.near_duplicate_classes(documents(spark, rows, extra=True)).collect()}
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    want = slow_components(prints)
    assert {i: got[i]["fingerprint"] for i, _ in rows} == {i: f"{p:016x}" for i, p in prints}
    assert {i: got[i]["component_id"] for i, _ in rows} == want
    assert any(want[i] != i and i >= 100 and want[i] < 12 for i, _ in rows)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=40, unique=True), st.integers(0, 3), st.randoms(use_true_random=False))
def test_gray_index_finds_every_pair(codes, radius, r):
    codes = list(dict.fromkeys(codes + [c ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for c in codes]))
    codes = np.array(codes, np.uint64)
    codes = codes[np.argsort(near_dedup.gray_rank(codes))]
    found = {(int(i), int(j)) for a, b in near_dedup.GrayIndex(np.zeros(len(codes), int), codes).pairs(radius) for i, j in zip(a, b)}
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= radius}
    assert found == want


def test_stars_tie_what_pairs_connect():
    for seed in range(1500):
        r = random.Random(seed)
        n, words, radius = r.randrange(1, 60), r.randrange(1, 4), r.randrange(0, 13)
        codes = [[r.getrandbits(r.choice([1, 8, 30, 64])) for _ in range(words)] for _ in range(max(1, n // 8))]
        while len(codes) < n:
            c = list(r.choice(codes))
            for _ in range(r.randrange(0, 9)):
                c[r.randrange(words)] ^= 1 << r.randrange(64)
            codes.append(c)
        codes, groups, node = np.array(codes, np.uint64), np.sort(np.array([r.randrange(3) for _ in range(n)])), np.array(r.sample(range(n), n))
        u, v = near_dedup.stars(groups, node, codes, radius)

        def sets(pairs):
            parent = list(range(n))

            def root(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in pairs:
                parent[max(root(a), root(b))] = min(root(a), root(b))
            return [root(x) for x in range(n)]

        near = [(node[i], node[j]) for i in range(n) for j in range(i) if groups[i] == groups[j] and np.bitwise_count(codes[i] ^ codes[j]).sum() <= radius]
        assert sets(near) == sets(zip(u.tolist(), v.tolist())) and len(u) < n


def test_gray_rank_of_several_words_orders_neighbours():
    codes = [(a << 62, b << 61) for a in range(4) for b in range(8)]
    at = lambda c: tuple(near_dedup.gray_rank(np.array([c], np.uint64))[0].tolist())
    codes.sort(key=at)
    assert all((a[0] ^ b[0]).bit_count() + (a[1] ^ b[1]).bit_count() == 1 for a, b in zip(codes, codes[1:]))


def test_keys_that_reach_over_chunks_are_searched_whole(monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 16)
    r = random.Random(3)
    base = r.getrandbits(63)
    codes = sorted({base ^ (1 << r.randrange(63)) for _ in range(50)}) + [r.getrandbits(63) for _ in range(90)]
    key = [1] * len(codes[:-90]) + sorted(r.randrange(2, 40) for _ in range(90))
    batches = [pa.RecordBatch.from_arrays([pa.array(x[at : at + 7], pa.int64()) for x in (key, range(len(key)), codes)], names=["key", "node", "f0"]) for at in range(0, len(key), 7)]
    got = [set(zip(b.column(0).to_pylist(), b.column(1).to_pylist())) for b in near_dedup._searcher(1, 2)(iter(batches))]
    u, v = near_dedup.stars(np.array(key), np.arange(len(key)), np.array(codes, np.uint64), 2)
    assert len(got) == 1 and got[0] == set(zip(u.tolist(), v.tolist())) and len(u) >= len(codes) - 91


def test_gray_rank_orders_neighbours():
    codes = np.array(sorted(range(64), key=lambda c: int(near_dedup.gray_rank(np.array([c], np.uint64))[0])), np.uint64)
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(codes, codes[1:]))


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140))


@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows_do_not_crash(spark, extra):
    df = documents(spark, ODD, extra)
    assert near_dedup.near_duplicate_classes(df).count() == len(ODD)
    assert substring_dedup.deduplicated(df).count() == len(ODD)
    assert fingerprints.document_fingerprints(df).count() == len(ODD)
    assert mixing.mix(df).count() == len(ODD)


def test_empty_tables(spark):
    df = spark.createDataFrame([], DOCUMENTS)
    for f in (near_dedup.near_duplicate_classes, substring_dedup.deduplicated, fingerprints.document_fingerprints, mixing.mix, mixing.mixed_documents, substring_dedup.stripped_documents):
        assert f(df).collect() == []


# ---- duplicate spans ----
def slow_spans(rows, window=20):
    first, out = {}, {}
    docs = sorted((i, t.encode().split()) for i, t in rows if i is not None and t is not None)
    for i, w in docs:
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (i, p))
    for i, w in docs:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (i, p):
                gone[p : p + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def span_rows():
    r = random.Random(8)
    passage = words(77, 60)
    rows = []
    for i in range(50):
        body = words(1000 + i, r.randrange(0, 200), 40)
        if r.random() < 0.5:
            w, at = body.split(), 0
            p = passage.split()[r.randrange(20) :]
            body = " ".join(w[:at] + p + w[at:])
        rows.append((i, body))
    rows += [(60, "a b " * 60), (61, "a b " * 30), (62, words(1000, 30)), (63, None), (64, "\t".join(passage.split()))]
    return rows


@pytest.mark.parametrize("block", [1 << 10, 12 << 20])
def test_spans_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    rows = span_rows()
    df = documents(spark, rows).repartition(5)
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substring_dedup.deduplicated(df).collect()}
    want = slow_spans(rows)
    assert got.pop(63) == (0, 0, hashlib.sha256(b"").hexdigest())
    assert got == want
    assert sum(x[1] for x in want.values()) > 500


def test_span_hashes_do_not_depend_on_pieces(monkeypatch):
    texts = [words(4, 3000, 30).encode()]
    run = lambda: [b.to_pydict() for b in substring_dedup._parse_block(np.array([1]), np.array([0], np.int32), texts, 20, 6)]
    whole = run()
    monkeypatch.setattr(substring_dedup, "HASH_WORDS", 97)
    assert run() == whole


def test_factors_name_their_sources(spark):
    a = words(5, 50, 10_000)
    rows = [(1, a), (2, "x y z " + a + " q")]
    got = [r.asDict() for r in substring_dedup.factors(documents(spark, rows)).collect()]
    assert sum(f["words"] - 19 for f in got) >= 31 and {f["source_doc"] for f in got} == {1}
    assert all(f["start"] - 3 == f["source_start"] for f in got)


def test_stripped_documents_keep_untouched_texts(spark):
    a = words(5, 50, 10_000)
    got = {r["doc_id"]: r for r in substring_dedup.stripped_documents(documents(spark, [(1, a + " \n"), (2, a), (3, None)])).collect()}
    assert got[1]["text"] == a + " \n" and got[2]["text"] == "" and got[2]["n_chars"] == 0 and got[3]["text"] is None


# ---- fingerprints ----
def test_fingerprints_and_edits(spark):
    rows = [(i, words(i, 30 + i)) for i in range(40)] + [(50, words(3, 33)), (51, None), (52, "ab")]
    got = {r["doc_id"]: r for r in fingerprints.document_fingerprints(documents(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (int(x, 16) for x in (got[i]["fingerprint"], got[i]["edited_fingerprint"], got[order[(k + 1) % len(order)][0]]["fingerprint"]))
        assert got[i]["near_edited"] == 1 - (a ^ b).bit_count() / 64 and got[i]["near_next"] == 1 - (a ^ c).bit_count() / 64
        votes = [0] * 64
        for w in t.split():
            h, weight = xxhash.xxh64_intdigest(w.encode(), 42), 1 + min(len(w), 16) ** 2 // 16
            votes = [v + (weight if h >> n & 1 else -weight) for n, v in enumerate(votes)]
        assert a == sum(1 << n for n, v in enumerate(votes) if v > 0)
    assert got[3]["fingerprint"] == got[50]["fingerprint"]
    assert np.mean([r["near_edited"] - r["near_next"] for r in got.values()]) > 0.1


def test_single_document_follows_itself(spark):
    got = fingerprints.document_fingerprints(documents(spark, [(1, "abcdef")])).first()
    assert got["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and got["near_next"] == 1.0


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_block_tables_find_all_within_the_radius(spark, radius):
    r = random.Random(radius)
    prints = [r.getrandbits(64) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 6))) for p in prints]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(x["a"], x["b"]) for x in fingerprints.near_pairs(spark.createDataFrame([(s,) for s in signed], "fingerprint long"), radius).collect()}
    want = {tuple(sorted((a, b))) for n, a in enumerate(signed) for b in signed[:n] if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
    assert got == want


# ---- mixing ----
def mixing_rows():
    r = random.Random(2)
    rows = [(i, words(i, r.randrange(1, 60)), "en", r.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(600)]
    return rows + [(1000, None, "en", "a"), (1001, "", "en", "empty"), (1002, "x", "en", "z")]


def test_targets_and_takes(spark):
    rows = mixing_rows()
    got = {r["doc_id"]: r for r in mixing.mix(documents(spark, rows, extra=True)).collect()}
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    total = {}
    for i, _, _, s in rows:
        total[s] = total.get(s, 0) + size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(total.values())
    while True:  # excess is shared again until none is above its ceiling
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken = dict.fromkeys(order, 0)
    for i, _, _, s in rows:
        g = got[i]
        assert g["size"] == size[i] and g["source_size"] == total[s] and math.isclose(g["target"], target[s], abs_tol=1e-6)
        assert 0 <= g["taken"] <= 2 * size[i]
        taken[s] += g["taken"]
    assert all(abs(taken[s] - target[s]) <= 60 for s in order)


def test_mix_is_the_same_again_and_matches_its_sql(spark):
    df = documents(spark, mixing_rows())
    columns = ["doc_id", "size", "source_size", "target", "taken", "shards"]
    a = mixing.mix(df).select(*columns).toPandas().sort_values("doc_id").reset_index(drop=True)
    b = mixing.mix(df.repartition(7)).select(*columns).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert a.equals(b)
    db = duckdb.connect()
    db.register("documents", df.toPandas().astype({"text": "string", "source": "string"}))
    c = db.execute(mixing.ORACLE).df()[columns].sort_values("doc_id").reset_index(drop=True)
    assert a["shards"].tolist() == c["shards"].tolist()
    assert np.allclose(a[columns[:-1]].to_numpy(float), c[columns[:-1]].to_numpy(float))


def test_mixed_documents_repeat_what_is_taken(spark):
    df = documents(spark, mixing_rows())
    want = {r["doc_id"]: r["times"] for r in mixing.mix(df).collect() if r["times"]}
    got = {r["doc_id"]: r["count"] for r in mixing.mixed_documents(df).groupBy("doc_id").count().collect()}
    assert got == want and mixing.mixed_documents(df).columns == df.columns


def test_the_tree_splits_quotas_evenly(spark):
    """Shards get as many blocks as each other, all blocks of every source are split, and no shard gets a share of a source
    that is far from the expected one (5 standard deviations of the hypergeometric draw)."""
    quota = {f"s{s}": n for s, n in enumerate((900, 300, 100, 20, 1, 0))}
    got = mixing.split_quotas(spark.createDataFrame(list(quota.items()), "_source_key string, _quota long"), 6).collect()
    total = sum(quota.values())
    size = [sum(r["_n"] for r in got if r["shard"] == k) for k in range(6)]
    assert max(size) - min(size) <= 3 and sum(size) == total
    for s, n in quota.items():
        mine = {r["shard"]: r["_n"] for r in got if r["_source_key"] == s}
        assert sum(mine.values()) == n
        p = n / total
        for k in range(6):
            assert abs(mine.get(k, 0) - n / 6) <= 5 * max(1.0, (n / 6 * (1 - p)) ** 0.5)


def test_a_document_is_in_as_many_shards_as_it_is_taken(spark):
    rows = mixing.mix(documents(spark, mixing_rows())).collect()
    assert any(r["times"] == 2 for r in rows) and len({s for r in rows for s in r["shards"].split(",") if s}) == mixing.SHARDS
    for r in rows:
        assert len([s for s in r["shards"].split(",") if s]) == r["times"] and r["taken"] == r["size"] * r["times"]


def test_rows_without_an_id_are_dealt_by_text(spark):
    """Null ids of one source spread over blocks; its words still come within a document of the target."""
    rows = [(None, "w " * (1 + i % 7) + f"x{i}", "en", "a") for i in range(300)] + [(i, "y z " * 40, "en", "b") for i in range(50)]
    got = mixing.mix(documents(spark, rows)).collect()
    mine = [r for r in got if r["doc_id"] is None]
    assert len({r["place"] for r in mine}) == 300
    assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 8
