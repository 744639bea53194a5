"""Byte-level BPE against the tiktoken library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from loomwright.llm import bpe  # noqa: E402

from .tables import DOCUMENTS, ODD, documents, words  # noqa: E402

PATH = public.path("byte_bpe_50k.tiktoken")
CODER = bpe.tokenizer(PATH)
EXACT = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=CODER.ranks, special_tokens={})


def check(texts):
    for text, (ids, n, back) in zip(texts, CODER.encode_block(texts)):
        want = EXACT.encode_ordinary(text)
        assert [int(x) for x in b" ".join(ids).split()] == want and n == len(want), text
        assert b"".join(back) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abst'relvmd 1²٣\t\n\r\x0b\x1c\x85\xa0  .!?_-é漢😀", max_size=40), min_size=1, max_size=6))
def test_any_text(texts):
    check(texts)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_unicode(text):
    check([text])


def test_long_pieces_and_texts(monkeypatch):
    r = random.Random(1)
    check(["a" * 5000, "".join(r.choice("abcdefgh") for _ in range(4000)), words(1, 3000)])
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    text = words(2, 400) + "\n\n  " + "x" * 300 + "  it's"
    parts = list(bpe.segments(text))
    assert "".join(parts) == text and len(parts) > 5
    got = [int(x) for _, ids, _ in bpe.encode_texts(CODER, [text.encode()]) for x in b" ".join(ids).split()]
    assert got == EXACT.encode_ordinary(text)


def test_heap_and_query_agree():
    pieces = [w.encode() for w in {w for k in range(30) for w in words(k, 20, 10**6).split()}] + [b"supercalifragilistic", b"\xff\xfe\x00"]
    assert [CODER._contract_long(p) for p in pieces] == CODER._contract(pieces)


def test_decode():
    text = "it's 12 äö 漢字\n\n ok"
    assert CODER.decode(EXACT.encode_ordinary(text)) == text.encode() and CODER.decode([]) == b""
    with pytest.raises(ValueError):
        CODER.decode([999_999])


def test_documents(spark):
    rows = [(i, t) for i, t, *_ in ODD]
    got = sorted(bpe.encoded_digests(documents(spark, ODD, extra=True)).collect(), key=str)
    want = []
    for i, t in rows:
        ids = EXACT.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encoded_digests(spark.createDataFrame([], DOCUMENTS)).collect() == []


def test_round_trip_of_documents(spark):
    df = documents(spark, ODD)
    encoded = bpe.encoded_documents(df)
    assert sorted((bytes(r["text"]).decode() for r in bpe.decoded_documents(encoded).collect())) == sorted((t or "") for _, t, *_ in ODD)
    assert all(r["n_tokens"] == len(r["ids"]) for r in encoded.collect())


def test_pieces_with_equal_keys_are_told_apart(monkeypatch):
    texts = "aa bb aa cc bb dd".split()
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    stops = np.cumsum([len(t) for t in texts])
    starts = stops - 2

    def check():
        sample, which = bpe.distinct_pieces(joined, codes, starts, stops)
        assert [texts[sample[w]] for w in which] == texts and len(sample) == 4

    check()
    unique = np.unique
    # all keys alike, as if every piece collided
    monkeypatch.setattr(bpe.np, "unique", lambda x, **k: unique(np.zeros_like(x) if x.dtype == np.uint64 else x, **k))
    check()


def test_order_of_rows_plays_no_part():
    """Token rows come in any order: positions alone say which tokens are neighbours and how they are joined."""
    import numpy as np
    import pyarrow as pa

    tok = bpe.Tokenizer(bpe.read_ranks(public.path("byte_bpe_50k.tiktoken")))
    pieces = [b" unbelievably", b" xyzzyqq", b"aaaaaaaaaaaaaaa", b" antidisestablishment"]
    want = tok._contract(pieces)
    text = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = [len(p) for p in pieces]
    wp = np.concatenate([(w << 10) | np.arange(n) for w, n in enumerate(lengths)])
    mixed = np.random.default_rng(3).permutation(len(wp))
    tok.db.register("tok", pa.table({"wp": wp[mixed], "id": tok.byte_ids[text][mixed]}))
    tok.db.execute(f"CREATE OR REPLACE TEMP TABLE ended AS {bpe.CONTRACT}")
    got = tok.db.execute(bpe.GATHER).fetchall()
    assert [(i.encode(), n, bytes.fromhex(d)) for _, i, n, d in got] == want


def test_pieces_are_gathered_without_a_join(monkeypatch):
    """Texts and bytes came from a join of all tokens with the vocabulary and two ordered aggregations of strings."""
    tok = bpe.Tokenizer(bpe.read_ranks(PATH))
    tok.db.execute("DROP TABLE vocabulary")
    pieces = [b" unbelievably", b"\xff\xfe\x00", b"aaaaaaaaaaaaaaa"]
    assert tok._contract(pieces) == [CODER._contract_long(p) for p in pieces]
    # a token that decodes to something else is seen
    tok.bytes = tok.bytes.slice(1)
    with pytest.raises(RuntimeError):
        tok._contract(pieces)
