"""The recursive splitter against a plain recursion."""

from __future__ import annotations

import random

import pytest

from loomwright.operators import splitter


def plain(text, size, overlap, separators):
    """Pieces are put together one by one, as lists of strings."""
    for n, sep in enumerate(separators):
        if not sep or sep in text:
            break
    else:
        return [text]
    rest = separators[n + 1 :]
    if sep:
        first, *others = text.split(sep)
        pieces = [p for p in [first, *[sep + o for o in others]] if p]
    else:
        pieces = list(text)
    out, short = [], []

    def put_together():
        held = []
        for p in short:
            if held and sum(map(len, held)) + len(p) > size:
                out.append("".join(held))
                while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(p) > size):
                    held.pop(0)
            held.append(p)
        if held:
            out.append("".join(held))
        short.clear()

    for p in pieces:
        if len(p) < size:
            short.append(p)
            continue
        put_together()
        out.extend(plain(p, size, overlap, rest) if rest else [p])
    put_together()
    return out


def random_text(r):
    word = lambda: "".join(r.choice("abcé漢") for _ in range(r.choice([1, 3, 8, 60])))
    return "".join(word() + r.choice([" ", " ", " ", "\n", "\n\n", "\n\n\n", "  ", ""]) for _ in range(r.randrange(0, 80)))


@pytest.mark.parametrize("separators", [splitter.SEPARATORS, ("\n\n", " "), (". ", "")])
@pytest.mark.parametrize("size,overlap", [(2, 0), (10, 3), (40, 39), (40, 0), (200, 50)])
def test_spans_are_those_of_the_plain_recursion(separators, size, overlap):
    r = random.Random(size)
    for text in [random_text(r) for _ in range(60)] + ["", " ", "\n\n", "x" * 500, "\n\nx", "x\n\n", "a b " * 100]:
        want = [c for x in plain(text, size, overlap, list(separators)) if (c := x.strip())] if text else []
        got = splitter.split(text, size, overlap, separators)
        assert [g["chunk"] for g in got] == want
        assert all(g["chunk"] in text[g["start"] : g["start"] + max(size, len(text))] for g in got)
        if separators[-1] == "":
            assert all(len(g["chunk"]) <= size for g in got)


def test_texts_of_any_kind_as_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "w" * 5000), (5, "para one\n\npara two"), (5, "para one\n\npara two")]
    df = spark.createDataFrame([(*x, "c") for x in rows], "id long, t string, chunk string")
    got = splitter.recursive_chunks(df, ["id"], "t", 12, 4).collect()
    assert {r["id"] for r in got} == {4, 5} and sum(r["id"] == 5 for r in got) == 4
    assert [r["chunk"] for r in sorted((r for r in got if r["id"] == 4), key=lambda r: r["chunk_pos"])] == ["w" * 12] * 624 + ["w" * 8]
    with pytest.raises(ValueError):
        splitter.recursive_chunks(df, ["id"], "t", 10, 10)
