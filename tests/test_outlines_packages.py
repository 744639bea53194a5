"""Outlines with their scopes, packages that can be installed, literals in replies."""

from __future__ import annotations

import ast
import json

import pytest
from pyspark.sql import functions as F

from loomwright.functions import parsing
from loomwright.operators import installable, views

CODE = '''import os

class A(Base):
    """About."""

    def __init__(self):
        self.x = 1
        if self.x:
            for y in z:
                total = Sum(y)
                print(total)
                print(total)
                print(total)
        return None

    def short(self):
        a = 1
        return a


def other():
    return 2'''


def outline(spark, budget, count=None):
    return spark.createDataFrame([(CODE,)], "c string").select(views.scoped_outline(F.col("c"), budget, *([count] if count else []))).first()[0].split("\n")


def test_every_kept_line_stands_in_its_scopes(spark):
    wide = outline(spark, 10_000)
    assert wide == [
        '│import os',
        '│',
        '│class A(Base):',
        '⋮',
        '│    def __init__(self):',
        '│        self.x = 1',
        '│        if self.x:',
        '│            for y in z:',
        '│                total = Sum(y)',
        '⋮',
        '│    def short(self):',
        '│        a = 1',
        '⋮',
        '│def other():',
        '⋮',
    ]
    kept = [x for x in wide if "total = Sum" in x or "if self.x" in x or "for y in z" in x]
    assert len(kept) == 3 and not any("print" in x for x in wide)
    # at the second level small scopes are whole, at the third they are not
    size = lambda text: F.length(text)
    levels = [views._scoped(CODE, k) for k in (1, 2, 3)]
    assert "return a" in levels[1] and "return 2" in levels[1] and "return a" not in levels[2] and "total = Sum" in levels[2]
    assert outline(spark, len(levels[2]), size) == levels[2].split("\n") and outline(spark, 1, size) == levels[2].split("\n")


def test_outlines_of_odd_texts(spark):
    rows = spark.createDataFrame([(None,), ("",), ("\n\n",), ("no code at all",), ("\tdef f():\n\t\treturn",)], "c string")
    assert [r[0] for r in rows.select(views.scoped_outline(F.col("c"))).collect()] == [None, "⋮", "⋮", "⋮", "│\tdef f():\n⋮"]


def test_installable_packages(spark):
    texts = ["No module named 'a.b'", "No module named 'built'", "No module named 'here'", "No module named '.rel'", "No module named 'odd'", "No module named 'a'", "nothing"]
    df = spark.createDataFrame([(i, f"ModuleNotFoundError: {t}") for i, t in enumerate(texts)] + [(90, None), (91, "")], "id long, text string")
    known = spark.createDataFrame([("built", "builtin"), ("here", "local"), ("have", "installed"), ("odd", "unheard of")], "name string, kind string")
    got = lambda lookup: {(r["id"], r["package"]) for r in installable.installable(df, "id", "text", known, lookup).collect()}
    assert got(lambda names: [n == "a" for n in names]) == {(0, "a.b"), (5, "a")}
    assert got(lambda names: 1 / 0) == set() and got(lambda names: []) == set()
    assert got(lambda names: [True] * len(names)) == {(0, "a.b"), (5, "a"), (4, "odd")}


@pytest.mark.parametrize("text", [
    "{'a': 1, 'b': [True, None, -2.5], 'c': (1, 'x'), \"d\": 'it\\'s \\u00e9\\n'}", "[1, 2, 3,]", "'text'", "{'k': {'n': 'v,w'}, }", "{}", "[]", "{1: 'a', 'b': 2}", "['a', {'b': [[]]}]",
])
def test_literals_as_json(text):
    want = json.loads(json.dumps(ast.literal_eval(text)))
    assert json.loads(parsing.literal_as_json(text)) == want and parsing.reply(text) == want and parsing.reply(f"```python\n{text}\n```") == want


def test_replies_that_are_no_literal():
    assert parsing.reply('{"a": 1}') == {"a": 1}
    assert parsing.reply("name: x, size: 3\nok: True") == {"name": "x", "size": 3, "ok": True}
    assert parsing.reply(None) == {} and parsing.reply("words alone") == {} and parsing.reply("a: [1") == {"a": "[1"}
    with pytest.raises(parsing.NotALiteral):
        parsing.literal_as_json("name(1)")
