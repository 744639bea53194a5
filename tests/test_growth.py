"""What must not grow: tasks take bounded shares of the rows, costly steps run once."""

from __future__ import annotations

import ast
import gc

import pytest

from loomwright.operators import entities as E
from loomwright.plans import explorer_queries as X
from loomwright.plans import registry


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A small part table in one file."""
    folder = str(tmp_path_factory.mktemp("parts"))
    spark.range(5000).selectExpr("id p_partkey", "'Brand' || id % 7 p_brand", "cast(id % 5 as int) p_size").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_modules_of_one_file_are_dealt_to_several_tasks(spark, parts):
    """grf_15, prj_05, prj_22, src_02_prj_02 and the others that parse: one file was one task, however many modules it held."""
    assert X.modules(spark, parts).rdd.getNumPartitions() == 3
    found = X.entities(spark, parts)
    assert found.count() == 30000 and found.rdd.getNumPartitions() == 3


def test_collector_rests_while_modules_are_parsed(monkeypatch):
    """The function that a task runs, called here: trees are parsed with the collector off, which is on again afterwards."""
    import pyarrow as pa

    class Rows:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return run

    states, parse = [], E.parse
    monkeypatch.setattr(E, "parse", lambda m, c: states.append(gc.isenabled()) or parse(m, c))
    batch = pa.RecordBatch.from_pydict({"module_id": ["m"] * 600, "content": ["import a"] * 600})
    assert [b.num_rows for b in E.extract(Rows())(iter([batch]))] == [1024, 176]
    assert gc.isenabled() and not any(states) and len(states) == 600


def test_nodes_are_those_of_walk():
    source = "@d(f(1))\nclass A(b.B):\n    def f(self, x=g()):\n        match x:\n            case True: return h(y := i())\n        global z\nasync def k(): await m(f'{n():>{o()}}')\n"
    tree = ast.parse(source)
    assert E._nodes(tree) == [n for n in ast.walk(tree) if type(n) not in E._LEAVES]


def test_last_of_equal_ids_counts(spark):
    rows = E.extract(spark.createDataFrame([("m", "def f(): a()\ndef f(): b()\n")], "module_id string, content string"))
    assert [c["name"] for c in E.latest(rows, "function").first()["calls"]] == ["b"]


def test_inheritance_of_dealt_modules(spark, parts):
    got = registry.queries()["grf_15"](spark, parts)
    assert got.count() == got.distinct().count() == 10000


@pytest.mark.parametrize("name", ["jn_01_02", "jn_07", "jn_08", "prj_11_13", "ret_07"])
def test_modules_are_parsed_once(spark, parts, name):
    """A query that reads entities several times reads a stored table: its plan parses nothing."""
    assert "MapIn" not in plan(registry.queries()[name](spark, parts))


def test_package_errors_are_those_of_a_plain_search(spark):
    """Texts of pieces in random order against the patterns as they stand; a text is searched only for what it holds."""
    import random
    import re

    from loomwright.functions import text as T

    pieces = ["\n", "\r", " ", "x", "a requires b", "A REQUIRES ", "1, but ", "2 is installed", ", which is not installed", "old 1.0 is incompatible with new 2", "ImportError: ", "/site-packages/p/q.py", "File '", "', line 3", "SyntaxError", "No module named 'z'", "cannot import name 'c' from 'd'", ": why"]
    draw = random.Random(7)
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(1, 14))) for _ in range(1500)] + list(map(str.upper, X.ERROR_TEXTS.values())) + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = sorted((r["key"], r["ord"], r["error_type"], r["match_text"], tuple(r["details"][g] for g in T.PACKAGE_ERRORS[r["error_type"]][1])) for r in T.package_errors(rows, "key", "text").select("key", "ord", "error_type", "match_text", "details").collect())
    wanted = []
    for key, t in enumerate(texts):
        each = [(n, m) for n, (p, _, _) in T.PACKAGE_ERRORS.items() for m in re.finditer(p, t or "", re.I | re.M | re.A)]
        wanted += [(key, k, n, m[0], m.groups()) for k, (n, m) in enumerate(each)]
    assert len(wanted) > 500 and got == sorted(wanted)


def test_a_long_line_is_searched_once(spark):
    """Each place of a line was tried with all that follows it: this took minutes."""
    import time

    from loomwright.functions import text as T

    rows = spark.createDataFrame([(1, "1, but 2 is installed, which is not installed\n" + "a requires " * 1500)], "key long, text string")
    began = time.monotonic()
    assert T.package_errors(rows, "key", "text").count() == 0
    assert time.monotonic() - began < 30


def test_error_texts_are_dealt(spark, tmp_path):
    spark.range(40000).selectExpr("id event_id").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert X.error_texts(spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_hybrid_search_builds_its_texts_once(spark, parts, monkeypatch):
    """Pivots, cells, counts and postings of ret_07_hybrid each parsed all modules again."""
    from loomwright.operators import postings, vector_store

    read = []

    class Seen(Exception):
        pass

    def filed(self, rows, *names):
        read.append(plan(rows))

    def indexed(self, docs, *names):
        read.append(plan(docs))
        raise Seen

    monkeypatch.setattr(vector_store.VectorStore, "append", filed)
    monkeypatch.setattr(postings.Postings, "append", indexed)
    with pytest.raises(Seen):
        registry.queries()["ret_07_hybrid"](spark, parts)
    assert len(read) == 2 and not any("MapIn" in p or "Join" in p for p in read)


def test_postings_move_texts_once_and_postings_once(spark, tmp_path):
    """ret_02_stored: every (document, word) moved too, and all postings twice."""
    from loomwright.operators import postings

    index, kept = postings.Postings(spark, f"{tmp_path}/p", 64), []
    index.store.transact = lambda work: kept.append(work(None))
    index.append(spark.range(500).selectExpr("id doc", "concat('a b w', id) text"), "doc", "text")
    rows = kept[0]["postings"].rows
    assert plan(rows).count("Exchange hashpartitioning") == 2
    assert rows.filter("term = ''").agg({"n": "sum"}).first()[0] == 500


@pytest.mark.parametrize("name, unread", [
    ("prj_03_04", "calls docstring bases import_name last_line"), ("prj_05", "docstring bases parameters import_name last_line"), ("prj_06_12_txt_17", "calls docstring bases parameters last_line"),
    ("prj_14_function", "calls bases import_name"), ("src_02_prj_02", "calls parameters import_name last_line"), ("grf_15", "calls docstring parameters import_name last_line"),
])
def test_what_a_query_does_not_read_is_not_made(spark, parts, name, unread):
    """Every query made and moved all columns of all kinds of entities, calls among them."""
    made = plan(registry.queries()[name](spark, parts))
    assert "MapInArrow" in made and not [c for c in unread.split() if f"{c}#" in made]


def test_overview_counts_narrow_rows(spark, parts, monkeypatch):
    """prj_22 made all columns of all rows to count them."""
    named = {"region": "0 r_regionkey, 'A' r_name", "nation": "0 n_nationkey, 0 n_regionkey, 'B' n_name"}
    made, extract, table = [], E.extract, X.table
    monkeypatch.setattr(X, "table", lambda s, d, name: s.sql(f"SELECT {named[name]}") if name in named else table(s, d, name))
    monkeypatch.setattr(X.E, "extract", lambda *a: made.append(extract(*a)) or made[0])
    assert "Total functions: 10000\n" in registry.queries()["prj_22"](spark, parts).first()["text"]
    assert made[0].columns == [*E.ALWAYS, "last_line"]


@pytest.mark.parametrize("name, unread", [
    ("prj_11_13", "calls bases import_name source"), ("prj_14_class", "calls import_name"), ("jn_07", "docstring parameters last_line"), ("jn_08", "docstring parameters last_line"),
])
def test_what_a_query_does_not_read_is_not_stored(spark, parts, monkeypatch, name, unread):
    stored, keep = {}, X.durable
    monkeypatch.setattr(X, "durable", lambda df, label: stored.setdefault(label, df) and keep(df, label))
    registry.queries()[name](spark, parts)
    assert not set(unread.split()) & set(stored["entities"].columns)


def test_saved_entities_are_parsed_for_their_kinds(spark, parts, monkeypatch):
    """snk_01: rows of modules and errors were stored and read again, which no sink takes."""
    stored, keep = {}, X.durable
    monkeypatch.setattr(X, "durable", lambda df, label: stored.setdefault(label, keep(df, label)))
    registry.queries()["snk_01"](spark, parts)
    assert {r["kind"] for r in stored["entities"].select("kind").distinct().collect()} == {"class", "function", "import", "importfrom"}


def test_rows_are_the_same_whatever_is_asked_for():
    source = "import os\nif x:\n    def f(a: int): g(a)\nelse:\n    class A(b.B):\n        'doc'\n        def f(self): return h()\ntry: pass\nexcept E:\n    def k(): pass\nmatch x:\n    case 1:\n        async def n():\n            def inner(): pass\nfrom p import (q as r, s)\n"
    whole = E.parse("m", source)
    assert [r["name"] for r in whole if r["kind"] in ("class", "function")] == [n.name for n in ast.walk(ast.parse(source)) if isinstance(n, (ast.ClassDef, ast.FunctionDef))]
    for kinds in (["class"], ["function"], ["import", "importfrom"], ["module", "class"]):
        for fields in (E.ALWAYS, [*E.ALWAYS, "calls", "name"], [*E.ALWAYS, "docstring", "parameters", "source"]):
            got = E.parse("m", source, frozenset(kinds), frozenset(fields))
            assert [{f: r.get(f) for f in fields if f != "source"} for r in got] == [{f: r.get(f) for f in fields if f != "source"} for r in whole if r["kind"] in kinds]
    assert [r["source"] for r in E.parse("m", source, frozenset(["function"]), frozenset(["source"]))][0] == "    def f(a: int): g(a)"


def test_outlines_look_at_a_line_once(spark):
    """prj_14_function, prj_14_class, prj_21: each line split the whole text again; 3,000 lines took minutes."""
    import random
    import re
    import time

    from pyspark.sql import functions as F

    from loomwright.operators import views

    draw = random.Random(5)
    lines = ["def f():", "    x = Y", "    y = 1", "    pass", "", "import a", "    z()", "⋮ no", "    __init__", "from b import c"]
    texts = ["\n".join(draw.choice(lines) for _ in range(draw.randint(0, 120))) for _ in range(60)] + ["", "\n", "\n\n"]

    def plain(text, keep):
        out = []
        for i, x in enumerate(text.split("\n")):
            if keep(x, i):
                out.append(x)
            elif not i or out[-1] != views.GAP:
                out.append(views.GAP)
        return "\n".join(out)

    wide = [plain(t, lambda x, i: re.match(views.STRUCTURE, x) or re.match(views.ASSIGNED, x)) for t in texts]
    narrow = [plain(t, lambda x, i: re.match(views.DEFINED, x) or re.match(views.CONSTANT, x) or "__init__" in x or (i < views.IMPORT_LINES and re.match(views.IMPORTED, x))) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, c string")
    got = rows.select("i", views.outline(F.col("c"), 10**6).alias("w"), views.outline(F.col("c"), -1).alias("n")).orderBy("i").collect()
    assert [r["w"] for r in got] == wide and [r["n"] for r in got] == narrow
    long = spark.createDataFrame([("\n".join(lines * 600),)], "c string")
    began = time.monotonic()
    assert long.select(F.size(F.split(views.outline(F.col("c"), 100), "\n")).alias("n")).first()["n"] > 100
    assert time.monotonic() - began < 20


def test_views_of_modules_evaluate_an_outline_once(spark, parts):
    """prj_21 and prj_14_function: the outline stood in the plan wherever its size or its text was asked for."""
    assert plan(registry.queries()["prj_21"](spark, parts)).count("regexp_replace") <= 3
    assert plan(registry.queries()["prj_14_function"](spark, parts)).count("regexp_replace") <= 3


def test_found_texts_are_stored_once(spark, parts, monkeypatch):
    """ret_07 joined functions to themselves and to all modules, made again, at each of its readings."""
    stored, keep = {}, X.durable
    monkeypatch.setattr(X, "durable", lambda df, label: stored.setdefault(label, df) and keep(df, label))
    assert "Join" not in plan(X.function_texts(spark, parts))
    registry.queries()["ret_07"](spark, parts)
    assert list(stored) == ["code-texts"] and stored["code-texts"].columns == ["id", "text"]


def test_calls_are_resolved_from_functions_sorted_once(spark):
    """jn_07, jn_08: each of eight rules sorted all functions for the last of equal ids; jn_07 resolved all calls for those of one class."""
    from pyspark.sql import functions as F

    from loomwright.operators import resolve

    modules = spark.createDataFrame([("m", "class A:\n    def f(self): g()\ndef g(): a.b.h()\ndef h(): g()\n")], "module_id string, content string")
    e = E.extract(modules).cache()
    edges = resolve.call_edges(e)
    assert plan(edges).count("Window") < 8
    assert {tuple(r) for r in edges.collect()} == {("m.A.f", "m.g"), ("m.h", "m.g")}
    assert {tuple(r) for r in resolve.call_edges(e, F.col("id").startswith("m.A.")).collect()} == {("m.A.f", "m.g")}


def test_statements_alone_make_the_tree_of_a_whole_parse(monkeypatch):
    """prj_22 and all that parse: every module made the nodes of all its lines, though most lines repeat."""
    import random

    pieces = ["x = 1", "x = 1", "f(a)", "# c", "", "import os; y = 2", "from p import (q,\n  r)", "@d", "def f(a, b: int) -> str:", "class A(B, c.D):", "    '''t'''", '    """t', 'u"""', "    return g(x)", "    if x: y()", "    else:", "        pass", "  z", "async def k():", "    x = [", "    ]", "try: a()", "finally: b()", "match x:", "    case 1: h()", "def g(): return 1", "x = '\\", "\tp", "def h(): x:", "if x:\n    import b\n    def i(): j()", "class E: pass", "y = (", ")", "lambda:", "lambda: pass", "case (x): y", "a; b;", "0" * 200]
    draw, made = random.Random(8), 0
    for _ in range(4000):
        source = "\n".join(draw.choice(pieces) for _ in range(draw.randint(1, 5)))
        try:
            whole = ast.parse(source)
        except SyntaxError:
            whole = None
        odd = any(x in source for x in E._ODD) or source[-1:] == "\\"
        try:
            tree = None if odd else E._Pieces(source.split("\n")).tree()
        except SyntaxError:
            continue
        if tree:
            made += 1
            assert whole and ast.dump(tree) == ast.dump(whole)
            spot = lambda t: [(n.lineno, n.end_lineno) for n in ast.walk(t) if isinstance(n, (ast.Import, ast.ImportFrom, ast.ClassDef, ast.FunctionDef))]
            assert spot(tree) == spot(whole)
    assert made > 200
    parsed, parse = [], ast.parse
    monkeypatch.setattr(E.ast, "parse", lambda text: parsed.append(text) or parse(text))
    source = "def f(a):\n" + "    a = a + 17\n" * 50 + "    return a\n"
    assert [r["last_line"] for r in E.parse("m", source, frozenset(["function"]))] == [52]
    assert "".join(parsed).count("a = a + 17") == 1


def test_searched_texts_are_split_once(spark):
    """ret_07: the words of all texts were made for statistics, for how many have a term, and for scores."""
    from loomwright.operators import retrieval

    docs = spark.createDataFrame([(1, "run helper run"), (2, "a b c"), (3, "helper")], "id long, text string")
    found = retrieval.bm25(docs, "id", "text", {0: "helper run"})
    assert "regexp_extract_all" not in plan(found)
    assert [r["id"] for r in found.orderBy("rank").collect()] == [1, 3]


def test_lines_of_a_known_shape_are_not_parsed_again(monkeypatch):
    """prj_06_12_txt_17 and all that parse: lines that differ in names alone were parsed for every module."""
    import random

    draw, lines = random.Random(3), ["import {0}", "from {0}.match import {1} as {2}, {3}", "{0}.{1} = {2}({3}, {1}={0}.{2}())", "{0} = lambda {1}, *{2}: {1}({3})", "if {0}: {1}()", "global {0}, {1}", "{0} = 0x1F + 1e5 if not {1} else None  # {2}", "print({0}); {1}[{2}:{3}]({0})"]
    heads = ["def {0}({1}, {2}: {3}.{0} = {1}) -> {2}[{3}]:", "class {0}({1}, {2}.{3}, metaclass={0}):", "async def {0}(): pass", "def {0}(): {1}()"]
    for _ in range(300):
        name = lambda text: text.format(*[draw.choice("a b n0 n1 type _ e5 Match xor is_".split()) for _ in range(4)])
        body = [x for _ in range(4) for head in [name(draw.choice(heads))] for x in [head, *([f"    {name(draw.choice(lines))}" for _ in range(3)] if head[-1] == ":" else [])]]
        source = "\n".join([*body, *[name(x) for x in lines[:3]], "x = 1"])
        tree, whole = E._Pieces(source.split("\n")).tree(), ast.parse(source)
        assert ast.dump(tree) == ast.dump(whole)
        spot = lambda t: [(n.lineno, n.end_lineno) for n in ast.walk(t) if isinstance(n, (ast.Import, ast.ImportFrom, ast.ClassDef, ast.FunctionDef))]
        assert spot(tree) == spot(whole)
    parsed, parse = [], ast.parse
    monkeypatch.setattr(E.ast, "parse", lambda text, *more: parsed.append(text) or parse(text, *more))
    for k in range(5):
        rows = E.parse(f"m{k}", f"from p{k} import q{k}\nclass C{k}(B{k}):\n    def run{k}(self):\n        g{k}(self.h{k})\n" + "        z += 1\n" * 30)
        assert [(r["id"], r["bases"]) for r in rows if r["kind"] == "class"] == [(f"m{k}.C{k}", [f"B{k}"])]
        assert [(r["id"], [c["name"] for c in r["calls"]]) for r in rows if r["kind"] == "function"] == [(f"m{k}.C{k}.run{k}", [f"g{k}"])]
        assert [(r["import_module"], r["import_name"], r["first_line"]) for r in rows if r["kind"] == "importfrom"] == [(f"p{k}", f"q{k}", 1)]
    assert not any(f"{x}{k}" in "".join(parsed) for x in ("p", "C", "run", "g") for k in (2, 3, 4))


def test_structures_come_without_joins(spark, parts):
    """prj_11_13: three sorts of the stored rows and two joins put together what the ids of a class and its methods say."""
    from loomwright.operators import views

    assert "Join" not in plan(registry.queries()["prj_11_13"](spark, parts))
    source = '"""D"""\nclass A:\n    "E\\nF"\n    def f(self): pass\n    def g(self, x: int):\n        "G"\ndef f(): pass\nclass B: pass\nclass A:\n    def f(self, y): pass\n'
    got = views.structures(E.extract(spark.createDataFrame([("m", source), ("n", ""), ("o", "def f(:")], "module_id string, content string")))
    text = "### Module: m\n'''D'''\n\nclass A:\n    def f(self, y):\n    def g(self, x: int):\n        # G\n\nclass B:\n    pass\n\ndef f():"
    found = {r["module_id"]: r["structure"] for r in got.collect()}
    assert sorted(found) == ["m", "n"] and found["n"] == "### Module: n"
    assert sorted(found["m"].split("\n")) == sorted(text.split("\n")) and found["m"].index("class B") < found["m"].index("class A") < found["m"].index("def f():")


def test_class_details_come_without_joins(spark, parts, monkeypatch):
    """prj_14_class: the texts of all functions were stored, and classes joined with their methods."""
    stored, keep = {}, X.durable
    monkeypatch.setattr(X, "durable", lambda df, label: stored.setdefault(label, keep(df, label)))
    assert "Join" not in plan(registry.queries()["prj_14_class"](spark, parts))
    assert {r["kind"] for r in stored["entities"].filter("source is not null").select("kind").distinct().collect()} == {"class"}


def test_calls_of_a_target_are_those_of_all_calls(spark):
    """jn_08: all calls of all modules were resolved for those from and to one class."""
    from loomwright.operators import resolve

    rows = [("m", "import n\nclass A:\n    def f(self): g()\ndef g():\n    A.f()\n    n.h()\n    x.m.A.f()\n    m.A.f()\n"), ("n", "from m import A, g as k\ndef h(): A.f(); g()\nclass B(m.A):\n    def i(self): f()\n"), ("p", "from n import h\ndef q(): h()\n")]
    e = E.extract(spark.createDataFrame(rows, "module_id string, content string")).cache()
    whole = {tuple(r) for r in resolve.call_edges(e).collect()}
    for target in ("m.A", "m.A.f", "n.h", "n.B"):
        own = lambda x: x == target or x.startswith(f"{target}.")  # noqa: E731, B023
        got = {tuple(r) for r in resolve.call_edges(e, target=target).collect()}
        assert got == {x for x in whole if own(x[0]) or own(x[1])} and got and got != whole
