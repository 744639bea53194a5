"""Entities, resolution and navigation over small generated repositories."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomwright.operators import entities, resolve, scoring
from loomwright.sources import files

SOURCES = {
    "pkg.base": 'class Base:\n    """A base."""\n    def run(self):\n        return self.go()\n    def go(self):\n        pass\n',
    "pkg.work": (
        "import os\nfrom pkg.base import Base\nfrom pkg.util import helper as h, other\nimport pkg.util as u\n\n\n"
        "class Child(Base):\n    def act(self, n: int, m: List[str]) -> dict:\n        run()\n        Base.go(self)\n        local()\n        return other()\n\n\n"
        "def local():\n    def inner():\n        pass\n    inner()\n    u.helper()\n    pkg.util.other()\n\n\nasync def ignored():\n    local()\n"
    ),
    "pkg.util": "def helper():\n    return other()\n\n\ndef other():\n    pass\n\n\ndef other():\n    return 2\n",
    "broken": "def f(:\n",
}


@pytest.fixture(scope="module")
def parsed(spark):
    modules = spark.createDataFrame(list(SOURCES.items()), "module_id string, content string")
    return modules, entities.extract(modules).cache()


def test_rows_of_each_kind(parsed):
    _, e = parsed
    ids = lambda kind: {r["id"] for r in entities.latest(e, kind).collect()}
    assert ids("class") == {"pkg.base.Base", "pkg.work.Child"}
    assert ids("function") == {"pkg.base.Base.run", "pkg.base.Base.go", "pkg.work.Child.act", "pkg.work.local", "pkg.work.inner", "pkg.util.helper", "pkg.util.other"}
    assert [r["module_id"] for r in e.filter("kind = 'error'").collect()] == ["broken"]


def test_parameters_and_calls(parsed):
    _, e = parsed
    act = entities.latest(e, "function").filter("id = 'pkg.work.Child.act'").first()
    assert [(p["name"], p["type"]) for p in act["parameters"]] == [("self", None), ("n", "int"), ("m", "List[str]")] and act["return_type"] == "dict"
    assert [(c["type"], c["name"] or c["attribute"]) for c in act["calls"]] == [("simple", "run"), ("attribute", "go"), ("simple", "local"), ("simple", "other")]


def test_last_of_equal_ids_counts(parsed):
    modules, e = parsed
    last = entities.latest(e, "function").filter("id = 'pkg.util.other'")
    assert entities.sources(last, modules).first()["source"] == "def other():\n    return 2"


def test_imports(parsed):
    _, e = parsed
    got = {(r["type"], r["module"], r["name"], r["alias"]) for r in entities.imports(e).filter("module_id = 'pkg.work'").collect()}
    assert got == {("import", None, "os", None), ("importfrom", "pkg.base", "Base", None), ("importfrom", "pkg.util", "helper", "h"), ("importfrom", "pkg.util", "other", None), ("import", None, "pkg.util", "u")}
    assert {(r["src"], r["dst"]) for r in resolve.import_edges(e).collect()} == {("pkg.work", "pkg.base"), ("pkg.work", "pkg.util")}


def test_resolved_calls(parsed):
    _, e = parsed
    got = {(r["src"].removeprefix("pkg."), r["dst"].removeprefix("pkg.")) for r in resolve.call_edges(e).collect()}
    assert got == {
        ("work.Child.act", "base.Base.go"), ("work.Child.act", "work.local"), ("work.Child.act", "util.other"),
        ("work.local", "work.inner"), ("work.local", "util.helper"), ("work.local", "util.other"), ("util.helper", "util.other"),
    }


def test_navigation(parsed):
    _, e = parsed
    calls, imports = resolve.call_edges(e).cache(), resolve.import_edges(e)
    refs = lambda t: {(r["relation"], r["source"]) for r in resolve.references(e, calls, imports, t).collect()}
    assert refs("pkg.util.other") == {("caller", "pkg.work.Child.act"), ("caller", "pkg.work.local"), ("caller", "pkg.util.helper")}
    assert refs("pkg.base.Base") == {("subclass", "pkg.work.Child"), ("method_caller", "pkg.work.Child.act")}
    assert refs("pkg.util") >= {("importer", "pkg.work")}
    deps = {(r["relation"], r["target"]) for r in resolve.dependencies(e, calls, "pkg.work").collect()}
    assert ("imports", "from pkg.util import helper as h") in deps and ("imports", "import pkg.util as u") in deps
    assert {r["id"]: r["n_callers"] for r in resolve.called_by(calls).collect()}["pkg.util.other"] == 3


@pytest.mark.parametrize("query, match, n", [("pkg.util", "exact", 1), ("other", "partial", 1), ("pkg", "partial", 12), ("nothing", None, 0)])
def test_find(parsed, query, match, n):
    got = resolve.find(parsed[1], query).collect()
    assert len(got) == min(n, 5) and all(r["match"] == match and r["n"] == n for r in got)


def test_outline(parsed):
    out = {r["module_id"]: r["outline"] for r in entities.outlines(parsed[0]).collect()}
    assert out["pkg.base"] == "class Base:\n    def run(self):\n        ...\n    def go(self):\n        ..." and out["broken"].startswith("def f(:")


def test_scan_of_a_folder(spark, tmp_path):
    layout = {"a.py": "x = 1\n", "pkg/init.py": "y = 2", "pkg/m.py": "def f():\n    pass\n", ".hidden.py": "no", "pkg/build/z.py": "no", "a/b/c/d/deep.py": "no", "pkg/n.ipynb": '{"cells":[{"cell_type":"code","source":["a = 1\\n","b"]},{"cell_type":"markdown","source":"x"},{"cell_type":"code","source":"c"}]}', "latin.txt": None}
    for name, text in layout.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"caf\xe9" if text is None else text.encode())
    for i in range(101):
        (tmp_path / "many").mkdir(exist_ok=True)
        (tmp_path / f"many/f{i}.txt").write_text("x")
    for i in range(60):
        (tmp_path / "some").mkdir(exist_ok=True)
        (tmp_path / f"some/f{i:02}.txt").write_text("x")
    got = {r["path"]: r for r in files.modules(files.scan(spark, str(tmp_path))).collect()}
    assert {p for p in got if not p.startswith("some/")} == {"a.py", "pkg/init.py", "pkg/m.py", "pkg/n.ipynb", "latin.txt"}
    assert sum(p.startswith("some/") for p in got) == 5
    assert got["pkg/n.ipynb"]["content"] == "a = 1\nb\n\nc" and got["latin.txt"]["content"] == "café" and got["pkg/m.py"]["module_id"] == "pkg.m"
    assert "content" not in files.scan(spark, str(tmp_path), content=False).columns


def test_complexity(spark):
    df = spark.createDataFrame([("if a:\n  for x in y:\n        def f():\n            pass\n",)], "c string")
    assert df.select(scoring.complexity(F.col("c"))).first()[0] == pytest.approx(2 / 50 + 0.3 * 2 / 5)
