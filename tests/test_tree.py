"""The directory data source against os.walk, and packages found through it."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from loomwright.operators import entities, resolve
from loomwright.sources import files, tree


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top, r = tmp_path_factory.mktemp("tree"), random.Random(1)
    for _ in range(150):
        parts = [r.choice(["a", "_b", ".c", "d e", "node_modules", "é"]) for _ in range(r.randrange(0, 5))]
        at = top.joinpath(*parts)
        at.mkdir(parents=True, exist_ok=True)
        (at / r.choice(["__init__.py", ".dot", "_x.txt", "m.py", "big.bin"])).write_bytes(r.randbytes(r.randrange(0, 300)))
    (top / "empty/none").mkdir(parents=True)
    os.symlink(top, top / "a" / "loop")
    return str(top)


def walked(root, prune=(), deepest=64):
    out = {}
    for at, dirs, names in os.walk(root):
        depth = 0 if at == root else len(os.path.relpath(at, root).split(os.sep))
        dirs[:] = [x for x in dirs if x not in prune and depth < deepest]
        for n in names:
            full = os.path.join(at, n)
            out[os.path.relpath(full, root)] = open(full, "rb").read()
    return out


@pytest.mark.parametrize("partitions", [1, 5, 32])
def test_a_tree_is_what_walking_finds(spark, root, partitions):
    rows = tree.scan(spark, root, partitions=partitions)
    got = rows.collect()
    assert rows.rdd.getNumPartitions() == partitions and len(got) == len({r["path"] for r in got})
    assert {r["path"]: bytes(r["content"]) for r in got} == walked(root)
    assert all(r["length"] == len(r["content"]) and r["modified"] is not None for r in got)


def test_pruning_by_name_depth_path_and_size(spark, root):
    names = lambda **o: {r["path"] for r in tree.scan(spark, root, content=False, **o).collect()}
    assert names(prune=["node_modules", ".c"]) == set(walked(root, ("node_modules", ".c")))
    assert names(deepest=2) == set(walked(root, deepest=2)) and names(deepest=0) == set(walked(root, deepest=0))
    assert names(under="a/_b") == {p for p in walked(root) if p.startswith("a/_b/")}
    assert names(under="a") == {p for p in walked(root) if p.startswith("a/")}
    some = tree.scan(spark, "file://" + root, most_bytes=100).collect()
    assert all((r["content"] is None) == (r["length"] > 100) for r in some) and len(some) == len(walked(root))


def test_missing_and_empty_roots(spark, tmp_path):
    assert tree.scan(spark, str(tmp_path)).collect() == []
    with pytest.raises(Exception):
        tree.scan(spark, f"{tmp_path}/none").collect()


def test_files_are_written_whole_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i % 3}/.f{i}", f"text {i}\n") for i in range(50)] + [("e/none", None), (None, "x")], "p string, c string")
    assert tree.write(rows.repartition(4), "p", "c", f"{tmp_path}/out") == 51
    assert walked(f"{tmp_path}/out") == {f"d{i % 3}/.f{i}": f"text {i}\n".encode() for i in range(50)} | {"e/none": b""}


def test_imports_of_packages_resolve(spark, tmp_path):
    layout = {"pkg/__init__.py": "x = 1\n", "pkg/m.py": "import pkg\nfrom pkg import x\nimport pkg.sub\nimport os\n", "pkg/sub/__init__.py": "from pkg.m import f\n", "both.py": "", "both/__init__.py": "", "use.py": "import both\n"}
    rows = spark.createDataFrame(list(layout.items()), "p string, c string")
    tree.write(rows, "p", "c", str(tmp_path))
    found = files.modules(tree.scan(spark, str(tmp_path)))
    parsed = entities.extract(found.filter(F.col("language") == "py"))
    got = {(r["src"], r["dst"]) for r in resolve.import_edges(parsed).collect()}
    assert got == {("pkg.m", "pkg.__init__"), ("pkg.m", "pkg.sub.__init__"), ("pkg.sub.__init__", "pkg.m"), ("use", "both")}
