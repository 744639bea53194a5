"""Functions and operators on literal fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomwright.functions import paths, text, times
from loomwright.operators import budgets, dedupe, graphs, messages, profiling, retrieval, scoring, snapshots
from loomwright.plans import message_queries
from loomwright.sources import tables, web


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", type(None): "string", bytes: "binary"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("n, want", [(0, "0 B"), (512, "512.0 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1280, "1.2 KB"), (1048576, "1.0 MB"), (1073741824, "1.0 GB")])
def test_sizes(spark, n, want):
    assert one(spark, paths.human_size(F.col("n")), n=n) == want


@pytest.mark.parametrize(
    "path, scan, monitor",
    [("a.py", False, False), ("x/.git/a.py", True, True), ("__init__.py", True, False), ("pkg/__init__.py", False, False), ("a.png", True, False), ("n.ipynb", False, False), ("venv/n.ipynb", True, True), ("a.PYC", False, True), ("a.pyc", True, True), (".hid", True, True), ("d/.hid", False, True), ("logs/x", True, False), ("x.log", False, True)],
)
def test_ignored(spark, path, scan, monitor):
    assert one(spark, paths.ignored_by_scan(F.col("p")), p=path) is scan
    assert one(spark, paths.ignored_by_monitor(F.col("p")), p=path) is monitor


def test_module_ids(spark):
    assert one(spark, paths.module_id(F.col("p")), p="pyx/.pyy/m.py") == "pyx..pyy.m"
    assert one(spark, paths.module_id(F.col("p"), True), p="src/pylib/m.py") == "srclib.m"


ERRORS = {
    "missing": ("ModuleNotFoundError: No module named 'pandas'", [("missing_package", {"package_name": "pandas"})]),
    "name": ("ImportError: cannot import name 'SequentialModel' from 'tensorflow.keras' (x)", [("import_name_error", {"component_name": "SequentialModel", "package_name": "tensorflow.keras"})]),
    "attribute": ("AttributeError: module 'numpy.random' has no attribute 'randn_special'", [("attribute_error", {"package_name": "numpy.random", "attribute_name": "randn_special"})]),
    "dll": ("ImportError: DLL load failed while importing cv2: The specified module could not be found.", [("dll_load_error", {"module_name": "cv2", "error_details": "The specified module could not be found."})]),
    "dependency": ("ERROR: tensorboard 2.4.0 requires markdown>=2.6.8, which is not installed.", [("dependency_error", {"package_name": "2.4.0", "dependency_name": "markdown>=2.6.8"})]),
    "none": ("all is well", []),
}


def test_package_errors(spark):
    df = spark.createDataFrame([(k, "a\nb\nc\nd\n" + v[0] + "\ne\nf\ng\nh") for k, v in ERRORS.items()], "id string, t string")
    got: dict = {}
    for r in text.package_errors(df, "id", "t").orderBy("id", "ord").collect():
        got.setdefault(r["id"], []).append((r["error_type"], r["details"]))
        assert r["context"].split("\n")[0] == "b" and r["context"].endswith("e\nf\ng") and "{" not in r["suggestion"]
    assert {k: got.get(k, []) for k in ERRORS} == {k: v[1] for k, v in ERRORS.items()}


def test_install_logs(spark):
    log = "Collecting x\nRequirement already satisfied: y\nkept\nSuccessfully installed x"
    assert one(spark, text.strip_install_noise(F.col("t")), t=log) == "kept\nSuccessfully installed x"
    assert one(spark, text.strip_install_noise(F.col("t")), t="Collecting x\nother") == "Collecting x\nother"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("see http://a.b/c now please ok", "see  now please ok"), ("a [link](x y) of text here", "a link of text here"), ("<p>one two three</p>", "one two three"), ("- Home\nreal line of text", "real line of text"),
        ("Copyright © 2020 x\none two three", "one two three"), ("Follow us on Twitter now\none two three", "one two three"), ("short\n\n\n\nlong enough line", "long enough line"), ("a b\nc d e", "c d e"),
    ],
)
def test_cleaning(spark, raw, want):
    assert one(spark, text.clean_page(F.col("t")), t=raw) == want


@pytest.mark.parametrize("content, want", [("x", None), ("```python\na\n```", [("python", "a")]), ("```sh\na\n```\n```python3\nb\nc\n```", [("sh", "a"), ("python3", "b\nc")]), ("```rust\na\n```\n```python\nb\n```", None), ("```\na\n```", None)])
def test_fences(spark, content, want):
    got = one(spark, text.code_blocks(F.col("t")), t=content)
    assert (got and [(b["language"], b["code"]) for b in got]) == want


def test_edits(spark):
    edit = lambda t, a: one(spark, text.replace_exact(F.col("t"), F.lit("a"), F.lit("b"), a), t=t)
    assert edit("xax", False) == "xbx" and edit("aa", False) is None and edit("aa", True) == "bb" and edit("x", True) is None


@pytest.mark.parametrize("day, want", [("2024-03-01", "2024-03-01"), ("2024-03-02", "2024-03-04"), ("2024-03-03", "2024-03-04"), ("2024-03-04", "2024-03-04")])
def test_weekdays(spark, day, want):
    assert str(one(spark, times.next_weekday(F.col("d").cast("date")), d=day)) == want


def test_relative_times(spark):
    ago = lambda then: one(spark, times.ago(F.lit("2024-01-10 12:00:00"), F.col("t")), t=then)
    assert [ago(t) for t in ("2024-01-10 11:59:30", "2024-01-10 11:50:00", "2024-01-10 09:00:00", "2024-01-08 09:00:00", "2023-12-01 00:00:00")] == ["Just now", "10 minutes ago", "3 hours ago", "2 days ago", "2023-12-01"]


def test_next_fit(spark):
    assert spark.range(1).select(budgets.next_fit(F.array(*map(F.lit, [30, 30, 50, 200, 10, 10])), 100.0)).first()[0] == [0, 0, 1, 2, 3, 3]


def test_commands(spark):
    rows = [(1, 0, "python", "# filename: run.sh\necho 1"), (1, 1, "python", "print( 1 )"), (1, 2, "sh", "sh run.sh"), (1, 3, "python", "print(  1 )"), (1, 4, "python", "# filename: run.sh\nother"), (1, 5, "python", "python run.sh")]
    df = spark.createDataFrame(rows, "g long, pos long, lang string, code string")
    assert sorted(r["pos"] for r in dedupe.commands(df, "g", "pos", "lang", "code").collect()) == [0, 1, 2]


def test_scores(spark):
    flags = [F.lit(1)] * 8
    assert spark.range(1).select(scoring.repo_score(flags, F.lit(10))).first()[0] == pytest.approx(1.06)
    assert spark.range(1).select(scoring.name_semantics(F.lit("main"))).first()[0] == pytest.approx(1.0)


def test_graph_scores(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "node long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 4)], "src long, dst long")
    b = {r["node"]: r["betweenness"] for r in graphs.betweenness(nodes, edges, normalized=False).collect()}
    assert b == {0: 0, 1: 2, 2: 2, 3: 0, 4: 0}
    pr = {r["node"]: r["pr"] for r in graphs.pagerank(nodes, edges, 50).collect()}
    assert sum(pr.values()) == pytest.approx(1) and pr[3] > pr[2] > pr[0]
    d = {r["node"]: (r["in_deg"], r["out_deg"]) for r in graphs.degrees(nodes, edges).collect()}
    assert d[0] == (0, 2) and d[4] == (1, 0)


def test_roll_up(spark):
    tree = graphs.prefixes(spark.createDataFrame([("a.b.c",), ("a.b.d",), ("a.e",)], "id string"), "id").withColumn("own", F.when(F.col("depth") == 3, 1.0).otherwise(0.5))
    got = {r["node"]: r["score"] for r in graphs.roll_up(tree, "own", lambda own, m, a: scoring.package(own, m, a), 3).collect()}
    assert got["a.b"] == pytest.approx(2.0) and got["a"] == pytest.approx(0.5 + (2.0 * 0.7 + 1.25 * 0.3) * 1.5)


def test_chunks_cover_texts(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, "abc"), (3, "")], "id long, t string")
    got = {}
    for r in retrieval.chunks(df, ["id"], "t", 4, 1).orderBy("id", "chunk_pos").collect():
        got.setdefault(r["id"], []).append(r["chunk"])
    assert got == {1: ["abcd", "defg", "ghij"], 2: ["abc"]}


def test_profile_and_json(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (None, "b")], "n long, s string")
    got = {r["column"]: r.asDict() for r in profiling.columns(df).collect()}
    assert got["n"]["nulls"] == 1 and got["n"]["high"] == "2" and got["s"]["n_distinct"] == 2 and got["s"]["rows"] == 3
    shape = spark.createDataFrame([('{"a":1,"b":[1]}',), ("[1,2]",), ("x",)], "j string").select(*profiling.json_shape(F.col("j"))).collect()
    assert shape[0]["n_keys"] == 2 and shape[1]["n_items"] == 2 and shape[2]["shape"] is None


def test_message_edits(spark, tmp_path):
    spark.createDataFrame([(1, t, r, f"text {t}") for t, r in enumerate(["user", "assistant", "user", "assistant"])], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    h = message_queries.histories(spark, str(tmp_path))
    m = F.col("messages")
    get = lambda c: h.select(c.alias("x")).first()["x"]
    assert [x["pos"] for x in get(messages.delete_at(m, 1))] == [0, 2, 3] and get(messages.delete_at(m, 1))[1]["tool_responses"] is None
    answered = get(messages.add_tool_response(m, F.lit("call_1_1"), F.lit("ok")))
    assert [x["role"] for x in answered] == ["user", "assistant", "tool", "user", "assistant"] and answered[2]["content"] == "ok"
    assert get(messages.add_tool_response(m, F.lit("none"), F.lit("ok"))) == get(m)
    assert get(messages.change_role(m, 1, "user"))[1]["tool_calls"] is None
    assert len(get(messages.drop_trailing_call(m))) == 3
    assert [x["content"] for x in get(messages.compact(m, F.lit("sum"), 1))] == ["text 0", "sum", "text 3"]
    called = get(messages.add_tool_call(m, 0, "f", F.lit("{}"), F.lit("id1")))
    assert called[0]["role"] == "assistant" and called[0]["tool_calls"][0]["id"] == "id1"


def test_snapshots(spark):
    before = spark.createDataFrame([("a", 1)], "path string, n long")
    after = spark.createDataFrame([("a", 2), ("b", 1)], "path string, n long")
    assert [r["path"] for r in snapshots.additions(before, after, ["path"]).collect()] == ["b"]


def test_stored_tables(spark, tmp_path):
    where = f"{tmp_path}/users"
    assert tables.stored(spark, where, "name string, hash string").count() == 0
    rows = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2")], "name string, hash string")
    tables.append_absent(spark, where, rows, ["name"])
    tables.append_absent(spark, where, spark.createDataFrame([("a", "9"), ("c", "3")], "name string, hash string"), ["name"])
    assert {tuple(r) for r in tables.stored(spark, where, rows.schema).collect()} == {("a", "1"), ("b", "2"), ("c", "3")}


def test_web_sources(spark):
    q = spark.createDataFrame([("x",)], "query string")
    found = web.search(q, lambda q, n: [{"title": "t", "snippet": "s", "link": "u1"}, {"title": None, "snippet": "s", "link": "u2"}])
    assert [r["link"] for r in found.collect()] == ["u1"]
    pages = web.fetched(spark.createDataFrame([("ok",), ("bad",)], "link string"), "link", lambda u: "<b>one two three</b>" if u == "ok" else 1 / 0)
    assert {r["link"]: r["content"] for r in pages.collect()} == {"ok": "one two three", "bad": ""}


def test_words_and_marks_are_counted_not_listed(spark):
    """prj_14_function: two thirds of its time went into lists of all words, made to be counted."""
    import random

    draw = random.Random(2)
    texts = ["".join(draw.choice(["a", "Z_9", " ", "\n", "\t", "\x0b", "\x1c", " ", " ", "é", "😀", "⋮", ".", "$1", "\\", "\r\n"]) for _ in range(draw.randint(0, 30))) for _ in range(500)] + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.token_estimate(F.col("t")).alias("n"), F.regexp_count("t", F.lit(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")).alias("m"))
    assert "regexp_extract_all" not in rows.select("n")._jdf.queryExecution().executedPlan().toString()
    assert all(n == m for n, m in rows.collect())
