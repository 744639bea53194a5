"""Code entities, resolution, views, parsing, stored tables and scores, over modules made from the rows of ``part``.

The tables hold no program text, so each part is a small module whose size, names, bases and calls follow from its columns;
what an operator must find in it can then be said in SQL.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions import paths as P
from ..functions import text as T
from ..functions import times as D
from ..operators import budgets, graphs, judged, resolve, retrieval, scoring, snapshots, views
from ..operators import entities as E
from ..operators import messages as M
from ..session import dealt, durable, shared_folder, table
from ..sources import files as S
from ..sources import sinks, tables, tree
from ..sources import web as W
from .graph_queries import ALPHA, ROUNDS, TRADE, _pagerank_sql, nations, trade
from .message_queries import C, histories
from .relational_queries import FILES, files

CATALOG: dict = {}


def query(name: str, sql: str | None):
    def keep(f):
        CATALOG[name] = (f, sql)
        return f

    return keep


# ---- modules ----
_K, _J = "CAST(p_partkey + 1 AS STRING)", "CAST(p_partkey AS STRING)"
_CLASS = f"""'class C' || {_K} || '(Base' || CAST(p_partkey % 4 AS STRING) || ', mixin.M' || CAST(p_partkey % 2 AS STRING) || '):' || chr(10) ||
'    \"\"\"About ' || p_brand || '.\"\"\"' || chr(10) || '    def run(self, x: int) -> str:' || chr(10) || '        self.size = Size(' || CAST(p_size AS STRING) || ')' || chr(10) ||
'        helper' || {_K} || '(x)' || chr(10) || '        C' || {_J} || '.run(x)' || chr(10) || '        return os.path.join(x)'"""
_HELPER = f"""'def helper' || {_K} || '(a, b):' || chr(10) || repeat('    a = a + 1' || chr(10), p_size) || '    return helper' || {_J} || '(a)'"""
CODE = f"""('import os' || chr(10) || 'from pkg.m' || {_J} || ' import helper' || {_J} || chr(10) || chr(10) || 'LIMIT = ' || CAST(p_size AS STRING) || chr(10) || chr(10) ||
{_CLASS} || chr(10) || chr(10) || {_HELPER})"""
_M = f"'pkg.m' || {_K}"
_TOKENS = "len(regexp_extract_all({}, '[A-Za-z0-9_]+|[^ \\t\\n\\v\\f\\rA-Za-z0-9_]'))"


def modules(s, d):
    """module_id, path, content.  A row of part is small and its module is not, so the rows are dealt before texts are made."""
    p = dealt(table(s, d, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey")
    return p.select(F.expr(_M).alias("module_id"), F.expr(f"'pkg/m' || {_K} || '.py'").alias("path"), F.expr(CODE).alias("content"))


def entities(s, d, kinds=None, columns=None):
    """Entity rows for a query that reads them once; it names the kinds and columns that it reads."""
    return E.extract(modules(s, d), kinds, columns)


def parsed(s, d, kinds=None, columns=None):
    """Entity rows for a query that reads them several times: modules are parsed once."""
    return durable(entities(s, d, kinds, columns), "entities")


#: What resolving calls reads, and what views of functions show.
_RESOLVED = (["module", "class", "function", "import", "importfrom"], ["class_id", "bases", "calls", "import_module", "import_name", "import_alias"])
_SIGNATURE = ["name", "class_id", "docstring", "parameters"]


@query("src_02_prj_02", f"SELECT {_M} || '.C' || {_K} AS id, 'C' || {_K} AS name, 'About ' || p_brand || '.' AS docstring, 'Base' || (p_partkey % 4) || ',mixin.M' || (p_partkey % 2) AS bases FROM part")
def class_rows(s, d):
    return E.latest(entities(s, d, ["class"], ["name", "docstring", "bases"]), "class").select("id", "name", "docstring", F.array_join("bases", ",").alias("bases"))


@query(
    "prj_03_04",
    f"SELECT {_M} || '.C' || {_K} || '.run' AS id, {_M} || '.C' || {_K} AS class_id, 'self, x: int' AS parameters, 'str' AS return_type FROM part UNION ALL SELECT {_M} || '.helper' || {_K}, NULL, 'a, b', NULL FROM part",
)
def function_rows(s, d):
    return E.latest(entities(s, d, ["function"], ["class_id", "parameters", "return_type"]), "function").select("id", "class_id", views.parameters(F.col("parameters")).alias("parameters"), "return_type")


@query(
    "prj_05",
    " UNION ALL ".join(
        f"SELECT {_M} || '.{src}' || {_K} || '{rest}' AS src, '{kind}' AS type, {target} AS target FROM part"
        for src, rest, kind, target in (("C", ".run", "simple", "'Size'"), ("C", ".run", "simple", f"'helper' || {_K}"), ("C", ".run", "attribute", f"'C' || {_J} || '.run'"), ("C", ".run", "nested_attribute", "'os.path.join'"), ("helper", "", "simple", f"'helper' || {_J}"))
    ),
)
def call_rows(s, d):
    calls = E.latest(entities(s, d, ["function"], ["calls"]), "function").select(F.col("id").alias("src"), F.explode("calls").alias("c"))
    return calls.select("src", "c.type", F.coalesce("c.full_path", F.concat_ws(".", "c.object", "c.attribute", "c.name")).alias("target"))


@query("prj_06_12_txt_17", f"SELECT {_M} AS module_id, 'import os' || chr(10) || 'from pkg.m' || {_J} || ' import helper' || {_J} AS imports FROM part")
def import_rows(s, d):
    return views.import_texts(entities(s, d, ["import", "importfrom"], ["import_module", "import_name", "import_alias"]))


_EDGES = f"""(SELECT {_M} || '.C' || {_K} || '.run' AS src, {_M} || '.helper' || {_K} AS dst FROM part
UNION ALL SELECT {_M} || '.helper' || {_K}, 'pkg.m' || {_J} || '.helper' || {_J} FROM part SEMI JOIN (SELECT p_partkey + 1 AS p_partkey FROM part) q USING (p_partkey)
UNION ALL SELECT {_M} || '.C' || {_K} || '.run', 'pkg.m' || {_J} || '.C' || {_J} || '.run' FROM part SEMI JOIN (SELECT p_partkey + 1 AS p_partkey FROM part) q USING (p_partkey))"""


@query("jn_01_02", f"SELECT src, dst FROM {_EDGES}")
def resolved_calls(s, d):
    return resolve.call_edges(parsed(s, d, *_RESOLVED))


_TARGET = "pkg.m5.C5"
_DEPENDS = f"SELECT 'calls' AS relation, dst AS other FROM {_EDGES} WHERE src = '{_TARGET}.run' UNION ALL SELECT 'extends', unnest(['Base0', 'mixin.M0'])"


@query("jn_07", f"SELECT relation, other AS target FROM ({_DEPENDS})")
def dependencies(s, d):
    e = parsed(s, d, *_RESOLVED)
    own = (F.col("id") == _TARGET) | F.col("id").startswith(_TARGET + ".")  # no other's calls are asked for
    return resolve.dependencies(e, resolve.call_edges(e, own), _TARGET)


@query("jn_08", f"SELECT 'out' AS direction, relation, other FROM ({_DEPENDS}) UNION ALL SELECT 'in', 'method_caller', src FROM {_EDGES} WHERE dst = '{_TARGET}.run'")
def relationships(s, d):
    e = parsed(s, d, *_RESOLVED)
    edges = durable(resolve.call_edges(e, target=_TARGET), "call-edges")  # read in both directions
    return views.relationships(e, edges, resolve.import_edges(e), _TARGET)


@query("grf_15", f"SELECT {_M} || '.C' || {_K} AS src, unnest(['Base' || (p_partkey % 4), 'mixin.M' || (p_partkey % 2)]) AS dst FROM part")
def inheritance(s, d):
    return resolve.inheritance_edges(entities(s, d, ["class"], ["bases"]))


_SKELETON = f"""'import os' || chr(10) || 'from pkg.m' || {_J} || ' import helper' || {_J} || chr(10) || 'class C' || {_K} || '(Base' || (p_partkey % 4) || ', mixin.M' || (p_partkey % 2) || '):' || chr(10) ||
'    def run(self, x):' || chr(10) || '        ...' || chr(10) || 'def helper' || {_K} || '(a, b):' || chr(10) || '    ...'"""


@query("prj_09", f"SELECT {_M} AS module_id, {_SKELETON} AS outline FROM part")
def skeletons(s, d):
    return E.outlines(modules(s, d))


def _outline_sql(content: str, budget: int) -> str:
    """list expressions of an outline of ``content`` (a column), its wide and its narrow form."""
    wide = r"(regexp_matches(x, '^\s*(def|class|import|from|async def)') OR regexp_matches(x, '^\s+[a-zA-Z_][a-zA-Z0-9_]*\s*='))"
    narrow = r"(regexp_matches(x, '^\s*(def|class)\s+') OR (regexp_matches(x, '^\s*(import|from)\s+') AND i <= 50) OR regexp_matches(x, '^\s+[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*[A-Z]') OR contains(x, '__init__'))"

    def kept(keep: str) -> str:
        flags = f"list_transform(string_split({content}, chr(10)), lambda x, i: {keep})"
        return f"array_to_string(list_filter(list_transform(string_split({content}, chr(10)), lambda y, j: CASE WHEN {flags}[j] THEN y WHEN j = 1 OR {flags}[j - 1] THEN '⋮' ELSE NULL END), lambda z: z IS NOT NULL), chr(10))"

    return f"CASE WHEN {_TOKENS.format(kept(wide))} <= {budget} THEN {kept(wide)} ELSE {kept(narrow)} END"


@query("prj_10", f"WITH m AS (SELECT {_M} AS module_id, {CODE} AS content FROM part), o AS (SELECT module_id, {_outline_sql('content', 100)} AS outline FROM m) SELECT module_id, md5(outline) AS digest, {_TOKENS.format('outline')}::BIGINT AS tokens FROM o")
def line_outlines(s, d):
    rows = modules(s, d).select("module_id", views.outline(F.col("content"), 100).alias("o"))
    return rows.select("module_id", F.md5(F.col("o").cast("binary")).alias("digest"), T.token_estimate(F.col("o")).cast("long").alias("tokens"))


_STRUCTURE = f"""'### Module: ' || {_M} || chr(10) || chr(10) || 'class C' || {_K} || ':' || chr(10) || '    ''''''About ' || p_brand || '....''''''' || chr(10) || '    def run(self, x: int):' || chr(10) || chr(10) || 'def helper' || {_K} || '(a, b):'"""


@query("prj_11_13", f"SELECT {_M} AS module_id, {_STRUCTURE} AS structure FROM part")
def module_structures(s, d):
    return views.structures(parsed(s, d, ["module", "class", "function"], _SIGNATURE))


@query("prj_13_head", "SELECT doc_id, md5(CASE WHEN len(x) > 50 THEN array_to_string(x[1:50], chr(10)) || chr(10) || '... [Omitted ' || (len(x) - 50) || ' lines]' ELSE text END) AS digest FROM (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents)")
def heads(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(views.head(F.col("text")).cast("binary")).alias("digest"))


@query(
    "prj_14_class",
    f"""SELECT {_M} || '.C' || {_K} AS id, '# Class: C' || {_K} || chr(10) || 'Module location: ' || {_M} || chr(10) || chr(10) || 'Documentation:' || chr(10) || '''''''About ' || p_brand || '.''''''' || chr(10) || chr(10) ||
'Inherits from: Base' || (p_partkey % 4) || ', mixin.M' || (p_partkey % 2) || chr(10) || chr(10) || 'Methods:' || chr(10) || '- run(self, x: int) -> str' || chr(10) || chr(10) || 'Source code:' || chr(10) || {_CLASS} AS details FROM part""",
)
def class_views(s, d):
    e = entities(s, d, ["class", "function"], [*_SIGNATURE, "bases", "return_type", "source"])
    return views.class_details(durable(e.withColumn("source", F.when(F.col("kind") == "class", F.col("source"))), "entities"))


@query(
    "prj_14_function",
    f"""WITH f AS (SELECT {_M} || '.helper' || {_K} AS id, 'helper' || {_K} AS name, {_M} AS module_id, {_HELPER} AS source FROM part), o AS (SELECT *, {_outline_sql('source', 60)} AS short FROM f)
SELECT id, '# Function: ' || name || chr(10) || 'Module location: ' || module_id || chr(10) || chr(10) || 'Signature: ' || name || '(a, b)' || chr(10) || chr(10) || 'Source code:' || chr(10) || CASE WHEN {_TOKENS.format('source')} > 60 THEN short ELSE source END AS details FROM o""",
)
def function_views(s, d):
    return views.function_details(entities(s, d, ["function"], [*_SIGNATURE, "return_type", "source"]).filter("class_id is null"), budget=60)


@query(
    "prj_21",
    f"""WITH m AS (SELECT 'pkg/m' || {_K} || '.py' AS path, {CODE} AS content, {_SKELETON} AS skeleton FROM part), o AS (SELECT *, {_outline_sql('content', 70)} AS short FROM m),
t AS (SELECT *, {_TOKENS.format('content')} AS a, {_TOKENS.format('short')} AS b, {_TOKENS.format('skeleton')} AS c, string_split(content, chr(10)) AS x FROM o)
SELECT path, 'python' AS language, md5(CASE WHEN a < 70 THEN content WHEN b <= 70 THEN short WHEN c <= 70 THEN skeleton WHEN len(x) > 50 THEN array_to_string(x[1:50], chr(10)) || chr(10) || '... [Omitted ' || (len(x) - 50) || ' lines]' ELSE content END) AS digest FROM t""",
)
def adaptive_views(s, d):
    return views.file_view(modules(s, d), 70).select("path", "language", F.md5(F.col("view").cast("binary")).alias("digest"))


@query("prj_21_other", f"SELECT path, 'text' AS language, md5(CASE WHEN len(w) > 40 THEN array_to_string(w[1:20] || ['...'] || w[-20:], ' ') ELSE content END) AS digest FROM (SELECT path, content, string_split(content, ' ') AS w FROM {FILES})")
def other_views(s, d):
    return views.file_view(files(s, d).select("path", "content"), 40).select("path", "language", F.md5(F.col("view").cast("binary")).alias("digest"))


@query(
    "prj_22",
    """WITH t AS (SELECT r_name AS path, 1 AS depth FROM region UNION ALL SELECT r_name || '/' || n_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey),
l AS (SELECT string_agg(repeat('  ', depth - 1) || '- ' || list_last(string_split(path, '/')), chr(10) ORDER BY path) AS tree FROM t)
SELECT '# Code Repository Overview' || chr(10) || 'Repository path: repo' || chr(10) || 'Total modules: ' || (SELECT count(*) FROM part) || chr(10) || 'Total classes: ' || (SELECT count(*) FROM part) || chr(10) || 'Total functions: ' || (SELECT 2 * count(*) FROM part) || chr(10)
 || 'Total lines of code: ' || (SELECT sum(p_size + 15) FROM part) || chr(10) || '# Package Structure' || chr(10) || tree AS text FROM l""",
)
def overview(s, d):
    e = entities(s, d, ["module", "class", "function"], ["last_line"])
    of = lambda kind: F.count_if(F.col("kind") == kind)
    totals = e.agg(of("module").alias("modules"), of("class").alias("classes"), of("function").alias("functions"), F.sum(F.when(F.col("kind") == "module", F.col("last_line"))).alias("lines"))
    regions = table(s, d, "region").select("r_regionkey", F.col("r_name").alias("path"))
    nested = table(s, d, "nation").join(regions.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select(F.concat_ws("/", "path", "n_name").alias("path"), F.lit(2).alias("depth"))
    return views.overview(totals, regions.select("path", F.lit(1).alias("depth")).unionByName(nested), "repo")


@query("prj_18", "SELECT event_id, event_type AS content, CASE WHEN value > 50 THEN 'user' ELSE 'assistant' END AS role, 'u' || user_id AS sender, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, CASE WHEN event_type = 'click' THEN '[\"a' || event_id || '\"]' ELSE '[]' END AS new_files FROM events")
def display_records(s, d):
    role = F.when(F.col("value") > 50, "user").otherwise("assistant")
    new = F.when(F.col("event_type") == "click", F.array(F.concat(F.lit("a"), F.col("event_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    info = views.display_info(F.col("event_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("chat"), role, F.col("ts"), new)
    return table(s, d, "events").select("event_id", info.alias("i")).select("event_id", "i.message.content", "i.message.role", F.col("i.sender_info.name").alias("sender"), "i.timestamp", "i.new_files")


# ---- listings ----
@query(
    "grf_14",
    """WITH f AS (SELECT lang || '/' || source AS dir, doc_id || '.txt' AS name FROM documents), r AS (SELECT dir, name, row_number() OVER (PARTITION BY dir ORDER BY name) AS place, count(*) OVER (PARTITION BY dir) AS n FROM f)
SELECT dir, place::INT AS place, '            ' || CASE WHEN place <= 30 THEN name ELSE '... ' || (n - 30) || ' more files not displayed' END AS line FROM r WHERE place <= 31""",
)
def listings(s, d):
    return views.listing(files(s, d), "path")


@query(
    "grf_13",
    """WITH f AS (SELECT lang AS a, source AS b, doc_id || '.txt' AS c, n_chars || ' chars' AS note FROM documents),
l0 AS (SELECT a, row_number() OVER (ORDER BY a) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT a FROM f)), s0 AS (SELECT *, r = least(n, 15) AS last FROM l0 WHERE r <= 16),
l1 AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS r, count(*) OVER (PARTITION BY a) AS n FROM (SELECT DISTINCT a, b FROM f)),
s1 AS (SELECT l1.*, l1.r = least(l1.n, 10) AS last, s0.r AS r0, CASE WHEN s0.last THEN '    ' ELSE '│   ' END AS above FROM l1 JOIN s0 ON s0.a = l1.a AND s0.r <= 15 WHERE l1.r <= 11),
l2 AS (SELECT a, b, c, note, row_number() OVER (PARTITION BY a, b ORDER BY c) AS r, count(*) OVER (PARTITION BY a, b) AS n FROM f),
s2 AS (SELECT l2.*, l2.r = least(l2.n, 8) AS last, s1.r0, s1.r AS r1, s1.above || CASE WHEN s1.last THEN '    ' ELSE '│   ' END AS above FROM l2 JOIN s1 ON s1.a = l2.a AND s1.b = l2.b AND s1.r <= 10 WHERE l2.r <= 9)
SELECT r::VARCHAR AS place, CASE WHEN r <= 15 THEN CASE WHEN last THEN '└── ' ELSE '├── ' END || a || '/' ELSE '... and ' || (n - 15) || ' more items' END AS line FROM s0
UNION ALL SELECT r0 || '.' || r, above || CASE WHEN r <= 10 THEN CASE WHEN last THEN '└── ' ELSE '├── ' END || b || '/' ELSE '... and ' || (n - 10) || ' more items' END FROM s1
UNION ALL SELECT r0 || '.' || r1 || '.' || r, above || CASE WHEN r <= 8 THEN CASE WHEN last THEN '└── ' ELSE '├── ' END || c || ' (' || note || ')' ELSE '... and ' || (n - 8) || ' more items' END FROM s2""",
)
def drawn_tree(s, d):
    rows = files(s, d).filter("lang is not null and source is not null").select("path", F.concat(F.col("n_chars").cast("string"), F.lit(" chars")).alias("note"))
    return views.tree_lines(rows, "path", "note").select(F.array_join(F.transform("place", lambda x: x.cast("string")), ".").alias("place"), "line")


@query(
    "agg_24",
    f"""WITH f AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, path, '-> ' || path || ' has content:' || chr(10) || chr(10) || content AS full FROM {FILES} WHERE len(string_split(content, chr(10))) < 30),
t AS (SELECT dir, sum(len("full") + 2) AS n FROM f GROUP BY 1) SELECT f.dir, path, md5(CASE WHEN n > 6000 THEN '-> ' || path ELSE "full" END) AS digest FROM f JOIN t ON f.dir = t.dir""",
)
def directory_previews(s, d):
    return views.previews(files(s, d), "path", "content", ["py", "sh"]).select("dir", "path", F.md5(F.col("preview").cast("binary")).alias("digest"))


# ---- reports and replies ----
#: Texts for each kind of package error; {n} is a number.
ERROR_TEXTS = {
    "missing_package": "ModuleNotFoundError: No module named 'pkg{n}'",
    "import_name_error": "ImportError: cannot import name 'part{n}' from 'lib.sub'",
    "attribute_error": "AttributeError: module 'numpy.random' has no attribute 'draw{n}'",
    "version_conflict": "tool requires alpha{n} >=2.0, but 1.9 is installed",
    "syntax_error_in_package": "SyntaxError: bad File '/x/site-packages/broken{n}/core.py', line 12",
    "import_error_in_package": "ImportError: trouble in /x/site-packages/inner{n}/api.py: cannot load part",
    "dependency_error": "beta{n} requires gamma, which is not installed",
    "dll_load_error": "ImportError: DLL load failed while importing cv{n}: The module was not there",
    "permission_error": "PermissionError: no access to /x/site-packages/locked{n}/data",
    "pkg_resources_error": "pkg_resources.DistributionNotFound: The 'delta{n}' distribution was not found",
    "incompatible_version": "old{n} 1.0 is incompatible with new 2.0",
}
_KINDS = list(ERROR_TEXTS)


def error_texts(s, d):
    n = F.col("event_id")
    kinds = F.array(*[F.concat(*[F.lit(x) if k != 1 else n.cast("string") for k, x in enumerate((a, "", b))]) for a, b in (t.split("{n}") for t in ERROR_TEXTS.values())])
    return dealt(table(s, d, "events").select("event_id"), "event_id", rows=16384).select("event_id", F.concat(F.lit("step\n"), F.get(kinds, (n % len(_KINDS)).cast("int")), F.lit("\ndone")).alias("text"))


@query("txt_03_kinds", "SELECT event_id, [" + ", ".join(f"'{k}'" for k in _KINDS) + f"][event_id % {len(_KINDS)} + 1] AS error_type, 'step' || chr(10) || [" + ", ".join("'" + t.replace("'", "''").replace("{n}", "' || event_id || '") + "'" for t in ERROR_TEXTS.values()) + f"][event_id % {len(_KINDS)} + 1] || chr(10) || 'done' AS context FROM events")
def all_error_kinds(s, d):
    return T.package_errors(error_texts(s, d), "event_id", "text").select("event_id", "error_type", "context")


@query(
    "agg_26",
    f"""SELECT event_id, 'Python Package Error Analysis Report' || chr(10) || '- Found 1 package-related errors' || chr(10) || '- Affected packages: pkg' || event_id || chr(10) || '- Missing Package: 1 errors' || chr(10) || 'Suggested fix commands:' || chr(10) || 'pip install pkg' || event_id || chr(10)
|| 'Error #1: Missing Package' || chr(10) || '  package_name: pkg' || event_id || chr(10) || 'Fix suggestion:' || chr(10) || 'Install the missing package using pip: pip install pkg' || event_id AS report FROM events WHERE event_id % {len(_KINDS)} = 0
UNION ALL SELECT event_id, 'Python Package Error Analysis Report' || chr(10) || '- Found 1 package-related errors' || chr(10) || '- Affected packages: delta' || event_id || chr(10) || '- Resource Distribution Error: 1 errors' || chr(10)
|| 'Error #1: Resource Distribution Error' || chr(10) || '  package_name: delta' || event_id || chr(10) || 'Fix suggestion:' || chr(10) || 'Distribution package delta' || event_id || ' not found. Try: pip install delta' || event_id FROM events WHERE event_id % {len(_KINDS)} = 9""",
)
def error_reports(s, d):
    rows = error_texts(s, d).filter((F.col("event_id") % len(_KINDS)).isin(0, 9))
    return views.error_reports(T.package_errors(rows, "event_id", "text"), "event_id")


@query("txt_05", "SELECT event_id, json_extract_string(props, '$.k') AS k, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'true' ELSE event_type END AS extra FROM events")
def lenient_replies(s, d):
    n = F.get_json_object("props", "$.k")
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    literal = F.concat(F.lit("{'k': "), n, F.lit(", 'extra': True}"))
    pairs = F.concat(F.lit("k: "), n, F.lit("\nextra: "), F.col("event_type"))
    kind = F.col("event_id") % 3
    rows = table(s, d, "events").select("event_id", parsing.replies(F.when(kind == 0, fenced).when(kind == 1, literal).otherwise(pairs)).alias("r"))
    return rows.select("event_id", F.get_json_object("r", "$.k").alias("k"), F.get_json_object("r", "$.extra").alias("extra"))


@query("txt_06", "SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE role END AS role, CASE WHEN turn % 5 = 4 THEN NULL ELSE turn::VARCHAR END AS content FROM conversations")
def parsed_dialogues(s, d):
    whole = F.concat(F.lit('Here it is: [{"role": "'), F.col("role"), F.lit('", "content": '), F.col("turn").cast("string"), F.lit("}] done"))
    broken = F.concat(F.lit('Here it is: [{"role": "'), F.col("role"), F.lit('"}] done'))
    rows = table(s, d, "conversations").select("conv_id", "turn", parsing.dialogue(F.when(F.col("turn") % 5 == 4, broken).otherwise(whole)).alias("x"))
    first = F.get("x", F.lit(0))
    return rows.select("conv_id", "turn", first["role"].alias("role"), first["content"].alias("content"))


@query("txt_08", "SELECT event_id, json_extract_string(props, '$.k') AS k, 'a, ' || event_type AS tags, '{\"x\":1}' AS other FROM events")
def simple_metadata(s, d):
    text = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "tags": ["a", "'), F.col("event_type"), F.lit('"], "other": {"x":1}}'))
    m = parsing.simple_metadata(text)
    return table(s, d, "events").select("event_id", m["k"].alias("k"), m["tags"].alias("tags"), m["other"].alias("other"))


@query("txt_15", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '[ \t\n\v\f\r]+', ' ', 'g'))) AS digest FROM pages")
def page_texts(s, d):
    return table(s, d, "pages").select("page_id", F.md5(parsing.page_text(F.col("html")).cast("binary")).alias("digest"))


@query("txt_20", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Successfully installed a' || event_id || ' b ... x y z ' || event_type ELSE 'Collecting a' || event_id || ' b c ... x y z ' || event_type END AS shown FROM events")
def clean_results(s, d):
    n = F.col("event_id").cast("string")
    log = F.concat(F.lit("  Downloading wheel\nSuccessfully installed a"), n, F.lit(" b c d e f x y z "), F.col("event_type"), F.lit("\nCollecting more"))
    plain = F.concat(F.lit("Collecting a"), n, F.lit(" b c d e f x y z "), F.col("event_type"))
    kept = T.strip_install_noise(F.when(F.col("event_id") % 2 == 0, log).otherwise(plain))
    return table(s, d, "events").select("event_id", F.array_join(budgets.head_tail(F.split(kept, " "), 8), " ").alias("shown"))


# ---- retrieval ----
@query("ret_06_label", "SELECT page_id, weight, CASE WHEN weight < 1 THEN 'hybrid' ELSE 'vector' END AS branch FROM (SELECT page_id, (page_id % 3) / 2.0 AS weight FROM pages)")
def routed(s, d):
    return table(s, d, "pages").select("page_id", (F.col("page_id") % 3 / F.lit(2.0)).alias("weight")).withColumn("branch", retrieval.branch(F.col("weight")))


#: Stated questions: the id of a vector, words, and the weight of the vectors.
_QUESTIONS = {0: (0, "the and of", 1.0), 1: (1, "der die und", 0.6), 2: (2, "les des que", 1.0), 3: (3, "of the with", 0.3)}


@query(
    "ret_06",
    f"""WITH q AS (SELECT * FROM (VALUES {", ".join(f"({q}::BIGINT, {v}, '{t}', {w}::DOUBLE)" for q, (v, x, w) in _QUESTIONS.items() for t in x.split())}) v(query, vec, term, weight)),
s AS (SELECT DISTINCT query, weight, a.vec_id AS item, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 9) AS x FROM embeddings a, q JOIN embeddings b ON b.vec_id = q.vec),
ve AS (SELECT query, weight, item, row_number() OVER (PARTITION BY query ORDER BY x DESC, item)::INT AS rank, x FROM s QUALIFY rank <= 10),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), a AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
t AS (SELECT doc_id, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM d, (SELECT DISTINCT term FROM q) WHERE list_contains(w, term)), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
b AS (SELECT query, weight, doc_id AS item, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS x FROM t JOIN f USING (term) JOIN q USING (term), a WHERE weight < 1 GROUP BY 1, 2, 3),
bm AS (SELECT query, weight, item, row_number() OVER (PARTITION BY query ORDER BY x DESC, item)::INT AS rank FROM b QUALIFY rank <= 10),
u AS (SELECT query, item, weight / (60.0::DOUBLE + rank) AS s FROM ve WHERE weight < 1 UNION ALL SELECT query, item, (1 - weight) / (60.0::DOUBLE + rank) FROM bm),
h AS (SELECT query, item, round(sum(s), 9) AS x FROM u GROUP BY 1, 2)
SELECT query, 'vector' AS branch, item, round(x, 6) AS score, rank FROM ve WHERE weight >= 1
UNION ALL SELECT * FROM (SELECT query, 'hybrid' AS branch, item, round(x, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY x DESC, item)::INT AS rank FROM h) WHERE rank <= 10""",
)
def answered(s, d):
    """Each question goes to the search that its weight names: vectors alone, or vectors and words together."""
    vectors = table(s, d, "embeddings").select("vec_id", "embedding")
    stated = {r["vec_id"]: r["embedding"] for r in vectors.filter(F.col("vec_id").isin([v for v, _, _ in _QUESTIONS.values()])).collect()}  # one a question
    questions = [retrieval.Question(q, stated[v], words, weight) for q, (v, words, weight) in _QUESTIONS.items()]
    out = retrieval.answer(vectors, table(s, d, "documents").select("doc_id", "text"), questions, 10, "doc_id", "text")
    return out.select("query", "branch", "item", F.round("score", 6).alias("score"), "rank")


_ASK = "helper run"
FUNCTION_TEXTS_SQL = f"""WITH d0 AS (SELECT {_M} || '.helper' || {_K} AS id, 'module: ' || {_M} || chr(10) || 'class: ' || chr(10) || {_HELPER} AS text FROM part UNION ALL SELECT {_M} || '.C' || {_K} || '.run', 'module: ' || {_M} || chr(10) || 'class: ' || {_M} || '.C' || {_K} || chr(10) || list_filter([substr({_CLASS}, instr({_CLASS}, '    def run'))], lambda x: true)[1] FROM part),
d AS (SELECT id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM d0)"""


def function_texts(s, d):
    """id and text, as it is searched, of every function."""
    docs = E.latest(entities(s, d, ["function"], ["class_id", "source"]), "function")
    return docs.select("id", F.concat_ws("\n", F.concat(F.lit("module: "), F.col("module_id")), F.concat(F.lit("class: "), F.coalesce("class_id", F.lit(""))), "source").alias("text"))


@query(
    "ret_07",
    FUNCTION_TEXTS_SQL + f""", q AS (SELECT unnest(['helper', 'run']) AS term), a AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
t AS (SELECT id, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM d, q WHERE list_contains(w, term)), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
b AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM t JOIN f USING (term), a GROUP BY 1),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM b QUALIFY rank <= 10), o AS (SELECT r.id, rank, text, {_outline_sql('text', 40)} AS short FROM r JOIN d USING (id))
SELECT id, rank, md5(CASE WHEN {_TOKENS.format('text')} > 40 THEN short ELSE text END) AS digest FROM o WHERE {_TOKENS.format('CASE WHEN ' + _TOKENS.format('text') + ' > 40 THEN short ELSE text END')} <= 40""",
)
def code_search(s, d):
    """Function sources by words; results as they are shown."""
    docs = durable(function_texts(s, d), "code-texts")  # read for lengths, for words and for what is shown
    found = retrieval.bm25(docs, "id", "text", {0: _ASK}).select("id", "rank").join(docs, "id")
    return views.snippets(found, "text", 40).select("id", "rank", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("ret_09", "SELECT source, doc_id, round(n_chars / max(n_chars) OVER (PARTITION BY source), 6) AS confidence, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents QUALIFY rank <= 5")
def by_relevance(s, d):
    return retrieval.by_relevance(table(s, d, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id", 5).select("source", "doc_id", F.round("confidence", 6).alias("confidence"), "rank")


@query("set_05", "WITH t AS (SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1), '/')[1] AS k FROM pages) SELECT min(page_id) AS page_id FROM t GROUP BY k")
def without_similar(s, d):
    rows = table(s, d, "pages").select("page_id", F.get(F.split(W.path(F.col("url")), "/"), F.lit(0)).alias("k"))
    return rows.groupBy("k").agg(F.min("page_id").alias("page_id")).select("page_id")


@query("top_10", "SELECT page_id FROM pages WHERE page_id NOT IN (SELECT item_id FROM benchmark) ORDER BY page_id DESC LIMIT 10")
def latest_results(s, d):
    rows = table(s, d, "pages").select("page_id", F.col("page_id").alias("link"))
    seen = table(s, d, "benchmark").select(F.col("item_id").alias("link"))
    return W.unseen(rows, seen, 20, [F.col("page_id").desc()]).orderBy(F.col("page_id").desc()).limit(10).select("page_id")


@query("src_11", r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a[^>]+href="([^"]+)"[^>]*>([^<]+)</a>', 1)) AS link, unnest(regexp_extract_all(html, '(?is)<a[^>]+href="([^"]+)"[^>]*>([^<]+)</a>', 2)) AS title FROM pages)
SELECT page_id, link, count(*)::BIGINT AS n FROM a WHERE trim(title) <> '' GROUP BY 1, 2""")
def scraped_links(s, d):
    return W.scraped(table(s, d, "pages"), "html", ["page_id"]).groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@query("src_13", r"""SELECT page_id, len(html) > 0 AS success, len(html)::BIGINT AS content_length, len(regexp_extract_all(html, '(?i)<a[^>]+href='))::BIGINT AS n_links, len(regexp_extract_all(html, '(?i)<img\b'))::BIGINT AS n_images FROM pages""")
def crawl_records(s, d):
    pages = table(s, d, "pages").select("page_id", "url", "html")
    return pages.select("page_id", W.crawled(F.col("url"), F.col("html")).alias("c")).select("page_id", "c.success", F.col("c.content_length").alias("content_length"), F.col("c.n_links").alias("n_links"), F.col("c.n_images").alias("n_images"))


# ---- messages ----
_ANSWER = "substr(text, 1, 30)"


@query("arr_16", f"SELECT conv_id, turn AS pos, CASE WHEN {_TOKENS.format(_ANSWER)} >= 5 THEN 'summary of ' || len({_ANSWER}) ELSE {_ANSWER} END AS response FROM {C} WHERE answers")
def summarized_responses(s, d):
    m = M.summarize_responses(F.col("messages"), 5, lambda c: F.format_string("summary of %d", F.length(c)))
    return histories(s, d).select("conv_id", F.explode(m).alias("m")).select("conv_id", F.col("m.pos").cast("long").alias("pos"), F.explode("m.tool_responses").alias("r")).select("conv_id", "pos", F.col("r.content").alias("response"))


@query("arr_17", f"SELECT conv_id, turn AS pos, CASE WHEN turn % 4 = 3 THEN 'history of ' || (SELECT count(*) FROM {C} x WHERE x.conv_id = c.conv_id AND NOT x.answers) ELSE substr(text, 1, 20) END AS arguments FROM {C} c WHERE calling")
def injected_histories(s, d):
    m = M.inject_history(F.col("messages"), "tool3", lambda h: F.format_string("history of %d", F.size(h)))
    return histories(s, d).select("conv_id", F.explode(m).alias("m")).select("conv_id", F.col("m.pos").cast("long").alias("pos"), F.explode("m.tool_calls").alias("c")).select("conv_id", "pos", F.col("c.function.arguments").alias("arguments"))


@query("arr_20", f"SELECT conv_id, '2024-02-01' AS time, min_by(text, turn) FILTER (role = 'user') AS query, least(count(*), 4)::BIGINT AS n_history, CASE WHEN conv_id % 7 = 0 THEN 'failed' ELSE NULL END AS error FROM {C} GROUP BY conv_id")
def researcher_records(s, d):
    r = M.researcher_history(F.col("messages"), F.lit("2024-02-01"), 2, F.when(F.col("conv_id") % 7 == 0, "failed"))
    return histories(s, d).select("conv_id", r.alias("r")).select("conv_id", "r.time", "r.query", F.size("r.history").cast("long").alias("n_history"), "r.error")


@query("str_03", f"SELECT conv_id, turn, CASE WHEN k = 0 THEN 0 ELSE (k - 1) % 2 + 1 END::INT AS n_calls FROM (SELECT conv_id, turn, sum(calling::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS k FROM {C})")
def counted_calls(s, d):
    return M.call_counter(table(s, d, "conversations"), "conv_id", "turn", (F.col("role") == "assistant") & (F.col("turn") % 2 == 1)).select("conv_id", "turn", "n_calls")


@query("str_01", "SELECT event_type, count(*)::BIGINT AS n FROM events e WHERE ts >= TIMESTAMP '2024-01-05' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.ts < TIMESTAMP '2024-01-05' AND b.user_id = e.user_id AND b.event_type = e.event_type) GROUP BY 1")
def polled_additions(s, d):
    """A later snapshot against the one before it."""
    e = table(s, d, "events").select("user_id", "event_type", "ts")
    cut = F.lit("2024-01-05").cast("timestamp_ntz")
    new = snapshots.additions(e.filter(F.col("ts") < cut), e.filter(F.col("ts") >= cut), ["user_id", "event_type"])
    return new.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("udf_04", "SELECT doc_id, (doc_id % 5 <> 0 AND n_chars > 500) AS important, CASE WHEN doc_id % 5 = 0 THEN 'no answer' ELSE 'chars ' || n_chars END AS summary FROM documents")
def judged_documents(s, d):
    """A judge is any callable from texts to replies; here it counts.  It breaks off on batches with a document whose id
    ends in 0 and replies no JSON to those whose id ends in 5: both are without a judgement, the rest of their batch has one."""

    def judge(texts: list[str]) -> list[str]:
        if any(t.partition(":")[0].endswith("0") for t in texts):
            raise TimeoutError("no reply")
        return ["I cannot say" if t.partition(":")[0].endswith("5") else counted(t) for t in texts]

    def counted(t: str) -> str:
        size = len(t.partition(":")[2])
        return json.dumps({"important": size > 500, "summary": f"chars {size}"})

    rows = table(s, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("text")).alias("text"))
    asked = judged.judged(rows, "text", judge, "important boolean, summary string")
    return asked.select("doc_id", F.coalesce("judgement.important", F.lit(False)).alias("important"), F.coalesce("judgement.summary", F.lit("no answer")).alias("summary"))


# ---- scores ----
def _personal_sql() -> str:
    steps = [f"WITH {TRADE}", "o AS (SELECT src, count(*) AS k FROM e GROUP BY 1)", "c AS (SELECT count(*)::DOUBLE AS c FROM n)", "r0 AS (SELECT a.node AS s, b.node AS node, 1.0::DOUBLE / c AS pr, CASE WHEN a.node = b.node THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END / (c + 1) AS p FROM n a, n b, c)"]
    for k in range(ROUNDS):
        steps.append(f"i{k} AS (SELECT s, dst AS node, sum(pr / k) AS x FROM e JOIN o USING (src) JOIN r{k} ON node = src GROUP BY 1, 2)")
        steps.append(f"l{k} AS (SELECT s, coalesce(sum(pr) FILTER (node NOT IN (SELECT src FROM o)), 0) AS lost FROM r{k} GROUP BY 1)")
        steps.append(f"r{k + 1} AS (SELECT r.s, r.node, {1 - ALPHA}::DOUBLE * p + {ALPHA}::DOUBLE * (coalesce(x, 0) + lost * p) AS pr, p FROM r{k} r LEFT JOIN i{k} i ON i.s = r.s AND i.node = r.node JOIN l{k} l ON l.s = r.s)")
    return ",\n".join(steps)


@query("grf_01", f"{_personal_sql()} SELECT node, round(least(10 * pr, 1.0), 6) AS score FROM r{ROUNDS} WHERE s = node")
def personal_scores(s, d):
    pr = graphs.personal_pageranks(nations(s, d), trade(s, d), ROUNDS, ALPHA).filter("s = node")
    return pr.select("node", F.round(F.least(F.col("pr") * 10, F.lit(1.0)), 6).alias("score"))


#: Shortest paths by walks of up to 6 edges: on the trade graph no shortest path is longer.
_PATHS = """x AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst), n0 AS (SELECT node AS s, node AS t, 0 AS d, 1.0::DOUBLE AS k FROM n),
""" + ",\n".join(f"n{i + 1} AS (SELECT s, dst AS t, {i + 1} AS d, sum(k) AS k FROM n{i} JOIN x ON t = src GROUP BY 1, 2)" for i in range(6)) + """,
w AS (""" + " UNION ALL ".join(f"SELECT * FROM n{i}" for i in range(7)) + """), m AS (SELECT s, t, min(d) AS d FROM w GROUP BY 1, 2), sp AS (SELECT w.* FROM w JOIN m USING (s, t, d)),
bt AS (SELECT a.t AS node, sum(a.k * b.k / c.k) / ((SELECT count(*) FROM n) - 1.0) / ((SELECT count(*) FROM n) - 2.0) AS btw FROM sp a JOIN sp b ON b.s = a.t JOIN sp c ON c.s = a.s AND c.t = b.t WHERE a.d + b.d = c.d AND a.d > 0 AND b.d > 0 GROUP BY 1)"""


@query("grf_03", f"WITH {TRADE}, {_PATHS} SELECT node, round(coalesce(btw, 0), 6) AS betweenness FROM n LEFT JOIN bt USING (node)")
def betweenness(s, d):
    return graphs.betweenness(nations(s, d), trade(s, d)).select("node", F.round("betweenness", 6).alias("betweenness"))


_USAGE = "least(i / 5.0, 1.0) + 0.5 * least(fc / 10.0, 1.0) + 0.5 * least(cc / 10.0, 1.0)"
#: A module of each nation: as many branches as its key says, a definition as deep as its region says.
_MODULE = "repeat('if a:' || chr(10), n_nationkey) || repeat('    ', n_regionkey) || 'def f():'"


@query(
    "grf_04_05",
    f"""{_personal_sql()}, {_PATHS},
g0 AS (SELECT n.node, (SELECT count(*) FROM e WHERE dst = n.node) AS i, (SELECT count(*) FROM e WHERE src = n.node) AS o, least(10 * r.pr, 1.0) AS pr, coalesce(btw, 0) AS btw,
 (SELECT count(*) FROM supplier WHERE s_nationkey = n.node) AS fc, (SELECT count(*) FROM customer WHERE c_nationkey = n.node AND c_acctbal < 0) AS cc FROM n JOIN r{ROUNDS} r ON r.s = n.node AND r.node = n.node LEFT JOIN bt ON bt.node = n.node),
h0 AS (SELECT c_nationkey AS node, count(*) AS commits, avg(c_acctbal) AS days FROM customer GROUP BY 1),
p0 AS (SELECT node, least((0.5 * least(i / 5.0, 1.0) + 0.2 * least(o / 10.0, 1.0) + 0.6 * pr + 0.4 * least(10 * btw, 1.0)) / 1.7 + CASE WHEN i > 2 AND o <= 1 THEN 0.3 WHEN i > 2 AND o > 2 THEN 0.2 ELSE 0.0 END, 1.0) AS refs, {_USAGE} AS usage,
 CASE WHEN n_name IN ('CHINA', 'JAPAN') THEN 0.5 ELSE 0.0 END AS semantic, least(n_nationkey / 50.0, 1.0) + 0.3 * least(n_regionkey / 5.0, 1.0) AS complexity, 0.7 * least(commits / 20.0, 1.0) + 0.3 * greatest(0.0, 1.0 - days / 365.0) AS git FROM g0 JOIN nation ON n_nationkey = node JOIN h0 USING (node))
SELECT node, round(refs, 5) AS refs, round(usage, 5) AS usage, round(git::DOUBLE, 5) AS git, round(complexity::DOUBLE, 5) AS complexity, round(least(2.0 * usage + 3.0 * refs + 1.0 * complexity + 0.5 * semantic + 4.0 * git, 10.0), 5) AS importance FROM p0""",
)
def importance(s, d):
    """The module score from all its parts: usage (imports, calls of functions and of classes), references (degrees,
    personalised PageRank, betweenness), complexity, names, history."""
    n, e = nations(s, d), trade(s, d)
    pr = graphs.personal_pageranks(n, e, ROUNDS, ALPHA).filter("s = node").select("node", F.least(F.col("pr") * 10, F.lit(1.0)).alias("pr"))
    rows = graphs.degrees(n, e).join(pr, "node").join(graphs.betweenness(n, e), "node")
    names = table(s, d, "nation").select(
        F.col("n_nationkey").alias("node"), F.when(F.col("n_name").isin("CHINA", "JAPAN"), 0.5).otherwise(0.0).alias("semantic"), scoring.complexity(F.expr(_MODULE.replace("chr(10)", "'\\n'"))).alias("complexity")
    )
    calls = lambda rows, key, name: rows.groupBy(F.col(key).alias("node")).agg(F.count(F.lit(1)).alias(name))
    rows = rows.join(calls(table(s, d, "supplier"), "s_nationkey", "fc"), "node", "left").join(calls(table(s, d, "customer").filter("c_acctbal < 0"), "c_nationkey", "cc"), "node", "left").fillna(0, ["fc", "cc"])
    past = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.count(F.lit(1)).alias("commits"), F.avg("c_acctbal").alias("days"))
    rows = rows.join(names, "node").join(past, "node").select("node", scoring.reference_score(F.col("in_deg"), F.col("out_deg"), F.col("pr"), F.col("betweenness")).alias("refs"), scoring.usage(F.col("in_deg"), F.col("fc"), F.col("cc")).alias("usage"), "complexity", "semantic", scoring.history(F.col("commits"), F.col("days")).alias("git"))
    total = scoring.importance(usage=F.col("usage"), refs=F.col("refs"), complexity=F.col("complexity"), semantic=F.col("semantic"), git=F.col("git"))
    return rows.select("node", F.round("refs", 5).alias("refs"), F.round("usage", 5).alias("usage"), F.round("git", 5).alias("git"), F.round("complexity", 5).alias("complexity"), F.round(total, 5).alias("importance"))


@query("dtm_04", "SELECT doc_id, round(least(n_chars / 5000.0, 1.0) * 0.7, 6) AS share FROM documents")
def capped_shares(s, d):
    return table(s, d, "documents").select("doc_id", F.round(D.capped(F.col("n_chars"), 5000, 0.7), 6).alias("share"))


@query("dtm_05", "SELECT o_orderkey, round(least(2.0::DOUBLE * pow(2, o_orderkey % 9), 60.0) * (0.5 + 0.5 * (o_custkey % 10) / 10.0), 6) AS delay FROM orders")
def delays(s, d):
    return table(s, d, "orders").select("o_orderkey", F.round(D.backoff(F.col("o_orderkey") % 9, 2.0, 60.0, F.col("o_custkey") % 10 / F.lit(10.0)), 6).alias("delay"))


# ---- stored tables ----
def _folder(s, name: str) -> str:
    return f"{shared_folder(s).rstrip('/')}/loomwright/{name}-{uuid.uuid4().hex}"


@query("src_05", "SELECT r_regionkey, r_name FROM region")
def csv_table(s, d):
    path = _folder(s, "csv")
    table(s, d, "region").write.csv(path, header=True)
    return tables.csv(s, path).select("r_regionkey", "r_name")


@query("src_07_snk_02", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def json_table(s, d):
    path = _folder(s, "json")
    one = F.to_json(F.struct("n_nationkey", "n_name"))
    tree.write(table(s, d, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".json")).alias("path"), one.alias("body")), "path", "body", path)
    document = lambda name, kind: F.variant_get("document", f"$.{name}", kind).alias(name)
    return tables.json_documents(s, path).select(document("n_nationkey", "bigint"), document("n_name", "string"))


@query("src_03_14_19", "SELECT 'd' || n_regionkey || '/n' || n_nationkey || '.txt' AS path, (len(n_name) + 1)::BIGINT AS length, n_name || chr(10) AS content, 'txt' AS language FROM nation")
def scanned_files(s, d):
    """Small files are written by the tasks, scanned again, and read in order of their paths."""
    path = _folder(s, "files")
    at = F.concat(F.lit("d"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string"), F.lit(".txt"))
    tree.write(table(s, d, "nation").select(at.alias("path"), F.concat("n_name", F.lit("\n")).alias("content")), "path", "content", path)
    found = S.texts(S.scan(s, path))
    return found.select("path", "length", "content", P.extension(F.col("path")).alias("language")).orderBy("path")


@query("src_15_snk_11", "SELECT c_custkey, c_name FROM customer")
def stored_users(s, d):
    """Insert-if-absent into a table that is not there yet, then again with rows it has."""
    path = _folder(s, "users")
    rows = table(s, d, "customer").select("c_custkey", "c_name")
    half = rows.filter("c_custkey % 2 = 0")
    schema = "c_custkey long, c_name string"
    # what is stored at first, which is nothing, takes part in the result
    tables.append_absent(s, path, half.unionByName(tables.stored(s, path, schema)), ["c_custkey"])
    tables.append_absent(s, path, rows, ["c_custkey"])
    return tables.stored(s, path, schema)


@query("snk_01", f"SELECT 'class' AS kind, count(*)::BIGINT AS n FROM part UNION ALL SELECT 'function', 2 * count(*) FROM part UNION ALL SELECT 'import', 2 * count(*) FROM part")
def saved_entities(s, d):
    path, e = _folder(s, "entities"), parsed(s, d, ["class", "function", "import", "importfrom"])
    sinks.save_entities({"class": E.latest(e, "class"), "function": E.latest(e, "function"), "import": E.imports(e)}, path)
    out = None
    for kind in ("class", "function", "import"):
        rows = s.read.parquet(f"{path}/{kind}").agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("snk_05", "SELECT conv_id, max(turn) AS last, count(*)::BIGINT AS n FROM conversations GROUP BY 1")
def stored_sessions(s, d):
    """Messages are appended as they come; a second append of the same ones adds nothing."""
    path = _folder(s, "sessions")
    rows = table(s, d, "conversations").select("conv_id", "turn", "role", "text")
    tables.append_absent(s, path, rows.filter("turn < 2"), ["conv_id", "turn"])
    tables.append_absent(s, path, rows, ["conv_id", "turn"])
    return tables.stored(s, path, rows.schema).groupBy("conv_id").agg(F.max("turn").alias("last"), F.count(F.lit(1)).alias("n"))


@query("snk_08", "SELECT o_orderkey::VARCHAR AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'in_progress' END AS status, CASE WHEN o_orderpriority < '2' THEN 'high' WHEN o_orderpriority < '4' THEN 'medium' ELSE 'low' END AS priority FROM orders")
def stored_todos(s, d):
    path = _folder(s, "todos")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("in_progress")
    priority = F.when(F.col("o_orderpriority") < "2", "high").when(F.col("o_orderpriority") < "4", "medium").otherwise("low")
    todos = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("content"), status.alias("status"), priority.alias("priority"))
    sinks.write_todos(todos, path)
    sinks.write_todos(todos, path)
    return sinks.todos(s, path).select("id", "status", "priority")


@query("snk_12", "SELECT page_id, strftime(TIMESTAMP '2024-02-01 10:30:00', '%Y%m%d_%H%M%S') || '_' || substr(lower(regexp_replace(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_ .-]', '', 'g'), ' +', '_', 'g'), '^[._]+|[._]+$', '', 'g')), 1, 40) AS name FROM pages WHERE html IS NOT NULL")
def upload_names(s, d):
    rows = table(s, d, "pages").filter("html is not null")
    return rows.select("page_id", P.upload_name(F.col("url"), F.lit("2024-02-01 10:30:00").cast("timestamp_ntz")).alias("name"))


@query("snk_04", "SELECT doc_id, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(range(0, greatest(1, ceil((len(text) - 100) / 900.0))::INT)) AS c FROM documents WHERE len(text) > 0) GROUP BY 1")
def stored_chunks(s, d):
    path = _folder(s, "chunks")
    docs = table(s, d, "documents").select("doc_id", "text")
    sinks.append_chunks(retrieval.chunks(docs, ["doc_id"], "text", 1000, 100), lambda texts: [[float(len(t))] for t in texts], path)
    return s.read.parquet(path).filter("embedding[0] = length(chunk)").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
