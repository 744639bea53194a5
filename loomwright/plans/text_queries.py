"""Text functions over the driver tables; literal fixtures where the tables hold no such texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import budgets, retrieval
from ..session import table
from ..sources.web import host, path
from .relational_queries import FILES, files

CATALOG: dict = {}


def query(name: str, sql: str | None):
    def keep(f):
        CATALOG[name] = (f, sql)
        return f

    return keep


_CLEAN = "html"
for _p, _r in T.CLEAN_STEPS:
    _flags = ""
    if _p.startswith("(?"):
        _head, _p = _p[2:].split(")", 1)
        _flags = _head.replace("(?", "")
    _opts = "g" + "".join(f for f in _flags if f in "ims")
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_r.replace('$1', chr(92) + '1')}', '{_opts}')"


@query(
    "txt_01",
    f"""WITH c AS (SELECT page_id, {_CLEAN} AS x FROM pages),
l AS (SELECT page_id, list_filter(list_transform(string_split(x, chr(10)), lambda y: regexp_replace(y, '^[ \\t\\f\\r\\v]+|[ \\t\\f\\r\\v]+$', '', 'g')), lambda y: len(string_split(trim(regexp_replace(y, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')), ' ')) > 2) AS ls FROM c)
SELECT page_id, md5(array_to_string(ls, chr(10))) AS digest FROM l""",
)
def cleaned_pages(s, d):
    return table(s, d, "pages").select("page_id", F.md5(T.clean_page(F.col("html")).cast("binary")).alias("digest"))


_FENCED = "CASE WHEN turn % 3 = 0 THEN '```' || CASE WHEN turn % 2 = 0 THEN 'python' ELSE 'bash' END || chr(10) || text || chr(10) || '```' WHEN turn % 3 = 1 THEN '```rust' || chr(10) || text || chr(10) || '```' ELSE text END"


@query("txt_02", f"WITH m AS (SELECT conv_id, turn, text, {_FENCED} AS content FROM conversations) SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'python' ELSE 'bash' END AS language, md5(text) AS code FROM m WHERE turn % 3 = 0 AND NOT contains(text, '```')")
def fenced_code(s, d):
    rows = table(s, d, "conversations").filter(~F.col("text").contains("```")).select("conv_id", "turn", F.expr(_FENCED.replace("chr(10)", "char(10)")).alias("content"))
    return rows.select("conv_id", "turn", F.explode(T.code_blocks(F.col("content"))).alias("b")).select("conv_id", "turn", "b.language", F.md5(F.col("b.code").cast("binary")).alias("code"))


_ERRORS = "'step ' || event_id || chr(10) || CASE event_id % 3 WHEN 0 THEN 'ModuleNotFoundError: No module named ''pkg' || (event_id % 50) || '''' WHEN 1 THEN 'ImportError: cannot import name ''part'' from ''lib' || (event_id % 7) || '''' ELSE 'all fine' END || chr(10) || 'done'"


def _error_text():
    n = F.col("event_id")
    first = F.concat(F.lit("ModuleNotFoundError: No module named 'pkg"), (n % 50).cast("string"), F.lit("'"))
    second = F.concat(F.lit("ImportError: cannot import name 'part' from 'lib"), (n % 7).cast("string"), F.lit("'"))
    return F.concat(F.lit("step "), n.cast("string"), F.lit("\n"), F.when(n % 3 == 0, first).when(n % 3 == 1, second).otherwise("all fine"), F.lit("\ndone"))


@query(
    "txt_03_04",
    f"""WITH t AS (SELECT event_id, {_ERRORS} AS text FROM events WHERE event_type = 'error')
SELECT event_id, 'missing_package' AS error_type, regexp_extract(text, 'No module named ''([^'']+)''', 1) AS package, 'Install the missing package using pip: pip install ' || regexp_extract(text, 'No module named ''([^'']+)''', 1) AS suggestion, len(text) AS context_size FROM t WHERE contains(text, 'No module named')
UNION ALL SELECT event_id, 'import_name_error', regexp_extract(text, 'from ''([^'']+)''', 1), 'Check if package ' || regexp_extract(text, 'from ''([^'']+)''', 1) || ' version is correct. Component part may have been added in newer versions or doesn''t exist in current version.', len(text) FROM t WHERE contains(text, 'cannot import name')""",
)
def package_errors(s, d):
    texts = table(s, d, "events").filter("event_type = 'error'").select("event_id", _error_text().alias("text"))
    return T.package_errors(texts, "event_id", "text").select("event_id", "error_type", F.col("details")["package_name"].alias("package"), "suggestion", F.length("context").cast("long").alias("context_size"))


@query("txt_07", "SELECT page_id, substr(lower(regexp_replace(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_ .-]', '', 'g'), ' +', '_', 'g'), '^[._]+|[._]+$', '', 'g')), 1, 40) AS name FROM pages")
def safe_names(s, d):
    return table(s, d, "pages").select("page_id", P.safe_name(F.col("url")).alias("name"))


@query("txt_09", "SELECT c_custkey, sha256(c_name) AS hash, md5(c_name) AS name FROM customer")
def digests(s, d):
    return table(s, d, "customer").select("c_custkey", F.sha2(F.col("c_name").cast("binary"), 256).alias("hash"), F.md5(F.col("c_name").cast("binary")).alias("name"))


@query("txt_11", "SELECT doc_id, len(split_part(text, chr(10), 1))::BIGINT AS before, (len(text) - len(split_part(text, chr(10), 1)))::BIGINT AS rest FROM documents")
def split_at_mark(s, d):
    head = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    return table(s, d, "documents").select("doc_id", F.length(head).cast("long").alias("before"), (F.length("text") - F.length(head)).cast("long").alias("rest"))


@query("txt_12_agg_19", "SELECT source, sum(len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^ \\t\\n\\v\\f\\rA-Za-z0-9_]')))::BIGINT AS tokens FROM documents GROUP BY 1")
def token_totals(s, d):
    return table(s, d, "documents").groupBy("source").agg(F.sum(T.token_estimate(F.col("text"))).cast("long").alias("tokens"))


@query("txt_13_windows", "SELECT doc_id, c AS chunk_pos, md5(substr(text, c * 900 + 1, 1000)) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil((len(text) - 100) / 900.0))::INT)) AS c FROM documents WHERE len(text) > 0)")
def text_chunks(s, d):
    out = retrieval.chunks(table(s, d, "documents").select("doc_id", "text"), ["doc_id"], "text", 1000, 100)
    return out.select("doc_id", F.col("chunk_pos").cast("long").alias("chunk_pos"), F.md5(F.col("chunk").cast("binary")).alias("chunk"))


@query("txt_14", "WITH b AS (SELECT source, doc_id, lang || ':' || doc_id AS t, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM documents) SELECT source, md5(string_agg(t, chr(10) ORDER BY doc_id)) AS context FROM b WHERE run <= 20000 GROUP BY 1")
def contexts(s, d):
    """What fits the budget of each source is joined; the rest is never collected."""
    docs = budgets.prefix(table(s, d, "documents").select("source", "doc_id", "n_chars", "lang"), "source", ["doc_id"], "n_chars", 20000)
    each = F.sort_array(F.collect_list(F.struct("doc_id", F.concat_ws(":", "lang", F.col("doc_id").cast("string")).alias("t"))))
    return docs.groupBy("source").agg(F.md5(F.array_join(F.transform(each, lambda x: x["t"]), "\n").cast("binary")).alias("context"))


@query("txt_16", "SELECT page_id, regexp_replace(list_last(string_split(regexp_replace(url, '/+$', ''), '/')), '\\.git$', '') AS repo, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
def repo_names(s, d):
    return table(s, d, "pages").select("page_id", T.repo_name(F.col("url")).alias("repo"), host(F.col("url")).alias("host"))


@query("txt_18_known", "SELECT p.p_partkey, p.p_brand FROM part p WHERE p.p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_size > 45) AND p.p_type <> 'PROMO'")
def known_brands(s, d):
    known = table(s, d, "part").filter("p_size > 45").select("p_brand").distinct()
    return table(s, d, "part").filter("p_type != 'PROMO'").select("p_partkey", "p_brand").join(known, "p_brand", "left_semi")


@query("txt_19", "SELECT conv_id, coalesce(nullif(trim(max_by(text, turn) FILTER (role = 'system')), ''), trim(max_by(text, turn))) AS answer FROM conversations GROUP BY 1")
def final_answers(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(
        F.coalesce(F.nullif(F.trim(F.max_by(F.when(F.col("role") == "system", F.col("text")), F.when(F.col("role") == "system", F.col("turn")))), F.lit("")), F.trim(F.max_by("text", "turn"))).alias("answer")
    )


@query("txt_22", "SELECT doc_id, len(text) > 2000 AS is_cut, md5(CASE WHEN len(text) > 2000 THEN substr(text, 1, 2000) || '...' ELSE text END) AS digest FROM documents")
def truncated(s, d):
    return table(s, d, "documents").select("doc_id", (F.length("text") > 2000).alias("is_cut"), F.md5(T.cut(F.col("text"), 2000).cast("binary")).alias("digest"))


@query("txt_23", "SELECT event_id, CASE event_type WHEN 'error' THEN 'Error' WHEN 'click' THEN 'Click' ELSE event_type END AS label FROM events")
def labels(s, d):
    names = F.create_map(F.lit("error"), F.lit("Error"), F.lit("click"), F.lit("Click"))
    return table(s, d, "events").select("event_id", F.coalesce(F.try_element_at(names, F.col("event_type")), F.col("event_type")).alias("label"))


@query(
    "txt_10",
    """SELECT n_nationkey, '{"type":"json_schema","json_schema":{"name":"response_jsons","strict":true,"schema":{"type":"object","properties":{"name":{"type":"string","description":"like ' || n_name || '"},"rank":{"type":"integer","description":"of ' || n_regionkey || '"},"steps":{"type":"array","description":"in order","items":{"properties":{"at":{"type":"integer"},"parts":{"items":{"type":"string"},"type":"array"}},"type":"object"}}},"required":["name","rank","steps"],"additionalProperties":false}}}' AS doc FROM nation""",
)
def response_formats(s, d):
    """A format with a nested list of objects."""
    field = lambda name, kind, about, items=None: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), about.alias("description"), F.lit(items).cast("string").alias("items"))
    nested = '{"type":"object","properties":{"at":{"type":"integer"},"parts":{"type":"array","items":{"type":"string"}}}}'
    fields = F.array(
        field("name", "string", F.concat(F.lit("like "), F.col("n_name"))), field("rank", "integer", F.concat(F.lit("of "), F.col("n_regionkey").cast("string")), nested), field("steps", "array", F.lit("in order"), nested)
    )
    return table(s, d, "nation").select("n_nationkey", T.response_format(fields).alias("doc"))


@query("snk_07", "SELECT doc_id, CASE WHEN len(text) - len(replace(text, 'License', '')) = 7 THEN md5(replace(text, 'License', 'Licence')) ELSE 'none' END AS edited FROM documents WHERE contains(text, 'License')")
def strict_edits(s, d):
    return table(s, d, "documents").filter(F.col("text").contains("License")).select("doc_id", F.coalesce(F.md5(T.replace_exact(F.col("text"), F.lit("License"), F.lit("Licence")).cast("binary")), F.lit("none")).alias("edited"))


@query("prj_01", f"SELECT doc_id, regexp_replace(replace(path, '.txt', '.py'), '/', '.', 'g')[1:-4] AS module_id FROM {FILES}")
def module_ids(s, d):
    return files(s, d).select("doc_id", P.module_id(F.replace(F.col("path"), F.lit(".txt"), F.lit(".py"))).alias("module_id"))


@query("prj_07", "SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[2:3], chr(10))) AS source FROM documents")
def source_slices(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(F.array_join(F.slice(T.lines(F.col("text")), 2, 2), "\n").cast("binary")).alias("source"))


@query("prj_08", "SELECT doc_id, CASE WHEN len(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS doc FROM documents")
def docstrings(s, d):
    return table(s, d, "documents").select("doc_id", T.cut(F.col("text"), 100).alias("doc"))


@query("prj_17", "SELECT conv_id, string_agg(role || '(' || len(text) || ')', ', ' ORDER BY turn) AS calls FROM conversations GROUP BY 1")
def call_info(s, d):
    each = F.sort_array(F.collect_list(F.struct("turn", F.format_string("%s(%d)", F.col("role"), F.length("text")).alias("t"))))
    return table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(each, lambda x: x["t"]), ", ").alias("calls"))


@query("prj_19", "SELECT conv_id, CASE WHEN len(p) > 50 THEN substr(p, 1, 50) || '...' ELSE p END AS preview FROM (SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS p FROM conversations GROUP BY 1) WHERE p IS NOT NULL")
def previews(s, d):
    user = F.col("role") == "user"
    rows = table(s, d, "conversations").groupBy("conv_id").agg(F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("p")).filter("p is not null")
    return rows.select("conv_id", T.cut(F.col("p"), 50).alias("preview"))


@query("prj_20", "SELECT o_orderkey, 'Order ' || o_orderkey || ' of ' || o_custkey || ' is ' || o_orderstatus AS task FROM orders")
def filled_templates(s, d):
    t = T.fill(F.lit("Order {id} of {who} is {state}"), {"id": F.col("o_orderkey").cast("string"), "who": F.col("o_custkey").cast("string"), "state": F.col("o_orderstatus")})
    return table(s, d, "orders").select("o_orderkey", t.alias("task"))


@query("src_12_host", "SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*)::BIGINT AS pages, sum(len(html))::BIGINT AS size FROM pages GROUP BY 1")
def hosts(s, d):
    return table(s, d, "pages").groupBy(host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("html")).cast("long").alias("size"))


@query("grf_09", "SELECT node, list_last(string_split(node, '/')) AS name, len(string_split(node, '/')) AS depth, count(*)::BIGINT AS n FROM (SELECT unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], '/'))) AS node FROM (SELECT string_split(regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1), '/') AS p FROM pages)) GROUP BY 1, 2, 3")
def path_tree(s, d):
    p = F.split(path(F.col("url")), "/")
    each = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))
    nodes = table(s, d, "pages").select(F.explode(each).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("node", F.element_at(F.split("node", "/"), -1).alias("name"), F.size(F.split("node", "/")).cast("long").alias("depth"), "n")
