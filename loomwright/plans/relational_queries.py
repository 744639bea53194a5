"""Filters, joins, aggregates, windows, top-k, set operations, dates and scores over the driver tables.

Every query runs over whole tables; each comes with the DuckDB text that gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..functions import times as D
from ..operators import budgets, dedupe, lines, profiling, scoring, snapshots
from ..session import table

CATALOG: dict = {}
AS_OF = "2024-02-01 00:00:00"


def query(name: str, sql: str | None):
    def keep(f):
        CATALOG[name] = (f, sql)
        return f

    return keep


def files(s, d):
    """documents as files: path, content, size."""
    return table(s, d, "documents").select(F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "doc_id", "lang", "source", F.col("text").alias("content"), "n_chars")


FILES = "(SELECT concat_ws('/', lang, source, doc_id || '.txt') AS path, doc_id, lang, source, text AS content, n_chars FROM documents)"


@query("flt_04_top_05", "SELECT doc_id, hits FROM (SELECT doc_id, len(list_filter(string_split(lower(text), chr(10)), lambda x: contains(x, 'the')))::BIGINT AS hits FROM documents) WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 20")
def keyword_hits(s, d):
    return lines.hits(table(s, d, "documents"), ["doc_id"], "text", "the").orderBy(F.col("hits").desc(), "doc_id").limit(20)


@query(
    "flt_04_context",
    """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE contains(lower(text), 'license')),
n AS (SELECT *, contains(lower(line), 'license') AS is_hit, max(contains(lower(line), 'license')::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM n WHERE near = 1)
SELECT doc_id, line_no::BIGINT AS line_no, line, is_hit FROM r WHERE k <= 51""",
)
def keyword_context(s, d):
    return lines.search(table(s, d, "documents"), ["doc_id"], "text", "license").withColumn("line_no", F.col("line_no").cast("long"))


@query("flt_01", r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1) AS path FROM pages)
SELECT page_id, path, (path LIKE '.%' OR path LIKE '\_\_%' ESCAPE '\' OR regexp_matches(path, '\.(png|jpg|gif|zip|pdf|html)$') OR list_has_any(string_split(path, '/'), ['de', 'build', 'logs'])) AS ignored FROM p""")
def ignored_pages(s, d):
    from ..sources.web import path

    rows = table(s, d, "pages").select("page_id", path(F.col("url")).alias("path"))
    p = F.col("path")
    return rows.withColumn("ignored", p.startswith(".") | p.startswith("__") | p.rlike(r"\.(png|jpg|gif|zip|pdf|html)$") | P.has_part(p, ["de", "build", "logs"]))


@query("flt_02", "SELECT doc_id, (source IN ('build', 'src3', 'dist') OR lang IN ('.git')) AS ignored FROM documents")
def monitor_ignored(s, d):
    return files(s, d).select("doc_id", (P.has_part(F.col("path"), ["build", "src3", "dist", ".git"]) | P.ignored_by_monitor(F.col("path"))).alias("ignored"))


@query("flt_03", f"SELECT path FROM {FILES} WHERE contains(lower(path), 'src1')")
def path_search(s, d):
    return files(s, d).filter(F.lower("path").contains("src1")).select("path")


@query(
    "flt_05",
    """WITH e AS (SELECT p_partkey, 'exact' AS match_kind FROM part WHERE p_name = 'ring'), q AS (SELECT p_partkey, 'partial' AS match_kind FROM part WHERE contains(p_name, 'ring') AND NOT EXISTS (SELECT 1 FROM e)),
u AS (SELECT * FROM e UNION ALL SELECT * FROM q) SELECT p_partkey, match_kind, (count(*) OVER ())::BIGINT AS n_matches FROM u ORDER BY p_partkey LIMIT 5""",
)
def find_part(s, d):
    parts = table(s, d, "part")
    exact = parts.filter("p_name = 'ring'").select("p_partkey", F.lit("exact").alias("match_kind"))
    has = exact.agg(F.count(F.lit(1)).alias("has"))
    partial = parts.filter(F.col("p_name").contains("ring")).join(F.broadcast(has)).filter("has = 0").select("p_partkey", F.lit("partial").alias("match_kind"))
    both = exact.unionByName(partial)
    n = both.agg(F.count(F.lit(1)).alias("n_matches"))
    return both.orderBy("p_partkey").limit(5).join(F.broadcast(n))


@query("flt_06", r"""SELECT doc_id, md5(CASE WHEN regexp_matches(text, 'license|License|http') THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^[ \t]*(The|En|Der) ')), chr(10)) ELSE text END) AS digest FROM documents""")
def gated_line_filter(s, d):
    each = T.lines(F.col("text"))
    marked = F.exists(each, lambda x: x.rlike("license|License|http"))
    kept = F.array_join(F.filter(each, lambda x: ~x.rlike(r"^[ \t]*(The|En|Der) ")), "\n")
    return table(s, d, "documents").select("doc_id", F.md5(F.when(marked, kept).otherwise(F.col("text")).cast("binary")).alias("digest"))


@query("flt_10", "SELECT lang, bool_or(source LIKE '%9') AS has_nine, bool_or(text LIKE '%.py') AS has_python FROM documents GROUP BY lang")
def has_suffix(s, d):
    return table(s, d, "documents").groupBy("lang").agg(F.bool_or(F.col("source").endswith("9")).alias("has_nine"), F.bool_or(F.col("text").endswith(".py")).alias("has_python"))


@query("flt_12", "SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = p.page_id * 3 AND d.lang = 'fr') ORDER BY page_id LIMIT 50")
def unseen_pages(s, d):
    seen = table(s, d, "documents").filter("lang = 'fr' and doc_id % 3 = 0").select((F.col("doc_id") / 3).cast("long").alias("page_id"))
    return table(s, d, "pages").select("page_id", "url").join(seen, "page_id", "left_anti").orderBy("page_id").limit(50)


@query("flt_13", "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS url FROM pages")
def prefix_scrub(s, d):
    return table(s, d, "pages").select("page_id", P.strip_prefix(F.col("url"), "https://").alias("url"))


@query("flt_14", "SELECT conv_id, coalesce(min(turn) FILTER (run > 300), -1) AS ends_at FROM (SELECT conv_id, turn, sum(len(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM conversations) GROUP BY conv_id")
def overflow_turn(s, d):
    run = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return table(s, d, "conversations").select("conv_id", "turn", run.alias("run")).groupBy("conv_id").agg(F.coalesce(F.min(F.when(F.col("run") > 300, F.col("turn"))), F.lit(-1)).cast("long").alias("ends_at"))


@query("flt_15", "SELECT d.doc_id, l.doc_id IS NOT NULL AS is_labelled, b.item_id IS NOT NULL AS is_item FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) LEFT JOIN (SELECT DISTINCT item_id FROM benchmark) b ON b.item_id = d.doc_id")
def existence(s, d):
    docs = table(s, d, "documents").select("doc_id")
    lab = table(s, d, "labels").select("doc_id").distinct().withColumn("a", F.lit(True))
    ben = table(s, d, "benchmark").select(F.col("item_id").alias("doc_id")).distinct().withColumn("b", F.lit(True))
    return docs.join(lab, "doc_id", "left").join(ben, "doc_id", "left").select("doc_id", F.col("a").isNotNull().alias("is_labelled"), F.col("b").isNotNull().alias("is_item"))


@query("flt_16", "SELECT c_custkey, s_suppkey IS NOT NULL AS is_known FROM customer LEFT JOIN supplier ON s_name = 'Supplier#' || substr(c_name, 10) AND sha256(substr(s_name, 10)) = sha256(substr(c_name, 10))")
def credential_check(s, d):
    """Names and hashes of one table against those stored in another."""
    stored = table(s, d, "supplier").select(F.col("s_name").alias("name"), F.sha2(F.substring("s_name", 10, 99).cast("binary"), 256).alias("hash"), F.lit(True).alias("there"))
    given = table(s, d, "customer").select("c_custkey", F.concat(F.lit("Supplier#"), F.substring("c_name", 10, 99)).alias("name"), F.sha2(F.substring("c_name", 10, 99).cast("binary"), 256).alias("hash"))
    return given.join(stored, ["name", "hash"], "left").select("c_custkey", F.col("there").isNotNull().alias("is_known"))


# ---- joins ----
EDGES = """(SELECT DISTINCT c.c_nationkey AS src, s.s_nationkey AS dst, count(*) OVER (PARTITION BY c.c_nationkey, s.s_nationkey) AS w
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey)"""


@query("jn_04", "SELECT l_suppkey, count(DISTINCT l_partkey)::BIGINT AS n FROM lineitem GROUP BY l_suppkey")
def called_by(s, d):
    return table(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct().groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("jn_03", """WITH p AS (SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.') AS parts FROM pages)
SELECT suffix, count(*)::BIGINT AS n, min(page_id) AS first_page FROM (SELECT page_id, unnest(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[i:], '.'))) AS suffix FROM p) GROUP BY suffix""")
def host_suffixes(s, d):
    from ..sources.web import host

    parts = F.split(host(F.col("url")), "[.]")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return table(s, d, "pages").select("page_id", F.explode(each).alias("suffix")).groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


@query("jn_06", "SELECT o.o_orderkey, n.n_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def referencing_orders(s, d):
    returned = table(s, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    people = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")).join(table(s, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return table(s, d, "orders").select("o_orderkey", "o_custkey").join(returned, "o_orderkey", "left_semi").join(people, "o_custkey").select("o_orderkey", "n_name")


@query("jn_10", "SELECT DISTINCT user_id, props FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND (user_id, props) NOT IN (SELECT user_id, props FROM events WHERE ts < TIMESTAMP '2024-01-15' AND user_id IS NOT NULL AND props IS NOT NULL)")
def snapshot_additions(s, d):
    e = table(s, d, "events").select("user_id", "props", "ts")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return snapshots.additions(e.filter(F.col("ts") < cut), e.filter(F.col("ts") >= cut), ["user_id", "props"]).select("user_id", "props").distinct()


@query("jn_11", "SELECT l.doc_id, l.quality, d.source FROM labels l JOIN documents d USING (doc_id)")
def judged_files(s, d):
    return table(s, d, "labels").select("doc_id", "quality").join(table(s, d, "documents").select("doc_id", "source"), "doc_id")


@query("jn_12", "WITH a AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents), b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS k FROM benchmark) SELECT a.source, a.doc_id, b.item_id FROM a JOIN b USING (k)")
def index_join(s, d):
    a = table(s, d, "documents").select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("k"))
    b = table(s, d, "benchmark").select("item_id", F.row_number().over(Window.orderBy("item_id")).alias("k"))  # a judged list: a few rows
    return a.join(b, "k").select("source", "doc_id", "item_id")


@query("jn_14", "SELECT c.c_custkey, coalesce(m.top, c.c_acctbal) AS balance FROM customer c LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1) m ON m.o_custkey = c.c_custkey")
def override_merge(s, d):
    top = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"))
    return table(s, d, "customer").select("c_custkey", "c_acctbal").join(top, "c_custkey", "left").select("c_custkey", F.coalesce("top", "c_acctbal").alias("balance"))


@query("jn_15", "SELECT o_custkey, coalesce(min_by(o_orderkey, (o_orderpriority, o_orderkey)) FILTER (o_orderstatus <> 'F'), -1) AS pick FROM orders GROUP BY 1")
def fallback_pick(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderstatus") != "F", F.struct("o_orderpriority", "o_orderkey")))["o_orderkey"].alias("pick")).select("o_custkey", F.coalesce("pick", F.lit(-1)).cast("long").alias("pick"))


# ---- aggregates ----
@query("agg_01", "SELECT count(*)::BIGINT AS modules, count(DISTINCT source)::BIGINT AS packages, sum(len(text) - len(replace(text, chr(10), '')) + 1)::BIGINT AS lines FROM documents")
def repo_stats(s, d):
    return table(s, d, "documents").agg(F.count(F.lit(1)).alias("modules"), F.count_distinct("source").alias("packages"), F.sum(F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("lines"))


@query(
    "agg_03_04",
    r"""WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
c AS (SELECT doc_id, source, (len(list_filter(lines, lambda x: regexp_matches(x, '(^|[^A-Za-z0-9_])in([^A-Za-z0-9_]|$)'))) + len(list_filter(lines, lambda x: regexp_matches(x, '(^|[^A-Za-z0-9_])for([^A-Za-z0-9_]|$)')))) AS branches FROM l),
u AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT doc_id, branches::BIGINT AS branches, round(least(branches / 50.0, 1.0), 6) AS complexity, round(least(n / 5.0, 1.0) + 0.5 * least(branches / 10.0, 1.0), 6) AS usage FROM c JOIN u USING (source)""",
)
def usage_complexity(s, d):
    ls = T.lines(F.col("text"))
    n = F.size(F.filter(ls, lambda x: x.rlike(scoring.word_pattern("in")))) + F.size(F.filter(ls, lambda x: x.rlike(scoring.word_pattern("for"))))
    docs = table(s, d, "documents").select("doc_id", "source", n.cast("long").alias("branches"))
    per = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return docs.join(per, "source").select("doc_id", "branches", F.round(D.capped(F.col("branches"), 50), 6).alias("complexity"), F.round(scoring.usage(F.col("n"), F.col("branches"), F.lit(0)), 6).alias("usage"))


@query("agg_05_06", "SELECT lang, source, count(*)::BIGINT AS methods, sum(n_chars)::BIGINT AS size, max(doc_id) AS newest FROM documents GROUP BY 1, 2")
def rollups(s, d):
    return table(s, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("methods"), F.sum("n_chars").alias("size"), F.max("doc_id").alias("newest"))


@query(
    "agg_07",
    """WITH c AS (SELECT n_regionkey AS r, n_nationkey AS n, avg(least(c_acctbal / 1000.0, 10)) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
p AS (SELECT r, least((max(score) * 0.7 + avg(score) * 0.3) * 1.5, 10.0) AS score FROM c GROUP BY 1)
SELECT r_name AS package, round(least(score, 10.0), 4) AS score FROM p JOIN region ON r = r_regionkey""",
)
def package_scores(s, d):
    leaf = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg(F.least(F.col("c_acctbal") / 1000.0, F.lit(10.0))).alias("score"))
    up = leaf.join(table(s, d, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.max("score").alias("m"), F.avg("score").alias("a"))
    return up.join(table(s, d, "region"), "r_regionkey").select(F.col("r_name").alias("package"), F.round(scoring.package(F.lit(0.0), F.col("m"), F.col("a")), 4).alias("score"))


@query("agg_08", "SELECT l_suppkey, round(0.4 * count(DISTINCT l_orderkey) + 0.3 * count(DISTINCT l_partkey) + 0.3 * count(*), 4) AS score FROM lineitem GROUP BY 1 ORDER BY score DESC, l_suppkey LIMIT 10")
def fallback_class_scores(s, d):
    out = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("a"), F.count_distinct("l_partkey").alias("b"), F.count(F.lit(1)).alias("c"))
    return out.select("l_suppkey", F.round(F.lit(0.4) * F.col("a") + F.lit(0.3) * F.col("b") + F.lit(0.3) * F.col("c"), 4).alias("score")).orderBy(F.col("score").desc(), "l_suppkey").limit(10)


@query("agg_10", "SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY 1")
def error_summary(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


_PROFILED = {"c_custkey": "BIGINT", "c_name": "VARCHAR", "c_nationkey": "INTEGER", "c_acctbal": "DOUBLE", "c_mktsegment": "VARCHAR"}


@query("agg_11", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*)::BIGINT AS rows, count(*) FILTER ({c} IS NULL)::BIGINT AS nulls, count(DISTINCT {c})::BIGINT AS n_distinct, min({c})::VARCHAR AS low, max({c})::VARCHAR AS high FROM customer" for c in _PROFILED))
def csv_profile(s, d):
    return profiling.columns(table(s, d, "customer").select(*_PROFILED)).drop("type")


@query("agg_11_top", """WITH v AS (SELECT 'p_brand' AS "column", p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part),
c AS (SELECT "column", value, count(*)::BIGINT AS n FROM v WHERE value IS NOT NULL GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)::INT AS rank FROM c QUALIFY rank <= 4""")
def csv_top(s, d):
    return profiling.top_values(table(s, d, "part"), ["p_brand", "p_type", "p_size"])


@query("agg_14", "SELECT event_id, len(json_keys(props))::BIGINT AS n_keys, json_extract_string(props, '$.k') AS k FROM events")
def json_keys(s, d):
    return table(s, d, "events").select("event_id", F.size(F.json_object_keys("props")).cast("long").alias("n_keys"), F.get_json_object("props", "$.k").alias("k"))


@query("agg_15", "WITH l AS (SELECT doc_id, string_split(lower(text), chr(10)) AS x FROM documents) SELECT doc_id, len(x)::BIGINT AS n_lines, len(list_filter(x, lambda y: regexp_matches(y, 'error|err|exception|fail')))::BIGINT AS n_errors, len(list_filter(x, lambda y: contains(y, 'warn')))::BIGINT AS n_warnings FROM l")
def log_stats(s, d):
    return table(s, d, "documents").select("doc_id", *profiling.log_counts(F.col("text")))


@query("agg_16", r"SELECT ext, count(*)::BIGINT AS n FROM (SELECT lower(regexp_extract(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1), '([^/]*)$', 1), '[^/]\.([^./]+)$', 1)) AS ext FROM pages) GROUP BY 1 ORDER BY n DESC, ext LIMIT 5")
def extension_histogram(s, d):
    from ..sources.web import path

    return profiling.kinds(table(s, d, "pages").select(path(F.col("url")).alias("path")), "path")


@query("agg_17", "SELECT doc_id, CASE WHEN len(text) = 0 THEN 0 ELSE len(text) - len(replace(text, chr(10), '')) + 1 END::BIGINT AS n_lines, len(text)::BIGINT AS n_chars FROM documents")
def text_stats(s, d):
    return table(s, d, "documents").select("doc_id", *profiling.text_counts(F.col("text")))


_FLAGS = ["quality = 1", "toxic = 0", "lang = 'en'", "n_chars > 500", "n_chars < 5000", "source <> 'src0'", "doc_id % 2 = 0", "n_chars % 3 = 0"]


@query("agg_18", "SELECT doc_id, round(0.6 * (" + " + ".join(f"({f})::INT * {w}::DOUBLE" for f, w in zip(_FLAGS, scoring.REPO_WEIGHTS)) + ") + (1 + doc_id % 10) / 10.0::DOUBLE * 0.4::DOUBLE, 6) AS score FROM labels JOIN documents USING (doc_id)")
def weighted_scores(s, d):
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang", "n_chars", "source"), "doc_id")
    return rows.select("doc_id", F.round(scoring.repo_score([F.expr(f).cast("int") for f in _FLAGS], 1 + F.col("doc_id") % 10), 6).alias("score"))


@query("agg_20", "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY 1")
def distinct_roles(s, d):
    firsts = table(s, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return firsts.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "role"))), lambda x: x["role"]), ",").alias("roles"))


@query("agg_21", "SELECT lang, source, count(*)::BIGINT AS n_files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY ROLLUP (lang, source)")
def directory_sizes(s, d):
    return table(s, d, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_chars").alias("bytes"))


@query("agg_22_top_11", "SELECT doc_id, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS priority FROM documents ORDER BY priority, doc_id LIMIT 8")
def file_strip(s, d):
    return table(s, d, "documents").select("doc_id", F.when(F.col("lang") == "en", 0).otherwise(1).alias("priority")).orderBy("priority", "doc_id").limit(8)


@query("agg_23", "SELECT p_partkey, coalesce(n, 0)::BIGINT AS n_callers FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def callers_per_part(s, d):
    n = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_suppkey").alias("n"))
    return table(s, d, "part").select("p_partkey").join(n, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_callers"))


# ---- windows ----
@query("win_03", "SELECT source, doc_id FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM documents) WHERE run <= 20000")
def budget_prefix(s, d):
    return budgets.prefix(table(s, d, "documents").select("source", "doc_id", "n_chars"), "source", ["doc_id"], "n_chars", 20000).select("source", "doc_id")


@query("win_03_overshoot", "SELECT source, doc_id FROM (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM documents) WHERE run - n_chars <= 20000")
def budget_overshoot(s, d):
    return budgets.prefix(table(s, d, "documents").select("source", "doc_id", "n_chars"), "source", ["doc_id"], "n_chars", 20000, overshoot=True).select("source", "doc_id")


@query(
    "win_04",
    """WITH RECURSIVE o AS (SELECT conv_id, turn, len(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
r AS (SELECT conv_id, turn, n, k, 0 AS bin, n AS used FROM o WHERE k = 1
 UNION ALL SELECT o.conv_id, o.turn, o.n, o.k, CASE WHEN r.used > 0 AND r.used + o.n > 200 THEN r.bin + 1 ELSE r.bin END, CASE WHEN r.used > 0 AND r.used + o.n > 200 THEN o.n ELSE r.used + o.n END FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = r.k + 1)
SELECT conv_id, turn, bin FROM r""",
)
def next_fit_bins(s, d):
    rows = table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("m"))
    bins = budgets.next_fit(F.transform("m", lambda x: x["n"]), 200)
    return rows.select("conv_id", F.explode(F.arrays_zip(F.transform("m", lambda x: x["turn"]).alias("turn"), bins.alias("bin"))).alias("e")).select("conv_id", "e.turn", "e.bin")


@query("win_05", "SELECT doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 3)::INT AS batch FROM documents")
def fixed_batches(s, d):
    return budgets.batches(table(s, d, "documents").select("source", "doc_id"), "source", ["doc_id"], 3).select("doc_id", "batch")


@query("win_07", "SELECT page_id, CASE WHEN instr(path, '/') = 0 THEN len(html) * 5 ELSE len(html) END::BIGINT AS score FROM (SELECT page_id, html, regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1) AS path FROM pages)")
def root_boost(s, d):
    from ..sources.web import path

    return table(s, d, "pages").select("page_id", scoring.boosted_roots(path(F.col("url")), F.length("html")).cast("long").alias("score"))


@query("win_08", "WITH t AS (SELECT doc_id, regexp_extract_all(text, '[a-z]+') AS w FROM documents) SELECT doc_id, md5(array_to_string(CASE WHEN len(w) > 40 THEN w[1:20] || ['...'] || w[-20:] ELSE w END, ' ')) AS digest FROM t")
def head_tail_cut(s, d):
    w = F.regexp_extract_all("text", F.lit("([a-z]+)"), F.lit(1))
    return table(s, d, "documents").select("doc_id", F.md5(F.array_join(budgets.head_tail(w, 40), " ").cast("binary")).alias("digest"))


@query("win_11", "SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS high, value - max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS drawdown FROM events")
def running_maximum(s, d):
    high = F.max("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return table(s, d, "events").select("user_id", "event_id", high.alias("high"), (F.col("value") - high).alias("drawdown"))


# ---- top-k, sets ----
@query("top_01", "SELECT n_name, score FROM (SELECT n_name, round(sum(s_acctbal), 2) AS score, count(*) OVER () AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) WHERE c <= 300")
def ranked_nations(s, d):
    rows = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sum("s_acctbal").alias("x")).join(table(s, d, "nation"), "n_nationkey").select("n_name", F.round("x", 2).alias("score"))
    return scoring.ranked(rows, "score", "n_name")


@query("top_03", "SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders QUALIFY rank <= 5")
def top_per_task(s, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(s, d, "orders").select("o_orderpriority", "o_orderkey", F.row_number().over(w).alias("rank")).filter("rank <= 5")


@query("top_04", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) ORDER BY p_partkey LIMIT 20")
def not_yet_shown(s, d):
    return table(s, d, "part").select("p_partkey").join(table(s, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").orderBy("p_partkey").limit(20)


@query("top_06", f"SELECT path FROM {FILES} ORDER BY lower(path), path LIMIT 50")
def browse_order(s, d):
    return files(s, d).select("path").orderBy(F.lower("path"), "path").limit(50)


@query("top_08", "SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id = 0 THEN 0 ELSE 1 END AS p FROM documents WHERE doc_id = 0 OR regexp_matches(text, 'http|license|[0-9]{4}')) ORDER BY p, doc_id LIMIT 21")
def important_files(s, d):
    rows = table(s, d, "documents").filter((F.col("doc_id") == 0) | F.col("text").rlike("http|license|[0-9]{4}"))
    return rows.select("doc_id", F.when(F.col("doc_id") == 0, 0).otherwise(1).alias("p")).orderBy("p", "doc_id").limit(21).select("doc_id")


@query("set_01", "SELECT k, v FROM (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier)")
def merged_tables(s, d):
    left = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("v"))
    return dedupe.merged(left, table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), "k")


@query("set_02", r"SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g')))")
def first_texts(s, d):
    return dedupe.first_ids(table(s, d, "documents"), "text", "doc_id")


@query("set_03", "SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def first_per_package(s, d):
    return table(s, d, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id"))


@query("set_04_07", "SELECT page_id AS id, 'a' AS engine FROM pages UNION ALL SELECT item_id, 'b' FROM benchmark")
def accumulated(s, d):
    return table(s, d, "pages").select(F.col("page_id").alias("id"), F.lit("a").alias("engine")).unionByName(table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("b").alias("engine")))


# ---- dates and scores ----
@query("dtm_01", "SELECT o_orderkey, strftime(CASE WHEN isodow(o_orderdate) >= 6 THEN o_orderdate::DATE + (8 - isodow(o_orderdate))::INT ELSE o_orderdate::DATE END, '%Y-%m-%d') AS due FROM orders")
def next_weekday(s, d):
    return table(s, d, "orders").select("o_orderkey", F.date_format(D.next_weekday(F.col("o_orderdate").cast("date")), "yyyy-MM-dd").alias("due"))


@query("dtm_02", "SELECT event_id, strftime(ts, '%m%d_%H%M') AS task_id FROM events")
def task_ids(s, d):
    return table(s, d, "events").select("event_id", F.date_format("ts", "MMdd_HHmm").alias("task_id"))


@query("dtm_03_grf_08", f"SELECT user_id, round(0.7 * least(count(*) / 20.0, 1.0) + 0.3 * greatest(0.0, 1.0 - (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(max(ts)))) / 86400.0 / 365.0), 6) AS history FROM events GROUP BY 1")
def history_scores(s, d):
    rows = table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("t"))
    return rows.select("user_id", F.round(scoring.history(F.col("n"), D.days_between(F.lit(AS_OF), F.col("t"))), 6).alias("history"))


@query(
    "dtm_06",
    f"""WITH s AS (SELECT event_id, ts, (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts)))::BIGINT AS s FROM events)
SELECT event_id, CASE WHEN s > 604800 THEN strftime(ts, '%Y-%m-%d') WHEN s >= 86400 THEN (s // 86400) || ' days ago' WHEN s >= 3600 THEN (s // 3600) || ' hours ago' WHEN s >= 60 THEN (s // 60) || ' minutes ago' ELSE 'Just now' END AS label FROM s""",
)
def relative_times(s, d):
    return table(s, d, "events").select("event_id", D.ago(F.lit(AS_OF), F.col("ts")).alias("label"))


_KEYS = "|".join(scoring.KEYWORDS)
_NAMES = "CASE p_size % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'event_handler' WHEN 2 THEN 'utils' ELSE 'thing' END"


@query(
    "grf_06",
    f"""WITH p AS (SELECT p_partkey, lower(p_type) AS a, {_NAMES} AS b FROM part),
s AS (SELECT p_partkey, {" + ".join(f"0.5 * least(CASE WHEN regexp_matches({c}, '{_KEYS}') THEN 0.3 ELSE 0.0 END + CASE WHEN {c} IN ('main', '__main__') THEN 0.7 ELSE 0.0 END + CASE WHEN {c} IN ('__init__', 'app', 'settings', 'config', 'utils', 'constants') THEN 0.5 ELSE 0.0 END, 1.0)" for c in "ab")} AS score FROM p)
SELECT p_partkey, round(least(score, 1.0)::DOUBLE, 6) AS score FROM s""",
)
def name_scores(s, d):
    ids = F.concat_ws(".", F.lower("p_type"), F.expr(_NAMES))
    return table(s, d, "part").select("p_partkey", F.round(scoring.id_semantics(ids), 6).alias("score"))


@query("grf_07", "SELECT doc_id, round(least(least(len(text) / 200.0, 1.0) * 0.7 + CASE WHEN contains(lower(text), 'args') THEN 0.1 ELSE 0 END + CASE WHEN contains(lower(text), 'returns') THEN 0.1 ELSE 0 END + CASE WHEN contains(lower(text), 'example') THEN 0.1 ELSE 0 END, 1.0), 6) AS documentation, round(least(n_chars / 500.0, 1.0), 6) AS size FROM documents")
def documentation_scores(s, d):
    return table(s, d, "documents").select("doc_id", F.round(scoring.documentation(F.col("text")), 6).alias("documentation"), F.round(scoring.size(F.col("n_chars")), 6).alias("size"))


#: Paths of every kind: an extension by the id.
_EXTENSIONS = "['txt', 'csv', 'png', 'pdf', 'mp3', 'mp4', 'bin', 'py', 'JSON']"


@query("prj_15", f"WITH e AS (SELECT doc_id, lower({_EXTENSIONS}[doc_id % 9 + 1]) AS e FROM documents) SELECT doc_id, CASE WHEN e IN ('csv', 'json') THEN 'data' WHEN e IN ('txt', 'py') THEN 'text' WHEN e = 'png' THEN 'image' WHEN e = 'pdf' THEN 'pdf' WHEN e = 'mp3' THEN 'audio' WHEN e = 'mp4' THEN 'video' ELSE 'other' END AS kind, CASE WHEN e = 'png' THEN 0 WHEN e = 'pdf' THEN 1 WHEN e IN ('csv', 'json') THEN 2 ELSE 3 END AS priority FROM e")
def file_kinds(s, d):
    ext = F.get(F.array(*[F.lit(x) for x in ("txt", "csv", "png", "pdf", "mp3", "mp4", "bin", "py", "JSON")]), (F.col("doc_id") % 9).cast("int"))
    path = F.concat(F.lit("a/b."), ext)
    return table(s, d, "documents").select("doc_id", P.kind(path).alias("kind"), P.priority(path).alias("priority"))


@query("prj_16", "SELECT doc_id, CASE WHEN n_chars = 0 THEN '0 B' WHEN n_chars < 1024 THEN printf('%.1f B', n_chars::DOUBLE) WHEN n_chars < 1048576 THEN printf('%.1f KB', n_chars / 1024.0) ELSE printf('%.1f MB', n_chars / 1048576.0) END AS size FROM documents")
def human_sizes(s, d):
    return table(s, d, "documents").select("doc_id", P.human_size(F.col("n_chars")).alias("size"))


@query(
    "src_01",
    f"""WITH f AS (SELECT path, doc_id, n_chars, regexp_replace(path, '/[^/]*$', '') AS dir FROM {FILES}),
n AS (SELECT *, count(*) OVER (PARTITION BY dir) AS n FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY path) AS r FROM n WHERE n <= 100 AND n_chars <= 10485760)
SELECT doc_id FROM k WHERE r <= CASE WHEN n > 50 THEN 5 ELSE 40 END""",
)
def repository_scan(s, d):
    return snapshots.limited_scan(files(s, d).select("path", "doc_id", "n_chars"), "path", "n_chars").select("doc_id")


@query("src_16", "SELECT doc_id, unnest(range(2, 2 + len(string_split(text, chr(10))[2:4])))::BIGINT AS line_no, unnest(string_split(text, chr(10))[2:4]) AS line FROM documents")
def line_ranges(s, d):
    return lines.line_range(table(s, d, "documents"), ["doc_id"], "text", 2, 3).withColumn("line_no", F.col("line_no").cast("long"))


@query("src_17", f"SELECT path FROM {FILES} WHERE path GLOB 'en/src1*' ORDER BY path")
def globbed(s, d):
    return files(s, d).filter(F.col("path").like("en/src1%")).select("path").orderBy("path")


@query("grf_12", """WITH f AS (SELECT lang || '/' || source AS dir, doc_id || '.txt' AS name FROM documents), r AS (SELECT dir, name, row_number() OVER (PARTITION BY dir ORDER BY name) AS r, count(*) OVER (PARTITION BY dir) AS n FROM f)
SELECT dir, name, 2 AS depth, greatest(n - 4, 0)::BIGINT AS n_other FROM r WHERE r <= 4""")
def capped_tree(s, d):
    return snapshots.capped_tree(files(s, d), "path", [10, 6, 4, 4])
