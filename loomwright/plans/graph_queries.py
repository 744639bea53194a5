"""Graph and retrieval operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graphs, retrieval
from ..session import table

CATALOG: dict = {}
ROUNDS, ALPHA, KEPT = 10, 0.85, 5


def query(name: str, sql: str | None):
    def keep(f):
        CATALOG[name] = (f, sql)
        return f

    return keep


def trade(s, d):
    """src, dst: each customer nation's five largest supplier nations."""
    who = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src"))
    sold = table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    counts = lines.join(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").join(who, "o_custkey").join(sold, "l_suppkey").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.col("n").desc(), "dst"))).filter(F.col("r") <= KEPT).select("src", "dst")


def nations(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").alias("node"))


TRADE = f"""n AS (SELECT n_nationkey AS node FROM nation),
g AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
e AS (SELECT src, dst FROM g QUALIFY row_number() OVER (PARTITION BY src ORDER BY k DESC, dst) <= {KEPT})"""


@query("jn_05_agg_02", f"WITH {TRADE} SELECT node, (SELECT count(*) FROM e WHERE dst = node)::BIGINT AS in_deg, (SELECT count(*) FROM e WHERE src = node)::BIGINT AS out_deg FROM n")
def degrees(s, d):
    return graphs.degrees(nations(s, d), trade(s, d))


def _pagerank_sql() -> str:
    steps = [f"WITH {TRADE}", "o AS (SELECT src, count(*) AS k FROM e GROUP BY 1)", "c AS (SELECT count(*)::DOUBLE AS c FROM n)", "r0 AS (SELECT node, 1.0::DOUBLE / c AS pr FROM n, c)"]
    for k in range(ROUNDS):
        steps.append(f"i{k} AS (SELECT dst AS node, sum(pr / k) AS x FROM e JOIN o USING (src) JOIN r{k} ON node = src GROUP BY 1)")
        steps.append(f"s{k} AS (SELECT coalesce(sum(pr), 0) AS lost FROM r{k} WHERE node NOT IN (SELECT src FROM o))")
        steps.append(f"r{k + 1} AS (SELECT n.node, {1 - ALPHA}::DOUBLE / c + {ALPHA}::DOUBLE * (coalesce(x, 0) + lost / c) AS pr FROM n LEFT JOIN i{k} USING (node), s{k}, c)")
    return ",\n".join(steps) + f" SELECT node, round(pr, 6) AS pr FROM r{ROUNDS}"


@query("grf_02", _pagerank_sql())
def pagerank(s, d):
    return graphs.pagerank(nations(s, d), trade(s, d), ROUNDS, ALPHA).select("node", F.round("pr", 6).alias("pr"))


@query("grf_10", "SELECT n_regionkey AS node, round(0.5 * sum(x), 4) AS score FROM (SELECT n_regionkey, n_nationkey, 0.3 * count(c_custkey) + 0.2 * count(DISTINCT c_mktsegment) AS x FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1")
def fallback_scores(s, d):
    per = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("a"), F.count_distinct("c_mktsegment").alias("b"))
    rows = table(s, d, "nation").join(per, "n_nationkey", "left").select("n_regionkey", (F.lit(0.3) * F.coalesce("a", F.lit(0)) + F.lit(0.2) * F.coalesce("b", F.lit(0))).alias("x"))
    return rows.groupBy(F.col("n_regionkey").alias("node")).agg(F.round(F.lit(0.5) * F.sum("x"), 4).alias("score"))


_TREE = """WITH RECURSIVE c AS (SELECT n_nationkey AS k, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1),
node AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS STRING) AS parent, r_name AS name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) * 20 AS score FROM region
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, c.n FROM nation JOIN c ON c.k = n_nationkey),
tree AS (SELECT id, name AS path, 1 AS depth, score, CAST(10.0 AS DOUBLE) AS threshold FROM node WHERE parent IS NULL AND score >= 10
 UNION ALL SELECT node.id, tree.path || '/' || node.name, tree.depth + 1, node.score, tree.threshold * (1 + 0.1 * tree.depth) FROM node JOIN tree ON node.parent = tree.id WHERE node.score >= tree.threshold * (1 + 0.1 * tree.depth))
SELECT path, depth FROM tree"""


@query("grf_11", _TREE.replace("STRING", "VARCHAR"))
def pruned_tree(s, d):
    """A package tree whose pruning threshold grows with each level.  Levels are few, so they are joined in a loop."""
    n = table(s, d, "nation")
    c = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("score"))
    regions = table(s, d, "region").join(n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg((F.count(F.lit(1)) * 20).alias("score")), "r_regionkey")
    nodes = regions.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), "score")
    nodes = nodes.unionByName(n.join(c, "n_nationkey").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.col("n_name").alias("name"), "score"))
    level = nodes.filter("parent is null and score >= 10").select("id", F.col("name").alias("path"), F.lit(1).alias("depth"), F.lit(10.0).alias("threshold"))
    out, depth = level, 1
    while not level.isEmpty():  # one level at a time, until none is left
        t = F.col("threshold") * (1 + 0.1 * depth)
        up = level.select(F.col("id").alias("parent"), F.col("path").alias("above"), t.alias("threshold"))
        level = nodes.join(up, "parent").filter(F.col("score") >= F.col("threshold")).select("id", F.concat_ws("/", "above", "name").alias("path"), F.lit(depth + 1).alias("depth"), "threshold")
        out, depth = out.unionByName(level), depth + 1
    return out.select("path", "depth")


QUERIES = {0: "the and of", 1: "der die und", 2: "les des que"}
_DOT = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"


def _vectors(s, d):
    v = table(s, d, "embeddings")
    asked = [(r["vec_id"], r["embedding"]) for r in v.filter("vec_id < 5").orderBy("vec_id").collect()]  # five stated queries
    return retrieval.vector_top_k(v.select("vec_id", "embedding"), asked, 10)


@query(
    "ret_01",
    """WITH s AS (SELECT b.vec_id AS query, a.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS x FROM embeddings a, embeddings b WHERE b.vec_id < 5)
SELECT query, vec_id, round(x, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY x DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 10""",
)
def vector_search(s, d):
    return _vectors(s, d).select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


_BM25 = f"""q AS (SELECT * FROM (VALUES {", ".join(f"({q}::BIGINT, '{t}')" for q, x in QUERIES.items() for t in x.split())}) v(query, term)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
a AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
t AS (SELECT doc_id, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM d, (SELECT DISTINCT term FROM q) WHERE list_contains(w, term)),
f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
b AS (SELECT query, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {retrieval.K1 + 1} / (tf + {retrieval.K1} * ({1 - retrieval.B} + {retrieval.B} * dl / avgdl))), 6) AS score FROM t JOIN f USING (term) JOIN q USING (term), a GROUP BY 1, 2),
bm AS (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id)::INT AS rank FROM b QUALIFY rank <= 10)"""


@query("ret_02", f"WITH {_BM25} SELECT * FROM bm")
def bm25(s, d):
    return retrieval.bm25(table(s, d, "documents").select("doc_id", "text"), "doc_id", "text", QUERIES)


@query(
    "ret_03",
    f"""WITH {_BM25}, l AS (SELECT q.query, d.doc_id, row_number() OVER (PARTITION BY q.query ORDER BY n_chars DESC, d.doc_id) AS rank FROM documents d, (SELECT DISTINCT query FROM q) q QUALIFY rank <= 10),
u AS (SELECT query, doc_id, 0.6 / (60.0 + rank) AS s FROM l UNION ALL SELECT query, doc_id, 0.4 / (60.0 + rank) FROM bm)
SELECT query, doc_id, round(sum(s::DOUBLE), 9) AS score, row_number() OVER (PARTITION BY query ORDER BY round(sum(s::DOUBLE), 9) DESC, doc_id)::INT AS rank FROM u GROUP BY 1, 2 QUALIFY rank <= 10""",
)
def fused(s, d):
    docs = table(s, d, "documents")
    longest = docs.select("doc_id", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id").limit(10)
    longest = longest.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n_chars").desc(), "doc_id"))).withColumn("query", F.explode(F.array(*[F.lit(q).cast("long") for q in QUERIES])))
    words = retrieval.bm25(docs.select("doc_id", "text"), "doc_id", "text", QUERIES)
    return retrieval.fuse([(longest, retrieval.WEIGHT), (words, 1 - retrieval.WEIGHT)], "doc_id")
