"""Splitting, directory trees, persisted indexes, packing, versions and crawling over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import graphs, installable, packing, postings, retrieval, splitter, vector_store, views
from ..session import dealt, durable, shared_folder, table
from ..sources import files, sinks, tables, tree, web
from ..streaming import crawl, sessions
from . import explorer_queries, graph_queries
from .graph_queries import TRADE

CATALOG: dict = {}


def query(name: str, sql: str | None):
    def keep(f):
        CATALOG[name] = (f, sql)
        return f

    return keep


def _folder(s, name: str) -> str:
    return f"{shared_folder(s).rstrip('/')}/loomwright/{name}-{uuid.uuid4().hex}"


# ---- splitting ----
def split_sql(source: str, key: str, text: str, size: int, overlap: int) -> str:
    """CTEs up to ``chunks`` (key, chunk_pos, start, chunk) of the recursive splitter."""
    steps = [f"txt AS (SELECT {key} AS k, {text} AS t FROM {source} WHERE len({text}) > 0)", "in0 AS (SELECT k, 0 AS lo, t FROM txt)"]
    for n, sep in enumerate(("chr(10) || chr(10)", "chr(10)", "' '")):
        steps += [
            f"p{n} AS (SELECT k, lo, unnest(list_transform(string_split(t, {sep}), lambda x, i: CASE WHEN i > 1 THEN {sep} || x ELSE x END)) AS piece, generate_subscripts(string_split(t, {sep}), 1) AS i FROM in{n} WHERE contains(t, {sep}))",
            f"q{n} AS (SELECT k, lo, i, piece, len(piece) AS n, lo + sum(len(piece)) OVER (PARTITION BY k, lo ORDER BY i) - len(piece) AS off, sum((len(piece) >= {size})::INT) OVER (PARTITION BY k, lo ORDER BY i) AS run FROM p{n} WHERE len(piece) > 0)",
            f"r{n} AS (SELECT k, min(off)::BIGINT AS base, list_prepend(0, list(e ORDER BY i)) AS edges FROM (SELECT k, lo, run, i, off, sum(n) OVER (PARTITION BY k, lo, run ORDER BY i)::BIGINT AS e FROM q{n} WHERE n < {size}) GROUP BY k, lo, run)",
            f"in{n + 1} AS (SELECT k, off::BIGINT AS lo, piece AS t FROM q{n} WHERE n >= {size} UNION ALL SELECT k, lo, t FROM in{n} WHERE NOT contains(t, {sep}))",
        ]
    steps += [
        "r3 AS (SELECT k, lo::BIGINT AS base, range(0, len(t) + 1) AS edges FROM in3)",
        "runs AS (" + " UNION ALL ".join(f"SELECT k, base, edges FROM r{n}" for n in range(4)) + ")",
        f"pack AS (SELECT k, base, edges, 1::BIGINT AS i, len(list_filter(edges, lambda x: x <= {size}))::BIGINT AS j FROM runs"
        f" UNION ALL SELECT k, base, edges, n, len(list_filter(edges, lambda x: x <= edges[n] + {size}))::BIGINT FROM (SELECT k, base, edges, len(list_filter(edges, lambda x: x < greatest(edges[j] - {overlap}, edges[j + 1] - {size})))::BIGINT + 1 AS n FROM pack WHERE j < len(edges)))",
        "cut AS (SELECT k, base + edges[i] AS start, regexp_replace(regexp_replace(substr(t, base + edges[i] + 1, edges[j] - edges[i]), '^\\s+', ''), '\\s+$', '') AS chunk FROM pack JOIN txt USING (k))",
        f"chunks AS (SELECT k AS {key}, (row_number() OVER (PARTITION BY k ORDER BY start) - 1)::BIGINT AS chunk_pos, start::BIGINT AS start, chunk FROM cut WHERE len(chunk) > 0)",
    ]
    return "WITH RECURSIVE " + ",\n".join(steps)


@query("txt_13", f"{split_sql('documents', 'doc_id', 'text', 1000, 100)} SELECT doc_id, chunk_pos, start, md5(chunk) AS chunk FROM chunks")
def recursive_chunks(s, d):
    """Chunks of whole documents by paragraphs, lines, words and characters."""
    out = splitter.recursive_chunks(table(s, d, "documents").select("doc_id", "text"), ["doc_id"], "text", 1000, 100)
    return out.select("doc_id", F.col("chunk_pos").cast("long").alias("chunk_pos"), F.col("start").cast("long").alias("start"), F.md5(F.col("chunk").cast("binary")).alias("chunk"))


@query("txt_13_small", f"{split_sql('documents', 'doc_id', 'text', 40, 15)} SELECT doc_id, count(*)::BIGINT AS n, sum(start)::BIGINT AS starts, md5(string_agg(chunk, '|' ORDER BY chunk_pos)) AS digest FROM chunks GROUP BY 1")
def small_chunks(s, d):
    """The same with small chunks, where long words are cut and every level is reached."""
    each = splitter.splits(F.col("text"), 40, 15)
    rows = table(s, d, "documents").select("doc_id", each.alias("c")).filter(F.size("c") > 0)
    return rows.select("doc_id", F.size("c").cast("long").alias("n"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["start"]).alias("starts"), F.md5(F.array_join(F.col("c.chunk"), "|").cast("binary")).alias("digest"))


# ---- directory trees ----
_NAME = "['__init__.py', '_private.py', '.hidden.txt', 'plain.py'][i]"


@query("src_01_19_tree", f"SELECT 'r' || n_regionkey || '/n' || n_nationkey || '/' || {_NAME} AS path, len(n_name)::BIGINT AS length, n_name AS content FROM nation, (SELECT unnest([1, 2, 3, 4]) AS i) WHERE n_regionkey <> 3")
def scanned_tree(s, d):
    """A tree of files with hidden and underscored names, written and scanned by tasks; one folder is pruned by name."""
    root = _folder(s, "tree")
    names = F.explode(F.array(*map(F.lit, ["__init__.py", "_private.py", ".hidden.txt", "plain.py"])))
    rows = table(s, d, "nation").select("n_regionkey", "n_nationkey", "n_name", names.alias("name"))
    path = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string"), F.lit("/"), F.col("name"))
    tree.write(rows.select(path.alias("path"), "n_name"), "path", "n_name", root)
    return tree.scan(s, root, prune=["r3"]).select("path", "length", F.col("content").cast("string").alias("content"))


# ---- persisted indexes ----
@query("ret_01_stored", graph_queries.CATALOG["ret_01"][1])
def stored_vector_search(s, d):
    """The same neighbours from a store to which two batches were appended."""
    rows = table(s, d, "embeddings").select("vec_id", "embedding")
    store = vector_store.VectorStore(s, _folder(s, "vectors"), 16)
    store.append(rows.filter("vec_id % 3 = 0"), "vec_id")
    store.append(rows.filter("vec_id % 3 != 0"), "vec_id")
    asked = {r["vec_id"]: r["embedding"] for r in rows.filter("vec_id < 5").collect()}  # five stated queries
    return store.search(asked, 10, "vec_id").select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("ret_02_stored", graph_queries.CATALOG["ret_02"][1])
def stored_bm25(s, d):
    """The same ranks from postings that were built in two segments."""
    docs = table(s, d, "documents").select("doc_id", "text")
    index = postings.Postings(s, _folder(s, "postings"), 64)
    index.append(docs.filter("doc_id % 2 = 0"), "doc_id", "text")
    index.append(docs.filter("doc_id % 2 = 1"), "doc_id", "text")
    return index.search(graph_queries.QUERIES).select("query", F.col("doc").alias("doc_id"), "score", "rank")


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(text):
    """A vector that SQL can make as well: how often a text has each letter."""
    return F.array(*[(F.length(text) - F.length(F.replace(F.lower(text), F.lit(c), F.lit("")))).cast("double") for c in _LETTERS])


def _letters_sql(text: str) -> str:
    return "[" + ", ".join(f"(len({text}) - len(replace(lower({text}), '{c}', '')))::DOUBLE" for c in _LETTERS) + "]"


_ASK = "helper run of the class"


@query(
    "ret_07_hybrid",
    explorer_queries.FUNCTION_TEXTS_SQL + f""", q AS (SELECT unnest({_ASK.split()!r}) AS term), a AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
t AS (SELECT id, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM d, q WHERE list_contains(w, term)), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
b AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM t JOIN f USING (term), a GROUP BY 1),
bm AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 10),
e AS (SELECT id, {_letters_sql('text')} AS v, {_letters_sql("'" + _ASK + "'")} AS u FROM d),
ve AS (SELECT id, row_number() OVER (ORDER BY round(list_dot_product(v, u) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(u, u)), 9) DESC, id) AS rank FROM e QUALIFY rank <= 10),
u AS (SELECT id, 0.6::DOUBLE / (60.0 + rank) AS s FROM ve UNION ALL SELECT id, 0.4::DOUBLE / (60.0 + rank) FROM bm)
SELECT id, round(sum(s), 9) AS score, row_number() OVER (ORDER BY round(sum(s), 9) DESC, id)::INT AS rank FROM u GROUP BY 1 QUALIFY rank <= 10""",
)
def hybrid_code_search(s, d):
    """Function sources by a stored vector index and stored postings, fused."""
    texts = explorer_queries.function_texts(s, d)
    docs = durable(texts.withColumn("embedding", letter_counts(F.col("text"))), "code-texts")  # both indexes read it, several times each
    vectors = vector_store.VectorStore(s, _folder(s, "code-vectors"), 16)
    vectors.append(docs.select("id", "embedding"))
    index = postings.Postings(s, _folder(s, "code-postings"), 64)
    index.append(docs, "id", "text")
    asked = [float(_ASK.count(c)) for c in _LETTERS]
    near = vectors.search({0: asked}, 10).select("query", "id", "rank")
    words = index.search({0: _ASK}).select("query", F.col("doc").alias("id"), "rank")
    return retrieval.fuse([(near, retrieval.WEIGHT), (words, 1 - retrieval.WEIGHT)], "id").select("id", "score", "rank")


# ---- packing ----
@query(
    "win_04_group",
    """WITH RECURSIVE o AS (SELECT conv_id, turn, len(coalesce(text, '')) AS n, row_number() OVER (ORDER BY conv_id, turn) AS k FROM conversations),
r AS (SELECT conv_id, turn, n, k, 0 AS bin, n AS used FROM o WHERE k = 1
 UNION ALL SELECT o.conv_id, o.turn, o.n, o.k, CASE WHEN r.used > 0 AND r.used + o.n > 1000 THEN r.bin + 1 ELSE r.bin END, CASE WHEN r.used > 0 AND r.used + o.n > 1000 THEN o.n ELSE r.used + o.n END FROM r JOIN o ON o.k = r.k + 1)
SELECT conv_id, turn, bin FROM r""",
)
def one_group_packed(s, d):
    """All turns as one group, packed in order."""
    rows = table(s, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"), F.lit("all").alias("g"))
    return packing.next_fit(rows, "g", ["conv_id", "turn"], "n", 1000).select("conv_id", "turn", "bin")


# ---- graph scores at size ----
_PUSHED = f"""WITH RECURSIVE {TRADE}, o AS (SELECT src, count(*) AS k FROM e GROUP BY 1),
w AS (SELECT node AS s, node, 1.0::DOUBLE AS m, 0 AS k FROM n UNION ALL SELECT s, dst, sum(0.85::DOUBLE * m / o.k), w.k + 1 FROM w JOIN e ON node = e.src JOIN o ON o.src = e.src WHERE w.k < 120 GROUP BY s, dst, w.k + 1),
v AS (SELECT s, node, sum(m) AS v FROM w GROUP BY 1, 2), u AS (SELECT node, sum(v) AS u FROM v GROUP BY 1)"""


@query("grf_01_push", f"{_PUSHED} SELECT v.s, v.node, round((u + v) / ((SELECT sum(u) FROM u) + (SELECT sum(v) FROM v x WHERE x.s = v.s)), 3) AS pr FROM v JOIN u USING (node)")
def pushed_scores(s, d):
    """Personalised PageRank of every nation and what its push reaches, to three digits."""
    pr = graphs.pushed_pageranks(graph_queries.nations(s, d), graph_queries.trade(s, d), bound=1e-7)
    return pr.select("s", "node", F.round("pr", 3).alias("pr"))


@query(
    "grf_03_sampled",
    f"""WITH {TRADE}, {explorer_queries._PATHS.replace('WHERE a.d + b.d', 'WHERE a.s IN (SELECT node FROM n ORDER BY md5(chr(48) || chr(58) || node), node LIMIT 10) AND a.d + b.d')}
SELECT node, round(coalesce(btw, 0) * (SELECT count(*) FROM n) / 10.0, 6) AS betweenness FROM n LEFT JOIN bt USING (node)""",
)
def sampled_betweenness(s, d):
    """Betweenness from ten seeded pivots."""
    return graphs.sampled_betweenness(graph_queries.nations(s, d), graph_queries.trade(s, d), 10).select("node", F.round("betweenness", 6).alias("betweenness"))


# ---- crawling ----
@query(
    "str_06_rounds",
    f"""WITH RECURSIVE {TRADE}, c AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e WHERE (src + dst) % 3 <> 0),
b AS (SELECT src, dst FROM c UNION SELECT dst, src FROM c), w AS (SELECT 0 AS node, 0 AS round UNION SELECT dst, round + 1 FROM w JOIN b ON node = src WHERE round < 6),
f AS (SELECT node, min(round) AS round FROM w GROUP BY 1)
SELECT 'http://trade.example/n' || f.node AS url, f.round, (SELECT min('http://trade.example/n' || p.node) FROM f p JOIN b ON b.src = p.node AND b.dst = f.node WHERE p.round = f.round - 1) AS parent FROM f""",
)
def crawled_rounds(s, d):
    """Pages made of the trade between nations, crawled from the first one by their links."""
    pairs = graph_queries.trade(s, d).filter("(src + dst) % 3 != 0")
    pairs = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src != dst").distinct()
    url = lambda c: F.concat(F.lit("http://trade.example/n"), F.col(c).cast("string"))
    anchor = F.concat(F.lit('<p><a href="'), url("dst"), F.lit('/#top">a nation</a></p>'))
    pages = pairs.select(url("src").alias("page"), anchor.alias("a")).groupBy("page").agg(F.array_join(F.sort_array(F.collect_list("a")), "\n").alias("html"))

    def links(front):
        return web.scraped(pages.join(front, F.col("page") == F.col("url")), "html", ["page"]).select(F.col("page").alias("parent"), F.col("link").alias("url"))

    return crawl.crawl(s, _folder(s, "crawl"), s.range(1).select(F.lit("http://trade.example/n0/").alias("url")), links, 6).select("url", "round", "parent")


# ---- tokens ----
def bpe_counts(s, d):
    """Tokens of whole documents by a public vocabulary."""
    import public_tokenizers

    count = tokens.counter(s, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return table(s, d, "documents").select("doc_id", count(F.col("text")).cast("long").alias("n_tokens"))


CATALOG["txt_12_bpe"] = (bpe_counts, None)


# ---- sources and sinks ----
@query("src_04", "SELECT doc_id, md5('a = ' || doc_id || chr(10) || 'b = 1' || chr(10) || chr(10) || 'print(' || n_chars || ')') AS code FROM documents")
def notebook_cells(s, d):
    """A notebook of each document: sources as lists and as texts, prose left out."""
    cell = lambda kind, source: F.concat(F.lit('{"cell_type":"' + kind + '","source":'), source, F.lit("}"))
    first = cell("code", F.concat(F.lit('["a = '), F.col("doc_id").cast("string"), F.lit('\\n","b = 1"]')))
    last = cell("code", F.concat(F.lit('"print('), F.col("n_chars").cast("string"), F.lit(')"')))
    book = F.concat(F.lit('{"cells":['), F.concat_ws(",", first, cell("markdown", F.lit('"some prose"')), last), F.lit("]}"))
    return table(s, d, "documents").select("doc_id", F.md5(files.notebook_code(book).cast("binary")).alias("code"))


@query("src_18", "SELECT n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.utf8' ELSE '.latin' END AS path, 'café ' || n_name AS content FROM nation")
def texts_of_two_encodings(s, d):
    root = _folder(s, "encodings")
    text, even = F.concat(F.lit("café "), F.col("n_name")), F.col("n_nationkey") % 2 == 0
    path = F.concat(F.col("n_nationkey").cast("string"), F.when(even, ".utf8").otherwise(".latin"))
    rows = table(s, d, "nation").select(path.alias("path"), F.when(even, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1")).alias("content"))
    tree.write(rows, "path", "content", root)
    return files.texts(tree.scan(s, root)).select("path", "content")


def _engine(question: str, most: int) -> list[dict]:
    """Stands for a search engine: every third result has no title."""
    return [{"title": None if k % 3 == 2 else f"{question} {k}", "snippet": f"about {question}", "link": f"http://e.example/{question}/{k}"} for k in range(most + 2)]


def _page(link: str) -> str:
    """Stands for the network: pages of result 1 cannot be had."""
    if link.endswith("/1"):
        raise TimeoutError(link)
    return f"<p>the page of {link.split('/')[3]} in full</p>"


_RESULTS = "SELECT n_name AS query, n_name || ' ' || k AS title, 'about ' || n_name AS snippet, 'http://e.example/' || n_name || '/' || k AS link, k FROM nation, (SELECT unnest(range(0, 6)) AS k) WHERE k % 3 <> 2"


@query("src_10", f"SELECT query, title, snippet, link FROM ({_RESULTS})")
def searched(s, d):
    return web.search(table(s, d, "nation").select(F.col("n_name").alias("query")), _engine, 6)


@query("src_20", f"SELECT link, CASE WHEN k = 1 THEN '' ELSE 'the page of ' || query || ' in full' END AS page FROM ({_RESULTS})")
def enriched(s, d):
    """Results with their pages; a page that cannot be had is empty and its row stays."""
    found = web.search(table(s, d, "nation").select(F.col("n_name").alias("query")), _engine, 6)
    return web.fetched(found, "link", _page).select("link", F.col("content").alias("page"))


@query("snk_03", "SELECT n_nationkey, n_name FROM nation")
def saved_output(s, d):
    path = _folder(s, "output") + ".csv"
    sinks.save_output(table(s, d, "nation").select("n_nationkey", "n_name"), path)
    return tables.csv(s, path)


@query("snk_06", "SELECT s_nationkey::BIGINT AS task, s_name AS repo, rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_name)::BIGINT AS rank FROM supplier) WHERE rank <= 5")
def saved_rankings(s, d):
    """The five best of each task, a folder a task."""
    path = _folder(s, "rankings")
    best = retrieval.top_k(table(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("task"), F.col("s_name").alias("repo"), "s_acctbal"), "task", "s_acctbal", "repo", 5)
    sinks.save_json(best.select("task", "repo", "rank"), path, "task")
    return s.read.schema("repo string, rank long, task long").json(path)


@query("snk_02", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def saved_json(s, d):
    path = _folder(s, "saved")
    sinks.save_json(table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"), path)
    return s.read.schema("n_nationkey long, n_name string").json(path)


# ---- streams ----
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _run(s, rows, stream):
    """What a stream over the rows, as files that arrive, has put out when all were read."""
    source, out, seen = _folder(s, "arriving"), _folder(s, "streamed"), _folder(s, "progress")
    rows.repartition(3, "conv_id").write.parquet(source)
    before = s.conf.get(_PROVIDER)
    s.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        read = stream(sessions.new_files(s, source, rows.schema))
        read.writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        s.conf.set(_PROVIDER, before)
    return s.read.schema(read.schema).parquet(out)


@query("str_02", "SELECT conv_id, turn, text FROM (SELECT conv_id, turn, 't' || turn // 2 AS text, lag('t' || turn // 2) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS DISTINCT FROM text")
def streamed_messages(s, d):
    """Messages that equal the one before go, by the state of their conversation."""
    rows = table(s, d, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.concat(F.lit("t"), F.expr("turn div 2").cast("string")).alias("text"))
    return _run(s, rows, sessions.without_repeats)


@query(
    "str_04",
    """WITH RECURSIVE o AS (SELECT conv_id, turn, len(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
r AS (SELECT conv_id, turn, k, CASE WHEN n > 150 THEN 0 ELSE n END AS used, (n > 150)::INT AS restarts, n > 150 AS restarted FROM o WHERE k = 1
 UNION ALL SELECT o.conv_id, o.turn, o.k, CASE WHEN used + n > 150 AND restarts < 2 THEN 0 ELSE used + n END, CASE WHEN used + n > 150 AND restarts < 2 THEN restarts + 1 ELSE restarts END, used + n > 150 AND restarts < 2 FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = r.k + 1)
SELECT conv_id, turn, used::BIGINT AS used, restarts::INT AS restarts, restarted FROM r""",
)
def streamed_overflow(s, d):
    """Conversations start anew when they outgrow their budget, twice at most."""
    rows = table(s, d, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.length("text").cast("long").alias("tokens"))
    return _run(s, rows, lambda r: sessions.overflow(r, 150, 2))


# ---- outlines and packages ----
@query(
    "prj_10_scopes",
    f"""WITH m AS (SELECT {explorer_queries._M} AS module_id, {explorer_queries.CODE.replace("CAST(p_size AS STRING)", "CAST(p_size AS VARCHAR)").replace("AS STRING", "AS VARCHAR")} AS content FROM part),
l AS (SELECT module_id, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS i, len(string_split(content, chr(10))) AS n FROM m),
d AS (SELECT *, CASE WHEN trim(x) <> '' THEN len(x) - len(ltrim(x)) END AS ind FROM l),
w AS (SELECT * FROM d WHERE regexp_matches(x, '^\\s*(def|class|import|from|async def)') OR regexp_matches(x, '^\\s+[a-zA-Z_][a-zA-Z0-9_]*\\s*=')),
up AS (SELECT w.module_id, max(d.i) AS i FROM w JOIN (SELECT unnest(range(0, 12)) AS lim) ON lim < w.ind JOIN d ON d.module_id = w.module_id AND d.i < w.i AND d.ind <= lim GROUP BY w.module_id, w.i, lim),
s0 AS (SELECT module_id, i FROM w UNION SELECT module_id, i FROM up WHERE i > 0),
s1 AS (SELECT module_id, i FROM s0 UNION SELECT a.module_id, a.i + 1 FROM s0 a JOIN s0 b ON a.module_id = b.module_id AND b.i = a.i + 2),
s2 AS (SELECT module_id, i FROM s1 UNION SELECT s1.module_id, s1.i + 1 FROM s1 JOIN d a ON a.module_id = s1.module_id AND a.i = s1.i AND a.ind IS NOT NULL JOIN d b ON b.module_id = s1.module_id AND b.i = s1.i + 1 AND b.ind IS NULL WHERE s1.i < a.n - 2),
f AS (SELECT d.module_id, d.i, d.x, s2.i IS NOT NULL AS shown, coalesce(lag(s2.i IS NOT NULL) OVER (PARTITION BY d.module_id ORDER BY d.i), TRUE) AS before FROM d LEFT JOIN s2 ON s2.module_id = d.module_id AND s2.i = d.i)
SELECT module_id, md5(string_agg(CASE WHEN shown THEN '│' || x ELSE '⋮' END, chr(10) ORDER BY i)) AS digest FROM f WHERE shown OR before GROUP BY 1""",
)
def scoped_outlines(s, d):
    """Outlines of modules with the headers around every kept line."""
    rows = explorer_queries.modules(s, d)
    return rows.select("module_id", F.md5(views.scoped_outline(F.col("content"), 1_000_000).cast("binary")).alias("digest"))


_NAME_OF = "'pkg' || (event_id % 50)"


@query(
    "txt_18_udf_08",
    f"""WITH t AS (SELECT event_id, {_NAME_OF} AS base, event_id % 3 AS kind FROM events WHERE event_type = 'error'),
k AS (SELECT 'pkg' || s_suppkey AS name, ['builtin', 'installed', 'local'][s_suppkey % 3 + 1] AS kind FROM supplier WHERE s_suppkey < 40)
SELECT event_id, CASE t.kind WHEN 0 THEN 'missing_package' ELSE 'pkg_resources_error' END AS error_type, base || CASE t.kind WHEN 0 THEN '.sub' ELSE '' END AS package
FROM t LEFT JOIN k ON k.name = base WHERE t.kind < 2 AND coalesce(k.kind = 'installed', substr(base, 4)::INT % 2 = 0)""",
)
def installable_packages(s, d):
    """Packages that errors name, against a table of known ones and an index that knows the even numbers."""
    name, kind = F.concat(F.lit("pkg"), (F.col("event_id") % 50).cast("string")), F.col("event_id") % 3
    missing = F.concat(F.lit("ModuleNotFoundError: No module named '"), name, F.lit(".sub'"))
    absent = F.concat(F.lit("pkg_resources.DistributionNotFound: The '"), name, F.lit("' distribution was not found"))
    texts = dealt(table(s, d, "events").filter("event_type = 'error'").select("event_id"), "event_id", rows=16384).select("event_id", F.when(kind == 0, missing).when(kind == 1, absent).otherwise("ImportError: cannot import name 'x' from 'y'").alias("text"))
    known = table(s, d, "supplier").filter("s_suppkey < 40").select(F.concat(F.lit("pkg"), F.col("s_suppkey").cast("string")).alias("name"), F.element_at(F.array(*map(F.lit, ["builtin", "installed", "local"])), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("kind"))
    return installable.installable(texts, "event_id", "text", known, lambda names: [int(n[3:]) % 2 == 0 for n in names])
