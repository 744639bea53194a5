"""Further rows: contexts, two-stage retrieval, previews, JSON schemas, orders and message rewrites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import messages as M
from ..operators import profiling, retrieval, splitter
from ..session import table
from .graph_queries import QUERIES
from .message_queries import C, histories
from .store_queries import split_sql

CATALOG: dict = {}


def query(name: str, sql: str | None):
    def keep(f):
        CATALOG[name] = (f, sql)
        return f

    return keep


@query(
    "win_09",
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE contains(text, 'License')),
h AS (SELECT doc_id, x, list_position(list_transform(x, lambda y: contains(y, 'License')), true) AS hit FROM l)
SELECT doc_id, hit::BIGINT AS line_no, md5(array_to_string(x[greatest(hit - 3, 1):hit + 3], chr(10))) AS context FROM h""",
)
def first_hit_contexts(s, d):
    x = F.split("text", "\n")
    at = F.array_position(F.transform(x, lambda y: y.contains("License")), True).cast("int")
    begin = F.greatest(at - 3, F.lit(1))
    context = F.array_join(F.slice(x, begin, at - begin + 4), "\n")
    return table(s, d, "documents").filter(F.col("text").contains("License")).select("doc_id", at.cast("long").alias("line_no"), F.md5(context.cast("binary")).alias("context"))


@query("top_05", "SELECT source, sum(len(list_filter(string_split(lower(text), chr(10)), lambda x: contains(x, 'the'))))::BIGINT AS hits FROM documents GROUP BY 1 ORDER BY hits DESC, source LIMIT 20")
def hit_sources(s, d):
    n = F.size(F.filter(F.split(F.lower("text"), "\n"), lambda x: x.contains("the")))
    return table(s, d, "documents").groupBy("source").agg(F.sum(n).cast("long").alias("hits")).orderBy(F.col("hits").desc(), "source").limit(20)


@query("top_07", "SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant') ORDER BY conv_id DESC")
def chat_order(s, d):
    return table(s, d, "conversations").filter("role = 'assistant'").select("conv_id").distinct().orderBy(F.col("conv_id").desc())


@query("top_02_09", "SELECT p_partkey, p_name, p_brand FROM part ORDER BY p_partkey LIMIT 5")
def heads(s, d):
    return table(s, d, "part").select("p_partkey", "p_name", "p_brand").orderBy("p_partkey").limit(5)


@query("agg_12", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL)::BIGINT AS nulls, count({c})::BIGINT AS present FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)" for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")))
def column_info(s, d):
    head = table(s, d, "orders").orderBy("o_orderkey").limit(100)
    rows = profiling.columns(head.select("o_orderkey", "o_orderstatus", "o_orderpriority"))
    return rows.select("column", "nulls", (F.col("rows") - F.col("nulls")).alias("present"))


@query("agg_13", "SELECT 'OBJECT<' || string_agg(k || ': ' || t, ', ' ORDER BY k) || '>' AS schema FROM (SELECT DISTINCT k, CASE WHEN json_type(props, '$.' || k) IN ('UBIGINT', 'BIGINT') THEN 'BIGINT' ELSE json_type(props, '$.' || k) END AS t FROM (SELECT props, unnest(json_keys(props)) AS k FROM events))")
def merged_schema(s, d):
    return profiling.json_schema(table(s, d, "events"), "props")


@query("agg_25", "SELECT doc_id, array_to_string(list_transform(x[1:3], lambda y: y[1:15]), chr(10)) AS thumbnail, greatest(len(x) - 3, 0)::BIGINT AS more FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)")
def thumbnails(s, d):
    x = F.split("text", "\n")
    return table(s, d, "documents").select("doc_id", F.array_join(F.transform(F.slice(x, 1, 3), lambda y: F.substring(y, 1, 15)), "\n").alias("thumbnail"), F.greatest(F.size(x) - 3, F.lit(0)).cast("long").alias("more"))


@query("jn_13_set_06", "WITH b AS (SELECT conv_id, turn, role, text, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS intent FROM conversations), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) AS n FROM b WHERE role <> 'tool') SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY intent, turn))::INT AS place FROM f WHERE n = 1")
def planned_blocks(s, d):
    intent = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    rows = table(s, d, "conversations").filter("role != 'tool'").withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "text").orderBy("turn"))).filter("n = 1")
    return rows.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(intent, "turn")).alias("place"))


@query("arr_09", f"SELECT conv_id, turn AS pos, 0 AS n_responses FROM {C}")
def without_responses(s, d):
    m = F.col("messages")
    ids = F.flatten(F.transform(F.filter(m, lambda x: x["tool_calls"].isNotNull()), lambda x: F.transform(x["tool_calls"], lambda c: c["id"])))
    return histories(s, d).select("conv_id", F.explode(M.drop_responses(m, ids)).alias("m")).select("conv_id", F.col("m.pos").cast("long").alias("pos"), F.coalesce(F.size("m.tool_responses"), F.lit(0)).alias("n_responses"))


@query("arr_11", f"SELECT conv_id, turn AS pos, CASE WHEN role = 'assistant' THEN 'tool' ELSE role END AS role, (turn = 0)::INT AS n_calls FROM {C}")
def converted(s, d):
    """The first message calls a function that all assistant turns are made to answer."""
    call = F.struct(F.lit("look").alias("name"), F.lit("{}").alias("arguments"))
    m = F.transform("messages", lambda x: x.withField("function_call", F.when(x["pos"] == 0, call)).withField("role", F.when(x["role"] == "assistant", "function").otherwise(x["role"])).withField("name", F.when(x["role"] == "assistant", "look")).withField("tool_calls", F.when(F.lit(False), x["tool_calls"])))
    rows = histories(s, d).select("conv_id", m.alias("messages"))
    out = M.function_call_to_tool_call(F.col("messages"), 0, F.lit("call_0"))
    return rows.select("conv_id", F.explode(out).alias("m")).select("conv_id", F.col("m.pos").cast("long").alias("pos"), "m.role", F.coalesce(F.size("m.tool_calls"), F.lit(0)).alias("n_calls"))


@query("arr_15", f"SELECT conv_id, turn AS pos, (calling AND turn % 4 <> 1)::INT AS n_calls FROM {C}")
def code_without_calls(s, d):
    m = F.transform("messages", lambda x: x.withField("content", F.when(x["pos"] % 4 == 1, F.lit("```python\nx\n```")).otherwise(x["content"])))
    return histories(s, d).select("conv_id", F.explode(M.exclusive_code(m)).alias("m")).select("conv_id", F.col("m.pos").cast("long").alias("pos"), F.coalesce(F.size("m.tool_calls"), F.lit(0)).alias("n_calls"))


@query(
    "ret_04",
    """WITH c AS (SELECT a.vec_id AS doc_id FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, a.vec_id LIMIT 100),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents SEMI JOIN c USING (doc_id)),
a AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d), q AS (SELECT unnest(['the', 'and', 'of']) AS term),
t AS (SELECT doc_id, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM d, q WHERE list_contains(w, term)), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM t JOIN f USING (term), a GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 10""",
)
def two_stage(s, d):
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    first = v.filter("vec_id = 0").first()
    near = retrieval.vector_top_k(v, [(0, first["embedding"])], 100, cosine=False).select(F.col("vec_id").alias("doc_id"))
    docs = table(s, d, "documents").select("doc_id", "text").join(near, "doc_id", "left_semi")
    return retrieval.bm25(docs, "doc_id", "text", {0: QUERIES[0]}).select("doc_id", "score")


@query("ret_05", f"{split_sql('pages', 'page_id', 'html', 2000, 200)} SELECT page_id, 'chunk' AS kind, chunk_pos AS pos, md5(chunk) AS digest FROM chunks UNION ALL SELECT page_id, 'snippet', 0, md5(url) FROM pages")
def chunks_and_snippets(s, d):
    """All chunks of whole pages, and a snippet for each page."""
    pages = table(s, d, "pages").select("page_id", "html", "url")
    digest = lambda c: F.md5(F.col(c).cast("binary")).alias("digest")
    each = splitter.recursive_chunks(pages, ["page_id"], "html", 2000, 200).select("page_id", F.lit("chunk").alias("kind"), F.col("chunk_pos").cast("long").alias("pos"), digest("chunk"))
    return each.unionByName(pages.select("page_id", F.lit("snippet").alias("kind"), F.lit(0).cast("long").alias("pos"), digest("url")))


@query("str_05", "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS text FROM conversations GROUP BY 1")
def joined_texts(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "").cast("binary")).alias("text"))


@query("str_06", "WITH a AS (SELECT page_id FROM pages WHERE contains(lower(html), 'news')), b AS (SELECT page_id FROM pages WHERE contains(lower(html), 'the') AND page_id NOT IN (SELECT page_id FROM a)) SELECT page_id, 1 AS round FROM a UNION ALL SELECT page_id, 2 FROM b")
def search_loop(s, d):
    """Two rounds of a search, the second without what the first has seen."""
    pages = table(s, d, "pages").select("page_id", F.lower("html").alias("html"))
    first = pages.filter(F.col("html").contains("news")).select("page_id")
    second = pages.filter(F.col("html").contains("the")).select("page_id").join(first, "page_id", "left_anti")
    return first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))


@query("txt_21", "SELECT event_id, 'value_' || json_extract_string(props, '$.k') || '_' || event_type || '.csv' AS path FROM events")
def parameter_paths(s, d):
    return table(s, d, "events").select("event_id", F.concat(F.concat_ws("_", F.lit("value"), F.get_json_object("props", "$.k"), F.col("event_type")), F.lit(".csv")).alias("path"))


@query("snk_09", "SELECT conv_id, count(*)::BIGINT AS n FROM conversations WHERE conv_id <> 3 GROUP BY 1")
def deleted_chat(s, d):
    """A chat's messages, displays and index row go in one commit."""
    import uuid

    from ..session import shared_folder
    from ..sources import sinks, versions

    path = f"{shared_folder(s).rstrip('/')}/loomwright/chats-{uuid.uuid4().hex}"
    messages = table(s, d, "conversations").withColumn("chat_id", F.col("conv_id").cast("string"))
    index = messages.select("chat_id", "conv_id").distinct()
    store = versions.Store(s, path)
    store.transact(lambda now: {"messages": versions.Change(messages), "index": versions.Change(index)})
    sinks.delete_chat(s, path, "3", ["messages", "index"])
    now = store.snapshot()
    return now.table("index").join(now.table("messages").groupBy("chat_id").agg(F.count(F.lit(1)).alias("n")), "chat_id", "full_outer").select("conv_id", "n")
