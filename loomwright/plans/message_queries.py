"""Message algebra over conversations: assistant turns of odd number gain a tool call, the next turn answers it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import messages as M
from ..session import table

CATALOG: dict = {}


def query(name: str, sql: str | None):
    def keep(f):
        CATALOG[name] = (f, sql)
        return f

    return keep


_CALL = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
_RESPONSE = "array<struct<tool_call_id:string,role:string,content:string>>"


def histories(s, d):
    """conv_id, messages; a call's answer is nested in the next message."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(s, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), "role", F.col("text").alias("content"))
    calling = (F.col("role") == "assistant") & (F.col("turn") % 2 == 1)
    name = F.concat(F.lit("tool"), (F.col("turn") % 4).cast("string"))
    call_id = lambda turn: F.concat_ws("_", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    call = F.array(F.struct(call_id(F.col("turn")).alias("id"), F.lit("function").alias("type"), F.struct(name.alias("name"), F.substring("content", 1, 20).alias("arguments")).alias("function"))).cast(_CALL)
    answers = F.lag(calling).over(w)
    response = F.array(F.struct(call_id(F.lag("turn").over(w)).alias("tool_call_id"), F.lit("tool").alias("role"), F.substring("content", 1, 30).alias("content"))).cast(_RESPONSE)
    rows = rows.withColumn("tool_calls", F.when(calling, call)).withColumn("tool_responses", F.when(answers, response))
    rows = rows.withColumn("name", F.lit(None).cast("string")).withColumn("tool_call_id", F.lit(None).cast("string")).withColumn("function_call", F.lit(None).cast("struct<name:string,arguments:string>"))
    return M.collect(rows, "conv_id", "turn", ["role", "content", "name", "tool_call_id", "tool_calls", "tool_responses", "function_call"])


C = "(SELECT conv_id, turn, role, text, role = 'assistant' AND turn % 2 = 1 AS calling, coalesce(lag(role = 'assistant' AND turn % 2 = 1) OVER (PARTITION BY conv_id ORDER BY turn), false) AS answers, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS after, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)"


@query("agg_09", f"SELECT conv_id, count(*)::BIGINT AS total, count(*) FILTER (role = 'system')::BIGINT AS n_system, count(*) FILTER (role = 'user')::BIGINT AS n_user, count(*) FILTER (role = 'assistant')::BIGINT AS n_assistant, 0::BIGINT AS n_tool, 0::BIGINT AS n_function, 0::BIGINT AS n_unknown, count(*) FILTER (calling)::BIGINT AS tool_calls, count(*) FILTER (answers)::BIGINT AS tool_responses, 0::BIGINT AS function_calls FROM {C} GROUP BY 1")
def summaries(s, d):
    return M.summary(histories(s, d), "conv_id")


@query("arr_01", f"SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1)::BIGINT AS pos, role FROM (SELECT conv_id, turn, 1 AS k, role FROM {C} UNION ALL SELECT conv_id, turn, 0, 'tool' FROM {C} WHERE answers)")
def unrolled(s, d):
    return M.unroll(histories(s, d), "conv_id").select("conv_id", F.col("pos").cast("long").alias("pos"), "role")


@query("jn_09", f"SELECT conv_id, 'call_' || conv_id || '_' || turn AS tool_call_id, turn AS call_pos, coalesce(after, -1) AS response_pos FROM {C} WHERE calling")
def call_pairs(s, d):
    return M.pairs(histories(s, d), "conv_id").select("conv_id", "tool_call_id", F.col("call_pos").cast("long"), F.coalesce("response_pos", F.lit(-1)).cast("long").alias("response_pos"))


@query("arr_02", f"SELECT conv_id, turn AS pos, CASE WHEN turn = 0 THEN 'X' ELSE text END AS content FROM {C} UNION ALL SELECT conv_id, max(turn) + 1, 'added' FROM conversations GROUP BY 1")
def appended(s, d):
    h = histories(s, d)
    new = F.get("messages", F.lit(0)).withField("pos", M.at(F.col("messages"), -1)["pos"] + 1).withField("content", F.lit("added"))
    m = M.append(M.replace_at(F.col("messages"), 0, lambda x: x.withField("content", F.lit("X"))), new)
    return h.select("conv_id", F.explode(m).alias("m")).select("conv_id", F.col("m.pos").cast("long").alias("pos"), "m.content")


@query("arr_03_04", f"SELECT conv_id, turn AS pos, (answers AND NOT (before = 1 AND coalesce(b.calls, false)))::INT AS n_responses FROM {C} c LEFT JOIN (SELECT conv_id AS id, calling AS calls FROM {C} WHERE turn = 1) b ON b.id = c.conv_id WHERE turn <> 1")
def deleted(s, d):
    m = M.delete_at(F.col("messages"), 1)
    return histories(s, d).select("conv_id", F.explode(m).alias("m")).select("conv_id", F.col("m.pos").cast("long").alias("pos"), F.coalesce(F.size("m.tool_responses"), F.lit(0)).alias("n_responses"))


@query("arr_05", f"SELECT conv_id, turn AS pos, CASE WHEN turn = 0 THEN 'assistant' ELSE role END AS role, (calling::INT + (turn = 0)::INT) AS n_calls FROM {C}")
def called(s, d):
    m = M.add_tool_call(F.col("messages"), 0, "look", F.lit("{}"))
    return histories(s, d).select("conv_id", F.explode(m).alias("m")).select("conv_id", F.col("m.pos").cast("long").alias("pos"), "m.role", F.coalesce(F.size("m.tool_calls"), F.lit(0)).alias("n_calls"))


@query("arr_06", f"SELECT conv_id, turn AS pos, (calling AND turn <> 1)::INT AS n_calls, (answers AND before <> 1)::INT AS n_responses FROM {C}")
def uncalled(s, d):
    gone = F.concat_ws("_", F.lit("call"), F.col("conv_id").cast("string"), F.lit("1"))
    m = M.delete_tool_call(F.col("messages"), gone)
    return histories(s, d).select("conv_id", F.explode(m).alias("m")).select("conv_id", F.col("m.pos").cast("long").alias("pos"), F.coalesce(F.size("m.tool_calls"), F.lit(0)).alias("n_calls"), F.coalesce(F.size("m.tool_responses"), F.lit(0)).alias("n_responses"))


@query("arr_07", f"SELECT conv_id, (count(*) + count(*) FILTER (calling AND turn = 1))::BIGINT AS n, count(*) FILTER (calling AND turn = 1)::BIGINT AS n_tool FROM {C} GROUP BY 1")
def responded(s, d):
    m = M.add_tool_response(F.col("messages"), F.concat_ws("_", F.lit("call"), F.col("conv_id").cast("string"), F.lit("1")), F.lit("ok"))
    return histories(s, d).select("conv_id", m.alias("m")).select("conv_id", F.size("m").cast("long").alias("n"), F.size(F.filter("m", lambda x: x["role"] == "tool")).cast("long").alias("n_tool"))


@query("arr_08", f"SELECT conv_id, turn AS pos, CASE WHEN before = 1 THEN 'new' ELSE substr(text, 1, 30) END AS response FROM {C} WHERE answers")
def updated(s, d):
    m = M.update_response(F.col("messages"), F.concat_ws("_", F.lit("call"), F.col("conv_id").cast("string"), F.lit("1")), F.lit("new"))
    return histories(s, d).select("conv_id", F.explode(m).alias("m")).select("conv_id", F.col("m.pos").cast("long").alias("pos"), F.explode("m.tool_responses").alias("r")).select("conv_id", "pos", F.col("r.content").alias("response"))


@query("arr_10", f"SELECT conv_id, turn AS pos, CASE WHEN turn = 1 THEN 'user' ELSE role END AS role, (calling AND turn <> 1)::INT AS n_calls FROM {C}")
def recast(s, d):
    m = M.change_role(F.col("messages"), 1, "user")
    return histories(s, d).select("conv_id", F.explode(m).alias("m")).select("conv_id", F.col("m.pos").cast("long").alias("pos"), "m.role", F.coalesce(F.size("m.tool_calls"), F.lit(0)).alias("n_calls"))


@query("arr_12_flt_07", f"SELECT conv_id, count(*) FILTER (role = 'user')::BIGINT AS n_user, max_by(text, turn) AS last_text, min_by(text, turn) AS first_text FROM {C} GROUP BY 1")
def picked(s, d):
    m = F.col("messages")
    return histories(s, d).select("conv_id", F.size(M.where(m, lambda x: x["role"] == "user")).cast("long").alias("n_user"), M.at(m, -1)["content"].alias("last_text"), M.at(m, 0)["content"].alias("first_text"))


@query("flt_08", f"SELECT conv_id, turn AS pos FROM {C} WHERE regexp_matches(text, 'the', 'i')")
def searched(s, d):
    return histories(s, d).select("conv_id", F.explode(M.matching(F.col("messages"), "the")).alias("pos")).withColumn("pos", F.col("pos").cast("long"))


@query("arr_13", f"SELECT conv_id, least(count(*), 4)::BIGINT AS n FROM {C} GROUP BY 1")
def compacted(s, d):
    return histories(s, d).select("conv_id", F.size(M.compact(F.col("messages"), F.lit("summary"), 2)).cast("long").alias("n"))


@query("arr_14", f"SELECT conv_id, (count(*) - count(*) FILTER (calling AND turn = last))::BIGINT AS n FROM {C} GROUP BY 1")
def untrailed(s, d):
    return histories(s, d).select("conv_id", F.size(M.drop_trailing_call(F.col("messages"))).cast("long").alias("n"))


@query("arr_19", f"SELECT conv_id, (count(*) - 1)::BIGINT AS n_history, max_by(text, turn) AS message FROM {C} GROUP BY 1")
def preloaded(s, d):
    m = F.col("messages")
    return histories(s, d).select("conv_id", F.size(F.slice(m, F.lit(1), F.size(m) - 1)).cast("long").alias("n_history"), M.at(m, -1)["content"].alias("message"))


@query("flt_11", "SELECT conv_id, turn FROM conversations WHERE NOT contains(text, 'that')")
def without_failures(s, d):
    return table(s, d, "conversations").filter(~F.col("text").contains("that")).select("conv_id", "turn")


_TWICE = "SELECT conv_id, turn * 2 AS pos, text FROM conversations UNION ALL SELECT conv_id, turn * 2 + 1, text FROM conversations WHERE turn % 2 = 0"


@query("win_01", f"SELECT conv_id, pos FROM (SELECT conv_id, pos, text, lag(text) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM ({_TWICE})) WHERE before IS NULL OR before <> text")
def without_repeats(s, d):
    c = table(s, d, "conversations")
    rows = c.select("conv_id", (F.col("turn") * 2).alias("pos"), "text").unionByName(c.filter("turn % 2 = 0").select("conv_id", (F.col("turn") * 2 + 1).alias("pos"), "text"))
    return M.without_repeats(rows, "conv_id", "pos", "text").select("conv_id", "pos")


@query("win_02", "SELECT conv_id, turn, CASE WHEN len(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def recent(s, d):
    from ..functions.text import cut

    return M.last_messages(table(s, d, "conversations"), "conv_id", "turn", 4).select("conv_id", "turn", cut(F.col("text"), 200).alias("text"))


@query("win_06", "SELECT conv_id, count(*) FILTER (o = 0)::BIGINT AS n_trailing FROM (SELECT conv_id, sum((role <> 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS o FROM conversations) GROUP BY 1")
def trailing_users(s, d):
    return M.trailing_run(table(s, d, "conversations"), "conv_id", "turn", "user")


@query("win_10", f"SELECT conv_id, count(*) FILTER (answers AND a2)::BIGINT AS pairs FROM (SELECT *, coalesce(lag(calling, 2) OVER (PARTITION BY conv_id ORDER BY turn), false) OR answers AS a2 FROM {C}) GROUP BY 1")
def paired_calls(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(s, d, "conversations").withColumn("calling", (F.col("role") == "assistant") & (F.col("turn") % 2 == 1))
    rows = rows.withColumn("answers", F.coalesce(F.lag("calling").over(w), F.lit(False))).withColumn("a2", F.coalesce(F.lag("calling", 2).over(w), F.lit(False)) | F.col("answers"))
    return rows.groupBy("conv_id").agg(F.count_if(F.col("answers") & F.col("a2")).alias("pairs"))


@query("win_12", "SELECT conv_id, coalesce(substr(max_by(text, turn) FILTER (role = 'user'), 1, 50), 'Untitled') || ' #' || conv_id AS title FROM conversations GROUP BY 1")
def titles(s, d):
    user = F.col("role") == "user"
    last = F.max_by(F.when(user, F.col("text")), F.when(user, F.col("turn")))
    return table(s, d, "conversations").groupBy("conv_id").agg(last.alias("t")).select("conv_id", F.concat(F.coalesce(F.substring("t", 1, 50), F.lit("Untitled")), F.lit(" #"), F.col("conv_id").cast("string")).alias("title"))


@query("arr_18", "SELECT conv_id, count(*) FILTER (trim(text) <> '')::BIGINT AS n, md5(string_agg(role || ': ' || trim(text), chr(10) ORDER BY turn) FILTER (trim(text) <> '')) AS prompt FROM conversations GROUP BY 1")
def history_prompts(s, d):
    each = F.sort_array(F.collect_list(F.when(F.trim("text") != "", F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.trim("text")).alias("t")))))
    return table(s, d, "conversations").groupBy("conv_id").agg(each.alias("e")).select("conv_id", F.size("e").cast("long").alias("n"), F.md5(F.array_join(F.transform("e", lambda x: x["t"]), "\n").cast("binary")).alias("prompt"))


@query("flt_09", "SELECT conv_id, turn FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE text <> '' AND NOT starts_with(text, '[') AND (before IS NULL OR before <> text)")
def checked(s, d):
    rows = table(s, d, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.filter((F.col("text") != "") & ~F.col("text").startswith("[") & (F.col("before").isNull() | (F.col("before") != F.col("text")))).select("conv_id", "turn")


@query("str_07", "SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT doc_id FROM documents WHERE lang = 'en') ORDER BY conv_id, turn")
def replay(s, d):
    there = table(s, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("conv_id"))
    return table(s, d, "conversations").select("conv_id", "turn", "role").join(there, "conv_id", "left_semi").orderBy("conv_id", "turn")
