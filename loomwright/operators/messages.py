"""Message algebra over nested histories: one row per conversation, ``messages`` an ordered array of structs.

A message has role, content, name, tool_call_id, tool_calls, tool_responses and function_call; an absent field is null, never an
empty list.  Edits are higher-order functions over the array: nothing is exploded, nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MESSAGE = (
    "struct<pos:int,role:string,content:string,name:string,tool_call_id:string,"
    "tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>,"
    "tool_responses:array<struct<tool_call_id:string,role:string,content:string>>,function_call:struct<name:string,arguments:string>>"
)


def collect(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """key, messages ordered by ``order``: a conversation's messages are bounded by the conversation."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("pos"), *fields))).alias("messages"))


def at(messages: Column, i: int) -> Column:
    """Message i from 0, null beyond the end; -1 is the last."""
    return F.get(messages, F.size(messages) + i if i < 0 else F.lit(i))


def where(messages: Column, keep: Callable[[Column], Column]) -> Column:
    return F.filter(messages, keep)


def matching(messages: Column, pattern: str, case_sensitive: bool = False) -> Column:
    """Positions of messages whose content matches."""
    rx = pattern if case_sensitive else "(?i)" + pattern
    return F.transform(F.filter(messages, lambda m: F.coalesce(m["content"].rlike(rx), F.lit(False))), lambda m: m["pos"])


def append(messages: Column, message: Column) -> Column:
    return F.array_append(messages, message)


def replace_at(messages: Column, i: int, change: Callable[[Column], Column]) -> Column:
    return F.transform(messages, lambda m, k: F.when(k == i, change(m)).otherwise(m))


def _or_null(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)


def drop_responses(messages: Column, ids: Column) -> Column:
    """Without tool rows and nested responses of the calls in ``ids``; an emptied list becomes absent."""
    kept = F.filter(messages, lambda m: ~((m["role"] == "tool") & F.coalesce(F.array_contains(ids, m["tool_call_id"]), F.lit(False))))
    return F.transform(kept, lambda m: m.withField("tool_responses", _or_null(F.filter(m["tool_responses"], lambda r: ~F.array_contains(ids, r["tool_call_id"])))))


def delete_at(messages: Column, i: int) -> Column:
    """Without message i and every response to its calls (the message is found before the cascade)."""
    gone = F.get(messages, F.lit(i))
    ids = F.coalesce(F.transform(gone["tool_calls"], lambda c: c["id"]), F.array().cast("array<string>"))
    return drop_responses(F.filter(messages, lambda m: ~m["pos"].eqNullSafe(gone["pos"])), ids)


def add_tool_call(messages: Column, i: int, name: str, arguments: Column, call_id: Column | None = None) -> Column:
    """Message i becomes the assistant's and gains a call; a missing id is a digest of position and arguments."""

    def change(m: Column) -> Column:
        made = call_id if call_id is not None else F.concat(F.lit("call_"), F.substring(F.md5(F.concat_ws("|", m["pos"].cast("string"), F.lit(name), arguments).cast("binary")), 1, 8))
        call = F.struct(made.alias("id"), F.lit("function").alias("type"), F.struct(F.lit(name).alias("name"), arguments.alias("arguments")).alias("function"))
        return m.withField("role", F.lit("assistant")).withField("tool_calls", F.coalesce(F.array_append(m["tool_calls"], call), F.array(call)))

    return replace_at(messages, i, change)


def delete_tool_call(messages: Column, call_id: Column) -> Column:
    """Without the call and its responses."""
    kept = F.transform(messages, lambda m: m.withField("tool_calls", _or_null(F.filter(m["tool_calls"], lambda c: c["id"] != call_id))))
    return drop_responses(kept, F.array(call_id))


def add_tool_response(messages: Column, call_id: Column, content: Column) -> Column:
    """A tool row right after the message that holds the call; unchanged when there is none."""
    owner = F.array_position(F.transform(messages, lambda m: F.coalesce(F.exists(m["tool_calls"], lambda c: c["id"] == call_id), F.lit(False))), True)
    template = F.get(messages, F.lit(0))
    none = {f: F.lit(None) for f in ("name", "tool_calls", "tool_responses", "function_call")}
    made = template.withField("role", F.lit("tool")).withField("content", content).withField("tool_call_id", call_id)
    for f in none:
        made = made.withField(f, F.when(F.lit(False), template[f]))
    return F.when(owner > 0, F.concat(F.slice(messages, F.lit(1), owner.cast("int")), F.array(made), F.slice(messages, (owner + 1).cast("int"), F.size(messages) + 1))).otherwise(messages)


def update_response(messages: Column, call_id: Column, content: Column) -> Column:
    """New content in tool rows and nested responses of a call."""

    def change(m: Column) -> Column:
        nested = F.transform(m["tool_responses"], lambda r: F.when(r["tool_call_id"] == call_id, r.withField("content", content)).otherwise(r))
        own = (m["role"] == "tool") & m["tool_call_id"].eqNullSafe(call_id)
        return m.withField("tool_responses", nested).withField("content", F.when(own, content).otherwise(m["content"]))

    return F.transform(messages, change)


def change_role(messages: Column, i: int, role: str) -> Column:
    """Fields that the new role cannot have go: calls unless assistant, call ids unless tool."""

    def change(m: Column) -> Column:
        out = m.withField("role", F.lit(role))
        if role != "assistant":
            out = out.withField("tool_calls", F.when(F.lit(False), m["tool_calls"])).withField("function_call", F.when(F.lit(False), m["function_call"]))
        if role != "tool":
            out = out.withField("tool_call_id", F.when(F.lit(False), m["tool_call_id"])).withField("tool_responses", F.when(F.lit(False), m["tool_responses"]))
        return out

    return replace_at(messages, i, change)


def function_call_to_tool_call(messages: Column, i: int, call_id: Column) -> Column:
    """Message i's function call becomes a tool call; all function rows of that name become its tool rows."""
    call = F.get(messages, F.lit(i))["function_call"]

    def change(m: Column, k: Column) -> Column:
        as_call = F.array(F.struct(call_id.alias("id"), F.lit("function").alias("type"), call.alias("function")))
        owner = (k == i) & call.isNotNull()
        answer = (m["role"] == "function") & m["name"].eqNullSafe(call["name"])
        out = m.withField("tool_calls", F.when(owner, as_call).otherwise(m["tool_calls"])).withField("function_call", F.when(~owner, m["function_call"]))
        return out.withField("role", F.when(answer, "tool").otherwise(m["role"])).withField("tool_call_id", F.when(answer, call_id).otherwise(m["tool_call_id"]))

    return F.transform(messages, change)


def unroll(rows: DataFrame, key: str) -> DataFrame:
    """key, pos, role, content: nested responses as rows of their own, then the message unless its role is tool."""
    nested = lambda m: F.transform(m["tool_responses"], lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content")))
    own = lambda m: F.array(F.struct(m["role"].alias("role"), m["content"].alias("content")))
    each = F.transform("messages", lambda m: F.when(m["tool_responses"].isNotNull(), F.when(m["role"] == "tool", nested(m)).otherwise(F.concat(nested(m), own(m)))).otherwise(own(m)))
    return rows.select(key, F.posexplode(F.flatten(each)).alias("pos", "m")).select(key, "pos", "m.role", "m.content")


def drop_trailing_call(messages: Column) -> Column:
    last = at(messages, -1)
    return F.when(F.size(last["tool_calls"]) > 0, F.slice(messages, F.lit(1), F.size(messages) - 1)).otherwise(messages)


def exclusive_code(messages: Column) -> Column:
    """Messages with runnable fences lose their calls."""
    from ..functions.text import code_blocks

    def change(m: Column) -> Column:
        code = code_blocks(m["content"]).isNotNull()
        return m.withField("tool_calls", F.when(~code, m["tool_calls"])).withField("function_call", F.when(~code, m["function_call"]))

    return F.transform(messages, change)


def compact(messages: Column, summary: Column, tail: int) -> Column:
    """The first message, a summary in the user's name, and the last ``tail`` messages; short histories stay."""
    first = F.get(messages, F.lit(0))
    note = first.withField("role", F.lit("user")).withField("content", summary)
    return F.when(F.size(messages) > tail + 1, F.concat(F.slice(messages, 1, 1), F.array(note), F.slice(messages, -tail, tail))).otherwise(messages)


def _has_role(role: str) -> Callable[[Column], Column]:
    return lambda m: F.coalesce(m["role"] == role, F.lit(False))


def summary(rows: DataFrame, key: str) -> DataFrame:
    """key, role counts and numbers of calls and responses, one row per conversation."""
    m = F.col("messages")
    count = lambda keep: F.size(F.filter(m, keep)).cast("long")
    total = lambda field: F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.size(x[field]), F.lit(0)))
    return rows.select(
        key, F.size(m).cast("long").alias("total"),
        *[count(_has_role(r)).alias(f"n_{r}") for r in ("system", "user", "assistant", "tool", "function")],
        count(lambda x: x["role"].isNull()).alias("n_unknown"), total("tool_calls").alias("tool_calls"),
        (total("tool_responses") + count(lambda x: x["role"] == "tool")).alias("tool_responses"),
        count(lambda x: x["function_call"].isNotNull()).alias("function_calls"),
    )


def without_repeats(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    same = F.lag(value).over(Window.partitionBy(key).orderBy(order)) == F.col(value)
    return rows.withColumn("_same", F.coalesce(same, F.lit(False))).filter(~F.col("_same")).drop("_same")


def last_messages(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).filter(F.col("_r") <= n).drop("_r")


def trailing_run(rows: DataFrame, key: str, order: str, role: str) -> DataFrame:
    """key, n_trailing: how many of the last messages are of the role."""
    after = F.sum((F.col("role") != role).cast("int")).over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return rows.withColumn("_o", after).groupBy(key).agg(F.count_if(F.col("_o") == 0).alias("n_trailing"))


def pairs(rows: DataFrame, key: str) -> DataFrame:
    """tool_call_id, call_pos, response_pos: each call with its first response, null if none."""
    calls = rows.select(key, F.explode("messages").alias("m")).select(key, F.col("m.pos").alias("call_pos"), F.explode("m.tool_calls").alias("c")).select(key, "call_pos", F.col("c.id").alias("tool_call_id"))
    each = rows.select(key, F.explode("messages").alias("m"))
    nested = each.select(key, F.col("m.pos").alias("p"), F.explode("m.tool_responses").alias("r")).select(key, "p", F.col("r.tool_call_id").alias("tool_call_id"))
    own = each.filter("m.role = 'tool'").select(key, F.col("m.pos").alias("p"), F.col("m.tool_call_id").alias("tool_call_id"))
    first = nested.unionByName(own).groupBy(key, "tool_call_id").agg(F.min("p").alias("response_pos"))
    return calls.join(first, [key, "tool_call_id"], "left").select(key, "tool_call_id", "call_pos", "response_pos")


def summarize_responses(messages: Column, limit: int, summary: Callable[[Column], Column], tokens: Callable[[Column], Column] | None = None) -> Column:
    """Nested responses of ``limit`` tokens or more are replaced by their summary, each its own."""
    from ..functions.text import token_estimate

    count = tokens or token_estimate
    short = lambda r: F.when(count(r["content"]) >= limit, r.withField("content", summary(r["content"]))).otherwise(r)
    return F.transform(messages, lambda m: m.withField("tool_responses", F.transform(m["tool_responses"], short)))


def inject_history(messages: Column, tool: str, summary: Callable[[Column], Column]) -> Column:
    """Calls of one tool get a summary of the history (the messages without responses) as their argument."""
    history = summary(F.filter(messages, lambda m: m["tool_responses"].isNull()))
    given = lambda c: F.when(c["function"]["name"] == tool, c.withField("function", c["function"].withField("arguments", history))).otherwise(c)
    return F.transform(messages, lambda m: m.withField("tool_calls", F.transform(m["tool_calls"], given)))


def researcher_history(messages: Column, at: Column, tail: int, error: Column | None = None) -> Column:
    """The record handed to a researcher: time, the first user message, the compacted history, and an error if there is one."""
    first = F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"]
    return F.struct(at.alias("time"), first.alias("query"), compact(messages, F.lit("summary"), tail).alias("history"), (error if error is not None else F.lit(None).cast("string")).alias("error"))


def call_counter(rows: DataFrame, key: str, order: str, calling: Column, reset: int = 2) -> DataFrame:
    """The rows with ``n_calls``: the calls of a session so far, counted from 1 again after ``reset`` of them."""
    so_far = F.sum(calling.cast("int")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("n_calls", F.when(so_far == 0, 0).otherwise((so_far - 1) % reset + 1).cast("int"))
