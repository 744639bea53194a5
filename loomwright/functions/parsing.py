"""Lenient reading of what a model replies: JSON, else a literal, else "key: value" pairs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fences and pairs in replies.
FENCES, PAIRS = r"```(?:json|python)?\s*", r"[\"']?(\w+)[\"']?\s*:\s*([^,}\n]+)"

#: Names of literals, and escapes in their strings, as JSON has them.
NAMES = {"True": "true", "False": "false", "None": "null"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0", "\n": ""}
OPENING, CLOSING = {"(": "["}, {")": "]"}
TOKEN = re.compile(r"""(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<mark>[][(){},:])|(?P<atom>[^]\s[(){},:"']+)|\s+""", re.S)


class NotALiteral(ValueError):
    pass


def _unquoted(token: str) -> str:
    def plain(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        return chr(int(code, 16)) if code else ESCAPES.get(m[4], m[4])

    return re.sub(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|(.))", plain, token[1:-1], flags=re.S)


def _atom(word: str) -> str:
    """A name or number as JSON."""
    if word in NAMES:
        return NAMES[word]
    for kind in (int, float):
        try:
            return json.dumps(kind(word))
        except ValueError:
            continue
    raise NotALiteral(word)


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise NotALiteral(text[at : at + 20])
        at = m.end()
        if m.lastgroup:
            yield m.lastgroup, m[0]


def literal_as_json(text: str) -> str:
    """A literal of strings, numbers, names, lists, tuples and dictionaries as JSON text; trailing commas go, keys become
    text."""
    found, out = [*_tokens(text), ("end", "")], []
    for (kind, token), (_, after) in zip(found, found[1:]):
        if kind == "text":
            out.append(json.dumps(_unquoted(token)))
        elif kind == "atom":
            out.append(json.dumps(token) if after == ":" else _atom(token))
        elif not (token == "," and after in ("]", "}", ")")):
            out.append(OPENING.get(token) or CLOSING.get(token) or token)
    return " ".join(out)


def _pair_value(raw: str):
    try:
        return json.loads(literal_as_json(raw))
    except ValueError:
        return raw.strip("\"'")


def reply(text: str | None):
    """The value that a reply holds; pairs as a dictionary where it is neither JSON nor a literal."""
    bare = re.sub(FENCES, "", text or "").strip("`")
    for form in (str, literal_as_json):
        try:
            return json.loads(form(bare))
        except (ValueError, RecursionError):
            pass
    return {m[1]: _pair_value(m[2]) for m in re.finditer(PAIRS, bare)}


def replies(text: Column) -> Column:
    """JSON text of :func:`reply`.  Replies that are JSON already never leave the JVM's columns."""

    @F.pandas_udf("string")
    def read(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else json.dumps(reply(x), default=str, ensure_ascii=False))

    bare = F.trim(F.regexp_replace(text, FENCES, ""))
    bare = F.regexp_replace(bare, "^`+|`+$", "")
    # Spark reads single quotes as well, which JSON does not know
    whole = F.try_parse_json(bare).isNotNull() & ~bare.contains("'")
    return F.when(whole, bare).otherwise(read(F.when(~whole, text)))


def dialogue(text: Column) -> Column:
    """array<struct<role, content, tool_calls>> from the first "[" to the last "]"; null unless every item has a role and a
    content.  Numbers become text."""
    start, stop = F.instr(text, "["), F.length(text) - F.instr(F.reverse(text), "]") + 1
    items = F.from_json(F.substr(text, start, stop - start + 1), "array<struct<role:string,content:string,tool_calls:string>>")
    fine = (start > 0) & (F.instr(text, "]") > 0) & F.forall(items, lambda x: x["role"].isNotNull() & x["content"].isNotNull())
    return F.when(fine, items)


def simple_metadata(text: Column) -> Column:
    """map<string,string> of a JSON object: scalars as they are, lists joined by ", ", other values as JSON text."""
    fields = F.from_json(text, "map<string,string>")
    joined = lambda v: F.coalesce(F.array_join(F.from_json(v, "array<string>"), ", "), v)
    return F.transform_values(fields, lambda _, v: F.when(v.startswith("["), joined(v)).otherwise(v))


def page_text(html: Column) -> Column:
    """The text of a page: scripts, styles and tags go, white space becomes single blanks."""
    from .text import squeeze

    return squeeze(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]+>", " "))
