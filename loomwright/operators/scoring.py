"""Importance scores of modules: usage, references, complexity, semantics, history, and their weighted sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import capped, recency

# Weights and names.
WEIGHTS = {"usage": 2.0, "refs": 3.0, "complexity": 1.0, "semantic": 0.5, "git": 4.0}
KEYWORDS = "main core engine api service controller manager handler processor factory builder provider repository executor scheduler config security".split()
COMMON = ["__init__", "app", "settings", "config", "utils", "constants"]
SPECIAL_PACKAGES = ["src", "core", "main", "api"]
REPO_WEIGHTS = [0.2, 0.2, 0.15, 0.15, 0.15, 0.1, 0.1, 0.05]
RANKED_AT_MOST = 300


def name_semantics(name: Column) -> Column:
    keyword = F.when(F.lower(name).rlike("|".join(KEYWORDS)), 0.3).otherwise(0.0)
    main = F.when(name.isin("__main__", "main"), 0.7).otherwise(0.0)
    common = F.when(name.isin(COMMON), 0.5).otherwise(0.0)
    return F.least(keyword + main + common, F.lit(1.0))


def id_semantics(module_id: Column) -> Column:
    return F.least(F.aggregate(F.transform(F.split(module_id, "[.]"), name_semantics), F.lit(0.0), lambda a, x: a + x * 0.5), F.lit(1.0))


def usage(imported: Column, function_calls: Column, class_calls: Column) -> Column:
    return capped(imported, 5) + capped(function_calls, 10, 0.5) + capped(class_calls, 10, 0.5)


def word_pattern(word: str) -> str:
    """A pattern for a whole word; letters beyond ASCII count as breaks in every engine."""
    return f"(?:^|[^A-Za-z0-9_]){word}(?:[^A-Za-z0-9_]|$)"


def complexity(content: Column) -> Column:
    """Branching lines (a line counts once for each kind of branch) and the deepest definition."""
    lines = F.split(content, "\n")
    holds = lambda word: lambda x: x.rlike(word_pattern(word))
    branches = sum((F.size(F.filter(lines, holds(w))) for w in ("if", "for", "while", "except")), F.lit(0))
    indents = F.transform(F.filter(lines, lambda x: x.rlike(r"^[ \t]*def ")), lambda x: F.length(F.regexp_extract(x, r"^([ \t]*)", 1)))
    return F.least(branches / 50.0, F.lit(1.0)) + capped(F.coalesce(F.array_max(indents), F.lit(0)) / 4.0, 5, 0.3)


def reference_score(in_deg: Column, out_deg: Column, pr: Column, between: Column) -> Column:
    base = (capped(in_deg, 5, 0.5) + capped(out_deg, 10, 0.2) + F.lit(0.6) * pr + F.lit(0.4) * F.least(F.lit(10.0) * between, F.lit(1.0))) / F.lit(1.7)
    bonus = F.when((in_deg > 2) & (out_deg <= 1), 0.3).when((in_deg > 2) & (out_deg > 2), 0.2).otherwise(0.0)
    return F.least(base + bonus, F.lit(1.0))


def history(commits: Column, days: Column) -> Column:
    return F.lit(0.7) * capped(commits, 20) + F.lit(0.3) * recency(days)


def importance(weights: dict[str, float] | None = None, **parts: Column) -> Column:
    w = WEIGHTS | (weights or {})
    return F.least(sum((F.lit(w[k]) * v for k, v in parts.items()), F.lit(0.0)), F.lit(10.0))


def package(own: Column, most: Column, mean: Column, name: Column | None = None) -> Column:
    bonus = F.when(name.isin(SPECIAL_PACKAGES), 2.0).otherwise(0.0) if name is not None else F.lit(0.0)
    return F.least(own + F.coalesce((most * 0.7 + mean * 0.3) * 1.5, F.lit(0.0)) + bonus, F.lit(10.0))


def documentation(docstring: Column) -> Column:
    bonus = sum((F.when(F.lower(docstring).contains(s), 0.1).otherwise(0.0) for s in ("args", "returns", "example")), F.lit(0.0))
    return F.least(capped(F.length(docstring), 200, 0.7) + bonus, F.lit(1.0))


def size(lines: Column) -> Column:
    return capped(lines, 500)


def repo_score(flags: list[Column], overall: Column) -> Column:
    """Eight 0/1 dimensions and an overall grade of 1 to 10; the weights sum to 1.10, so up to 1.06."""
    return F.lit(0.6) * sum((f * F.lit(w) for f, w in zip(flags, REPO_WEIGHTS)), F.lit(0.0)) + overall / 10.0 * 0.4


def ranked(scores: DataFrame, score: str, key: str, most: int = RANKED_AT_MOST) -> DataFrame:
    """Best first; empty when there are more rows than can be ranked."""
    n = scores.agg(F.count(F.lit(1)).alias("_n"))
    return scores.join(F.broadcast(n)).filter(F.col("_n") <= most).drop("_n").orderBy(F.col(score).desc(), key)  # one row


def boosted_roots(path: Column, score: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, score * 5).otherwise(score)
