"""Views of code within a budget of tokens: outlines by lines, structures from entities, listings, overviews, reports.

Budgets are counted by a column function (:func:`~loomwright.functions.text.token_estimate` unless another is given).
Everything but the skeleton of a syntax tree is a column expression or a grouping by module; no text of a whole corpus is
ever gathered, only that of one file, folder or conversation.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from . import entities as E

Tokens = Callable[[Column], Column]

# Lines that an outline keeps, and its limits.
STRUCTURE, DEFINED, IMPORTED = r"^\s*(def|class|import|from|async def)", r"^\s*(def|class)\s+", r"^\s*(import|from)\s+"
ASSIGNED, CONSTANT = r"^\s+[a-zA-Z_][a-zA-Z0-9_]*\s*=", r"^\s+[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*[A-Z]"
IMPORT_LINES, HEAD_LINES, FILES_SHOWN, TREE_CAPS, TREE_DEPTH = 50, 50, 30, [15, 10, 8, 6], 3
OUTLINE_TOKENS, VIEW_TOKENS, ENTITY_TOKENS, SNIPPET_TOKENS, LEAST_SNIPPET = 3000, 5000, 1000, 500, 5
# Languages by extension.
LANGUAGES = {
    "py": "python", "md": "markdown", "js": "javascript", "html": "html", "css": "css", "json": "json", "txt": "text", "yml": "yaml", "yaml": "yaml",
    "sh": "bash", "java": "java", "c": "c", "cpp": "cpp", "h": "c", "go": "go", "rs": "rust", "ipynb": "python",
}
# Names of package errors in reports.
ERROR_NAMES = {
    "missing_package": "Missing Package", "import_name_error": "Import Name Error", "attribute_error": "Attribute Error", "version_conflict": "Version Conflict",
    "syntax_error_in_package": "Syntax Error in Package", "import_error_in_package": "Package Import Error", "dependency_error": "Dependency Error",
    "dll_load_error": "DLL Load Error", "permission_error": "Permission Error", "pkg_resources_error": "Resource Distribution Error", "incompatible_version": "Incompatible Version",
}
GAP, SHOWN = "⋮", "│"


# The patterns of single lines as they stand in a whole text: spaces do not reach over the end of a line.
_IN_LINE = {x: x.removeprefix("^").replace(r"\s", r"[^\S\n]") for x in (STRUCTURE, DEFINED, IMPORTED, ASSIGNED, CONSTANT)}


def _kept_lines(content: Column, keep: str) -> Column:
    """The lines that begin with the pattern, one mark for each run of others: one search of the text, which does not
    begin again in an empty line that ends a run.  Runs are possessive, so
    that their length takes no stack."""
    return F.regexp_replace(content, rf"(?d)(?:\A|(?<=\n)(?!\G))(?!{keep}).*(?:\n(?!{keep}).*)*+", GAP)


def _wide(content: Column) -> Column:
    return _kept_lines(content, f"(?:{_IN_LINE[STRUCTURE]}|{_IN_LINE[ASSIGNED]})")


def _narrow(content: Column) -> Column:
    always = f"{_IN_LINE[DEFINED]}|{_IN_LINE[CONSTANT]}|.*__init__"
    # late imports that nothing else keeps are marked first, so that they are none
    head = F.substring_index(content, "\n", IMPORT_LINES)
    late = F.regexp_replace(F.substr(content, F.length(head) + 1), rf"(?d)(?<=\n)(?={_IN_LINE[IMPORTED]})(?!{always})", GAP)
    return _kept_lines(F.concat(head, late), f"(?:{always}|{_IN_LINE[IMPORTED]})")


def outline(content: Column, budget: int = OUTLINE_TOKENS, tokens: Tokens = T.token_estimate) -> Column:
    """Definitions, imports and assignments; if that is over the budget definitions, early imports, constants and
    initialisers alone."""
    wide = _wide(content)
    return F.when(tokens(wide) <= budget, wide).otherwise(_narrow(content))


def within(rows: DataFrame, name: str, content: Column, budget: int, tokens: Tokens) -> DataFrame:
    """The rows with ``name``: the content, its outline if that is over the budget.  Columns of its own hold the count and the
    wide outline, which would be made again at each place that an expression names them."""
    rows = rows.withColumns({"_text": content, "_count": tokens(content)})
    rows = rows.withColumn("_wide", F.when(F.col("_count") > budget, _wide(F.col("_text"))))
    rows = rows.withColumn("_short", F.when(tokens(F.col("_wide")) <= budget, F.col("_wide")).when(F.col("_count") > budget, _narrow(F.col("_text"))))
    return rows.withColumn(name, F.when(F.col("_count") > budget, F.col("_short")).otherwise(F.col("_text"))).drop("_text", "_count", "_wide", "_short")


#: Scopes of fewer lines are shown whole at the second level.
SMALL_SCOPE = 5


def _scoped(source: str, level: int) -> str:
    """The lines of interest of a level with the headers of the blocks around them, by indentation; small gaps are closed,
    each other gap is one mark."""
    rows = source.split("\n")
    indent = [len(x) - len(x.lstrip(" \t")) if x.strip(" \t\r") else None for x in rows]
    if level == 1:
        interest = [i for i, x in enumerate(rows) if re.match(STRUCTURE, x) or re.match(ASSIGNED, x)]
    else:
        interest = [i for i, x in enumerate(rows) if re.match(DEFINED, x) or (i < IMPORT_LINES and re.match(IMPORTED, x)) or re.match(CONSTANT, x) or "__init__" in x]
    shown, chain, wanted = set(interest), [], set(interest)
    for i, own in enumerate(indent):
        if own is None:
            continue
        while chain and indent[chain[-1]] >= own:
            chain.pop()
        if i in wanted:
            shown.update(c for c in chain if c)  # the first line of a file is no header to show
        chain.append(i)
    if level == 2:
        for i in interest:
            end = i + 1
            while indent[i] is not None and end < len(rows) and (indent[end] is None or indent[end] > indent[i]):
                end += 1
            if end - i <= SMALL_SCOPE:
                shown.update(range(i, end))
    shown |= {i + 1 for i in shown if i + 2 in shown}
    shown |= {i + 1 for i in shown if i < len(rows) - 2 and rows[i].strip() and not rows[i + 1].strip()}
    out, gap = [], 0 not in shown
    for i, x in enumerate(rows):
        if i in shown:
            out.append(SHOWN + x)
            gap = True
        elif gap:
            out.append(GAP)
            gap = False
    return "\n".join(out)


def scoped_outline(content: Column, budget: int = OUTLINE_TOKENS, tokens: Tokens = T.token_estimate) -> Column:
    """The first of three outlines that is within the budget, else the last: all definitions, imports and assignments;
    definitions, early imports, constants and initialisers with small scopes whole; the same without these.  Every line
    comes with the headers of the blocks that it stands in."""

    @F.pandas_udf("array<string>")
    def levels(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [_scoped(t, k) for k in (1, 2, 3)])

    each = levels(content)
    return F.when(tokens(F.get(each, 0)) <= budget, F.get(each, 0)).when(tokens(F.get(each, 1)) <= budget, F.get(each, 1)).otherwise(F.get(each, 2))


def head(content: Column, most: int = HEAD_LINES) -> Column:
    """The first lines and how many are left out."""
    lines = T.lines(content)
    return F.when(F.size(lines) > most, F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.format_string("\n... [Omitted %d lines]", F.size(lines) - most))).otherwise(content)


def adaptive(content: Column, skeleton: Column, budget: int = VIEW_TOKENS, tokens: Tokens = T.token_estimate) -> Column:
    """The first of these that is within the budget: the text, its outline, its skeleton; else its first lines."""
    short = outline(content, budget, tokens)
    return F.when(tokens(content) < budget, content).when(tokens(short) <= budget, short).when(tokens(skeleton) <= budget, skeleton).otherwise(head(content))


def language(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, P.extension(path)), F.lit("text"))


def file_view(files: DataFrame, budget: int = VIEW_TOKENS, tokens: Tokens = T.token_estimate) -> DataFrame:
    """path, language, view of files (path, content): modules adaptively, other files cut in the middle; ignored files
    have a remark instead.  Only modules whose text and outline are over the budget are parsed."""
    from . import budgets

    # what :func:`adaptive` chooses from, each in a column of its own and made where what comes before it does not fit
    module = (P.extension(F.col("path")) == "py") & ~P.ignored_by_scan(F.col("path"))
    rows = files.select("path", "content", module.alias("_module")).withColumn("_count", F.when(F.col("_module"), tokens(F.col("content"))))
    large = F.col("_count") >= budget
    rows = rows.withColumn("_wide", F.when(large, _wide(F.col("content"))))
    rows = rows.withColumn("_short", F.when(large, F.when(tokens(F.col("_wide")) <= budget, F.col("_wide")).otherwise(_narrow(F.col("content")))))
    rows = rows.withColumn("_fits", tokens(F.col("_short")) <= budget)
    rows = rows.withColumn("_skeleton", E.outline_udf()(F.when(large & ~F.col("_fits"), F.col("content")).otherwise("")))
    chosen = F.when(F.col("_count") < budget, F.col("content")).when(F.col("_fits"), F.col("_short")).when(tokens(F.col("_skeleton")) <= budget, F.col("_skeleton")).otherwise(head(F.col("content")))
    words = F.split("content", " ")
    cut = F.array_join(budgets.head_tail(words, budget), " ")
    view = F.when(P.ignored_by_scan(F.col("path")), F.concat(F.lit("File "), F.col("path"), F.lit(" is compiled or temporary file, usually no need to view content.")))
    view = view.when(F.col("_module"), chosen).otherwise(cut)
    return rows.select("path", language(F.col("path")).alias("language"), view.alias("view"))


def parameters(p: Column) -> Column:
    """name or "name: type", joined."""
    return F.array_join(F.transform(p, lambda x: F.concat(x["name"], F.coalesce(F.concat(F.lit(": "), x["type"]), F.lit("")))), ", ")


def _ordered(text: Column, order: str = "ordinal") -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), text.alias("t")))), lambda x: x["t"])


def _first_line(doc: Column) -> Column:
    return F.split_part(doc, F.lit("\n"), F.lit(1))


def structures(entities: DataFrame) -> DataFrame:
    """module_id, structure: each class with its methods, then the functions, with the first lines of their docs.  Ids of
    classes begin with their module, so that rows are grouped by class, then by module, without a join."""
    rows = E.latest(entities, "module", "class", "function")
    is_class, is_module, loose = F.col("kind") == "class", F.col("kind") == "module", (F.col("kind") == "function") & F.col("class_id").isNull()
    documented = F.col("docstring") != ""
    head = F.format_string("def %s(%s):", F.col("name"), parameters(F.col("parameters")))
    own = F.when(documented, F.concat(F.lit("    '''"), _first_line(F.col("docstring")), F.lit("...'''\n"))).otherwise("")
    text = F.when(is_module, F.col("docstring")).when(is_class, F.concat(F.lit("\nclass "), F.col("name"), F.lit(":\n"), own))
    text = text.when(loose, F.concat(F.lit("\n"), head, F.when(documented, F.concat(F.lit("\n    # "), _first_line(F.col("docstring")))).otherwise("")))
    text = text.otherwise(F.concat(F.lit("    "), head, F.when(documented, F.concat(F.lit("\n        # "), _first_line(F.col("docstring")))).otherwise("")))
    place = F.when(is_module, 0).when(loose, 2).otherwise(1)
    rows = rows.select("module_id", place.alias("place"), F.when(place == 1, F.coalesce("class_id", "id")).otherwise(F.col("id")).alias("block"), (place == 1) & ~is_class, "ordinal", text.alias("t")).toDF("module_id", "place", "block", "method", "ordinal", "t")
    methods = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("method"), F.struct("ordinal", "t")))), lambda x: x["t"]), "\n")
    first = F.max(F.when(~F.col("method"), F.struct("ordinal", "t")))  # one row
    blocks = rows.groupBy("module_id", "place", "block").agg(first.alias("x"), methods.alias("m")).filter("x is not null")
    t = F.concat("x.t", F.when(F.col("place") != 1, "").when(F.col("m") != "", F.col("m")).otherwise("    pass"))
    parts = F.sort_array(F.collect_list(F.when(F.col("place") > 0, F.struct("place", "x.ordinal", t.alias("t")))))
    modules = blocks.groupBy("module_id").agg(F.max(F.when(F.col("place") == 0, F.struct(F.col("x.t").alias("doc")))).alias("own"), parts.alias("parts")).filter("own is not null")
    doc = F.when(F.col("own.doc") != "", F.concat(F.lit("'''"), F.col("own.doc"), F.lit("'''")))
    joined = F.when(F.size("parts") > 0, F.array_join(F.transform("parts", lambda x: x["t"]), "\n"))
    return modules.select("module_id", F.concat_ws("\n", F.concat(F.lit("### Module: "), F.col("module_id")), doc, joined).alias("structure"))


def class_details(entities: DataFrame, modules: DataFrame | None = None, budget: int = ENTITY_TOKENS, tokens: Tokens = T.token_estimate) -> DataFrame:
    """id, details of each class: place, docs, bases, methods, source (its outline if the source is over the budget).
    ``modules`` are read for the sources of entities that come without."""
    own, method = F.col("kind") == "class", F.col("class_id").isNotNull()
    returned = F.coalesce(F.concat(F.lit(" -> "), F.col("return_type")), F.lit(""))
    line = F.concat(F.format_string("- %s(%s)", F.col("name"), parameters(F.col("parameters"))), returned)
    rows = E.latest(entities, "class", "function").filter(own | method).withColumn("_class", F.when(own, F.col("id")).otherwise(F.col("class_id")))
    kept = [c for c in ("module_id", "name", "docstring", "bases", "source", "first_line", "last_line") if c in rows.columns]
    methods = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(method, F.struct("ordinal", line.alias("t"))))), lambda x: x["t"]), "\n")
    rows = rows.groupBy(F.col("_class").alias("id")).agg(F.first(F.when(own, F.struct(*kept)), ignorenulls=True).alias("x"), methods.alias("methods")).filter("x is not null")
    rows = rows.select("id", "x.*", F.when(F.col("methods") != "", F.col("methods")).alias("methods"))
    rows = within(E.with_sources(rows, modules), "_shown", F.col("source"), budget, tokens)
    return rows.select(
        "id",
        F.concat_ws(
            "\n", F.concat(F.lit("# Class: "), F.col("name")), F.concat(F.lit("Module location: "), F.col("module_id")),
            F.when(F.col("docstring") != "", F.concat(F.lit("\nDocumentation:\n'''"), F.col("docstring"), F.lit("'''"))),
            F.when(F.size("bases") > 0, F.concat(F.lit("\nInherits from: "), F.array_join("bases", ", "))),
            F.coalesce(F.concat(F.lit("\nMethods:\n"), F.col("methods")), F.lit("\nThis class has no methods")), F.concat(F.lit("\nSource code:\n"), F.col("_shown")),
        ).alias("details"),
    )


def function_details(entities: DataFrame, modules: DataFrame | None = None, budget: int = ENTITY_TOKENS, tokens: Tokens = T.token_estimate) -> DataFrame:
    """id, details of each function: place, class, signature, docs, source (its outline if the source is over the budget).
    ``modules`` are read for the sources of entities that come without."""
    rows = within(E.with_sources(E.latest(entities, "function"), modules), "_shown", F.col("source"), budget, tokens)
    returned = F.coalesce(F.concat(F.lit(" -> "), F.col("return_type")), F.lit(""))
    return rows.select(
        "id",
        F.concat_ws(
            "\n", F.concat(F.lit("# Function: "), F.col("name")), F.concat(F.lit("Module location: "), F.col("module_id")), F.concat(F.lit("Class: "), F.col("class_id")),
            F.concat(F.format_string("\nSignature: %s(%s)", F.col("name"), parameters(F.col("parameters"))), returned),
            F.when(F.col("docstring") != "", F.concat(F.lit("\nDocumentation:\n'''"), F.col("docstring"), F.lit("'''"))), F.concat(F.lit("\nSource code:\n"), F.col("_shown")),
        ).alias("details"),
    )


def relationships(entities: DataFrame, edges: DataFrame, imports: DataFrame, target: str) -> DataFrame:
    """direction, relation, other: what refers to an entity and what it refers to, in one table."""
    from . import resolve

    into = resolve.references(entities, edges, imports, target).select(F.lit("in").alias("direction"), "relation", F.col("source").alias("other"))
    return into.unionByName(resolve.dependencies(entities, edges, target).select(F.lit("out").alias("direction"), "relation", F.col("target").alias("other")))


def import_texts(entities: DataFrame) -> DataFrame:
    """module_id, imports: the import statements of each module as text, in their order."""
    i = E.imports(entities)
    line = F.concat(F.when(F.col("type") == "import", F.concat(F.lit("import "), F.col("name"))).otherwise(F.concat(F.lit("from "), F.col("module"), F.lit(" import "), F.col("name"))), F.coalesce(F.concat(F.lit(" as "), F.col("alias")), F.lit("")))
    return i.groupBy("module_id").agg(F.array_join(_ordered(line, "pos"), "\n").alias("imports"))


def listing(files: DataFrame, path: str, most: int = FILES_SHOWN, deepest: int = 4) -> DataFrame:
    """dir, place, line: each folder's files by name, indented, the first ``most`` and a line on the rest; folders at the
    greatest depth have one line on that instead."""
    parts = F.split(F.col(path), "/")
    rows = files.select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("dir"), F.element_at(parts, -1).alias("name"), (F.size(parts) - 1).alias("depth"))
    w = Window.partitionBy("dir")
    rows = rows.withColumn("place", F.row_number().over(w.orderBy("name"))).withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("place") <= F.when(F.col("depth") >= deepest, 1).otherwise(most + 1))
    line = F.when(F.col("depth") >= deepest, F.lit("... Maximum depth limit reached")).when(F.col("place") <= most, F.col("name")).otherwise(F.format_string("... %d more files not displayed", F.col("_n") - most))
    return rows.select("dir", F.col("place").cast("int").alias("place"), F.concat(F.repeat(F.lit("    "), F.col("depth") + F.when(F.col("depth") >= deepest, 0).otherwise(1)), line).alias("line"))


def tree_lines(files: DataFrame, path: str, note: str, caps: list[int] = TREE_CAPS, deepest: int = TREE_DEPTH) -> DataFrame:
    """place (array<int>, the order), line: a tree drawn with connectors; of each folder the first entries by name up to
    the cap of its depth and a line on the rest.  ``note`` is a column that stands behind a file's name."""
    parts = F.split(F.col(path), "/")
    rows = files.select(parts.alias("_p"), F.col(note).alias("_note"))
    level, out = None, None
    for depth in range(deepest + 1):
        here = rows.filter(F.size("_p") > depth)
        nodes = here.groupBy(F.slice("_p", 1, depth).alias("parent"), F.get("_p", F.lit(depth)).alias("name")).agg(F.max(F.when(F.size("_p") == depth + 1, F.col("_note"))).alias("note"), F.max(F.size("_p")).alias("longest"))
        cap = caps[min(depth, len(caps) - 1)]
        w = Window.partitionBy("parent")
        nodes = nodes.withColumn("r", F.row_number().over(w.orderBy("name"))).withColumn("n", F.count(F.lit(1)).over(w)).filter(F.col("r") <= cap + 1)
        if level is None:
            nodes = nodes.withColumn("above", F.lit("")).withColumn("at", F.array().cast("array<int>"))
        else:  # only what stands below a folder that is shown
            nodes = nodes.join(level, "parent")
        last = F.col("r") == F.least("n", F.lit(cap))
        text = F.concat("above", F.when(last, "└── ").otherwise("├── "), "name", F.when(F.col("longest") > depth + 1, "/").otherwise(F.concat(F.lit(" ("), "note", F.lit(")"))))
        more = F.concat("above", F.format_string("... and %d more items", F.col("n") - cap))
        shown = nodes.select(F.array_append("at", F.col("r").cast("int")).alias("place"), F.when(F.col("r") <= cap, text).otherwise(more).alias("line"))
        out = shown if out is None else out.unionByName(shown)
        folder = nodes.filter((F.col("r") <= cap) & (F.col("longest") > depth + 1))
        level = folder.select(F.array_append("parent", F.col("name")).alias("parent"), F.concat("above", F.when(last, "    ").otherwise("│   ")).alias("above"), F.array_append("at", F.col("r").cast("int")).alias("at"))
    return out


def overview(totals: DataFrame, tree: DataFrame, name: str) -> DataFrame:
    """text: four totals (modules, classes, functions, lines; one row) and the paths of a pruned package tree (path, depth),
    which its threshold bounds."""
    drawn = tree.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "depth"))), lambda x: F.concat(F.repeat(F.lit("  "), x["depth"] - 1), F.lit("- "), F.element_at(F.split(x["path"], "/"), -1))), "\n").alias("_tree"))
    lines = [F.lit("# Code Repository Overview"), F.lit(f"Repository path: {name}")]
    lines += [F.format_string(f"Total {label}: %d", F.col(c)) for label, c in (("modules", "modules"), ("classes", "classes"), ("functions", "functions"), ("lines of code", "lines"))]
    return totals.join(F.broadcast(drawn)).select(F.concat_ws("\n", *lines, F.lit("# Package Structure"), "_tree").alias("text"))  # one row each


def error_reports(errors: DataFrame, key: str) -> DataFrame:
    """key, report: per text the summary, counts by type, install commands and numbered details of
    :func:`~loomwright.functions.text.package_errors` rows."""
    names = F.create_map(*[F.lit(x) for pair in ERROR_NAMES.items() for x in pair])
    named = errors.withColumn("_name", F.coalesce(F.try_element_at(names, F.col("error_type")), F.col("error_type")))
    package = F.col("details")["package_name"]
    command = F.when(F.col("error_type") == "missing_package", F.concat(F.lit("pip install "), F.split_part(package, F.lit("."), F.lit(1)))).when(F.col("error_type") == "dependency_error", F.concat(F.lit("pip install "), F.col("details")["dependency_name"])).when(
        F.col("error_type") == "version_conflict", F.concat(F.lit("pip install "), package, F.lit("=="), F.col("details")["required_version"])
    ).when(F.col("error_type") == "syntax_error_in_package", F.concat(F.lit("pip uninstall -y "), package, F.lit(" && pip install --no-cache-dir "), package))
    rows = F.sort_array(F.collect_list(F.struct(F.col("ord"), F.col("_name").alias("name"), F.map_entries("details").alias("d"), command.alias("command"), F.col("suggestion"), package.alias("package"))))
    each = named.groupBy(key).agg(rows.alias("r"))
    r = F.col("r")
    kinds = F.array_distinct(F.transform(r, lambda x: x["name"]))
    commands = F.array_distinct(F.array_compact(F.transform(r, lambda x: x["command"])))
    packages = F.array_distinct(F.array_compact(F.transform(r, lambda x: x["package"])))
    counts = F.transform(kinds, lambda k: F.format_string("- %s: %d errors", k, F.size(F.filter(r, lambda x: x["name"] == k))))
    details = F.transform(r, lambda x, i: F.concat_ws("\n", F.format_string("Error #%d: %s", i + 1, x["name"]), F.array_join(F.transform(x["d"], lambda e: F.format_string("  %s: %s", e["key"], e["value"])), "\n"), F.lit("Fix suggestion:"), x["suggestion"]))
    return each.select(
        key,
        F.concat_ws(
            "\n", F.lit("Python Package Error Analysis Report"), F.format_string("- Found %d package-related errors", F.size(r)), F.concat(F.lit("- Affected packages: "), F.array_join(packages, ", ")),
            F.array_join(counts, "\n"), F.when(F.size(commands) > 0, F.concat(F.lit("Suggested fix commands:\n"), F.array_join(commands, "\n"))), F.array_join(details, "\n"),
        ).alias("report"),
    )


def previews(files: DataFrame, path: str, content: str, code: list[str], most_lines: int = 30, budget: int = 6000) -> DataFrame:
    """dir, path, preview: short files with their content (code in a fence); of folders whose previews together are over
    the budget the names alone."""
    n = F.size(T.lines(F.col(content)))
    body = F.when(P.extension(F.col(path)).isin(code), F.concat(F.lit("```\n"), F.col(content), F.lit("\n```"))).otherwise(F.col(content))
    shown = F.concat(F.lit("-> "), F.col(path), F.lit(" has content:\n\n"), body)
    rows = files.filter(n < most_lines).select(F.regexp_replace(path, "/[^/]*$", "").alias("dir"), F.col(path).alias("path"), shown.alias("_full"))
    total = rows.groupBy("dir").agg(F.sum(F.length("_full") + 2).alias("_n"))
    return rows.join(total, "dir").select("dir", "path", F.when(F.col("_n") > budget, F.concat(F.lit("-> "), F.col("path"))).otherwise(F.col("_full")).alias("preview"))


def display_info(content: Column, sender: Column, receiver: Column, role: Column, at: Column, new_files: Column) -> Column:
    """The record of a displayed message; new files are JSON text."""
    return F.struct(
        F.struct(content.alias("content"), role.alias("role")).alias("message"), F.struct(sender.alias("name"), F.lit("").alias("description"), F.lit("").alias("system_message")).alias("sender_info"),
        receiver.alias("receiver_name"), role.alias("sender_role"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.when(F.size(new_files) > 0, F.to_json(new_files)).otherwise("[]").alias("new_files"),
    )


def snippets(found: DataFrame, text: str, budget: int = SNIPPET_TOKENS, tokens: Tokens = T.token_estimate) -> DataFrame:
    """Search results as they are shown: very short ones go, long ones become outlines, what is still long goes."""
    return within(found.filter(F.length(text) >= LEAST_SNIPPET), text, F.col(text), budget, tokens).filter(tokens(F.col(text)) <= budget)
