"""Column functions over texts: cleaning, fences, errors, digests, templates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Page cleaning, in order (pattern, replacement).
CLEAN_STEPS = [
    (r"http[s]?://\S+", ""),
    (r"\[([^\]]+)\]\([^\)]+\)", "$1"),
    (r"<[^>]+>", ""),
    (r"!\[([^\]]*)\]\([^\)]+\)", "$1"),
    (r"(?s)<!--.*?-->", ""),
    (r"(?im)^\s*[-*]\s+(Home|About|Contact|Menu|Search|Privacy Policy|Terms of Service)\s*$", ""),
    (r"(?i)Copyright © \d{4}[^\n]*", ""),
    (r"(?i)All rights reserved\.?", ""),
    (r"(?i)(Follow|Like|Share|Subscribe)[^\n]*(Facebook|Twitter|Instagram|LinkedIn|YouTube)[^\n]*", ""),
]
# Package errors (pattern, names of its groups, advice).
PACKAGE_ERRORS = {
    "missing_package": (r"(?:ImportError|ModuleNotFoundError): No module named ['\"]([^'\"]+)['\"]", ["package_name"], "Install the missing package using pip: pip install {package_name}"),
    "import_name_error": (
        r"(?:ImportError): cannot import name ['\"]([^'\"]+)['\"] from ['\"]([^'\"]+)['\"]",
        ["component_name", "package_name"],
        "Check if package {package_name} version is correct. Component {component_name} may have been added in newer versions or doesn't exist in current version.",
    ),
    "attribute_error": (
        r"(?:AttributeError): module ['\"]([^'\"]+)['\"] has no attribute ['\"]([^'\"]+)['\"]",
        ["package_name", "attribute_name"],
        "Check the documentation of package {package_name} to confirm if {attribute_name} exists or requires additional imports.",
    ),
    "version_conflict": (
        r"(?:[^\n]*?)requires ([^\s]+) ([^,]+), but ([^\s]+) is installed",
        ["package_name", "required_version", "installed_version"],
        "Install the required version of package: pip install {package_name}=={required_version} or use virtual environment to isolate dependencies.",
    ),
    "syntax_error_in_package": (
        r"(?:SyntaxError|IndentationError)(?:[^\n]*?)File ['\"](?:[^\n]*?)site-packages[/\\]([^/\\]+)[/\\](?:[^\n]*?)['\"], line (\d+)",
        ["package_name", "line_number"],
        "Package {package_name} may be incompletely installed or corrupted. Try reinstalling: pip uninstall {package_name} && pip install {package_name}",
    ),
    "import_error_in_package": (
        r"(?:ImportError): (?:[^\n]*?)site-packages[/\\]([^/\\]+)[/\\](?:[^\n]*?): ([^\"'\n]+)",
        ["package_name", "error_details"],
        "Package {package_name} internal dependency issue: {error_details}. Check if its dependencies are completely installed.",
    ),
    "dependency_error": (r"(?:[^\n]*?)([^\s]+) requires ([^\s]+), which is not installed", ["package_name", "dependency_name"], "Install the missing dependency: pip install {dependency_name}"),
    "dll_load_error": (
        r"(?:ImportError): DLL load failed while importing ([^:]+): ([^\"'\n]+)",
        ["module_name", "error_details"],
        "Module {module_name} failed to load DLL: {error_details}. May need to install system-level dependencies or VC++ runtime.",
    ),
    "permission_error": (r"(?:PermissionError)(?:[^\n]*?)site-packages[/\\]([^/\\]+)[/\\]", ["package_name"], "Package {package_name} access permission issue. Try running with administrator/sudo privileges or check file permissions."),
    "pkg_resources_error": (r"(?:pkg_resources\.DistributionNotFound): The '([^']+)(?:[^']*?)' distribution was not found", ["package_name"], "Distribution package {package_name} not found. Try: pip install {package_name}"),
    "incompatible_version": (
        r"(?:[^\n]*?)([^\s]+) ([^\s]+) is incompatible with ([^\s]+) ([^\s]+)",
        ["package1", "version1", "package2", "version2"],
        "Package version conflict: {package1} {version1} is incompatible with {package2} {version2}. Create virtual environment or adjust dependency versions.",
    ),
}
#: What every match of a pattern holds.  A text without it is not searched: patterns that begin with any part of a line try
#: each place of each line, with all that follows it.
HELD = {
    "missing_package": ["No module named"], "import_name_error": ["cannot import name"], "attribute_error": ["has no attribute"], "version_conflict": ["requires ", ", but ", " is installed"],
    "syntax_error_in_package": ["Error", "site-packages", ", line "], "import_error_in_package": ["ImportError", "site-packages"], "dependency_error": [" requires ", ", which is not installed"],
    "dll_load_error": ["DLL load failed while importing "], "permission_error": ["PermissionError", "site-packages"], "pkg_resources_error": ["distribution was not found"], "incompatible_version": [" is incompatible with "],
}
#: A pattern that begins with any part of a line: if it fails there, it fails from all later places of the line.
ANY_START, AT_LINE = r"(?:[^\n]*?)", r"(?:\G|(?<=\n))(?:[^\n]*?)"
ERROR_ROWS = "array<struct<error_type:string,match_text:string,details:map<string,string>,suggestion:string>>"
# Install logs (what marks one, what is noise in one).
INSTALL_MARKS = [
    r"Successfully installed ", r"Requirement already satisfied:", r"WARNING: You are using pip version", r"ERROR: pip's dependency resolver",
    r"ERROR: Could not install packages", r"Attempting uninstall", r"Found existing installation", r"Successfully uninstalled",
]
INSTALL_NOISE = [
    r"^\s*Requirement already satisfied:", r"^\s*Collecting\s+\S+", r"^\s*Using cached", r"^\s*Installing collected packages", r"^\s*Downloading\s+\S+",
    r"^\s*Attempting uninstall", r"^\s*Found existing installation", r"^\s*Uninstalling", r"^\s*Successfully uninstalled",
]
FENCE = r"(?s)```[ \t]*(\w+)?[ \t]*\r?\n(.*?)\r?\n[ \t]*```"
RUNNABLE = ["python", "python3", "sh", "bash", "shell"]


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def squeeze(text: Column) -> Column:
    """White space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def clean_page(text: Column) -> Column:
    """The ordered page-cleaning steps, then blank and very short lines (up to two words) go."""
    for pattern, replacement in CLEAN_STEPS:
        text = F.regexp_replace(text, pattern, replacement)
    kept = F.filter(F.transform(lines(text), lambda x: F.regexp_replace(x, r"^[ \t\f\r\x0B]+|[ \t\f\r\x0B]+$", "")), lambda x: F.size(F.split(squeeze(x), " ")) > 2)
    return F.array_join(kept, "\n")


def code_blocks(text: Column) -> Column:
    """array<struct<language, code>>, or null when there is no fence or a fence is not runnable."""
    tags, codes = F.regexp_extract_all(text, F.lit(FENCE), F.lit(1)), F.regexp_extract_all(text, F.lit(FENCE), F.lit(2))
    good = (F.size(tags) > 0) & F.forall(tags, lambda x: x.isin(RUNNABLE))
    return F.when(good, F.transform(F.arrays_zip(tags.alias("t"), codes.alias("c")), lambda x: F.struct(x["t"].alias("language"), x["c"].alias("code"))))


def _error_row(name: str, groups: list[str], advice: str):
    def row(m: Column) -> Column:
        details = F.map_from_arrays(F.array(*map(F.lit, groups)), F.array(*[m[f"g{i + 1}"] for i in range(len(groups))]))
        suggestion = fill(F.lit(advice), {g: m[f"g{i + 1}"] for i, g in enumerate(groups)})
        return F.struct(F.lit(name).alias("error_type"), m["g0"].alias("match_text"), details.alias("details"), suggestion.alias("suggestion"))

    return row


def package_errors(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, ord, error_type, match_text, details map, suggestion, context: one row per match, in pattern order.

    All patterns are evaluated in one pass over the texts; there is no join.
    """
    found = []
    for name, (pattern, groups, advice) in PACKAGE_ERRORS.items():
        rx = F.lit("(?im)" + (AT_LINE + pattern.removeprefix(ANY_START) if pattern.startswith(ANY_START) else pattern))
        columns = [F.regexp_extract_all(F.col(text), rx, F.lit(i)) for i in range(len(groups) + 1)]
        zipped = F.arrays_zip(*[c.alias(f"g{i}") for i, c in enumerate(columns)])
        held = reduce(and_, [F.col(text).rlike("(?i)" + x) for x in HELD[name]])
        found.append(F.when(held, F.transform(zipped, _error_row(name, groups, advice))).otherwise(F.array().cast(ERROR_ROWS)))
    out = texts.select(key, F.col(text).alias("_text"), F.posexplode(F.concat(*found)).alias("ord", "e")).select(key, "ord", "e.*", "_text")
    before = F.call_function("substring_index", F.col("_text"), F.col("match_text"), F.lit(1))
    at = F.size(lines(before)) - 1
    span = F.size(lines(F.col("match_text")))
    begin = F.greatest(at - 3, F.lit(0))
    context = F.array_join(F.slice(lines(F.col("_text")), begin + 1, at - begin + span + 3), "\n")
    return out.withColumn("context", context).drop("_text")


def strip_install_noise(log: Column) -> Column:
    """An install log without its noise lines; any other text as it is."""
    each = lines(log)
    marked = F.exists(each, lambda x: x.rlike("|".join(INSTALL_MARKS)))
    kept = F.array_join(F.filter(each, lambda x: ~x.rlike("|".join(INSTALL_NOISE))), "\n")
    return F.when(marked, kept).otherwise(log)


def cut(text: Column, limit: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def fill(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def repo_name(url: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), r"\.git$", "")


def repo_type(path: Column) -> Column:
    return F.when(path.contains("github.com"), "github").when(path.startswith("/") | path.startswith("."), "local").when(F.size(F.split(path, "/")) == 2, "github").otherwise("local")


def replace_exact(text: Column, old: Column, new: Column, replace_all: bool = False) -> Column:
    """Strict edit: null unless old differs from new and occurs once (or at all, with ``replace_all``)."""
    times = (F.length(text) - F.length(F.replace(text, old, F.lit("")))) / F.length(old)
    fine = (old != new) & (F.length(old) > 0) & ((times >= 1) if replace_all else (times == 1))
    return F.when(fine, F.replace(text, old, new))


def token_estimate(text: Column) -> Column:
    """Words and marks: the offline stand-in for an injected tokenizer.  What is left with a character a word and no spaces is
    as long as they are many; listing them all takes far longer."""
    return F.length(F.array_join(F.split(text, r"(?<=[A-Za-z0-9_])[A-Za-z0-9_]++|\s++"), ""))


def response_format(fields: Column) -> Column:
    """JSON text of a strict response format from array<struct<name, type, description, items>>: every field required, no
    others.  ``items`` is the JSON text of what an array holds, of any depth; it is null, and counts for arrays alone."""
    each = lambda f: F.struct(f["type"].alias("type"), f["description"].alias("description"), F.when(f["type"] == "array", F.parse_json(f["items"])).alias("items"))
    properties = F.map_from_entries(F.transform(fields, lambda f: F.struct(f["name"], each(f))))
    schema = F.struct(F.lit("object").alias("type"), properties.alias("properties"), F.transform(fields, lambda f: f["name"]).alias("required"), F.lit(False).alias("additionalProperties"))
    return F.to_json(F.struct(F.lit("json_schema").alias("type"), F.struct(F.lit("response_jsons").alias("name"), F.lit(True).alias("strict"), schema.alias("schema")).alias("json_schema")))
