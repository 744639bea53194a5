"""Column functions over file paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the scan ignores.
SCAN_DIRS = ["__pycache__", ".git", ".vscode", "venv", "env", "node_modules", ".pytest_cache", "build", "dist", ".github", "logs"]
SCAN_SUFFIXES = (
    ".png .jpg .jpeg .gif .bmp .tiff .ico .webp .mp4 .avi .mov .wmv .flv .mpeg .mpg .m4v .mkv .webm .mp3 .wav .ogg .m4a .aac .flac .wma .m4b .m4p "
    ".zip .rar .tar .gz .bz2 .7z .iso .dmg .pkg .deb .rpm .msi .exe .app .pdf .doc .docx .xls .xlsx .ppt .pptx"
).split()
SCAN_NAMES = r"(\.pyc|\.pyo|\.pyd|\.so|\.dll|\.class|\.egg-info|~|\.swp)$"
# What the directory monitor ignores.
MONITOR_DIRS = "__pycache__ .git .svn .hg node_modules .venv venv .env env .pytest_cache .mypy_cache .tox dist build egg-info .eggs .idea .vscode .DS_Store".split()
MONITOR_SUFFIXES = ".pyc .pyo .pyd .so .dll .dylib .log .tmp .bak .swp .DS_Store".split()
# Kinds of files by extension.
KINDS = {
    "data": "csv tsv xlsx xls json parquet",
    "text": "txt md py js html css yaml yml xml log",
    "pdf": "pdf",
    "image": "png jpg jpeg gif bmp webp svg",
    "audio": "mp3 wav ogg flac m4a",
    "video": "mp4 avi mov mkv webm",
}


def _any_suffix(path: Column, suffixes: list[str]) -> Column:
    return path.rlike("(" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")$")


def parts(path: Column) -> Column:
    return F.split(path, "/")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-cased extension of the last part, without its dot; empty if none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^/]\.([^./]+)$", 1))


def has_part(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(parts(path), F.array(*map(F.lit, names)))


def ignored_by_scan(path: Column) -> Column:
    """Notebooks outside ignored folders stay; leading "." or "__", media and archives, ignored folders and build
    products go."""
    notebook = path.endswith(".ipynb") & ~has_part(path, SCAN_DIRS)
    out = path.startswith(".") | path.startswith("__") | _any_suffix(path, SCAN_SUFFIXES) | has_part(path, SCAN_DIRS) | base_name(path).rlike(SCAN_NAMES)
    return ~notebook & out


def ignored_by_monitor(path: Column) -> Column:
    name = base_name(path)
    suffix = F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))
    return has_part(path, MONITOR_DIRS) | suffix.isin(MONITOR_SUFFIXES) | name.startswith(".")


def module_id(path: Column, strict_compat: bool = False) -> Column:
    """Dotted id of a source file; with ``strict_compat`` every literal ".py" goes, not only the suffix."""
    dotted = F.regexp_replace(path, r"[/\\]", ".")
    return F.replace(dotted, F.lit(".py"), F.lit("")) if strict_compat else F.regexp_replace(dotted, r"\.py$", "")


def kind(path: Column) -> Column:
    out = F.lit("other")
    for name, exts in KINDS.items():
        out = F.when(extension(path).isin(exts.split()), name).otherwise(out)
    return out


def priority(path: Column) -> Column:
    """0 images, 1 PDF, 2 tables and JSON, 3 the rest."""
    e = extension(path)
    return F.when(e.isin("png jpg jpeg gif bmp webp svg".split()), 0).when(e == "pdf", 1).when(e.isin("csv", "xlsx", "json"), 2).otherwise(3)


def human_size(n: Column) -> Column:
    """Bytes as text with one decimal, dividing by 1024 up to TB, ties to even; zero is "0 B"."""
    n = n.cast("double")
    out = F.format_string("%.1f TB", F.bround(n / 1024.0**4, 1))
    for i, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(n < 1024.0 ** (i + 1), F.format_string(f"%.1f {unit}", F.bround(n / 1024.0**i, 1))).otherwise(out)
    return F.when(n == 0, "0 B").otherwise(out)


def safe_name(name: Column, limit: int = 40) -> Column:
    """Word characters, blanks, dots and dashes kept; blanks become "_"; ends trimmed of "._"; lower case; cut."""
    kept = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_ .-]", ""), r"[ ]+", "_")
    return F.substring(F.lower(F.regexp_replace(kept, r"^[._]+|[._]+$", "")), 1, limit)


def strip_prefix(path: Column, prefix: str) -> Column:
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def upload_name(name: Column, at: Column) -> Column:
    """A time stamp and the safe name."""
    return F.concat_ws("_", F.date_format(at, "yyyyMMdd_HHmmss"), safe_name(name))
