"""Which of the packages that errors name can be installed."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Errors whose package could be installed, and what is known of kinds of packages.
TYPES = ["missing_package", "version_conflict", "dependency_error", "pkg_resources_error", "syntax_error_in_package"]
KNOWN = {"builtin": False, "installed": True, "local": False}


def installable(texts: DataFrame, key: str, text: str, packages: DataFrame, lookup: Callable[[list[str]], list[bool]]) -> DataFrame:
    """key, error_type, package of the errors in the texts whose package can be installed.

    ``packages`` (name, kind) says what is known: builtin and local ones cannot be installed, installed ones can.  Of other
    names the part before the first dot is looked up, each name once however many errors have it; a lookup that fails or
    answers too little counts as no.  Empty and relative names are none."""
    errors = T.package_errors(texts, key, text).filter(F.col("error_type").isin(TYPES))
    errors = errors.select(key, "error_type", F.col("details")["package_name"].alias("package"))
    errors = errors.filter("package is not null and package != '' and not startswith(package, '.')").withColumn("_base", F.element_at(F.split("package", "[.]"), 1))

    @F.pandas_udf("boolean")
    def asked(names: pd.Series) -> pd.Series:
        try:
            found = list(lookup(names.tolist()))
        except Exception:  # an injected index may fail in any way
            found = []
        return pd.Series(found if len(found) == len(names) else [False] * len(names), dtype=bool)

    kinds = packages.filter(F.col("kind").isin(list(KNOWN))).groupBy(F.col("name").alias("_base")).agg(F.min("kind").alias("_kind"))
    bases = errors.select("_base").distinct().join(kinds, "_base", "left")
    known = bases.filter("_kind is not null").select("_base", (F.col("_kind") == "installed").alias("_good"))
    others = bases.filter("_kind is null").select("_base", asked("_base").alias("_good"))
    good = known.unionByName(others).filter("_good").select("_base")
    return errors.join(good, "_base", "left_semi").select(key, "error_type", "package")
