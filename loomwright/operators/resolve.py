"""Call and import resolution as equi joins on constructed ids, the first rule that matches wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import entities as E


def _suffixes(functions: DataFrame) -> DataFrame:
    """suffix, id, ordinal of every dotted suffix: a search for an ending becomes an equi join."""
    parts = F.split("id", "[.]")
    return functions.select("id", "ordinal", "module_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))).alias("suffix"))


def call_edges(entities: DataFrame, callers: Column | None = None, target: str | None = None) -> DataFrame:
    """src, dst: distinct resolved calls between functions, or the calls alone of functions that ``callers`` (of their id) names,
    or those alone from and to a ``target``, a function or a class with its methods.

    Whatever the rule, a call resolves to a function whose last name is its own, so of the others only the target's matter.

    Simple names: the same module, the same class, its bases, then from-imports.  Attributes: a class of that name that
    has the method, then imported modules.  Nested attributes: the exact id, then the first function of that ending.
    """
    functions, classes, imports = E.latest(entities, "function"), E.latest(entities, "class"), E.imports(entities)
    # functions are sorted for the last of equal ids: what each rule reads of them is stored, so that it is done once
    functions = durable(functions.select("module_id", "class_id", "id", "ordinal", "calls"), "functions")
    calls = functions if callers is None else functions.filter(callers)
    calls = calls.select("module_id", "class_id", F.col("id").alias("src"), F.posexplode("calls").alias("pos", "c")).select("module_id", "class_id", "src", "pos", "c.*")
    of_target = lambda c: (F.col(c) == target) | F.col(c).startswith(f"{target}.")
    if target is not None:
        last = lambda c: F.element_at(F.split(c, "[.]"), -1)
        names = functions.filter(of_target("id")).select(last("id").alias("_last"), F.lit(True).alias("_named")).distinct()  # of one class
        calls = calls.withColumn("_last", F.coalesce("name", "attribute", last("full_path"))).join(F.broadcast(names), "_last", "left").filter(of_target("src") | F.col("_named")).drop("_last", "_named")
    ids = functions.select("id")
    dot = lambda *x: F.concat_ws(".", *x)
    call = ["src", "pos"]

    def candidates(rows: DataFrame, target, rule: int, order=None) -> DataFrame:
        return rows.select(*call, target.alias("dst"), F.lit(rule).alias("rule"), (order if order is not None else F.lit(0)).cast("long").alias("ord"))

    simple, attribute, nested = (calls.filter(F.col("type") == t) for t in ("simple", "attribute", "nested_attribute"))
    bases = classes.select(F.col("id").alias("class_id"), F.posexplode("bases").alias("base_pos", "base"))
    froms = imports.filter("type = 'importfrom'")
    found = candidates(simple, dot("module_id", "name"), 1)
    found = found.unionByName(candidates(simple.filter("class_id is not null"), dot("class_id", "name"), 2))
    inherited = simple.filter("class_id is not null").join(bases, "class_id")
    found = found.unionByName(candidates(inherited, F.when(F.col("base").contains("."), dot("base", "name")).otherwise(dot("module_id", "base", "name")), 3, F.col("base_pos")))
    imported = simple.join(froms.select("module_id", "name", F.col("module").alias("m"), F.col("pos").alias("ipos")), ["module_id", "name"])
    found = found.unionByName(candidates(imported, dot("m", "name"), 4, F.col("ipos")))
    owners = classes.select(F.element_at(F.split("id", "[.]"), -1).alias("object"), F.col("id").alias("owner"), F.col("ordinal").alias("o"))
    by_class = attribute.join(owners, "object")
    found = found.unionByName(candidates(by_class, dot("owner", "attribute"), 5, F.col("o")))
    modules = imports.select("module_id", F.col("pos").alias("ipos"), F.explode(F.array_distinct(F.array_compact(F.array("name", "alias")))).alias("object"), F.when(F.col("type") == "import", F.col("name")).otherwise(dot("module", "name")).alias("m"))
    found = found.unionByName(candidates(attribute.join(modules, ["module_id", "object"]), dot("m", "attribute"), 6, F.col("ipos")))
    found = found.unionByName(candidates(nested, F.col("full_path"), 7))
    # endings of functions that a nested call names by their last part, and of these the ones that one names
    named = nested.select("full_path").distinct()
    likely = functions.withColumn("_last", F.element_at(F.split("id", "[.]"), -1)).join(named.select(F.element_at(F.split("full_path", "[.]"), -1).alias("_last")).distinct(), "_last", "left_semi")
    endings = _suffixes(likely).join(named.withColumnRenamed("full_path", "suffix"), "suffix", "left_semi").groupBy(F.col("suffix").alias("full_path")).agg(F.min(F.struct("module_id", "ordinal", "id"))["id"].alias("hit"))
    found = found.unionByName(candidates(nested.join(endings, "full_path"), F.col("hit"), 8))
    # only functions that exist; of those the best rule, then order, then id
    real = found.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    edges = real.groupBy(*call).agg(F.min(F.struct("rule", "ord", "dst"))["dst"].alias("dst")).select("src", "dst").distinct()
    return edges if target is None else edges.filter(of_target("src") | of_target("dst"))


def called_by(edges: DataFrame) -> DataFrame:
    """id, callers (sorted), n_callers."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("callers")).withColumn("n_callers", F.size("callers").cast("long"))


def import_edges(entities: DataFrame) -> DataFrame:
    """src, dst: modules that import modules of the same repository; a package is imported by way of its __init__."""
    ids = entities.filter("kind = 'module'").select(F.col("id").alias("dst")).distinct()
    package = F.regexp_extract("dst", r"^(.+)\.__init__$", 1)
    named = ids.select("dst", F.col("dst").alias("name"), F.lit(0).alias("_r")).unionByName(ids.filter(package != "").select("dst", package.alias("name"), F.lit(1).alias("_r")))
    modules = named.groupBy("name").agg(F.min(F.struct("_r", "dst"))["dst"].alias("hit"))
    wanted = E.imports(entities).select(F.col("module_id").alias("src"), F.when(F.col("type") == "import", F.col("name")).otherwise(F.col("module")).alias("dst"))
    return wanted.join(modules, wanted["dst"] == modules["name"]).select("src", F.col("hit").alias("dst")).distinct()


def inheritance_edges(entities: DataFrame) -> DataFrame:
    return E.latest(entities, "class").select(F.col("id").alias("src"), F.explode("bases").alias("dst"))


def find(entities: DataFrame, query: str, most: int = 5) -> DataFrame:
    """id, match, n: the exact id, else ids that end with ".query" or hold it, the first few and their number."""
    ids = entities.filter(F.col("kind").isin("module", "class", "function")).select("id", "kind").distinct()
    exact = ids.filter(F.col("id") == query).withColumn("match", F.lit("exact"))
    near = ids.filter(F.col("id").endswith("." + query) | F.col("id").contains(query)).withColumn("match", F.lit("partial"))
    has = exact.agg(F.count(F.lit(1)).alias("has"))
    partial = near.join(F.broadcast(has)).filter("has = 0").drop("has")  # one row
    both = exact.unionByName(partial)
    total = both.agg(F.count(F.lit(1)).alias("n"))
    return both.orderBy("id").limit(most).join(F.broadcast(total)).select("id", "kind", "match", "n")


def references(entities: DataFrame, edges: DataFrame, imports: DataFrame, target: str) -> DataFrame:
    """relation, source: callers of a function, subclasses and callers of methods of a class, importers of a module."""
    last = target.rpartition(".")[2]
    callers = edges.filter(F.col("dst") == target).select(F.lit("caller").alias("relation"), F.col("src").alias("source"))
    subclasses = inheritance_edges(entities).filter(F.col("dst").isin(target, last) & (F.col("src") != target)).select(F.lit("subclass").alias("relation"), F.col("src").alias("source"))
    methods = edges.filter(F.col("dst").startswith(target + ".")).select(F.lit("method_caller").alias("relation"), F.col("src").alias("source"))
    importers = imports.filter(F.col("dst") == target).select(F.lit("importer").alias("relation"), F.col("src").alias("source"))
    return callers.unionByName(subclasses).unionByName(methods).unionByName(importers).distinct()


def dependencies(entities: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """relation, target: what an entity calls, extends and imports."""
    calls = edges.filter((F.col("src") == target) | F.col("src").startswith(target + ".")).select(F.lit("calls").alias("relation"), F.col("dst").alias("target"))
    bases = inheritance_edges(entities).filter(F.col("src") == target).select(F.lit("extends").alias("relation"), F.col("dst").alias("target"))
    i = E.imports(entities).filter(F.col("module_id") == target)
    line = F.concat(F.when(F.col("type") == "import", F.concat(F.lit("import "), F.col("name"))).otherwise(F.concat(F.lit("from "), F.col("module"), F.lit(" import "), F.col("name"))), F.coalesce(F.concat(F.lit(" as "), F.col("alias")), F.lit("")))
    return calls.unionByName(bases).unionByName(i.select(F.lit("imports").alias("relation"), line.alias("target"))).distinct()
