"""Graph operators over edge tables (src, dst) and node tables (node).

Iterations cut their lineage every few rounds with checkpoint(), which survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

CUT_EVERY = 5


def _cut(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, in_deg, out_deg; isolated nodes have 0."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = both.groupBy("node").agg(F.sum("i").alias("in_deg"), F.sum("o").alias("out_deg"))
    return nodes.join(sums, "node", "left").select("node", F.coalesce("in_deg", F.lit(0)).cast("long").alias("in_deg"), F.coalesce("out_deg", F.lit(0)).cast("long").alias("out_deg"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, alpha: float = 0.85, teleport: DataFrame | None = None) -> DataFrame:
    """node, pr after a fixed number of rounds.  ``teleport`` (node, p) sums to 1, uniform by default; what dangling nodes
    hold goes the same way."""
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("pr"))
    base = nodes.join(teleport, "node", "left").select("node", F.coalesce("p", F.lit(0.0)).alias("p")) if teleport is not None else nodes.select("node", F.lit(1.0 / n).alias("p"))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_out"))
    weighted = edges.join(out, "src").select("src", "dst", (F.lit(1.0) / F.col("_out")).alias("_w"))
    state = base.join(out.select(F.col("src").alias("node"), "_out"), "node", "left").select("node", "p", F.col("_out").isNull().alias("_sink"), F.lit(1.0 / n).alias("pr"))
    for k in range(rounds):
        sinks = state.agg(F.coalesce(F.sum(F.when(F.col("_sink"), F.col("pr"))), F.lit(0.0)).alias("_lost"))
        into = weighted.join(state.select(F.col("node").alias("src"), "pr"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("pr") * F.col("_w")).alias("_in"))
        state = state.join(into, "node", "left").join(F.broadcast(sinks)).select(  # one row
            "node", "p", "_sink", (F.lit(1 - alpha) * F.col("p") + F.lit(alpha) * (F.coalesce("_in", F.lit(0.0)) + F.col("_lost") * F.col("p"))).alias("pr"))
        if k % CUT_EVERY == CUT_EVERY - 1:
            state = _cut(state)
    return state.select("node", "pr")


def betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, normalized: bool = True) -> DataFrame:
    """node, betweenness by level-synchronous shortest paths from all (or the given) sources, then dependencies from the
    deepest level back.  State is keyed (source, node): its size is sources x nodes, so give sources on large graphs."""
    edges = edges.filter("src != dst").select("src", "dst").distinct()
    start = (sources if sources is not None else nodes).select(F.col("node").alias("s"))
    level = start.select("s", F.col("s").alias("node"), F.lit(0).alias("d"), F.lit(1.0).alias("paths"))
    levels, seen, d = [_cut(level)], level.select("s", "node"), 0
    while True:
        d += 1
        step = levels[-1].join(edges, levels[-1]["node"] == edges["src"]).groupBy("s", "dst").agg(F.sum("paths").alias("paths"))
        step = step.select("s", F.col("dst").alias("node"), F.lit(d).alias("d"), "paths").join(seen, ["s", "node"], "left_anti")
        step = _cut(step.select("s", "node", "d", "paths"))
        if not step.take(1):
            break
        levels.append(step)
        seen = _cut(seen.unionByName(step.select("s", "node")))
    above = levels[-1].select("s", "node", "paths", F.lit(0.0).alias("dep"))
    total = None
    for lower in reversed(levels[:-1]):
        shares = above.select("s", F.col("node").alias("dst"), ((F.lit(1.0) + F.col("dep")) / F.col("paths")).alias("share")).join(edges, "dst").select("s", F.col("src").alias("node"), "share")
        dep = lower.join(shares, ["s", "node"], "left").groupBy("s", "node", "paths").agg((F.col("paths") * F.coalesce(F.sum("share"), F.lit(0.0))).alias("dep"))
        above = _cut(dep.select("s", "node", "paths", "dep"))
        part = above.filter("s != node").select("node", "dep")
        total = part if total is None else total.unionByName(part)
    n = nodes.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0
    sums = total.groupBy("node").agg(F.sum("dep").alias("b")) if total is not None else nodes.select("node", F.lit(0.0).alias("b")).limit(0)
    return nodes.join(sums, "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) * F.lit(scale)).alias("betweenness"))


def prefixes(ids: DataFrame, column: str, separator: str = ".") -> DataFrame:
    """node, parent, depth, name: the tree of all dotted prefixes of the ids."""
    parts = F.split(F.col(column), f"[{separator}]")
    each = ids.select(parts.alias("_p")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("_p")), lambda n: F.slice("_p", F.lit(1), n))).alias("_q"))
    join = lambda a: F.array_join(a, separator)
    return each.select(
        join("_q").alias("node"), F.when(F.size("_q") > 1, join(F.slice("_q", F.lit(1), F.size("_q") - 1))).alias("parent"), F.size("_q").alias("depth"), F.element_at("_q", -1).alias("name")
    ).distinct()


def roll_up(tree: DataFrame, own: str, combine, deepest: int) -> DataFrame:
    """node, score: from the deepest level to the top, ``combine(own, max, avg)`` of each node's children."""
    done = tree.filter(F.col("depth") == deepest).select("node", "parent", combine(F.col(own), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("score"))
    out = done
    for depth in range(deepest - 1, 0, -1):
        below = done.groupBy(F.col("parent").alias("node")).agg(F.max("score").alias("_m"), F.avg("score").alias("_a"))
        done = tree.filter(F.col("depth") == depth).join(below, "node", "left").select("node", "parent", combine(F.col(own), F.col("_m"), F.col("_a")).alias("score"))
        out = out.unionByName(done)
    return out.select("node", "score")


def personal_pageranks(nodes: DataFrame, edges: DataFrame, rounds: int = 20, alpha: float = 0.85, weight: float = 2.0) -> DataFrame:
    """s, node, pr: for each node s the PageRank whose teleport goes to s with ``weight`` and to the others with 1.

    What a teleport spreads is linear in it, so one state keyed (s, node) carries all of them through the same rounds; it
    has nodes^2 rows, so callers rank no more nodes than that allows.
    """
    n = nodes.count()
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_out"))
    weighted = edges.join(out, "src").select(F.col("src").alias("node"), "dst", (F.lit(1.0) / F.col("_out")).alias("_w"))
    sinks = nodes.join(out.select(F.col("src").alias("node"), "_out"), "node", "left").select("node", F.col("_out").isNull().alias("_sink"))
    every = nodes.select(F.col("node").alias("s"), F.lit(1).alias("_k")).join(sinks.withColumn("_k", F.lit(1)), "_k").drop("_k")  # the result itself
    p = F.when(F.col("s") == F.col("node"), weight).otherwise(1.0) / F.lit(n - 1 + weight)
    state = _cut(every.select("s", "node", "_sink", p.alias("p"), F.lit(1.0 / max(n, 1)).alias("pr")))
    for k in range(rounds):
        lost = state.groupBy("s").agg(F.coalesce(F.sum(F.when(F.col("_sink"), F.col("pr"))), F.lit(0.0)).alias("_lost"))
        into = state.join(weighted, "node").groupBy("s", F.col("dst").alias("node")).agg(F.sum(F.col("pr") * F.col("_w")).alias("_in"))
        state = state.join(into, ["s", "node"], "left").join(lost, "s").select("s", "node", "_sink", "p", (F.lit(1 - alpha) * F.col("p") + F.lit(alpha) * (F.coalesce("_in", F.lit(0.0)) + F.col("_lost") * F.col("p"))).alias("pr"))
        if k % CUT_EVERY == CUT_EVERY - 1:
            state = _cut(state)
    return state.select("s", "node", "pr")


def push(seeds: DataFrame, edges: DataFrame, alpha: float = 0.85, bound: float = 1e-6) -> DataFrame:
    """s, node, mass, left: forward push of what each seed s puts on nodes (s, node, mass); s may be null.

    In each round what has come to a node becomes its mass, and ``alpha`` of it is passed on along its edges if it exceeds
    ``bound`` times the out-degree; else it is counted as ``left`` and goes no further.  So rows grow with the edges that carry
    more than the bound, whatever the graph's size, and what is missing from a seed's mass is at most the sum of its
    ``left`` * alpha / (1 - alpha).
    """
    edges = edges.select("src", "dst")
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_out"))
    weighted = _cut(edges.join(out, "src").select(F.col("src").alias("node"), "dst", "_out"))
    front = seeds.groupBy("s", "node").agg(F.sum("mass").alias("mass")).withColumn("_k", F.lit(0))
    parts = []
    while True:
        rounds, last = [front], front
        for k in range(1, CUT_EVERY + 1):
            passed = last.join(weighted, "node").filter(F.col("mass") > F.lit(bound) * F.col("_out"))
            last = passed.groupBy("s", F.col("dst").alias("node")).agg(F.sum(F.lit(alpha) * F.col("mass") / F.col("_out")).alias("mass")).withColumn("_k", F.lit(k))
            rounds.append(last)
        together = rounds[0]
        for r in rounds[1:]:
            together = together.unionByName(r)
        together = _cut(together)
        parts.append(together.filter(F.col("_k") < CUT_EVERY))
        front = together.filter(F.col("_k") == CUT_EVERY).withColumn("_k", F.lit(0))
        if front.isEmpty():
            break
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    stays = (F.col("_out") > 0) & (F.col("mass") <= F.lit(bound) * F.col("_out"))
    every = every.join(out.select(F.col("src").alias("node"), "_out"), "node", "left")
    return every.groupBy("s", "node").agg(F.sum("mass").alias("mass"), F.coalesce(F.sum(F.when(stays, F.col("mass"))), F.lit(0.0)).alias("left"))


def pushed_pageranks(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, alpha: float = 0.85, weight: float = 2.0, bound: float = 1e-6) -> DataFrame:
    """s, node, pr of the nodes near each seed s (all nodes by default): the PageRank whose teleport goes to s with ``weight``
    and to the others with 1, dangling nodes included.

    Up to scale it is a sum of one vector for all seeds, the series of the uniform teleport, and ``weight`` - 1 times the
    series of s alone, which is found by :func:`push`; nodes that the push from s does not reach differ by scale from the
    common vector and are left out.  So the state grows with the edges that are touched, not with nodes times seeds.
    """
    n = nodes.count()
    if not n:
        return nodes.select(F.col("node").alias("s"), "node", F.lit(0.0).alias("pr"))
    starts = (seeds if seeds is not None else nodes).select(F.col("node").alias("s"), "node", F.lit(weight - 1).alias("mass"))
    uniform = nodes.select(F.lit(None).cast(starts.schema["s"].dataType).alias("s"), "node", F.lit(1.0).alias("mass"))
    every = _cut(push(starts.unionByName(uniform), edges, alpha, bound))
    common, own = every.filter("s is null").select("node", F.col("mass").alias("_c")), every.filter("s is not null")
    whole = common.agg(F.sum("_c").alias("_whole"))
    sums = own.groupBy("s").agg(F.sum("mass").alias("_sum"))
    rows = own.join(common, "node").join(sums, "s").join(F.broadcast(whole))  # one row
    return rows.select("s", "node", ((F.col("_c") + F.col("mass")) / (F.col("_whole") + F.col("_sum"))).alias("pr"))


def pivots(nodes: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k nodes by the least digests of the seed and the node; all if there are no more."""
    return nodes.select("node").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("node").cast("string")).cast("binary")), "node").limit(k)


def sampled_betweenness(nodes: DataFrame, edges: DataFrame, k: int = 20, seed: int = 0) -> DataFrame:
    """node, betweenness from min(k, n) seeded pivots, scaled to all sources; the state has pivots x nodes rows at most.
    With k of n or more it is exact."""
    n = nodes.count()
    some = nodes if k >= n else _cut(pivots(nodes, k, seed))
    out = betweenness(nodes, edges, some)
    return out.select("node", (F.col("betweenness") * F.lit(n / max(1, min(k, n)))).alias("betweenness"))
