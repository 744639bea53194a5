"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame operations only).

Documents of a source are dealt into blocks by a keyed digest, and its blocks are permuted.  A source's quota is a number
of blocks: as many whole passes over its permuted blocks as its target holds, then the blocks of one more pass up to the
one in which the target ends.  A binary tree splits these quotas over the output shards: a node with b blocks for s shards
sends a uniformly random set of floor(b * s_left / s) of them to its left child, so the numbers of each source on either
side are a multivariate hypergeometric draw.  The leaves say how many blocks of each source a shard gets; shard after
shard then draws that many from the source's permuted blocks, where the last one stopped, so draws are disjoint and a
document is taken as often as shards drew its block.  Inside a shard documents are ordered by a digest of their own.

Of the block in which a target ends only some documents are taken.  It is cut into cells by the same digest; cells before
the end are whole, and only the documents of one cell of a source are ordered.  A row for each block (512 a source) and
each draw (at most 1,025 a source) is planned; no source's documents meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, only

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
CEILING = 2.0
#: Blocks of a source, cells of the block in which its target ends.
BLOCKS, CELLS = 512, 512
SHARDS = 8
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(*parts: Column) -> Column:
    """A number in [0, 2^52) that depends on the seed and the parts alone."""
    digest = F.md5(F.concat_ws(":", F.lit(str(SEED)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> weight and target words.

    With targets min(ceiling * size, level * weight), resharing the excess by weight ends where the targets sum to the
    total.  The sources that stop are a prefix in ascending order of ceiling * size / weight, so the level follows
    from running sums over the sources: no loop is needed.  A row per source is small beside the documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    by_stop = Window.orderBy("stop", F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_i", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("_i") % len(WEIGHTS) + 1).cast("int"))
    )
    ranked = ranked.withColumn("stop", F.lit(CEILING) * F.col("source_size") / F.col("weight"))
    ranked = (
        ranked.withColumn("_total", F.lit(TOTAL_SHARE) * F.sum("source_size").over(every))
        .withColumn("_full", F.coalesce(F.sum(F.lit(CEILING) * F.col("source_size")).over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("weight").over(by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_rest"))
    )
    # it rises while sources stop below it and falls afterwards
    level = F.max("_level").over(every)
    return ranked.select(
        "source", "source_size", "weight", F.least(F.lit(CEILING) * F.col("source_size"), F.col("weight") * level).alias("target")
    )


def split_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """(_source_key, _quota) -> (_source_key, shard, _n): each source's blocks split over the shards by the tree; shards
    that get no block of a source have no row for it."""
    out = quotas.filter("_quota > 0").select("_source_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_quota") - 1)).alias("_d"))
    out = out.withColumn("_lo", F.lit(0)).withColumn("_s", F.lit(shards))
    width, depth = shards, 0
    while width > 1:
        node = Window.partitionBy("_lo", "_s")
        rank = F.row_number().over(node.orderBy(_draw(F.lit(f"split{depth}"), F.col("_source_key"), F.col("_d")), "_source_key", "_d"))
        out = out.withColumn("_r", rank).withColumn("_b", F.count(F.lit(1)).over(node)).withColumn("_half", F.floor(F.col("_s") / 2).cast("int"))
        left = (F.col("_s") > 1) & (F.col("_r") <= F.floor(F.col("_b") * F.col("_half") / F.col("_s")))
        lo = F.when((F.col("_s") > 1) & ~left, F.col("_lo") + F.col("_half")).otherwise(F.col("_lo"))
        size = F.when(F.col("_s") <= 1, F.col("_s")).when(left, F.col("_half")).otherwise(F.col("_s") - F.col("_half"))
        out = out.select("_source_key", "_d", lo.alias("_lo"), size.alias("_s"))
        width, depth = (width + 1) // 2, depth + 1
    return out.groupBy("_source_key", F.col("_lo").alias("shard")).agg(F.count(F.lit(1)).alias("_n"))


def _drawn(blocks: DataFrame, shards: int) -> DataFrame:
    """Blocks (_source_key, _position, _copies, _left, _words) -> (_source_key, _position, _draws): the draws of each block
    that is drawn, as (pass, shard) in order of passes, at most three."""
    quotas = blocks.groupBy("_source_key").agg(
        F.count(F.lit(1)).alias("_present"), (F.max("_copies") * F.count(F.lit(1)) + F.count(F.when(F.col("_left") > 0, 1))).cast("long").alias("_quota")
    )
    earlier = Window.partitionBy("_source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spans = split_quotas(quotas, shards).withColumn("_from", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long")))
    draws = spans.select("_source_key", "shard", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("_n") - 1)).alias("_d")).join(quotas, "_source_key")
    draws = draws.select("_source_key", (F.col("_d") % F.col("_present")).alias("_position"), F.floor(F.col("_d") / F.col("_present")).cast("int").alias("pass"), "shard")
    return draws.groupBy("_source_key", "_position").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("_draws"))


def mix(docs: DataFrame, shards: int = SHARDS, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, shards, times, place (and text, lang, source, n_chars
    and the list of shards with ``keep_text``).

    A document is taken 0, 1 or 2 times, so ``taken`` is a multiple of its size; ``shards`` names the shards that drew it,
    comma-joined, in order of passes.  Null and empty texts have size 0 and are never taken; a text of any length is one
    document, taken whole or not; a null source is a source of its own, last in order; a source without words has target
    0.  Repeated rows and equal ids are documents of their own, dealt to one block; rows without an id are dealt by their
    texts.  An empty table gives an empty mix.  Other columns play no part, whatever their names.
    """
    names = ["doc_id", "text", "source"] + (["lang", "n_chars"] if keep_text else [])
    rows = only(docs, names)
    who = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    rows = rows.withColumn("size", word_count(F.col("text"))).withColumn("_source_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    rows = rows.withColumn("_draw", _draw(F.lit("doc"), F.col("_source_key"), who)).withColumn("_block", (F.col("_draw") % BLOCKS).cast("int"))
    rows = rows.withColumn("_cell", (F.floor(F.col("_draw") / BLOCKS) % CELLS).cast("int"))
    # without texts, so that they are read once, and once more where they are asked for
    sizes = durable(rows.select("doc_id", "source", "size", "_source_key", "_draw", "_block", "_cell"), "mix-sizes")
    sums = sizes.groupBy("_source_key", "source", "_block").agg(F.sum("size").alias("_words"))
    per_source = sums.groupBy("_source_key", "source").agg(F.sum("_words").cast("long").alias("source_size"))
    targets = source_targets(per_source).withColumn("_source_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    # words beyond the whole copies of the source
    targets = targets.withColumn("_copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    targets = targets.withColumn("_rest", F.col("target") - F.col("_copies") * F.col("source_size"))
    permuted = Window.partitionBy("_source_key").orderBy(_draw(F.lit("block"), F.col("_source_key"), F.col("_block")), "_block")
    before = F.coalesce(F.sum("_words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sums.drop("source").join(targets, "_source_key").withColumn("_position", F.row_number().over(permuted) - 1).withColumn("_left", F.col("_rest") - before)
    blocks = blocks.join(_drawn(blocks, shards), ["_source_key", "_position"], "left")
    partial = (F.col("_left") > 0) & (F.col("_left") < F.col("_words"))
    none = F.array().cast("array<int>")
    ending = lambda x: F.col("_partial") & (x["pass"] == F.col("_copies"))
    shards_of = lambda keep: F.coalesce(F.transform(F.filter("_draws", keep), lambda x: x["shard"]), none)
    # a table, so that its size is known when Spark decides whether to send it to all tasks
    plan = durable(
        blocks.withColumn("_partial", partial).select(
            "_source_key", "_block", "source_size", "target", "_left", "_partial",
            shards_of(lambda x: ~ending(x)).alias("_whole"), shards_of(ending).alias("_ending"),
        ),
        "mix-plan",
    )
    cells = sizes.join(plan.filter("_partial").select("_source_key", "_block"), ["_source_key", "_block"]).groupBy("_source_key", "_block", "_cell").agg(F.sum("size").alias("_cell_words"))
    by_cell = Window.partitionBy("_source_key", "_block").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = durable(cells.withColumn("_before", F.coalesce(F.sum("_cell_words").over(by_cell), F.lit(0).cast("long"))), "mix-cells")
    base = rows.drop("_cell_words", "_before") if keep_text else sizes
    joined = base.join(plan, ["_source_key", "_block"]).join(cells, ["_source_key", "_block", "_cell"], "left")
    edge = F.coalesce(F.col("_partial") & (F.col("_before") < F.col("_left")) & (F.col("_before") + F.col("_cell_words") > F.col("_left")), F.lit(False))
    outside = joined.filter(~edge).withColumn("_more", F.coalesce(F.col("_before") + F.col("_cell_words") <= F.col("_left"), F.lit(False)))
    inside = Window.partitionBy("_source_key", "_block", "_cell").orderBy("_draw", F.col("doc_id").asc_nulls_last(), "size")
    cum = F.col("_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a document is taken if that brings the sum nearer to the target than leaving it out
    ended = joined.filter(edge).withColumn("_cum", cum).withColumn("_more", F.col("_cum") - F.col("size") / F.lit(2.0) <= F.col("_left")).drop("_cum")
    out = outside.unionByName(ended)
    out = out.withColumn("_to", F.when(F.col("size") == 0, none).when(F.col("_more"), F.concat("_whole", "_ending")).otherwise(F.col("_whole"))).withColumn("times", F.size("_to"))
    taken = (F.col("size") * F.col("times")).cast("long").alias("taken")
    keep = ["doc_id", "size", "source_size", "target", taken, F.concat_ws(",", F.col("_to").cast("array<string>")).alias("shards"), "times", F.col("_draw").alias("place")]
    return out.select(*keep, *(["_to", "text", "lang", "source", "n_chars"] if keep_text else []))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: documents columns, each document once for each draw, in the shard that drew it and shuffled inside
    it.  Odd rows are treated as :func:`mix` says."""
    out = mix(docs, keep_text=True).select("*", F.explode("_to").alias("shard"))
    salt = F.pmod(F.col("place"), F.lit(64))
    return out.repartition(F.col("shard"), salt).sortWithinPartitions("shard", "place").select("doc_id", "text", "lang", "source", "n_chars")


def _tree_sql(shards: int) -> str:
    """The splitting tree as one query per depth, from ``items`` to ``tree``."""
    steps, width, depth, prior = [], shards, 0, f"(SELECT k, d, 0 AS lo, {shards} AS n FROM items)"
    while width > 1:
        draw = f"('0x' || substr(md5('{SEED}:split{depth}:' || k || ':' || d), 1, 13))::BIGINT"
        steps.append(
            f"ranked{depth} AS (SELECT k, d, lo, n, n > 1 AND row_number() OVER (PARTITION BY lo, n ORDER BY {draw}, k, d) <= floor((count(*) OVER (PARTITION BY lo, n)) * (n // 2) / n) AS is_left FROM {prior}),\n"
            f"tree{depth} AS (SELECT k, d, CASE WHEN n > 1 AND NOT is_left THEN lo + n // 2 ELSE lo END AS lo, CASE WHEN n <= 1 THEN n WHEN is_left THEN n // 2 ELSE n - n // 2 END AS n FROM ranked{depth}),"
        )
        prior, width, depth = f"tree{depth}", (width + 1) // 2, depth + 1
    return "\n".join(steps) + f"\ntree AS (SELECT k, d, lo AS shard FROM {prior}),"


#: DuckDB text of the op10 query.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         coalesce('s' || source, 'n') AS k, coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, ''))) AS who FROM documents),
e AS (SELECT *, ('0x' || substr(md5('{SEED}:doc:' || k || ':' || who), 1, 13))::BIGINT AS draw FROM d),
f AS (SELECT *, (draw % {BLOCKS})::INT AS block, ((draw // {BLOCKS}) % {CELLS})::INT AS cell FROM e),
sums AS (SELECT k, source, block, sum(size)::BIGINT AS words FROM f GROUP BY ALL),
per AS (SELECT k, source, sum(words)::BIGINT AS source_size FROM sums GROUP BY ALL),
ranked AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight FROM per),
stops AS (SELECT *, {CEILING}::DOUBLE * source_size / weight AS stop, {TOTAL_SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM ranked),
levels AS (SELECT *, (total - coalesce(sum({CEILING}::DOUBLE * source_size) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl FROM stops),
targets AS (SELECT k, source_size, least({CEILING}::DOUBLE * source_size, weight * (max(lvl) OVER ())) AS target FROM levels),
quotas AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::INT AS copies FROM targets),
plan AS (SELECT s.k, s.block, q.source_size, q.target, q.copies, s.words, row_number() OVER w - 1 AS position,
  q.target - q.copies * q.source_size - coalesce(sum(s.words) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS leftover
  FROM sums s JOIN quotas q USING (k)
  WINDOW w AS (PARTITION BY s.k ORDER BY ('0x' || substr(md5('{SEED}:block:' || s.k || ':' || s.block), 1, 13))::BIGINT, s.block)),
wanted AS (SELECT k, count(*) AS present, max(copies) * count(*) + count(*) FILTER (WHERE leftover > 0) AS quota FROM plan GROUP BY k),
items AS (SELECT k, unnest(range(quota::BIGINT)) AS d FROM wanted),
{_tree_sql(SHARDS)}
dealt AS (SELECT k, shard, row_number() OVER (PARTITION BY k ORDER BY shard) - 1 AS d FROM tree),
draws AS (SELECT dealt.k, d % present AS position, d // present AS pass, shard FROM dealt JOIN wanted USING (k)),
marked AS (SELECT *, leftover > 0 AND leftover < words AS part FROM plan),
placed AS (SELECT p.k, p.block, p.source_size, p.target, p.copies, p.words, p.leftover, p.part,
  string_agg(shard::VARCHAR, ',' ORDER BY pass) FILTER (WHERE shard IS NOT NULL AND NOT (part AND pass = copies)) AS whole,
  max(shard) FILTER (WHERE part AND pass = copies) AS ending
  FROM marked p LEFT JOIN draws t ON t.k = p.k AND t.position = p.position GROUP BY ALL),
joined AS (SELECT f.doc_id, f.size, p.*, sum(f.size) OVER (PARTITION BY f.k, f.block ORDER BY f.cell, f.draw, f.doc_id NULLS LAST, f.size ROWS UNBOUNDED PRECEDING) AS cum
  FROM f JOIN placed p ON f.k = p.k AND f.block = p.block)
SELECT doc_id, size, source_size, target,
  (size * (copies + CASE WHEN size > 0 AND (leftover >= words OR (leftover > 0 AND cum - size / 2.0 <= leftover)) THEN 1 ELSE 0 END))::BIGINT AS taken,
  CASE WHEN size = 0 THEN '' WHEN part AND cum - size / 2.0 <= leftover THEN concat_ws(',', whole, ending) ELSE coalesce(whole, '') END AS shards
FROM joined
"""
