"""Mixing sources to target weights by hash-threshold histograms (DataFrame operations only).

A source's target is met by whole passes over the source and one partial pass. The partial
pass keeps the documents whose hash lies under a threshold. The threshold is found from sums
of sizes by (source, hash bucket): the bucket in which the running sum crosses the budget is
the boundary bucket, and only its rows are summed again, by the next digits of the hash.
Nothing is sorted, and no row but those of boundary buckets is read twice after the first sum.

Larger budgets have larger thresholds on the same hashes, so the selections nest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: Hash digits, base 4096: three levels of histograms.
DIGIT_BITS, LEVELS = 12, 3


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null has none."""
    flat = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(F.length(flat) == 0, F.lit(0)).otherwise(F.size(F.split(flat, " +"))).cast("long")


def row_hash(key: Column) -> Column:
    """36 bits of the md5 of the key as text (null: empty text), as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, DIGIT_BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in order of code points, null last, take the weights in turn and share
    share * the sum of all sizes in proportion; no target exceeds ceiling * its source's size,
    and what is cut off goes to the others by weight until none is above. That is the water level
    L with sum(min(ceiling * size, L * weight)) = share * total: sources by rising
    ceiling * size / weight, the first whose own limit is not below the level given by those
    after it sets L. The table has one row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    turn = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    df = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(ceiling)))
    by_ratio = everything.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("before", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    df = df.withColumn("after", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("before")) / F.col("after")
    df = df.withColumn("level", F.when(level <= F.col("limit") / F.col("weight"), level)).withColumn("place", F.row_number().over(by_ratio))
    df = df.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.col("place"))).over(everything))
    return df.select("source", "source_size", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight"))).alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    ceiling: float = 2.0,
) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, repeats, taken.

    size is the text's number of words (null: 0), repeats how often the mix holds the document
    (0 to ceil(ceiling)), taken = size * repeats. Rows with equal ids share a hash and are kept
    or left together; a null source is a source of its own; empty texts take the decision of
    their hash like others, at no cost. An empty table gives an empty result. Columns of docs
    other than the three named are not read.
    """
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), row_hash(F.col(id_col)).alias("hash")), "mix-sizes")
    decided = _decided(rows, _plan(rows, weights, share, ceiling))
    return decided.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """The mix itself: every row of docs as often as mix_sources says, with the columns of docs. Texts are not shuffled."""
    rows = written(docs.select(F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), row_hash(F.col(id_col)).alias("hash")), "mix-sizes")
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).cast("string").alias("source"), row_hash(F.col(id_col)).alias("hash"))
    out = _decided(own, _plan(rows, weights, share, ceiling)).where("repeats > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select("row.*")


def _plan(rows: DataFrame, weights: tuple[float, ...], share: float, ceiling: float) -> DataFrame:
    """(source, source_size, target, passes, prefix) of each source, from rows (source, size, hash)."""
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = written(
        targets(per_source, weights, share, ceiling)
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size")),
        "mix-targets",
    )
    threshold = goal.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        threshold = written(_refine(rows, threshold, level), f"mix-level{level}")
    both = goal.alias("g").join(threshold.alias("t"), F.col("g.source").eqNullSafe(F.col("t.source")))
    return written(both.select("g.source", "g.source_size", "g.target", "g.passes", "t.prefix"), "mix-plan")


def _decided(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with source_size, target and repeats of their source and hash."""
    repeats = (F.col("p.passes") + F.when(F.col("r.hash") < F.col("p.prefix"), 1).otherwise(0)).cast("long").alias("repeats")
    joined = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    return joined.select("r.*", "p.source_size", "p.target", repeats)


def _refine(rows: DataFrame, threshold: DataFrame, level: int) -> DataFrame:
    """The next digit of each source's threshold: rows of its boundary bucket only are summed.

    threshold: (source, left, prefix), prefix the digits so far and left the budget that the
    buckets below it leave. After the last level prefix is the exclusive bound of the hash,
    the boundary's own bucket being kept if that comes nearer to the budget.
    """
    below = DIGIT_BITS * (LEVELS - level)
    digit = F.shiftright(F.col("r.hash"), below - DIGIT_BITS).bitwiseAND(2**DIGIT_BITS - 1)
    inside = F.col("r.source").eqNullSafe(F.col("t.source"))
    if level:
        inside = inside & (F.shiftright(F.col("r.hash"), below) == F.col("t.prefix"))
    bars = rows.alias("r").join(threshold.alias("t"), inside).groupBy(F.col("t.source").alias("source"), F.col("t.left").alias("left"), F.col("t.prefix").alias("prefix"), digit.alias("digit")).agg(F.sum("r.size").alias("bar"))
    upto = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    bars = bars.withColumn("sum", F.sum("bar").over(upto))
    # the first bucket whose running sum exceeds the budget; none: everything fits
    edge = bars.groupBy("source", "left", "prefix").agg(
        F.min_by(F.struct("digit", "bar", "sum"), F.when(F.col("sum") > F.col("left"), F.col("digit"))).alias("edge"),
    )
    edge = edge.withColumn("digit", F.coalesce(F.col("edge.digit"), F.lit(2**DIGIT_BITS)))
    rest = F.coalesce(F.col("left") - (F.col("edge.sum") - F.col("edge.bar")), F.col("left"))
    prefix = F.col("prefix") * 2**DIGIT_BITS + F.col("digit")
    if level == LEVELS - 1:
        prefix = prefix + F.when(F.col("edge").isNotNull() & (F.col("edge.bar") - rest < rest), 1).otherwise(0)
    found = edge.select("source", rest.cast("double").alias("left"), prefix.alias("prefix"))
    # a source all of whose rows lie under the threshold has no boundary bucket to refine
    kept = threshold.alias("t").join(found.alias("f"), F.col("t.source").eqNullSafe(F.col("f.source")), "left")
    return kept.select(F.col("t.source").alias("source"), F.coalesce(F.col("f.left"), F.col("t.left")).alias("left"), F.coalesce(F.col("f.prefix"), F.col("t.prefix") * 2**DIGIT_BITS).alias("prefix"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
                  ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9))::BIGINT AS hash FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS lim, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
c AS (SELECT *, coalesce(sum(lim) OVER b, 0) AS before, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS after, 1.5::DOUBLE * sum(source_size) OVER () AS total, row_number() OVER (ORDER BY lim / weight, source NULLS LAST) AS place
      FROM w WINDOW b AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((total - before) / after, place) AS level FROM c WHERE (total - before) / after <= lim / weight),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN lim ELSE least(lim, level * weight) END AS target FROM c, l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
r AS (SELECT d.doc_id, d.source, d.size, d.hash, g.source_size, g.target, g.passes, g.target - g.passes * g.source_size AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.hash) AS own
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT source, min(hash) AS edge FROM r WHERE upto > budget GROUP BY source)
SELECT r.doc_id, r.size, r.source_size, r.target,
       CAST(r.size * (r.passes + CASE WHEN e.edge IS NULL OR r.hash < e.edge OR (r.hash = e.edge AND r.own - (r.budget - (r.upto - r.own)) < r.budget - (r.upto - r.own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r LEFT JOIN e ON r.source IS NOT DISTINCT FROM e.source
"""
