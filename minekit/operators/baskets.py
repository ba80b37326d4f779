"""Frequent itemsets level by level, and rules of any size of consequent."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.text import settled


def singletons(baskets: DataFrame, support: int) -> DataFrame:
    """(items, support) of single items in more than `support` baskets. baskets: distinct (basket, item)."""
    return baskets.groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") > support).select(F.array("item").alias("items"), "support")


def candidates(level: DataFrame, k: int) -> DataFrame:
    """(items): unions of two frequent (k-1)-sets that share their first k-2 items, in order; the others are unions of those too."""
    if k == 2:  # nothing in common to meet by: blocks of one side meet all of the other
        blocks = int(level.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        a = level.select(F.col("items").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("p"))
        b = level.select(F.col("items").alias("b"), F.pmod(F.xxhash64("items"), F.lit(blocks)).cast("int").alias("p"))
        return a.join(b, "p").where(F.col("a")[0] < F.col("b")[0]).select(F.concat("a", "b").alias("items"))
    a = level.select(F.col("items").alias("a"), F.slice("items", 1, k - 2).alias("p"))
    b = a.select(F.col("a").alias("b"), "p")
    return a.join(b, "p").where(F.element_at("a", -1) < F.element_at("b", -1)).select(F.concat("a", F.slice("b", k - 1, 1)).alias("items"))


def counted(baskets: DataFrame, cands: DataFrame, k: int, support: int) -> DataFrame:
    """Candidates in more than `support` baskets: baskets are grown item by item along the candidates' own items.

    Only pieces that begin some candidate survive a step, so a basket never shows all its subsets.
    """
    grown = baskets.join(cands.select(F.col("items")[0].alias("item")).distinct(), "item", "left_semi").select("basket", F.array("item").alias("s"))
    for i in range(2, k + 1):
        heads = cands.select(F.slice("items", 1, i).alias("s2"), F.slice("items", 1, i - 1).alias("s"), F.col("items")[i - 1].alias("item")).distinct()
        grown = grown.join(heads, "s").join(baskets, ["basket", "item"], "left_semi").select("basket", F.col("s2").alias("s"))
    return grown.groupBy(F.col("s").alias("items")).agg(F.count("*").alias("support")).where(F.col("support") > support)


def apriori(baskets: DataFrame, support: int, longest: int | None = None) -> DataFrame:
    """(items, k, support) of all frequent itemsets; support is strict, items are sorted. Goes on until no candidates are left, or to sets of longest items.

    Baskets alike are one row with a number. A level's rows hold a frequent set s and the basket's later items that
    may follow it: those y with s[:-1] + y frequent, so that what is counted are the candidates. Each level is written, and the plan does not grow with them.
    """
    level = settled(singletons(baskets, support), "itemsets")
    out = level.withColumn("k", F.lit(1).cast("long"))
    own = baskets.join(level.select(F.col("items")[0].alias("item")), "item", "left_semi").groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("rest"))
    state = own.groupBy("rest").agg(F.count("*").alias("n")).select(F.slice("rest", 1, 0).alias("s"), "rest", "n")
    for k in count(2):
        if longest and k > longest:
            break
        steps = state.where(F.size("rest") > 1).select("s", "rest", "n", F.explode(F.sequence(F.lit(1), F.size("rest") - 1)).alias("i"))
        grown = steps.select(F.concat("s", F.slice("rest", F.col("i"), 1)).alias("s"), F.slice("rest", F.col("i") + 1, F.size("rest")).alias("rest"), "n")
        state = settled(grown.groupBy("s", "rest").agg(F.sum("n").alias("n")), "grown")
        sets = state.select("s", F.explode("rest").alias("x"), "n").groupBy("s", "x").agg(F.sum("n").alias("support")).where(F.col("support") > support)
        level = settled(sets.select(F.concat("s", F.array("x")).alias("items"), "support"), "itemsets")
        if level.isEmpty():
            break
        out = out.unionByName(level.withColumn("k", F.lit(k).cast("long")))
        after = level.groupBy(F.slice("items", 1, k - 1).alias("s")).agg(F.collect_list(F.element_at("items", -1)).alias("after"))
        state = state.join(after, "s").select("s", F.array_intersect("rest", "after").alias("rest"), "n")
    return out


def rules(itemsets: DataFrame, confidence: float) -> DataFrame:
    """(antecedent, consequent, confidence) with confidence at least the given one, from every proper non-empty subset."""
    whole = itemsets.where(F.size("items") > 1).select("items", "support")
    n = F.size("items")
    masks = F.sequence(F.lit(1), (F.lit(1) * F.pow(F.lit(2), n)).cast("int") - 2)
    one = whole.withColumn("mask", F.explode(masks))
    picked = F.filter("items", lambda x, i: F.expr("1 = 1") & (F.floor(F.col("mask") / F.pow(F.lit(2.0), i)) % 2 == 1))
    sub = one.withColumn("antecedent", picked).withColumn("consequent", F.array_except("items", "antecedent"))
    base = itemsets.select(F.col("items").alias("antecedent"), F.col("support").alias("base"))
    return sub.join(base, "antecedent").select("antecedent", "consequent", (F.col("support") / F.col("base")).alias("confidence")).where(F.col("confidence") >= confidence)
