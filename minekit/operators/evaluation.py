"""Exact metrics, drift and error analysis as DataFrame operations.

Ranks are taken over distinct scores: scores are counted first, and the counts are cumulated
inside narrow ranges of the score, whose own sums are cumulated apart. So no task sorts all
rows or all scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of a score per unit.
RANGES = 4096


def below(counts: DataFrame, by: list[str], score: str, sums: dict[str, str]) -> DataFrame:
    """counts with, for each column of sums, its total over the rows of the group with a lower score, under the name given."""
    ranged = counts.withColumn("_range", F.floor(F.col(score) * RANGES))
    per_range = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t{c}") for c in sums])
    lower = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_k{i}" for i in range(len(by))]
    offsets = per_range.select(*[F.col(c).alias(k) for c, k in zip(by, names, strict=True)], F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_t{c}").over(lower), F.lit(0)).alias(f"_o{c}") for c in sums])
    on = F.col("_range") == F.col("_r")
    for c, k in zip(by, names, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(k))
    inside = Window.partitionBy(*by, "_range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(offsets, on)
    return joined.select(*counts.columns, *[(F.col(f"_o{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for c, n in sums.items()])


def auc(df: DataFrame, score: str = "p", target: str = "y", by: list[str] | None = None) -> DataFrame:
    """(by..., n, auc): rank-sum with average ranks; null where a group has one class only. Null scores and targets are left out."""
    by = by or []
    counts = df.where(F.col(score).isNotNull() & F.col(target).isNotNull()).groupBy(*by, score).agg(F.sum(target).alias("_p"), F.count("*").alias("_n"))
    ranked = below(counts, by, score, {"_n": "_below"})
    # average rank of a tie of _n scores behind _below others
    sums = ranked.groupBy(*by).agg(F.sum(F.col("_p") * (F.col("_below") + (F.col("_n") + 1) / F.lit(2.0))).alias("_r"), F.sum("_p").alias("_p"), F.sum("_n").alias("n"))
    other = F.col("n") - F.col("_p")
    value = F.when((F.col("_p") > 0) & (other > 0), (F.col("_r") - F.col("_p") * (F.col("_p") + 1) / F.lit(2.0)) / (F.col("_p") * F.lit(1.0) * other))
    return sums.select(*by, "n", value.alias("auc"))


def ks_two_sample(df: DataFrame, value: str, sample: str) -> DataFrame:
    """(statistic): the greatest distance between the distribution functions of the rows with sample 0 and 1."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.sum(F.when(F.col(sample) == 0, 1).otherwise(0)).alias("_a"), F.sum(F.when(F.col(sample) == 1, 1).otherwise(0)).alias("_b"))
    whole = counts.agg(F.sum("_a").alias("_wa"), F.sum("_b").alias("_wb"))
    upto = below(counts, [], value, {"_a": "_la", "_b": "_lb"}).crossJoin(F.broadcast(whole))
    gap = F.abs((F.col("_la") + F.col("_a")) / F.col("_wa") - (F.col("_lb") + F.col("_b")) / F.col("_wb"))
    return upto.agg(F.max(gap).alias("statistic"))


def calibration(df: DataFrame, score: str = "p", target: str = "y", bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("long")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_pred"), F.avg(target).alias("frac_pos"))


def confusion(df: DataFrame, true: str, pred: str, errors_only: bool = True) -> DataFrame:
    rows = df.where(F.col(true) != F.col(pred)) if errors_only else df
    n = rows.groupBy(true, pred).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def accuracy(df: DataFrame, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg((F.col(true) == F.col(pred)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def equal_width_bin(c: Column, low: Column, high: Column, n: int) -> Column:
    return F.least(F.greatest(F.floor((c - low) / (high - low) * n), F.lit(0)), F.lit(n - 1)).cast("long")


def binned(df: DataFrame, value: str, n: int) -> DataFrame:
    """df with bin 0..n-1 of equal width between the extremes (one row joined on)."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    out = df.crossJoin(F.broadcast(ends)).withColumn("bin", equal_width_bin(F.col(value), F.col("_lo"), F.col("_hi"), n))
    return out.drop("_lo", "_hi")


def quantile_cut(df: DataFrame, value: str, q: int = 10) -> DataFrame:
    """df with bucket 0.. of right-closed quantile ranges, doubled edges merged; the first holds the minimum."""
    edges = df.agg(F.array_sort(F.array_distinct(F.percentile(value, F.array(*[F.lit(i / q) for i in range(q + 1)])))).alias("_e"))
    out = df.crossJoin(F.broadcast(edges))
    bucket = F.greatest(F.size(F.filter("_e", lambda e: e < F.col(value))) - 1, F.lit(0))
    return out.withColumn("bucket", bucket.cast("long")).drop("_e")


def map_at_k(df: DataFrame, rank: str, k: int = 3) -> Column:
    """Mean of 1 / rank of the true label where it is among the first k."""
    return F.avg(F.when(F.col(rank) <= k, F.lit(1.0) / F.col(rank)).otherwise(0.0))
