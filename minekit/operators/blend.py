"""Blending of model scores keyed by id.

Global ranks are made without one task that sorts all rows: rows are range-partitioned, numbered
inside their ranges, and shifted by the sizes of the ranges below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.text import settled
from .evaluation import auc


def average(*columns: str) -> Column:
    return reduce(lambda a, b: a + b, map(F.col, columns)) / F.lit(float(len(columns)))


def weighted(weights: dict[str, float]) -> Column:
    """Negative weights count as 0; the rest is normalised."""
    own = {c: max(0.0, w) for c, w in weights.items()}
    total = sum(own.values())
    return reduce(lambda a, b: a + b, [F.col(c) * F.lit(w / total) for c, w in own.items()])


def stable_rank(df: DataFrame, column: str, out: str, id_col: str = "id", parts: int = 32) -> DataFrame:
    """df with the 0-based rank of column, ties by id."""
    cuts = df.select(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda x: x <= F.col(column))) if cuts else F.lit(0)
    df = df.withColumn("_b", bucket)
    sizes = df.groupBy("_b").agg(F.count("*").alias("_n"))  # at most parts rows
    below = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(column, id_col)) - 1
    return df.withColumn("_r", inside).join(F.broadcast(below), "_b").withColumn(out, (F.col("_r") + F.col("_o")).cast("long")).drop("_b", "_r", "_o")


def rank_blend(df: DataFrame, anchor: str, support: str, weight: int, of: int = 100, id_col: str = "id") -> DataFrame:
    """df with blended: the row whose blended rank is k-th gets the k-th smallest anchor value.

    The weight is the fraction weight / of, so that blended ranks are whole numbers and ties are exact.
    """
    # each ranking reads its rows twice: they are written, not computed again
    df = settled(stable_rank(settled(df, "scores"), anchor, "_ra", id_col), "ranked")
    df = settled(stable_rank(df, support, "_rs", id_col), "ranked")
    df = df.withColumn("_m", (of - weight) * F.col("_ra") + weight * F.col("_rs"))
    df = settled(stable_rank(df, "_m", "_k", id_col), "ranked")
    values = df.select(F.col("_ra").alias("_k"), F.col(anchor).alias("blended"))
    return df.join(values, "_k").drop("_k", "_ra", "_rs", "_m")


def consensus(df: DataFrame, columns: list[str], target: str, floor: float) -> DataFrame:
    """df with consensus: columns weighted by how far their AUC exceeds floor."""
    weights = [auc(df, c, target).select(F.greatest(F.round("auc", 6) - F.lit(floor), F.lit(0.0)).alias(f"_w{i}")) for i, c in enumerate(columns)]
    one = reduce(lambda a, b: a.crossJoin(b), weights)  # one row
    total = reduce(lambda a, b: a + b, [F.col(f"_w{i}") for i in range(len(columns))])
    mixed = reduce(lambda a, b: a + b, [F.col(f"_w{i}") * F.col(c) for i, c in enumerate(columns)]) / total
    return df.crossJoin(F.broadcast(one)).withColumn("consensus", mixed).drop(*[f"_w{i}" for i in range(len(columns))])


def most_apart(df: DataFrame, anchor: str, other: str, percent: float, variant: str = "all", id_col: str = "id") -> DataFrame:
    """(id, place): the rows, of those with the wanted direction, where the scores are furthest apart; percent of all rows, 1 at least."""
    k = max(1, int(df.count() * percent / 100.0))
    side = {"up": F.col(other) > F.col(anchor), "down": F.col(other) < F.col(anchor), "all": F.lit(True)}[variant]
    rows = df.where(side).select(id_col, (-F.round(F.abs(F.col(other) - F.col(anchor)), 9)).alias("_d"))
    return stable_rank(rows, "_d", "_p", id_col).where(F.col("_p") < k).select(id_col, (F.col("_p") + 1).alias("place"))


def selective(df: DataFrame, anchor: str, other: str, percent: float, w: float, variant: str = "all", id_col: str = "id") -> DataFrame:
    """df with corrected: the anchor, moved towards other by w on the most different rows only."""
    marked = df.join(most_apart(df, anchor, other, percent, variant, id_col), id_col, "left")
    moved = F.lit(1.0 - w) * F.col(anchor) + F.lit(w) * F.col(other)
    return marked.withColumn("corrected", F.when(F.col("place").isNotNull(), moved).otherwise(F.col(anchor))).drop("place")
