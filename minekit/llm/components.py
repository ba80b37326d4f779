"""Connected components by minimum labels with pointer jumping, as DataFrame operations on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every end of an edge; component is the least id reachable.

    Each round a vertex takes the least label among its own and its neighbours', then the label
    of that label, until nothing changes. Nulls and loops add nothing; no edges: no rows.
    """
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = step = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("l")).select(F.col("u").alias("id"), "l"), "cc-labels")
    while True:
        offered = both.join(labels, both.v == labels.id).groupBy(F.col("u").alias("id")).agg(F.min("l").alias("m"))
        lower = written(labels.join(offered, "id", "left").select("id", "l", F.least("l", F.coalesce("m", "l")).alias("n")), "cc-lower")
        target = lower.select(F.col("id").alias("n"), F.col("n").alias("t"))
        after = written(lower.join(target, "n", "left").select("id", F.col("l").alias("old"), F.least("n", F.coalesce("t", "n")).alias("l")), "cc-step")
        discard(lower, step)
        step, labels = after, after.select("id", "l")
        if not step.where("old <> l").limit(1).count():
            discard(both)
            return labels.select("id", F.col("l").alias("component"))
