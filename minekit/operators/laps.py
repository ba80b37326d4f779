"""Lap features: windows over ordered events of a driver, smoothed rates and medians joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clip_low, indicator, log_base, map_default, ratio

GROUP = ["driver", "race", "year"]
ALPHA = 20.0
# Wear classes of compounds (here: event types), anything else 1.
COMPOUND_ORDINAL = {"purchase": 3, "signup": 2, "click": 1, "error": 1, "view": 0}


def in_order(*keys: str) -> Window:
    return Window.partitionBy(*(keys or GROUP)).orderBy("ts", "id")


def laps(events: DataFrame) -> DataFrame:
    """Events in the role of laps: a user drives, a purchase is a pit stop, the target is a purchase at the next event."""
    w = in_order()
    df = events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("driver"), F.col("event_type").alias("compound"), "value", "ts",
        F.when(F.dayofmonth("ts") > 15, 2023).otherwise(2022).cast("long").alias("year"), (F.dayofmonth("ts") % 5).cast("long").alias("race"),
    )
    pit = F.when(F.col("compound") == "purchase", 1).otherwise(0)
    df = df.select(
        "*",
        F.row_number().over(w).cast("long").alias("lap"),
        F.count("*").over(Window.partitionBy(*GROUP)).alias("laps"),
        (F.coalesce(F.sum(pit).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).cast("long").alias("stint"),
        (F.col("value") - F.lag("value").over(w)).alias("delta"),
        F.when(F.lead("compound").over(w) == "purchase", 1).otherwise(0).cast("long").alias("target"),
    )
    s = Window.partitionBy(*GROUP, "stint").orderBy("lap")
    return df.select(
        "*",
        F.row_number().over(s).cast("long").alias("tyre_life"),
        F.sum("value").over(s.rowsBetween(Window.unboundedPreceding, 0)).alias("degradation"),
        (F.col("lap").cast("double") / F.col("laps")).alias("progress"),
    )


def rolling_mean(c: str, n: int, w: Window) -> Column:
    return F.avg(c).over(w.rowsBetween(-(n - 1), 0))


def build_features(df: DataFrame) -> DataFrame:
    """Row features, rolling means and lags in order of laps within (driver, race, year)."""
    w = in_order()
    df = df.withColumns({
        "is_2023": indicator(F.col("year") == 2023),
        "tyre_sq": F.col("tyre_life") * F.col("tyre_life"),
        "tyre_log": log_base(F.col("tyre_life") + 1, 2.718281828),
        "compound_ord": map_default(F.col("compound"), COMPOUND_ORDINAL, 1),
        "progress_x_stint": F.col("progress") * F.col("stint"),
        "degradation_rate": F.col("degradation") / (F.col("tyre_life") + 1),
        "est_laps_left": F.col("lap") * (F.lit(1.0) - F.col("progress")) / clip_low(F.col("progress"), 0.01),
    })
    df = df.withColumns({
        "tyre_x_compound": F.col("tyre_life") * F.col("compound_ord"),
        "delta_roll3": rolling_mean("delta", 3, w),
        "delta_roll7": rolling_mean("delta", 7, w),
        "value_roll5": rolling_mean("value", 5, w),
        **{f"delta_lag{k}": F.coalesce(F.lag("delta", k).over(w), F.lit(0.0)) for k in (1, 2, 3)},
    })
    df = df.withColumn("value_vs_roll5", F.col("value") - F.col("value_roll5"))
    return df.withColumn("pace_anomaly", ratio(F.col("value_vs_roll5"), F.col("value_roll5")))


def smoothed_rate(ref: DataFrame, keys: list[str], out: str, target: str = "target", alpha: float = ALPHA) -> DataFrame:
    """(sum of the target + alpha * global mean) / (rows + alpha) by keys; the global mean rides along as a one-row join."""
    overall = ref.agg(F.avg(target).alias("_global"))
    grouped = ref.groupBy(*keys).agg(F.sum(target).alias("_sum"), F.count("*").alias("_n"))
    return grouped.crossJoin(F.broadcast(overall)).select(*keys, ((F.col("_sum") + alpha * F.col("_global")) / (F.col("_n") + alpha)).alias(out))


def group_features(ref: DataFrame, df: DataFrame) -> DataFrame:
    """Smoothed rates and medians of ref (rows outside of 2023) joined onto df; missing groups get the global figures.

    The lookups have a row per group; whether one is small enough to broadcast is left to the
    optimizer, which knows its size at run time.
    """
    ref = ref.where(F.col("year") != 2023)
    pits = ref.where("target = 1")
    globals_ = ref.agg(F.avg("target").alias("g_rate")).crossJoin(pits.agg(F.median("tyre_life").alias("g_tyre")))
    out = df
    for keys, name in ((["driver"], "driver_rate"), (["driver", "compound"], "driver_compound_rate"), (["race", "compound"], "race_compound_rate")):
        out = out.join(smoothed_rate(ref, keys, name), keys, "left")
    for keys, name in ((["driver"], "driver_tyre"), (["race", "compound"], "race_compound_tyre"), (["compound"], "compound_tyre")):
        out = out.join(pits.groupBy(*keys).agg(F.median("tyre_life").alias(name)), keys, "left")
    out = out.crossJoin(F.broadcast(globals_))  # one row
    for c in ("driver_rate", "driver_compound_rate", "race_compound_rate"):
        out = out.withColumn(c, F.coalesce(c, "g_rate"))
    for c in ("driver_tyre", "race_compound_tyre", "compound_tyre"):
        out = out.withColumn(c, F.coalesce(c, "g_tyre"))
    return out.withColumns({
        "tyre_frac": ratio(F.col("tyre_life").cast("double"), F.col("compound_tyre")),
        "window_gap": F.col("race_compound_tyre") - F.col("tyre_life"),
        "laps_past_window": clip_low(F.col("tyre_life") - F.col("race_compound_tyre"), 0.0),
    }).drop("compound_tyre", "g_rate", "g_tyre")


def overdue(df: DataFrame, pred: str = "p") -> DataFrame:
    """Running sum of predictions in the stint before this lap."""
    w = Window.partitionBy(*GROUP, "stint").orderBy("lap").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("overdue", F.coalesce(F.sum(pred).over(w), F.lit(0.0)))


def laps_to_next(df: DataFrame) -> DataFrame:
    """Laps to the next pit at or after this one, 0 to 10; 10 where none comes."""
    w = Window.partitionBy(*GROUP).orderBy("lap").rowsBetween(0, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("target") == 1, F.col("lap")), ignorenulls=True).over(w)
    gap = nxt - F.col("lap")
    return df.withColumn("next_pit", nxt).withColumn("laps_to_next", F.coalesce(F.when(gap > 10, 10).otherwise(gap), F.lit(10)).cast("long"))
