"""Closed-form scorers, their threshold search and their errors."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X

# Intercepts and weights of the ten indicators for Low, Medium, High.
INTERCEPTS = (16.3173, 4.6524, -20.9697)
WEIGHTS = {
    "soil_low": (-11.0237, 0.3290, 10.6947),
    "temp_high": (-5.8559, -0.0204, 5.8763),
    "rain_low": (-10.8500, 0.1542, 10.6958),
    "wind_high": (-5.8284, 0.0841, 5.7444),
    "Flowering": (-5.4155, 0.3586, 5.0569),
    "Harvest": (5.5073, -0.1348, -5.3725),
    "Sowing": (5.2299, -0.3547, -4.8752),
    "Vegetative": (-5.4617, 0.3334, 5.1283),
    "mulch_No": (-3.0014, 0.1883, 2.8131),
    "mulch_Yes": (2.8613, 0.0142, -2.8755),
}
CLASSES = ("Low", "Medium", "High")
THRESHOLDS = {"soil": 25.0, "temp": 30.0, "rain": 300.0, "wind": 10.0}
#: The grid of the full search: 15 * 10 * 21 * 10 = 31,500 combinations.
GRID = {"soil": [float(x) for x in range(18, 33)], "temp": [float(x) for x in range(26, 36)], "rain": [float(x) for x in range(200, 401, 10)], "wind": [float(x) for x in range(6, 16)]}


def irrigation(lineitem: DataFrame) -> DataFrame:
    """lineitem in the role of fields: four measures, a growth stage, mulching and the need."""
    stage = F.element_at(F.array(*map(F.lit, ("Flowering", "Harvest", "Sowing", "Vegetative"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    return lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_quantity").alias("soil"), (F.lit(20) + F.lit(200) * F.col("l_tax")).alias("temp"), (F.lit(150) + F.col("l_extendedprice") / 250).alias("rain"), (F.lit(100) * F.col("l_discount") + 5).alias("wind"),
        stage.alias("stage"), F.when(F.col("l_returnflag") == "N", "No").otherwise("Yes").alias("mulch"),
        F.when(F.col("l_quantity") < 17, "High").when(F.col("l_quantity") < 34, "Medium").otherwise("Low").alias("y"),
    )


def indicators(t: dict[str, object] = THRESHOLDS) -> dict:
    out = {"soil_low": F.col("soil") < t["soil"], "temp_high": F.col("temp") > t["temp"], "rain_low": F.col("rain") < t["rain"], "wind_high": F.col("wind") > t["wind"]}
    out |= {s: F.col("stage") == s for s in ("Flowering", "Harvest", "Sowing", "Vegetative")}
    return {k: X.indicator(v) for k, v in (out | {"mulch_No": F.col("mulch") == "No", "mulch_Yes": F.col("mulch") == "Yes"}).items()}


def formula_logit(df: DataFrame) -> DataFrame:
    """Ten indicators to three logits, probabilities and the likeliest class."""
    found = indicators()
    df = df.withColumns({f"z{i}": X.linear(INTERCEPTS[i], [(found[k], w[i]) for k, w in WEIGHTS.items()]) for i in range(3)})
    z = [F.col(f"z{i}") for i in range(3)]
    df = df.withColumns(dict(zip(("p_low", "p_medium", "p_high"), X.softmax(z), strict=True)))
    return df.withColumn("label", X.argmax_label(z, CLASSES))


def formula_rules(df: DataFrame) -> DataFrame:
    """High score less low score, in three bands."""
    i = indicators()
    score = 2 * i["soil_low"] + 2 * i["rain_low"] + i["temp_high"] + i["wind_high"] - 2 * (i["Harvest"] + i["Sowing"]) - i["mulch_Yes"]
    return df.withColumn("score", score).withColumn("label", X.case3(F.col("score"), 0, 3, CLASSES))


def threshold_grid(df: DataFrame, grid: dict[str, list[float]] | None = None, folds: int = 10) -> DataFrame:
    """Accuracy, averaged over folds, of every combination of thresholds.

    Rows are first counted by what any combination can tell apart (the cells between thresholds,
    stage, mulching, class, fold): a few thousand counts whatever the number of rows. Only
    those meet the grid.
    """
    grid = grid or SMALL_GRID
    df = df.withColumn("fold", X.id_fold(F.col("id"), folds))
    # the cell: thresholds passed, so that x < t exactly when t is among the upper ones
    cell = {c: sum((X.indicator(F.col(c) >= v if c in ("soil", "rain") else F.col(c) > v) for v in grid[c][1:]), X.indicator(F.col(c) >= grid[c][0] if c in ("soil", "rain") else F.col(c) > grid[c][0])) for c in grid}
    counts = df.groupBy(*[v.alias(f"{c}_cell") for c, v in cell.items()], "stage", "mulch", "y", "fold").agg(F.count("*").alias("n"))
    spark = df.sparkSession
    columns = ", ".join(f"{c}_t double, {c}_i int" for c in grid)
    combos = spark.createDataFrame([tuple(x for i, v in combo for x in (float(v), i)) for combo in product(*(list(enumerate(values)) for values in grid.values()))], columns)
    both = counts.crossJoin(F.broadcast(combos))  # the grid's size is a parameter, not the data's
    hit = {"soil_low": F.col("soil_cell") <= F.col("soil_i"), "rain_low": F.col("rain_cell") <= F.col("rain_i"), "temp_high": F.col("temp_cell") > F.col("temp_i"), "wind_high": F.col("wind_cell") > F.col("wind_i")}
    i = indicators(dict.fromkeys(grid, 0.0)) | {k: X.indicator(v) for k, v in hit.items()}
    z = [X.linear(INTERCEPTS[j], [(i[k], w[j]) for k, w in WEIGHTS.items()]) for j in range(3)]
    both = both.withColumns({f"z{j}": z[j] for j in range(3)})
    right = F.when(X.argmax_label([F.col(f"z{j}") for j in range(3)], CLASSES) == F.col("y"), F.col("n")).otherwise(0)
    keys = [f"{c}_t" for c in grid]
    per_fold = both.groupBy(*keys, "fold").agg((F.sum(right) / F.sum("n")).alias("a"))
    return per_fold.groupBy(*keys).agg(X.r6(F.avg("a")).alias("accuracy"))


SMALL_GRID = {"soil": [20.0, 25.0, 30.0], "temp": [28.0, 30.0], "rain": [250.0, 300.0, 350.0], "wind": [8.0, 10.0]}


def error_slices(df: DataFrame) -> DataFrame:
    """Of each feature, class and correctness: count, mean, median and median distance from the threshold."""
    long = df.select("y", (F.col("label") != F.col("y")).alias("wrong"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v"), F.lit(t).alias("t")) for c, t in THRESHOLDS.items()])).alias("x")).select("y", "wrong", "x.*")
    return long.groupBy("feature", "y", "wrong").agg(F.count("*").alias("n"), X.r6(F.avg("v")).alias("mean"), X.r6(F.median("v")).alias("med"), X.r6(F.median(F.abs(F.col("v") - F.col("t")))).alias("distance"))


# The same in SQL


def _logit_sql(i: int, t: dict[str, str]) -> str:
    ind = {"soil_low": f"soil < {t['soil']}", "temp_high": f"temp > {t['temp']}", "rain_low": f"rain < {t['rain']}", "wind_high": f"wind > {t['wind']}", **{s: f"stage = '{s}'" for s in ("Flowering", "Harvest", "Sowing", "Vegetative")}, "mulch_No": "mulch = 'No'", "mulch_Yes": "mulch = 'Yes'"}
    return f"{INTERCEPTS[i]}::DOUBLE + " + " + ".join(f"CAST({ind[k]} AS INTEGER) * ({w[i]}::DOUBLE)" for k, w in WEIGHTS.items())


_FIXED = {k: str(v) for k, v in THRESHOLDS.items()}
LOGIT_SQL = f"""z AS (SELECT *, {', '.join(f'{_logit_sql(i, _FIXED)} AS z{i}' for i in range(3))} FROM irr),
m AS (SELECT *, greatest(z0, z1, z2) AS top FROM z), x AS (SELECT *, exp(z0 - top) AS e0, exp(z1 - top) AS e1, exp(z2 - top) AS e2 FROM m),
scores AS (SELECT *, e0 / (e0 + e1 + e2) AS p_low, e1 / (e0 + e1 + e2) AS p_medium, e2 / (e0 + e1 + e2) AS p_high, CASE WHEN z0 = top THEN 'Low' WHEN z1 = top THEN 'Medium' ELSE 'High' END AS label FROM x)"""
RULES_SQL = """r0 AS (SELECT *, 2 * CAST(soil < 25 AS INTEGER) + 2 * CAST(rain < 300 AS INTEGER) + CAST(temp > 30 AS INTEGER) + CAST(wind > 10 AS INTEGER) - 2 * CAST(stage IN ('Harvest', 'Sowing') AS INTEGER) - CAST(mulch = 'Yes' AS INTEGER) AS score FROM irr),
ruled AS (SELECT *, CASE WHEN score <= 0 THEN 'Low' WHEN score <= 3 THEN 'Medium' ELSE 'High' END AS label FROM r0)"""


def grid_sql(base: str) -> str:
    tables = ", ".join(f"(SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in values)}]) AS {c}_t) {c}s" for c, values in SMALL_GRID.items())
    t = {c: f"{c}_t" for c in SMALL_GRID}
    keys = ", ".join(t.values())
    return f"""WITH {base}, b AS (SELECT irr.*, {keys}, ('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 7))::BIGINT % 10 AS fold FROM irr, {tables}),
z AS (SELECT *, {', '.join(f'{_logit_sql(i, t)} AS z{i}' for i in range(3))} FROM b),
h AS (SELECT {keys}, fold, avg(CAST(CASE WHEN z0 = greatest(z0, z1, z2) THEN 'Low' WHEN z1 = greatest(z0, z1, z2) THEN 'Medium' ELSE 'High' END = y AS INTEGER)) AS a FROM z GROUP BY {keys}, fold)
SELECT {keys}, round(avg(a), 6) AS accuracy FROM h GROUP BY {keys}"""
