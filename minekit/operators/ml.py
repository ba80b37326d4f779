"""Folds, preparation, models and model selection with Spark ML; numpy only for sequential inference and small series."""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import id_fold, logit
from .evaluation import auc


def plain_folds(df: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    return df.withColumn("fold", id_fold(F.col(id_col), k))


def stratified_folds(df: DataFrame, k: int, label: str, id_col: str = "id", salts: int = 64) -> DataFrame:
    """Folds that deal each class evenly, within salts of the id's hash so that a large class is not one task's."""
    salt = id_fold(F.concat(F.lit("s"), F.col(id_col).cast("string")), salts)
    w = Window.partitionBy(label, salt).orderBy(F.md5(F.col(id_col).cast("string").cast("binary")))
    return df.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("long"))


def group_folds(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """All rows of a group fall into one fold."""
    return df.withColumn("fold", id_fold(F.concat_ws("|", *[F.col(c).cast("string") for c in keys]), k))


def prepare(numeric: list[str], categorical: list[str], scale: bool = True) -> list:
    """Stages that index, one-hot encode (unknown categories kept apart), assemble and standardise."""
    stages: list = []
    if categorical:
        stages += [StringIndexer(inputCols=categorical, outputCols=[f"{c}_ix" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=[f"{c}_ix" for c in categorical], outputCols=[f"{c}_oh" for c in categorical], handleInvalid="keep")]
    raw = "raw_features" if scale else "features"
    stages.append(VectorAssembler(inputCols=[*numeric, *(f"{c}_oh" for c in categorical)], outputCol=raw, handleInvalid="keep"))
    return stages + ([StandardScaler(inputCol=raw, outputCol="features", withMean=False)] if scale else [])


def positive(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))[1]


def out_of_fold(df: DataFrame, stages: Callable[[], list[Estimator]], folds: int, out: str = "p", keep: tuple[str, ...] = ("id", "fold", "label")) -> DataFrame:
    """Each row predicted by a model that saw only the other folds."""
    parts = []
    for i in range(folds):
        model = Pipeline(stages=stages()).fit(df.where(F.col("fold") != i))
        parts.append(model.transform(df.where(F.col("fold") == i)).select(*keep, positive().alias(out)))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def impute(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Exact medians and modes for nulls; one row of figures is joined on."""
    one = df.agg(*[F.median(c).alias(f"_m_{c}") for c in numeric], *[F.mode(c).alias(f"_m_{c}") for c in categorical])
    out = df.crossJoin(F.broadcast(one))
    return out.withColumns({c: F.coalesce(c, f"_m_{c}") for c in [*numeric, *categorical]}).drop(*[f"_m_{c}" for c in [*numeric, *categorical]])


def yeo_johnson(c: Column, lam: float) -> Column:
    up = F.ln(c + 1) if abs(lam) < 1e-9 else (F.pow(c + 1, F.lit(lam)) - 1) / lam
    down = -F.ln(1 - c) if abs(lam - 2) < 1e-9 else -(F.pow(1 - c, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(c >= 0, up).otherwise(down)


def fit_yeo_johnson(df: DataFrame, column: str, grid: list[float] | None = None) -> float:
    """The power with the best likelihood on a grid; all powers share one pass."""
    grid = grid or [round(-2 + 0.25 * i, 2) for i in range(17)]
    c = F.col(column)
    jac = F.sum(F.signum(c) * F.ln(F.abs(c) + 1))
    row = df.where(c.isNotNull()).agg(F.count("*").alias("n"), jac.alias("j"), *[F.var_pop(yeo_johnson(c, v)).alias(f"v{i}") for i, v in enumerate(grid)]).first()
    scores = [-row["n"] / 2 * np.log(max(row[f"v{i}"] or 1e-12, 1e-12)) + (v - 1) * row["j"] for i, v in enumerate(grid)]
    return grid[int(np.argmax(scores))]


def random_search(space: dict[str, list], trials: int, score: Callable[[dict], float], seed: int = 42) -> list[tuple[float, dict]]:
    """Seeded trials, best first."""
    rng, out = random.Random(seed), []
    for _ in range(trials):
        params = {k: rng.choice(v) for k, v in space.items()}
        out.append((score(params), params))
    return sorted(out, key=lambda x: -x[0])


def nelder_mead(f: Callable[[np.ndarray], float], x0: np.ndarray, steps: int = 120) -> np.ndarray:
    """A minimum of f by the downhill simplex."""
    n = len(x0)
    simplex = [np.asarray(x0, float)] + [np.asarray(x0, float) + 0.25 * np.eye(n)[i] for i in range(n)]
    values = [f(x) for x in simplex]
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        simplex, values = [simplex[i] for i in order], [values[i] for i in order]
        center = np.mean(simplex[:-1], axis=0)
        step = lambda t: center + t * (simplex[-1] - center)  # noqa: B023, E731
        x, v = step(-1.0), f(step(-1.0))
        if v < values[0]:
            y = step(-2.0)
            x, v = (y, f(y)) if f(y) < v else (x, v)
        elif v >= values[-2]:
            y = step(-0.5 if v < values[-1] else 0.5)
            if f(y) < min(v, values[-1]):
                x, v = y, f(y)
            else:
                simplex = [simplex[0]] + [(s + simplex[0]) / 2 for s in simplex[1:]]
                values = [values[0]] + [f(s) for s in simplex[1:]]
                continue
        simplex[-1], values[-1] = x, v
    return simplex[int(np.argmin(values))]


def fit_weights(df: DataFrame, columns: list[str], target: str, steps: int = 40) -> dict[str, float]:
    """Non-negative weights that maximise the AUC of the weighted mean: each try is one distributed AUC."""
    from .blend import weighted

    def loss(w: np.ndarray) -> float:
        w = np.clip(w, 0, None)
        if not w.sum():
            return 0.0
        p = F.round(weighted(dict(zip(columns, w.tolist(), strict=True))), 9)
        return -float(auc(df.select(p.alias("p"), F.col(target).alias("y"))).first()["auc"] or 0.0)

    w = np.clip(nelder_mead(loss, np.full(len(columns), 1 / len(columns)), steps), 0, None)
    return dict(zip(columns, (w / w.sum()).tolist(), strict=True))


def logits(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_z": logit(F.col(c)) for c in columns})


def autoregressive(df: DataFrame, keys: list[str], order: str, features: list[str], weights: list[float], bias: float, feedback: float) -> DataFrame:
    """(id, p): within a group each row's score uses the sum of the scores before it; groups are independent tasks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        base = pdf[features].to_numpy(float) @ np.asarray(weights) + bias
        out, owed = np.empty(len(pdf)), 0.0
        for i, z in enumerate(base):
            out[i] = 1 / (1 + np.exp(-(z + feedback * owed)))
            owed += out[i]
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "p": out})

    return df.select(*dict.fromkeys(["id", *keys, order, *features])).groupBy(*keys).applyInPandas(run, "id long, p double")


def forecasts(series: DataFrame, keys: list[str], horizon: int = 30) -> DataFrame:
    """(keys..., model, mape): of every series the best of naive, mean and linear trend by MAPE on its last days."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("day")["v"].to_numpy(float)
        h = max(1, min(horizon, len(y) // 3))
        past, future = y[:-h], y[-h:]
        if len(past) < 2:
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "model": ["none"], "mape": [np.nan]})
        slope, start = np.polyfit(np.arange(len(past)), past, 1)
        tries = {"naive": np.full(h, past[-1]), "mean": np.full(h, past.mean()), "trend": start + slope * np.arange(len(past), len(past) + h)}
        errors = {k: float(np.mean(np.abs((future - v) / np.where(future == 0, np.nan, future)))) for k, v in tries.items()}
        best = min(errors, key=lambda k: errors[k])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "model": [best], "mape": [errors[best]]})

    kinds = dict(series.dtypes)
    return series.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "model string, mape double"]))
