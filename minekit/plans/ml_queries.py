"""Folds, preparation, models. Learners have no SQL twin; their results are held to ranges in tests."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import evaluation as E
from ..operators import laps as L
from ..operators import ml as M
from ..session import table
from .feature_queries import laps, rounded, scored
from .registry import query
from .sqlbits import LAPS, SCORED

_H = "('0x' || substr(md5({}), 1, 7))::BIGINT"
NUMERIC = ["value", "tyre_life", "degradation", "progress", "delta_roll3", "value_roll5"]


@query("cv_plain", f"SELECT event_id AS id, {_H.format('CAST(event_id AS VARCHAR)')} % 5 AS fold FROM events")
def cv_plain(spark, d):
    return M.plain_folds(table(spark, d, "events").select(F.col("event_id").alias("id")), 5)


@query("cv_stratified", f"WITH {LAPS} SELECT id, (row_number() OVER (PARTITION BY target, {_H.format(chr(39) + 's' + chr(39) + ' || CAST(id AS VARCHAR)')} % 64 ORDER BY md5(CAST(id AS VARCHAR))) - 1) % 5 AS fold FROM laps")
def cv_stratified(spark, d):
    return M.stratified_folds(laps(spark, d), 5, "target").select("id", "fold")


@query("cv_group", f"WITH {LAPS} SELECT id, {_H.format('concat_ws(chr(124), CAST(driver AS VARCHAR), CAST(race AS VARCHAR), CAST(year AS VARCHAR))')} % 5 AS fold FROM laps")
def cv_group(spark, d):
    return M.group_folds(laps(spark, d), 5, *L.GROUP).select("id", "fold")


@query("fe_label_encode", "SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events")
def fe_label_encode(spark, d):
    """Alphabetical codes from the table of distinct labels."""
    e = table(spark, d, "events").select("event_id", "event_type")
    codes = e.select("event_type").distinct().withColumn("code", (F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("event_type")) - 1).cast("long"))
    return e.join(codes, "event_type").select("event_id", "code")


@query("fe_onehot", "SELECT event_id, CAST(event_type = 'click' AS INTEGER) AS click, CAST(event_type = 'error' AS INTEGER) AS error, CAST(event_type = 'view' AS INTEGER) AS view FROM events")
def fe_onehot(spark, d):
    return table(spark, d, "events").select("event_id", *[X.indicator(F.col("event_type") == c).alias(c) for c in ("click", "error", "view")])


@query("fe_scale", "WITH m AS (SELECT avg(value) AS a, stddev_pop(value) AS s FROM events) SELECT event_id, round((value - a) / s, 6) AS z FROM events, m")
def fe_scale(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    one = e.agg(F.avg("value").alias("a"), F.stddev_pop("value").alias("s"))
    return e.crossJoin(F.broadcast(one)).select("event_id", X.r6((F.col("value") - F.col("a")) / F.col("s")).alias("z"))


@query("fe_impute", f"WITH {LAPS} SELECT id, round(coalesce(delta, (SELECT median(delta) FROM laps)), 6) AS delta FROM laps")
def fe_impute(spark, d):
    return rounded(M.impute(laps(spark, d).select("id", "delta"), ["delta"], []), "delta")


@query("fe_power")
def fe_power(spark, d):
    """Yeo-Johnson with the likeliest power, then standardised."""
    e = table(spark, d, "events").select("event_id", "value")
    e = e.withColumn("y", M.yeo_johnson(F.col("value"), M.fit_yeo_johnson(e, "value")))
    one = e.agg(F.avg("y").alias("a"), F.stddev_pop("y").alias("s"))
    return e.crossJoin(F.broadcast(one)).select("event_id", ((F.col("y") - F.col("a")) / F.col("s")).alias("z"))


def learning_set(spark, d):
    df = L.build_features(laps(spark, d)).fillna(0.0, NUMERIC).withColumn("label", F.col("target").cast("double"))
    return M.stratified_folds(df, 3, "target").select("id", "fold", "label", "compound", "year", *NUMERIC).persist()


@query("ml_gbdt_bin")
def ml_gbdt_bin(spark, d):
    stages = lambda: [*M.prepare(NUMERIC, ["compound"], scale=False), GBTClassifier(maxIter=5, maxDepth=3, seed=42)]
    return E.auc(M.out_of_fold(learning_set(spark, d), stages, 3), "p", "label")


@query("cv_oof")
def cv_oof(spark, d):
    stages = lambda: [*M.prepare(NUMERIC, ["compound"]), LogisticRegression(maxIter=20)]
    return M.out_of_fold(learning_set(spark, d), stages, 3)


@query("ml_ablation")
def ml_ablation(spark, d):
    """AUC with and without the category."""
    df, out = learning_set(spark, d), None
    for name, cats in (("all", ["compound"]), ("without compound", [])):
        a = E.auc(M.out_of_fold(df, lambda c=cats: [*M.prepare(NUMERIC, c), LogisticRegression(maxIter=20)], 3), "p", "label").select(F.lit(name).alias("run"), "auc")
        out = a if out is None else out.unionByName(a)
    return out


@query("ml_adversarial")
def ml_adversarial(spark, d):
    """How well the held-out year can be told from the others."""
    df = learning_set(spark, d).withColumn("label", (F.col("year") == 2023).cast("double"))
    return E.auc(M.out_of_fold(df, lambda: [*M.prepare(NUMERIC, ["compound"], scale=False), RandomForestClassifier(numTrees=10, maxDepth=4, seed=42)], 3), "p", "label")


@query("ens_stack_v1")
def ens_stack_v1(spark, d):
    """A logistic meta-learner on the logits of three scores, out of fold."""
    df = M.logits(M.stratified_folds(scored(spark, d), 3, "target"), ["p1", "p2", "p3"]).withColumn("label", F.col("target").cast("double")).persist()
    return E.auc(M.out_of_fold(df, lambda: [*M.prepare(["p1_z", "p2_z", "p3_z"], []), LogisticRegression(maxIter=20)], 3), "p", "label")


@query("ens_stack_v2")
def ens_stack_v2(spark, d):
    """The same with original features beside the logits, with L2 and with L1."""
    df = M.logits(M.stratified_folds(scored(spark, d), 3, "target"), ["p1", "p2", "p3"]).withColumn("label", F.col("target").cast("double")).persist()
    out = None
    for name, net in (("l2", 0.0), ("l1", 1.0)):
        a = E.auc(M.out_of_fold(df, lambda n=net: [*M.prepare(["p1_z", "p2_z", "p3_z", "tyre_life", "progress"], ["compound"]), LogisticRegression(maxIter=20, regParam=1e-4, elasticNetParam=n)], 3), "p", "label").select(F.lit(name).alias("run"), "auc")
        out = a if out is None else out.unionByName(a)
    return out


def _parts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice", "p_brand", "p_type")


def _label(df):
    from pyspark.ml.feature import StringIndexer

    return StringIndexer(inputCol="p_type", outputCol="label", stringOrderType="alphabetAsc").fit(df)


@query("ml_logreg")
def ml_logreg(spark, d):
    """Multinomial regression: the three likeliest labels of a part, best first."""
    df = _parts(spark, d)
    index = _label(df)
    model = Pipeline(stages=[*M.prepare(["p_size", "p_retailprice"], ["p_brand"]), LogisticRegression(maxIter=20)]).fit(index.transform(df))
    names = F.array(*[F.lit(x) for x in index.labels])
    order = F.sort_array(F.transform(vector_to_array(F.col("probability")), lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
    return model.transform(df).select("id", F.array_join(F.transform(F.slice(order, 1, 3), lambda x: F.element_at(names, x["i"].cast("int") + 1)), " ").alias("top3"))


@query("agg_importance")
def agg_importance(spark, d):
    df = learning_set(spark, d)
    model = Pipeline(stages=[*M.prepare(NUMERIC, [], scale=False), RandomForestClassifier(numTrees=10, maxDepth=4, seed=42)]).fit(df)
    return spark.createDataFrame(list(zip(NUMERIC, [float(x) for x in model.stages[-1].featureImportances.toArray()], strict=True)), "feature string, gain double")


@query("ml_tune")
def ml_tune(spark, d):
    """A seeded random search; each trial is scored on one fold."""
    df = learning_set(spark, d)
    train, valid = df.where("fold <> 0"), df.where("fold = 0")

    def score(p: dict) -> float:
        model = Pipeline(stages=[*M.prepare(NUMERIC, ["compound"]), LogisticRegression(maxIter=10, **p)]).fit(train)
        return float(E.auc(model.transform(valid).select("label", M.positive().alias("p")), "p", "label").first()["auc"])

    found = M.random_search({"regParam": [1e-4, 1e-3, 1e-2, 1e-1], "elasticNetParam": [0.0, 0.5, 1.0]}, 4, score)
    return spark.createDataFrame([(i, v, p["regParam"], p["elasticNetParam"]) for i, (v, p) in enumerate(found)], "place long, auc double, reg double, net double")


@query("ens_weights_fit")
def ens_weights_fit(spark, d):
    w = M.fit_weights(scored(spark, d).select("target", "p1", "p2", "p3").persist(), ["p1", "p2", "p3"], "target", steps=10)
    return spark.createDataFrame(list(w.items()), "model string, weight double")


@query("ml_ar_infer", f"WITH RECURSIVE {LAPS}, g AS (SELECT *, -2 + 0.01::DOUBLE * value + 0.05::DOUBLE * tyre_life AS z FROM laps), r AS (SELECT id, driver, race, year, stint, tyre_life, 1 / (1 + exp(-z)) AS p, 1 / (1 + exp(-z)) AS owed FROM g WHERE tyre_life = 1 UNION ALL SELECT g.id, g.driver, g.race, g.year, g.stint, g.tyre_life, 1 / (1 + exp(-(g.z + 0.3::DOUBLE * r.owed))), r.owed + 1 / (1 + exp(-(g.z + 0.3::DOUBLE * r.owed))) FROM r JOIN g ON g.driver = r.driver AND g.race = r.race AND g.year = r.year AND g.stint = r.stint AND g.tyre_life = r.tyre_life + 1) SELECT id, round(p, 6) AS p FROM r")
def ml_ar_infer(spark, d):
    return rounded(M.autoregressive(laps(spark, d), [*L.GROUP, "stint"], "tyre_life", ["value", "tyre_life"], [0.01, 0.05], -2.0, 0.3), "p")


query("win_recurrent", f"WITH RECURSIVE {LAPS}, g AS (SELECT *, -1 + 0.01::DOUBLE * value AS z FROM laps), r AS (SELECT id, driver, race, year, stint, tyre_life, 1 / (1 + exp(-z)) AS p, 1 / (1 + exp(-z)) AS owed FROM g WHERE tyre_life = 1 UNION ALL SELECT g.id, g.driver, g.race, g.year, g.stint, g.tyre_life, 1 / (1 + exp(-(g.z + 0.2::DOUBLE * r.owed))), r.owed + 1 / (1 + exp(-(g.z + 0.2::DOUBLE * r.owed))) FROM r JOIN g ON g.driver = r.driver AND g.race = r.race AND g.year = r.year AND g.stint = r.stint AND g.tyre_life = r.tyre_life + 1) SELECT id, round(p, 6) AS p FROM r")(
    lambda spark, d: rounded(M.autoregressive(laps(spark, d), [*L.GROUP, "stint"], "tyre_life", ["value"], [0.01], -1.0, 0.2), "p")
)


@query("ml_automl_ts")
def ml_automl_ts(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    daily = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment", "o_orderstatus", F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("v"))
    return M.forecasts(daily, ["c_mktsegment", "o_orderstatus"])
