"""Boosting of residuals and of several classes, ranking, networks, attributions, model selection, stored models and sweeps.

Learners have no SQL twin; tests hold their results to ranges.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import evaluation as E
from ..operators import ml as M
from ..operators import scoring as S
from ..operators import similarity as T
from ..session import table
from ..sources.text import scratch
from .feature_queries import scored
from .ml_queries import NUMERIC, learning_set
from .registry import query
from .sqlbits import SCORED


@query("ml_gbdt_residual")
def ml_gbdt_residual(spark, d):
    """Boosted corrections of the formula's probabilities, class by class and out of fold: log loss and accuracy before and after."""
    base = S.formula_logit(S.irrigation(table(spark, d, "lineitem")))
    names = dict(zip(S.CLASSES, ("p_low", "p_medium", "p_high"), strict=True))
    base = M.plain_folds(base, 3).select("id", "fold", "y", "soil", "temp", "rain", "wind", *names.values()).persist()
    out = base
    for c, p in names.items():
        rows = base.withColumn("label", (F.col("y") == c).cast("double") - F.col(p))
        parts = []
        for i in range(3):
            model = Pipeline(stages=[*M.prepare(["soil", "temp", "rain", "wind", *names.values()], [], scale=False), GBTRegressor(maxIter=5, maxDepth=3, seed=42)]).fit(rows.where(F.col("fold") != i))
            parts.append(model.transform(rows.where(F.col("fold") == i)).select("id", F.greatest(F.lit(1e-6), F.col(p) + F.col("prediction")).alias(f"{p}_r")))
        out = out.join(parts[0].unionByName(parts[1]).unionByName(parts[2]), "id")
    total = sum(F.col(f"{p}_r") for p in names.values())
    best = lambda suffix: F.when(F.col(f"p_low{suffix}") >= F.greatest(f"p_medium{suffix}", f"p_high{suffix}"), "Low").when(F.col(f"p_medium{suffix}") >= F.col(f"p_high{suffix}"), "Medium").otherwise("High")
    own = lambda suffix: F.coalesce(*[F.when(F.col("y") == c, F.col(f"{p}{suffix}")) for c, p in names.items()])
    loss = [F.avg(-F.ln(F.greatest(own(s) / t, F.lit(1e-9)))).alias(n) for s, t, n in (("", F.lit(1.0), "loss_before"), ("_r", total, "loss_after"))]
    return out.agg(*loss, *[F.avg((best(s) == F.col("y")).cast("double")).alias(n) for s, n in (("", "accuracy_before"), ("_r", "accuracy_after"))])


def _rated(spark, d, folds: int = 3):
    """(id, fold, label, features of a part): the type of a part as a number."""
    from pyspark.ml.feature import StringIndexer

    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice", "p_brand", "p_type")
    index = StringIndexer(inputCol="p_type", outputCol="label", stringOrderType="alphabetAsc").fit(parts)
    return M.plain_folds(index.transform(parts), folds).persist(), index.labels


@query("ml_gbdt_multi")
def ml_gbdt_multi(spark, d):
    """One boosted model for each class against the rest, judged out of fold: rows and accuracy of each predicted class."""
    df, labels = _rated(spark, d)
    out = df.select("id", "label", "fold")
    for c in range(len(labels)):
        one = df.withColumn("class", F.col("label")).withColumn("label", (F.col("label") == c).cast("double"))
        stages = lambda: [*M.prepare(["p_size", "p_retailprice"], ["p_brand"], scale=False), GBTClassifier(maxIter=5, maxDepth=3, seed=42)]
        out = out.join(M.out_of_fold(one, stages, 3, f"p{c}", ("id",)), "id")
    z = F.array(*[F.struct((-F.col(f"p{c}")).alias("z"), F.lit(c).alias("c")) for c in range(len(labels))])
    out = out.withColumn("prediction", F.array_min(z)["c"].cast("double"))
    return out.groupBy("prediction").agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


@query("ml_ranker")
def ml_ranker(spark, d):
    """Every part crossed with every type (the list of types is checked and small), relevance learnt pointwise; the mean reciprocal rank among the first three, out of fold."""
    df, labels = _rated(spark, d)
    if len(labels) > 1000:
        raise ValueError("too many candidates a row for a ranker that crosses them")
    rows = df.withColumn("candidate", F.explode(F.array(*[F.lit(x) for x in labels])))
    rows = rows.withColumn("label", (F.col("candidate") == F.col("p_type")).cast("double"))
    rate = rows.groupBy("candidate", "p_brand").agg(F.sum("label").alias("s"), F.count("*").alias("n"))
    rows = rows.join(rate, ["candidate", "p_brand"]).withColumn("others", (F.col("s") - F.col("label") + 1) / (F.col("n") + len(labels))).persist()
    scores = M.out_of_fold(rows, lambda: [*M.prepare(["p_size", "p_retailprice", "others"], ["candidate"]), LogisticRegression(maxIter=10)], 3, "p", ("id", "label", "candidate"))
    order = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("p"), "candidate", "label"))), 1, 3)
    top = scores.groupBy("id").agg(order.alias("top"))
    hit = F.array_position(F.transform("top", lambda x: x["label"]), 1.0)
    return top.agg(F.count("*").alias("n"), F.avg(F.when(hit > 0, 1 / hit).otherwise(0.0)).alias("map3"))


@query("ml_mlp")
def ml_mlp(spark, d):
    """A network with one hidden layer, out of fold: its AUC."""
    stages = lambda: [*M.prepare(NUMERIC, []), MultilayerPerceptronClassifier(layers=[len(NUMERIC), 8, 2], maxIter=30, seed=42)]
    return E.auc(M.out_of_fold(learning_set(spark, d), stages, 3), "p", "label")


@query("ml_shap")
def ml_shap(spark, d):
    """Mean absolute Shapley value of each feature in a logistic model: for a linear score and independent features w (x - mean) is exact. The values of a row add up to its score less the mean score."""
    df = learning_set(spark, d)
    model = Pipeline(stages=[*M.prepare(NUMERIC, []), LogisticRegression(maxIter=20)]).fit(df)
    rows = model.transform(df).select("id", vector_to_array("features").alias("x"), vector_to_array("rawPrediction")[1].alias("z")).persist()
    w = model.stages[-1].coefficients.toArray().tolist()
    mean = rows.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(w))], F.avg("z").alias("mz")).first()
    phi = [w[i] * (F.col("x")[i] - mean[f"m{i}"]) for i in range(len(w))]
    gap = F.max(F.abs(sum(phi) - (F.col("z") - mean["mz"])))
    got = rows.agg(*[F.avg(F.abs(p)).alias(c) for p, c in zip(phi, NUMERIC, strict=True)], gap.alias("gap")).first()
    return spark.createDataFrame([(c, float(got[c]), float(got["gap"])) for c in NUMERIC], "feature string, mean_abs double, gap double")


def _board(spark, found: dict[str, float], lower: bool = False):
    rows = sorted(found.items(), key=lambda x: x[1] if lower else -x[1])
    return spark.createDataFrame([(i + 1, k, float(v)) for i, (k, v) in enumerate(rows)], "place int, model string, score double")


@query("ml_automl_cls")
def ml_automl_cls(spark, d):
    """A leaderboard of classifiers by AUC out of fold."""
    df = learning_set(spark, d)
    tries = {"logistic": LogisticRegression(maxIter=20), "tree": DecisionTreeClassifier(maxDepth=4, seed=42), "forest": RandomForestClassifier(numTrees=10, maxDepth=4, seed=42), "boosted": GBTClassifier(maxIter=5, maxDepth=3, seed=42)}
    return _board(spark, {k: E.auc(M.out_of_fold(df, lambda m=m: [*M.prepare(NUMERIC, ["compound"]), m.copy()], 3), "p", "label").first()["auc"] for k, m in tries.items()})


@query("ml_automl_reg")
def ml_automl_reg(spark, d):
    """A leaderboard of regressors by root mean squared error out of fold."""
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("label"), "l_quantity", "l_discount", "l_tax", "l_returnflag")
    df = M.plain_folds(li, 3).persist()
    tries = {"linear": LinearRegression(regParam=0.1), "tree": DecisionTreeRegressor(maxDepth=4, seed=42), "forest": RandomForestRegressor(numTrees=10, maxDepth=4, seed=42), "boosted": GBTRegressor(maxIter=5, maxDepth=3, seed=42)}
    found = {}
    for k, m in tries.items():
        total = n = 0.0
        for i in range(3):
            model = Pipeline(stages=[*M.prepare(["l_quantity", "l_discount", "l_tax"], ["l_returnflag"]), m.copy()]).fit(df.where(F.col("fold") != i))
            got = model.transform(df.where(F.col("fold") == i)).agg(F.sum(F.pow(F.col("prediction") - F.col("label"), 2)).alias("s"), F.count("*").alias("n")).first()
            total, n = total + (got["s"] or 0.0), n + got["n"]
        found[k] = (total / max(1.0, n)) ** 0.5
    return _board(spark, found, lower=True)


def _stored(spark, d):
    df = learning_set(spark, d)
    model = Pipeline(stages=[*M.prepare(NUMERIC, ["compound"]), LogisticRegression(maxIter=10)]).fit(df)
    path = scratch(spark, "model")
    model.write().overwrite().save(path)
    return df, model, path


@query("snk_model")
def snk_model(spark, d):
    """A fitted pipeline stored whole, read back and applied: id, and the score before and after."""
    df, model, path = _stored(spark, d)
    before, after = (m.transform(df).select("id", M.positive().alias(c)) for m, c in ((model, "before"), (PipelineModel.load(path), "after")))
    return before.join(after, "id")


@query("src_model")
def src_model(spark, d):
    """The predictions of a stored pipeline."""
    df, _, path = _stored(spark, d)
    return PipelineModel.load(path).transform(df).select("id", M.positive().alias("p"))


@query("snk_json", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def snk_json(spark, d):
    path = scratch(spark, "json")
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    nation.write.json(path)
    return spark.read.schema(nation.schema).json(path)


@query("snk_npy", f"WITH {SCORED} SELECT id, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM scored")
def snk_npy(spark, d):
    """Two aligned prediction arrays, kept by id."""
    path = scratch(spark, "arrays")
    scored(spark, d).select("id", F.array(X.r6(F.col("p1")), X.r6(F.col("p2"))).alias("p")).write.parquet(path)
    return spark.read.parquet(path).select("id", F.col("p")[0].alias("p1"), F.col("p")[1].alias("p2"))


_WORDS = "s AS (SELECT doc_id AS id, list_distinct(string_split(lower(substr(text, 1, length(text))), ' ')) AS w FROM documents WHERE text IS NOT NULL)"


@query("agg_jaccard", f"WITH {_WORDS} SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE, 6) AS jaccard FROM s a JOIN s b ON b.id = a.id + 1")
def agg_jaccard(spark, d):
    """The similarity of each document's words to those of the document with the next id."""
    s = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    return s.alias("a").join(s.alias("b"), F.expr("b.id = a.id + 1")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), X.r6(X.jaccard(F.col("a.w"), F.col("b.w"))).alias("jaccard"))


@query(
    "fn_combinations",
    "WITH p AS (SELECT n_regionkey AS r, list_sort(list(n_name)) AS x FROM nation GROUP BY 1), u AS (SELECT r, x, unnest(range(1, len(x) + 1)) AS i FROM p), v AS (SELECT r, x, i, unnest(range(i + 1, len(x) + 1)) AS j FROM u) SELECT r, x[i] || '|' || x[j] AS pair FROM v",
)
def fn_combinations(spark, d):
    """All pairs of the names of a region, in order."""
    x = F.col("x")
    pairs = F.flatten(F.transform(x, lambda a, i: F.transform(F.slice(x, i + 2, F.greatest(F.size(x) - i - 1, F.lit(0))), lambda b: F.concat(a, F.lit("|"), b))))
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.sort_array(F.collect_list("n_name")).alias("x")).select("r", F.explode(pairs).alias("pair"))


@query("fn_random")
def fn_random(spark, d):
    """Seeded uniform draws that depend on the id alone, so reruns and other partitions agree."""
    u = F.pmod(F.xxhash64("event_id", F.lit(42)), F.lit(2**53)) / F.lit(float(2**53))
    return table(spark, d, "events").select("event_id", u.alias("u"))


@query("txt_sweep")
def txt_sweep(spark, d):
    """Candidate pairs and pairs found by banded signatures for several numbers of bands, beside the exact number of pairs over 0.8."""
    docs = table(spark, d, "documents")
    exact = T.pair_counts(docs.select(F.col("doc_id").alias("id"), "text"), 0.8).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counted = T.band_counts(T.signature_classes(docs, 20), 20, 0.8, (4, 5, 10))
    return spark.createDataFrame([(b, *n, exact) for b, n in counted.items()], "bands int, candidates long, found long, exact long")
