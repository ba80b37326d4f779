"""Aggregations, metrics, drift, ensembling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import blend as B
from ..operators import evaluation as E
from ..operators import scoring as S
from ..session import table
from .feature_queries import laps, rounded, scored
from .registry import query
from .sqlbits import IRRIGATION, LAPS, SCORED

FOLD = "('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 7))::BIGINT"


def auc_sql(source: str, p: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    keys, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""SELECT {keys}count(*) AS n, round(CASE WHEN sum(target) > 0 AND sum(target) < count(*) THEN (sum(target * r) - sum(target) * (sum(target) + 1) / 2.0::DOUBLE) / (sum(target) * (count(*) - sum(target))::DOUBLE) END, 6) AS auc
 FROM (SELECT *, rank() OVER ({part}ORDER BY {p}) + (count(*) OVER (PARTITION BY {keys}{p}) - 1) / 2.0::DOUBLE AS r FROM {source}){group}"""  # fmt: skip


@query("agg_auc", f"WITH {SCORED} {auc_sql('scored', 'p1')}")
def agg_auc(spark, d):
    return rounded(E.auc(scored(spark, d), "p1", "target"), "auc")


@query("ev_auc_by_group", f"WITH {SCORED} {auc_sql('scored', 'p1', 'compound')}")
def ev_auc_by_group(spark, d):
    return rounded(E.auc(scored(spark, d), "p1", "target", ["compound"]), "auc")


@query("agg_nunique_guard", f"WITH {SCORED} SELECT driver, count(*) AS n FROM scored GROUP BY driver HAVING count(DISTINCT target) = 2")
def agg_nunique_guard(spark, d):
    return scored(spark, d).groupBy("driver").agg(F.count("*").alias("n"), F.count_distinct("target").alias("k")).where("k = 2").drop("k")


@query("srt_worst_groups", f"WITH {SCORED}, a AS ({auc_sql('scored', 'p1', 'driver')}) SELECT * FROM a WHERE n >= 50 AND auc IS NOT NULL ORDER BY auc, driver LIMIT 15")
def srt_worst_groups(spark, d):
    found = rounded(E.auc(scored(spark, d), "p1", "target", ["driver"]), "auc")
    return found.where("n >= 50 AND auc IS NOT NULL").orderBy("auc", "driver").limit(15)


@query("ev_expected_lb", f"WITH {SCORED}, a AS ({auc_sql('scored', 'p1', 'race')}), w AS (SELECT race, count(*) / sum(count(*)) OVER () AS f FROM laps WHERE year = 2023 GROUP BY race) SELECT round(sum(f * auc), 6) AS expected FROM a JOIN w USING (race)")
def ev_expected_lb(spark, d):
    """AUC by race weighted with the mix of the held-out year."""
    a = rounded(E.auc(scored(spark, d), "p1", "target", ["race"]), "auc")
    n = laps(spark, d).where("year = 2023").groupBy("race").agg(F.count("*").alias("n2"))
    w = n.select("race", (F.col("n2") / F.sum("n2").over(Window.partitionBy(F.lit(0)))).alias("f"))
    return a.join(w, "race").agg(X.r6(F.sum(F.col("f") * F.col("auc"))).alias("expected"))


@query("agg_weighted_reweight", f"WITH {LAPS}, r AS (SELECT compound, avg(target) AS r FROM laps WHERE year = 2022 GROUP BY compound), w AS (SELECT compound, count(*) AS n FROM laps WHERE year = 2023 GROUP BY compound) SELECT round(sum(r * n) / sum(n), 6) AS rate FROM r JOIN w USING (compound)")
def agg_weighted_reweight(spark, d):
    df = laps(spark, d)
    r = df.where("year = 2022").groupBy("compound").agg(F.avg("target").alias("r"))
    w = df.where("year = 2023").groupBy("compound").agg(F.count("*").alias("n"))
    return r.join(w, "compound").agg(X.r6(F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("rate"))


@query("agg_group_sum_len", f"WITH {LAPS} SELECT driver, CAST(sum(target) AS BIGINT) AS s, count(*) AS n FROM laps GROUP BY driver")
def agg_group_sum_len(spark, d):
    return laps(spark, d).groupBy("driver").agg(F.sum("target").alias("s"), F.count("*").alias("n"))


@query("agg_global_mean", "SELECT round(avg(value), 6) AS mean FROM events")
def agg_global_mean(spark, d):
    return table(spark, d, "events").agg(X.r6(F.avg("value")).alias("mean"))


@query("agg_median", "SELECT event_type, round(median(value), 6) AS med FROM events GROUP BY event_type")
def agg_median(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(X.r6(F.median("value")).alias("med"))


@query("agg_percentiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag")
def agg_percentiles(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_extendedprice", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"))
    return p.select("l_returnflag", *[F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


@query("agg_mean_std", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd FROM lineitem GROUP BY l_returnflag")
def agg_mean_std(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(X.r6(F.avg("l_quantity")).alias("mean"), X.r6(F.stddev_pop("l_quantity")).alias("sd"))


@query("agg_count_by", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def agg_count_by(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", X.r6(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))))


@query("agg_value_counts", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
def agg_value_counts(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(10)


@query("agg_rate_by_cat", f"WITH {LAPS}, t AS (SELECT driver, count(*) AS n, round(avg(target), 6) AS rate FROM laps GROUP BY driver ORDER BY n DESC, driver LIMIT 20) SELECT * FROM t ORDER BY rate DESC, driver")
def agg_rate_by_cat(spark, d):
    top = laps(spark, d).groupBy("driver").agg(F.count("*").alias("n"), X.r6(F.avg("target")).alias("rate")).orderBy(F.desc("n"), "driver").limit(20)
    return top.orderBy(F.desc("rate"), "driver")


@query("agg_crosstab", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_crosstab(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


_BIN = "CAST(least(greatest(floor((l_extendedprice - lo) / (hi - lo) * {n}), 0), {n} - 1) AS BIGINT)"


@query("agg_binned_rate", f"WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT {_BIN.format(n=20)} AS bin, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(avg(CAST(l_returnflag = 'R' AS INTEGER)), 6) AS rate FROM lineitem, m GROUP BY 1")
def agg_binned_rate(spark, d):
    b = E.binned(table(spark, d, "lineitem"), "l_extendedprice", 20)
    return b.groupBy("bin").agg(F.count("*").alias("n"), X.r6(F.avg("l_quantity")).alias("mean"), X.r6(F.avg((F.col("l_returnflag") == "R").cast("int"))).alias("rate"))


@query("agg_hist", f"WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT bin, count(*) AS n, round(count(*) * 40 / (sum(count(*)) OVER () * any_value(w)), 9) AS density FROM (SELECT {_BIN.format(n=40)} AS bin, hi - lo AS w FROM lineitem, m) GROUP BY bin")
def agg_hist(spark, d):
    li = table(spark, d, "lineitem").select("l_extendedprice")
    n = E.binned(li, "l_extendedprice", 40).groupBy("bin").agg(F.count("*").alias("n"))
    width = li.agg((F.max("l_extendedprice") - F.min("l_extendedprice")).alias("w"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return n.crossJoin(F.broadcast(width)).select("bin", "n", F.round(F.col("n") * 40 / (total * F.col("w")), 9).alias("density"))


@query("fn_minmax_scale_bin", f"WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, {_BIN.format(n=20)} AS bin FROM lineitem, m")
def fn_minmax_scale_bin(spark, d):
    return E.binned(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 20).drop("l_extendedprice")


@query("agg_qcut", "WITH q AS (SELECT list_distinct(quantile_cont(l_quantity, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM lineitem) SELECT bucket, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM (SELECT l_quantity, CAST(greatest(len(list_filter(e, lambda x : x < l_quantity)) - 1, 0) AS BIGINT) AS bucket FROM lineitem, q) GROUP BY bucket")
def agg_qcut(spark, d):
    return E.quantile_cut(table(spark, d, "lineitem").select("l_quantity"), "l_quantity").groupBy("bucket").agg(F.count("*").alias("n"), X.r6(F.avg("l_quantity")).alias("mean"))


@query("agg_confusion", f"WITH {IRRIGATION}, {S.RULES_SQL} SELECT y, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ruled WHERE y <> label GROUP BY y, label")
def agg_confusion(spark, d):
    return rounded(E.confusion(S.formula_rules(S.irrigation(table(spark, d, "lineitem"))), "y", "label"), "share")


@query("agg_accuracy", f"WITH {IRRIGATION}, {S.RULES_SQL} SELECT {FOLD} % 5 AS fold, round(avg(CAST(y = label AS INTEGER)), 6) AS accuracy, count(*) AS n FROM ruled GROUP BY 1")
def agg_accuracy(spark, d):
    df = S.formula_rules(S.irrigation(table(spark, d, "lineitem"))).withColumn("fold", X.id_fold(F.col("id"), 5))
    return rounded(E.accuracy(df, "y", "label", ["fold"]), "accuracy")


@query("agg_cond_counts", f"WITH {IRRIGATION}, {S.RULES_SQL}, f AS (SELECT *, abs(soil - 25) <= 2.5 AS near, y <> label AS wrong FROM ruled) SELECT count(*) FILTER (near) AS near_n, count(*) FILTER (near AND wrong) AS near_wrong, count(*) FILTER (NOT near) AS far_n, count(*) FILTER (NOT near AND wrong) AS far_wrong FROM f")
def agg_cond_counts(spark, d):
    df = S.formula_rules(S.irrigation(table(spark, d, "lineitem")))
    near, wrong = F.abs(F.col("soil") - 25) <= 2.5, F.col("y") != F.col("label")
    return df.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("near_n", near), ("near_wrong", near & wrong), ("far_n", ~near), ("far_wrong", ~near & wrong))])


@query("flt_near", f"WITH {IRRIGATION} SELECT id, temp FROM irr WHERE abs(temp - 30) <= 30 * 0.10::DOUBLE")
def flt_near(spark, d):
    return S.irrigation(table(spark, d, "lineitem")).where(F.abs(F.col("temp") - 30) <= F.lit(30) * F.lit(0.10)).select("id", "temp")


_RANKED = SCORED + """, u AS (SELECT id, target, p1 AS p, 'a' AS label FROM scored UNION ALL SELECT id, target, p2, 'b' FROM scored UNION ALL SELECT id, target, p3, 'c' FROM scored),
 k AS (SELECT id, label, CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS y, row_number() OVER (PARTITION BY id ORDER BY round(p, 9) DESC, label) AS r FROM u), t AS (SELECT id, r FROM k WHERE label = y)"""


def true_ranks(spark, d):
    """Rank of the true label among three scored ones."""
    pairs = F.array(*[F.struct((-F.round(p, 9)).alias("p"), F.lit(label).alias("label")) for p, label in (("p1", "a"), ("p2", "b"), ("p3", "c"))])
    y = F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c")
    return scored(spark, d).select("id", F.array_position(F.transform(F.sort_array(pairs), lambda x: x["label"]), y).alias("r"))


@query("agg_lrap", f"WITH {_RANKED} SELECT round(avg(1.0::DOUBLE / r), 6) AS lrap FROM t")
def agg_lrap(spark, d):
    return true_ranks(spark, d).agg(X.r6(F.avg(F.lit(1.0) / F.col("r"))).alias("lrap"))


@query("agg_map_at_3", f"WITH {_RANKED} SELECT round(avg(CASE WHEN r <= 2 THEN 1.0::DOUBLE / r ELSE 0 END), 6) AS map FROM t")
def agg_map_at_3(spark, d):
    df = true_ranks(spark, d)
    return df.agg(X.r6(E.map_at_k(df, "r", 2)).alias("map"))


@query("agg_top3_hit", f"WITH {_RANKED} SELECT round(avg(CAST(r <= 2 AS INTEGER)), 6) AS hit FROM t")
def agg_top3_hit(spark, d):
    return true_ranks(spark, d).agg(X.r6(F.avg((F.col("r") <= 2).cast("int"))).alias("hit"))


@query("agg_calibration", f"WITH {SCORED} SELECT CAST(least(floor(p1 * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p1), 6) AS mean_pred, round(avg(target), 6) AS frac_pos FROM scored GROUP BY 1")
def agg_calibration(spark, d):
    return rounded(E.calibration(scored(spark, d), "p1", "target"), "mean_pred", "frac_pos")


@query("agg_corr_matrix", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS qe, round(corr(l_quantity, l_discount), 6) AS qd, round(corr(l_quantity, l_tax), 6) AS qt, round(corr(l_extendedprice, l_discount), 6) AS ed, round(corr(l_extendedprice, l_tax), 6) AS et, round(corr(l_discount, l_tax), 6) AS dt FROM lineitem")
def agg_corr_matrix(spark, d):
    c = {"q": "l_quantity", "e": "l_extendedprice", "d": "l_discount", "t": "l_tax"}
    return table(spark, d, "lineitem").agg(*[X.r6(F.corr(c[a], c[b])).alias(a + b) for a, b in ("qe", "qd", "qt", "ed", "et", "dt")])


@query("agg_pearson_mad", f"WITH {SCORED} SELECT round(corr(p1, p2), 6) AS r, round(avg(abs(p1 - p2)), 6) AS mad FROM scored")
def agg_pearson_mad(spark, d):
    return scored(spark, d).agg(X.r6(F.corr("p1", "p2")).alias("r"), X.r6(F.avg(F.abs(F.col("p1") - F.col("p2")))).alias("mad"))


@query("agg_ks2", "WITH c AS (SELECT value, count(*) FILTER (event_id % 2 = 0) AS a, count(*) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY value), k AS (SELECT sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER () AS g FROM c WINDOW w AS (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT round(max(abs(g)), 6) AS statistic FROM k")
def agg_ks2(spark, d):
    return rounded(E.ks_two_sample(table(spark, d, "events").withColumn("half", F.col("event_id") % 2), "value", "half"), "statistic")


@query("agg_describe", "SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS lo, max(value) AS hi, round(median(value), 6) AS med FROM events")
def agg_describe(spark, d):
    return table(spark, d, "events").agg(F.count("value").alias("n"), X.r6(F.avg("value")).alias("mean"), X.r6(F.stddev_samp("value")).alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"), X.r6(F.median("value")).alias("med"))


@query("agg_null_count", f"WITH {LAPS} SELECT count(*) FILTER (delta IS NULL) AS delta, count(*) FILTER (value IS NULL) AS value, count(*) FILTER (compound IS NULL) AS compound FROM laps")
def agg_null_count(spark, d):
    return laps(spark, d).agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in ("delta", "value", "compound")])


@query("agg_minmax", "SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi, count(DISTINCT o_orderpriority) AS k FROM orders")
def agg_minmax(spark, d):
    return table(spark, d, "orders").agg(F.min("o_orderdate").cast("date").alias("lo"), F.max("o_orderdate").cast("date").alias("hi"), F.count_distinct("o_orderpriority").alias("k"))


# Ensembles


@query("ens_avg", f"WITH {SCORED} SELECT id, round((p1 + p2 + p3) / 3, 6) AS p FROM scored")
def ens_avg(spark, d):
    return scored(spark, d).select("id", X.r6(B.average("p1", "p2", "p3")).alias("p"))


@query("ens_weighted", f"WITH {SCORED} SELECT id, round((0.5 * p1 + 0.3 * p2 + 0.2 * p3), 6) AS p FROM scored")
def ens_weighted(spark, d):
    return scored(spark, d).select("id", X.r6(B.weighted({"p1": 5.0, "p2": 3.0, "p3": 2.0})).alias("p"))


@query("ens_conditional", f"WITH {SCORED} SELECT id, round(CASE WHEN year = 2023 THEN 0.8 * p1 + 0.2 * p2 ELSE 0.4 * p1 + 0.6 * p2 END, 6) AS p FROM scored")
def ens_conditional(spark, d):
    return scored(spark, d).select("id", X.r6(F.when(F.col("year") == 2023, B.weighted({"p1": 0.8, "p2": 0.2})).otherwise(B.weighted({"p1": 0.4, "p2": 0.6}))).alias("p"))


_CONSENSUS = f"{SCORED}, a AS (SELECT greatest((SELECT auc FROM ({auc_sql('scored', 'p2')})) - 0.45::DOUBLE, 0) AS w2, greatest((SELECT auc FROM ({auc_sql('scored', 'p3')})) - 0.45::DOUBLE, 0) AS w3)"


@query("ens_consensus", f"WITH {_CONSENSUS} SELECT id, round((w2 * p2 + w3 * p3) / (w2 + w3), 5) AS p FROM scored, a")
def ens_consensus(spark, d):
    return B.consensus(scored(spark, d), ["p2", "p3"], "target", 0.45).select("id", F.round("consensus", 5).alias("p"))


_RB = f"{SCORED}, r AS (SELECT id, round(p1, 9) AS p1, row_number() OVER (ORDER BY round(p1, 9), id) - 1 AS ra, row_number() OVER (ORDER BY round(p2, 9), id) - 1 AS rs FROM scored), b AS (SELECT id, row_number() OVER (ORDER BY 95 * ra + 5 * rs, id) AS k FROM r), sv AS (SELECT p1, row_number() OVER (ORDER BY p1, id) AS k FROM r)"


@query("ens_rank_blend", f"WITH {_RB} SELECT id, round(p1, 6) AS p FROM b JOIN sv USING (k)")
def ens_rank_blend(spark, d):
    df = scored(spark, d).select("id", F.round("p1", 9).alias("p1"), F.round("p2", 9).alias("p2"))
    return B.rank_blend(df, "p1", "p2", 5, 100).select("id", X.r6(F.col("blended")).alias("p"))


@query("win_rank_stable", f"WITH {SCORED} SELECT id, row_number() OVER (ORDER BY round(p1, 9), id) - 1 AS r FROM scored")
def win_rank_stable(spark, d):
    return B.stable_rank(scored(spark, d).select("id", F.round("p1", 9).alias("p1")), "p1", "r").select("id", "r")


@query("win_rank_remap", f"WITH {_RB} SELECT count(*) AS n, round(sum(p1), 4) AS total FROM b JOIN sv USING (k)")
def win_rank_remap(spark, d):
    df = scored(spark, d).select("id", F.round("p1", 9).alias("p1"), F.round("p2", 9).alias("p2"))
    return B.rank_blend(df, "p1", "p2", 5, 100).agg(F.count("*").alias("n"), F.round(F.sum("blended"), 4).alias("total"))


_SEL = f"{SCORED}, t AS (SELECT *, row_number() OVER (ORDER BY round(abs(p2 - p1), 9) DESC, id) AS k FROM scored WHERE p2 > p1), n AS (SELECT greatest(1, CAST(floor(count(*) * 5 / 100) AS BIGINT)) AS m FROM scored)"


@query("ens_selective", f"WITH {_SEL} SELECT s.id, round(CASE WHEN t.k <= m THEN 0.8 * s.p1 + 0.2 * s.p2 ELSE s.p1 END, 6) AS p FROM scored s CROSS JOIN n LEFT JOIN t ON s.id = t.id")
def ens_selective(spark, d):
    return B.selective(scored(spark, d), "p1", "p2", 5, 0.2, "up").select("id", X.r6(F.col("corrected")).alias("p"))


@query("srt_topk_disagree", f"WITH {_SEL} SELECT t.id, t.k AS place FROM t, n WHERE t.k <= m")
def srt_topk_disagree(spark, d):
    return B.most_apart(scored(spark, d), "p1", "p2", 5, "up").select("id", "place")
