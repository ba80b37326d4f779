"""Windows, projections and domain features over events and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import laps as L
from ..operators import scoring as S
from ..session import table
from .registry import query
from .sqlbits import IRRIGATION, LAPS, SCORED

DOMAIN_FEATURES = """
f1 AS (SELECT *, CAST(year = 2023 AS INTEGER) AS is_2023, tyre_life * tyre_life AS tyre_sq, ln(tyre_life + 1) / ln(2.718281828::DOUBLE) AS tyre_log,
  CASE compound WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 WHEN 'error' THEN 1 WHEN 'view' THEN 0 ELSE 1 END AS compound_ord,
  progress * stint AS progress_x_stint, degradation / (tyre_life + 1) AS degradation_rate, lap * (1 - progress) / greatest(progress, 0.01) AS est_laps_left FROM laps),
f2 AS (SELECT *, tyre_life * compound_ord AS tyre_x_compound, avg(delta) OVER (g ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS delta_roll3, avg(delta) OVER (g ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS delta_roll7,
  avg(value) OVER (g ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS value_roll5, coalesce(lag(delta, 1) OVER g, 0) AS delta_lag1, coalesce(lag(delta, 2) OVER g, 0) AS delta_lag2, coalesce(lag(delta, 3) OVER g, 0) AS delta_lag3
  FROM f1 WINDOW g AS (PARTITION BY driver, race, year ORDER BY ts, id))
"""


def laps(spark: SparkSession, d: str) -> DataFrame:
    return L.laps(table(spark, d, "events"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Laps with three model scores made of figures of the row."""
    return laps(spark, d).withColumns({
        "p1": F.round(X.sigmoid(F.lit(0.02) * (F.col("value") - 40) + F.lit(0.1) * (F.col("tyre_life") % 7) - 1.0), 9),
        "p2": F.round(X.sigmoid(F.lit(0.3) * (F.col("lap") % 5) - 1.2 + F.lit(0.01) * (F.col("id") % 13)), 9),
        "p3": F.round(X.sigmoid(F.lit(0.05) * (F.col("id") % 17) - 0.9 + F.lit(0.2) * F.col("target")), 9),
    })


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: X.r6(F.col(c)) for c in columns})


@query("fe_f1_build", f"""WITH {LAPS}, {DOMAIN_FEATURES} SELECT id, driver, lap, stint, is_2023, tyre_sq, round(tyre_log, 6) AS tyre_log, compound_ord, round(progress_x_stint, 6) AS progress_x_stint, round(degradation_rate, 6) AS degradation_rate,
 round(est_laps_left, 6) AS est_laps_left, tyre_x_compound, round(delta_roll3, 6) AS delta_roll3, round(delta_roll7, 6) AS delta_roll7, round(value_roll5, 6) AS value_roll5, round(delta_lag1, 6) AS delta_lag1, round(delta_lag2, 6) AS delta_lag2,
 round(delta_lag3, 6) AS delta_lag3, round(value - value_roll5, 6) AS value_vs_roll5, round((value - value_roll5) / value_roll5, 6) AS pace_anomaly FROM f2""")  # fmt: skip
def fe_f1_build(spark, d):
    out = L.build_features(laps(spark, d))
    names = ["tyre_log", "progress_x_stint", "degradation_rate", "est_laps_left", "delta_roll3", "delta_roll7", "value_roll5", "delta_lag1", "delta_lag2", "delta_lag3", "value_vs_roll5", "pace_anomaly"]
    return rounded(out, *names).select("id", "driver", "lap", "stint", "is_2023", "tyre_sq", "compound_ord", "tyre_x_compound", *names)


GROUP_FEATURES = """
ref AS (SELECT * FROM laps WHERE year <> 2023), gl AS (SELECT avg(target) AS g_rate, (SELECT median(tyre_life) FROM ref WHERE target = 1) AS g_tyre FROM ref),
dr AS (SELECT driver, (sum(target) + 20.0::DOUBLE * any_value(g_rate)) / (count(*) + 20.0::DOUBLE) AS r FROM ref, gl GROUP BY driver),
dc AS (SELECT driver, compound, (sum(target) + 20.0::DOUBLE * any_value(g_rate)) / (count(*) + 20.0::DOUBLE) AS r FROM ref, gl GROUP BY driver, compound),
rc AS (SELECT race, compound, (sum(target) + 20.0::DOUBLE * any_value(g_rate)) / (count(*) + 20.0::DOUBLE) AS r FROM ref, gl GROUP BY race, compound),
dt AS (SELECT driver, median(tyre_life) AS m FROM ref WHERE target = 1 GROUP BY driver), rt AS (SELECT race, compound, median(tyre_life) AS m FROM ref WHERE target = 1 GROUP BY race, compound),
ct AS (SELECT compound, median(tyre_life) AS m FROM ref WHERE target = 1 GROUP BY compound)
"""


@query("fe_f1_group", f"""WITH {LAPS}, {GROUP_FEATURES}, j AS (SELECT l.*, coalesce(dr.r, g_rate) AS driver_rate, coalesce(dc.r, g_rate) AS driver_compound_rate, coalesce(rc.r, g_rate) AS race_compound_rate, coalesce(dt.m, g_tyre) AS driver_tyre, coalesce(rt.m, g_tyre) AS race_compound_tyre, coalesce(ct.m, g_tyre) AS compound_tyre
 FROM laps l CROSS JOIN gl LEFT JOIN dr USING (driver) LEFT JOIN dc ON l.driver = dc.driver AND l.compound = dc.compound LEFT JOIN rc ON l.race = rc.race AND l.compound = rc.compound LEFT JOIN dt ON l.driver = dt.driver LEFT JOIN rt ON l.race = rt.race AND l.compound = rt.compound LEFT JOIN ct ON l.compound = ct.compound)
 SELECT id, round(driver_rate, 6) AS driver_rate, round(driver_compound_rate, 6) AS driver_compound_rate, round(race_compound_rate, 6) AS race_compound_rate, driver_tyre, race_compound_tyre, round(tyre_life / compound_tyre, 6) AS tyre_frac, race_compound_tyre - tyre_life AS window_gap, greatest(tyre_life - race_compound_tyre, 0) AS laps_past_window FROM j""")  # fmt: skip
def fe_f1_group(spark, d):
    df = laps(spark, d)
    out = rounded(L.group_features(df, df), "driver_rate", "driver_compound_rate", "race_compound_rate", "tyre_frac")
    return out.select("id", "driver_rate", "driver_compound_rate", "race_compound_rate", "driver_tyre", "race_compound_tyre", "tyre_frac", "window_gap", "laps_past_window")


@query("agg_smoothed_rate", f"WITH {LAPS}, {GROUP_FEATURES} SELECT driver, compound, round(r, 6) AS rate FROM dc")
def agg_smoothed_rate(spark, d):
    return rounded(L.smoothed_rate(laps(spark, d).where("year <> 2023"), ["driver", "compound"], "rate"), "rate")


for _n, _c in ((3, "delta"), (7, "delta"), (5, "value")):

    def _roll(spark, d, n=_n, c=_c):
        return laps(spark, d).select("id", X.r6(L.rolling_mean(c, n, L.in_order())).alias("mean"))

    query(f"win_roll_mean_{_n}", f"WITH {LAPS} SELECT id, round(avg({_c}) OVER (PARTITION BY driver, race, year ORDER BY ts, id ROWS BETWEEN {_n - 1} PRECEDING AND CURRENT ROW), 6) AS mean FROM laps")(_roll)

for _k in (1, 2, 3):

    def _lag(spark, d, k=_k):
        return laps(spark, d).select("id", X.r6(F.coalesce(F.lag("delta", k).over(L.in_order()), F.lit(0.0))).alias("lagged"))

    query(f"win_lag_{_k}", f"WITH {LAPS} SELECT id, round(coalesce(lag(delta, {_k}) OVER (PARTITION BY driver, race, year ORDER BY ts, id), 0), 6) AS lagged FROM laps")(_lag)


@query("win_cumsum_lag", f"WITH {SCORED} SELECT id, round(coalesce(sum(p1) OVER (PARTITION BY driver, race, year, stint ORDER BY lap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS overdue FROM scored")
def win_cumsum_lag(spark, d):
    return rounded(L.overdue(scored(spark, d), "p1"), "overdue").select("id", "overdue")


@query("fe_overdue", f"WITH {SCORED} SELECT driver, stint, round(sum(o), 4) AS overdue FROM (SELECT *, coalesce(sum(p2) OVER (PARTITION BY driver, race, year, stint ORDER BY lap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM scored) GROUP BY driver, stint")
def fe_overdue(spark, d):
    return L.overdue(scored(spark, d), "p2").groupBy("driver", "stint").agg(F.round(F.sum("overdue"), 4).alias("overdue"))


_BFILL = "min(CASE WHEN target = 1 THEN lap END) OVER (PARTITION BY driver, race, year ORDER BY lap ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("win_bfill", f"WITH {LAPS} SELECT id, CAST({_BFILL} AS DOUBLE) AS next_pit FROM laps")
def win_bfill(spark, d):
    return L.laps_to_next(laps(spark, d)).select("id", F.col("next_pit").cast("double").alias("next_pit"))


@query("fe_laps_to_next", f"WITH {LAPS} SELECT laps_to_next, count(*) AS n, CAST(sum(target) AS BIGINT) AS pits FROM (SELECT *, CAST(coalesce(least({_BFILL} - lap, 10), 10) AS BIGINT) AS laps_to_next FROM laps) GROUP BY laps_to_next")
def fe_laps_to_next(spark, d):
    return L.laps_to_next(laps(spark, d)).groupBy("laps_to_next").agg(F.count("*").alias("n"), F.sum("target").alias("pits"))


@query("win_share", "SELECT event_type, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def win_share(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select("event_type", X.r6(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("share"))


@query("win_groupid", f"WITH {LAPS} SELECT driver, race, year, dense_rank() OVER (ORDER BY driver, race, year) AS group_id FROM (SELECT DISTINCT driver, race, year FROM laps)")
def win_groupid(spark, d):
    groups = laps(spark, d).select(*L.GROUP).distinct()
    return groups.withColumn("group_id", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(*L.GROUP)).cast("long"))


@query("win_topk_per_row", f"""WITH {SCORED}, u AS (SELECT id, 'a' AS label, p1 AS p FROM scored UNION ALL SELECT id, 'b', p2 FROM scored UNION ALL SELECT id, 'c', p3 FROM scored),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(p, 9) DESC, label) AS k FROM u) SELECT id, string_agg(label, ' ' ORDER BY k) AS top FROM r WHERE k <= 2 GROUP BY id""")  # fmt: skip
def win_topk_per_row(spark, d):
    """The two most probable labels of a row, best first, without leaving the row."""
    pairs = F.array(*[F.struct((-F.round(p, 9)).alias("p"), F.lit(label).alias("label")) for p, label in (("p1", "a"), ("p2", "b"), ("p3", "c"))])
    return scored(spark, d).select("id", F.array_join(F.transform(F.slice(F.sort_array(pairs), 1, 2), lambda x: x["label"]), " ").alias("top"))


# Formula scorers on the irrigation role of lineitem


@query("fe_formula_logit", f"WITH {IRRIGATION}, {S.LOGIT_SQL} SELECT id, label, round(p_low, 6) AS p_low, round(p_medium, 6) AS p_medium, round(p_high, 6) AS p_high FROM scores")
def fe_formula_logit(spark, d):
    return rounded(S.formula_logit(S.irrigation(table(spark, d, "lineitem"))), "p_low", "p_medium", "p_high").select("id", "label", "p_low", "p_medium", "p_high")


@query("fe_formula_proba", f"WITH {IRRIGATION}, {S.LOGIT_SQL} SELECT y, count(*) AS n, round(avg(p_low), 6) AS p_low, round(avg(p_medium), 6) AS p_medium, round(avg(p_high), 6) AS p_high FROM scores GROUP BY y")
def fe_formula_proba(spark, d):
    return S.formula_logit(S.irrigation(table(spark, d, "lineitem"))).groupBy("y").agg(F.count("*").alias("n"), *[X.r6(F.avg(c)).alias(c) for c in ("p_low", "p_medium", "p_high")])


@query("fe_formula_rules", f"WITH {IRRIGATION}, {S.RULES_SQL} SELECT id, score, label FROM ruled")
def fe_formula_rules(spark, d):
    return S.formula_rules(S.irrigation(table(spark, d, "lineitem"))).select("id", "score", "label")


@query("fe_threshold_grid", S.grid_sql(IRRIGATION))
def fe_threshold_grid(spark, d):
    return S.threshold_grid(S.irrigation(table(spark, d, "lineitem")))


@query("srt_topk_grid", S.grid_sql(IRRIGATION) + " ORDER BY accuracy DESC, soil_t DESC, temp_t DESC, rain_t DESC, wind_t DESC LIMIT 10")
def srt_topk_grid(spark, d):
    g = S.threshold_grid(S.irrigation(table(spark, d, "lineitem")))
    return g.orderBy(*[F.desc(c) for c in ("accuracy", "soil_t", "temp_t", "rain_t", "wind_t")]).limit(10)


@query("fe_error_slices", f"""WITH {IRRIGATION}, {S.RULES_SQL}, u AS (SELECT y, label <> y AS wrong, unnest(['soil', 'temp', 'rain', 'wind']) AS feature, unnest([soil, temp, rain, wind]) AS v, unnest([25.0, 30.0, 300.0, 10.0])::DOUBLE AS t FROM ruled)
 SELECT feature, y, wrong, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS med, round(median(abs(v - t)), 6) AS distance FROM u GROUP BY feature, y, wrong""")  # fmt: skip
def fe_error_slices(spark, d):
    return S.error_slices(S.formula_rules(S.irrigation(table(spark, d, "lineitem"))))


_ROW = {
    "prj_indicator": ("CAST(value > 50 AS INTEGER) AS flag", lambda: [X.indicator(F.col("value") > 50).alias("flag")]),
    "prj_cast": ("CAST(value AS BIGINT) AS whole, CAST(user_id AS VARCHAR) AS name", lambda: [F.round("value").cast("long").alias("whole"), F.col("user_id").cast("string").alias("name")]),
    "prj_literal": ("0.0::DOUBLE AS zero", lambda: [F.lit(0.0).alias("zero")]),
    "prj_map_default": ("CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'view' THEN 0 ELSE 1 END AS ord", lambda: [X.map_default(F.col("event_type"), {"purchase": 3, "signup": 2, "view": 0}, 1).alias("ord")]),
    "prj_case3": ("CASE WHEN value <= 20 THEN 'Low' WHEN value <= 60 THEN 'Medium' ELSE 'High' END AS band", lambda: [X.case3(F.col("value"), 20, 60, ("Low", "Medium", "High")).alias("band")]),
    "prj_null_fill": ("coalesce(CASE WHEN event_type = 'view' THEN value END, 0) AS v", lambda: [F.coalesce(F.when(F.col("event_type") == "view", F.col("value")), F.lit(0.0)).alias("v")]),
    "fn_square": ("round(value * value, 6) AS sq", lambda: [X.r6(F.col("value") * F.col("value")).alias("sq")]),
    "fn_log_base": ("round(ln(value + 1) / ln(2.718281828::DOUBLE), 6) AS lg", lambda: [X.r6(X.log_base(F.col("value") + 1, 2.718281828)).alias("lg")]),
    "fn_product": ("round(value * user_id, 6) AS prod", lambda: [X.r6(F.col("value") * F.col("user_id")).alias("prod")]),
    "fn_ratio": ("round(value / nullif(user_id, 0), 9) AS ratio", lambda: [F.round(X.ratio(F.col("value"), F.col("user_id")), 9).alias("ratio")]),
    "fn_abs": ("round(abs(value - 50), 6) AS gap", lambda: [X.r6(F.abs(F.col("value") - 50)).alias("gap")]),
    "fn_exp_pow_sqrt": ("round(exp(-value / 100), 6) AS e, round(pow(value, 1.5::DOUBLE), 3) AS p, round(sqrt(value), 6) AS s", lambda: [X.r6(F.exp(-F.col("value") / 100)).alias("e"), F.round(F.pow("value", F.lit(1.5)), 3).alias("p"), X.r6(F.sqrt("value")).alias("s")]),
    "fn_clip_low": ("greatest(value, 10) AS c", lambda: [X.clip_low(F.col("value"), 10.0).alias("c")]),
    "fn_clip_range": ("least(greatest(value, 10), 90) AS c", lambda: [X.clip(F.col("value"), 10.0, 90.0).alias("c")]),
    "fn_logit": ("round(ln(p / (1 - p)), 6) AS z", lambda: [X.r6(X.logit(F.col("value") / 500)).alias("z")]),
    "fn_sigmoid": ("round(1 / (1 + exp(-(value - 50) / 10)), 6) AS s", lambda: [X.r6(X.sigmoid((F.col("value") - 50) / 10)).alias("s")]),
    "fn_mod_hash": ("(event_id * 1103515245 + 12345) % 2147483647 AS h", lambda: [F.pmod(F.col("event_id") * F.lit(1103515245).cast("long") + 12345, F.lit(2147483647).cast("long")).alias("h")]),
    "fn_id_mod": ("CAST(event_id % 4 AS BIGINT) AS color", lambda: [(F.col("event_id") % 4).cast("long").alias("color")]),
    "fn_ceil_int_round": ("CAST(ceil(value / 7) AS BIGINT) AS up, CAST(floor(value) AS BIGINT) AS whole, round(value / 3, 6) AS r", lambda: [F.ceil(F.col("value") / 7).cast("long").alias("up"), F.col("value").cast("long").alias("whole"), X.r6(F.col("value") / 3).alias("r")]),
    "fn_concat": ("event_type || '_' || CAST(user_id AS VARCHAR) AS key", lambda: [F.concat("event_type", F.lit("_"), F.col("user_id").cast("string")).alias("key")]),
    "fn_substring": ("substr(event_type, 2, 3) AS part", lambda: [F.substring("event_type", 2, 3).alias("part")]),
    "fn_starts_with": ("starts_with(event_type, 'p') AS yes", lambda: [F.col("event_type").startswith("p").alias("yes")]),
    "fn_lower_contains": ("contains(lower(event_type), 'ew') AS yes, upper(event_type) AS up", lambda: [F.lower("event_type").contains("ew").alias("yes"), F.upper("event_type").alias("up")]),
    "fn_conditional_nan": ("CASE WHEN event_type = 'error' THEN value END AS v", lambda: [F.when(F.col("event_type") == "error", F.col("value")).alias("v")]),
    "fn_coalesce": ("coalesce(CASE WHEN value > 100 THEN NULL ELSE value END, -1) AS v", lambda: [F.coalesce(F.when(F.col("value") > 100, None).otherwise(F.col("value")), F.lit(-1.0)).alias("v")]),
    "fn_acceptance": ("round(exp((value - 50) / 100), 6) AS ex, round(1 / (1 + exp(-(value - 50) / 100)), 6) AS cu, CAST(100.0 * value > 50 AS DOUBLE) AS li", lambda: [X.r6(X.acceptance("EXP", F.lit(50.0), F.col("value"), F.lit(100.0))).alias("ex"), X.r6(X.acceptance("CUSTOM", F.lit(50.0), F.col("value"), F.lit(100.0))).alias("cu"), X.acceptance("LINEAR", F.lit(50.0), F.col("value"), F.lit(100.0)).alias("li")]),
    "fn_xi_eta": ("round(greatest(1, event_id * 1.0::DOUBLE * (event_id - 1) * (event_id - 2) / (100.0::DOUBLE * 99 * 98)), 4) AS xi, round(greatest(1, (event_id - 1) * 1.0::DOUBLE * (event_id - 2) / (100.0::DOUBLE * 99)), 4) AS eta", lambda: [F.round(F.greatest(F.lit(1.0), F.col("event_id") * F.lit(1.0) * (F.col("event_id") - 1) * (F.col("event_id") - 2) / F.lit(100.0 * 99 * 98)), 4).alias("xi"), F.round(F.greatest(F.lit(1.0), (F.col("event_id") - 1) * F.lit(1.0) * (F.col("event_id") - 2) / F.lit(100.0 * 99)), 4).alias("eta")]),
    "fn_laps_remaining": ("round(user_id * (1 - value / 500) / greatest(value / 500, 0.01), 6) AS laps", lambda: [X.r6(F.col("user_id") * (F.lit(1.0) - F.col("value") / 500) / X.clip_low(F.col("value") / 500, 0.01)).alias("laps")]),
    "fn_softmax": ("round(exp(value / 100 - greatest(value / 100, 0.5, 0.2)) / (exp(value / 100 - greatest(value / 100, 0.5, 0.2)) + exp(0.5 - greatest(value / 100, 0.5, 0.2)) + exp(0.2 - greatest(value / 100, 0.5, 0.2))), 6) AS p", lambda: [X.r6(X.softmax([F.col("value") / 100, F.lit(0.5), F.lit(0.2)])[0]).alias("p")]),
    "fn_linear3": ("round(1.5 + 0.25 * value - 0.5 * (user_id % 3), 6) AS z", lambda: [X.r6(X.linear(1.5, [(F.col("value"), 0.25), (F.col("user_id") % 3, -0.5)])).alias("z")]),
    "fn_strptime": ("CAST(strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d') AS DATE) AS day", lambda: [F.to_date(F.date_format("ts", "yyyy-MM-dd"), "yyyy-MM-dd").alias("day")]),
    "fn_now_format": ("strftime(ts, '%Y%m%d_%H%M%S') AS stamp", lambda: [F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp")]),
    "srt_argmax": ("CASE WHEN value >= 50 AND value >= user_id THEN 'v' WHEN 50 >= user_id THEN 'c' ELSE 'u' END AS top", lambda: [X.argmax_label([F.col("value"), F.lit(50.0), F.col("user_id").cast("double")], ["v", "c", "u"]).alias("top")]),
}
for _name, (_sql, _cols) in _ROW.items():

    def _row(spark, d, cols=_cols):
        return table(spark, d, "events").select("event_id", *cols())

    _source = "(SELECT *, CASE WHEN value / 500 < 1e-7 THEN 1e-7 WHEN value / 500 > 1 - 1e-7 THEN 1 - 1e-7 ELSE value / 500 END::DOUBLE AS p FROM events)" if _name == "fn_logit" else "events"
    query(_name, f"SELECT event_id, {_sql} FROM {_source}".replace("CAST(value AS BIGINT) AS whole, CAST(user_id", "CAST(round(value) AS BIGINT) AS whole, CAST(user_id"))(_row)
