"""Projections, filters, joins, sorts and set operations."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import expr as X
from ..operators.scoring import SMALL_GRID
from ..session import table
from .feature_queries import laps
from .registry import query
from .source_queries import baskets
from .sqlbits import BASKETS, LAPS


def ev(spark, d):
    return table(spark, d, "events")


@query("prj_select", "SELECT l_orderkey, l_quantity FROM lineitem")
def prj_select(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_quantity")


@query("prj_with_columns", "SELECT event_id, round(value * 2, 6) AS a, round(value * 2 + 1, 6) AS b FROM events")
def prj_with_columns(spark, d):
    return ev(spark, d).select("event_id", (F.col("value") * 2).alias("a")).withColumn("b", X.r6(F.col("a") + 1)).withColumn("a", X.r6(F.col("a")))


@query("prj_drop", "SELECT n_nationkey, n_name FROM nation")
def prj_drop(spark, d):
    return table(spark, d, "nation").drop("n_regionkey")


@query("prj_exclude_by_set", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def prj_exclude_by_set(spark, d):
    """All columns but the strings, found from the schema."""
    df = table(spark, d, "customer")
    return df.select(*[f.name for f in df.schema if not isinstance(f.dataType, StringType)])


_FILTERS = {
    "flt_eq": ("event_type = 'purchase'", lambda: F.col("event_type") == "purchase"),
    "flt_ne": ("event_type <> 'view'", lambda: F.col("event_type") != "view"),
    "flt_mask": ("value > 50 AND user_id % 2 = 0", lambda: (F.col("value") > 50) & (F.col("user_id") % 2 == 0)),
    "flt_in": ("event_type IN ('view', 'click')", lambda: F.col("event_type").isin("view", "click")),
}
for _name, (_sql, _cond) in _FILTERS.items():
    query(_name, f"SELECT event_id, value FROM events WHERE {_sql}")(lambda spark, d, c=_cond: ev(spark, d).where(c()).select("event_id", "value"))


@query("flt_threshold_count", f"WITH {BASKETS} SELECT item, count(*) AS n FROM baskets GROUP BY item HAVING count(*) > 100")
def flt_threshold_count(spark, d):
    return baskets(spark, d).groupBy("item").agg(F.count("*").alias("n")).where("n > 100")


@query("flt_dropnull", f"WITH {LAPS} SELECT id, round(delta, 6) AS delta FROM laps WHERE delta IS NOT NULL")
def flt_dropnull(spark, d):
    return laps(spark, d).dropna(subset=["delta"]).select("id", X.r6(F.col("delta")).alias("delta"))


@query("jn_left_lookup", "SELECT o_orderkey, round(m, 6) AS mean FROM orders LEFT JOIN (SELECT l_orderkey, avg(l_quantity) AS m FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def jn_left_lookup(spark, d):
    agg = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.avg("l_quantity").alias("m"))
    return table(spark, d, "orders").join(agg, "o_orderkey", "left").select("o_orderkey", X.r6(F.col("m")).alias("mean"))


@query("jn_left_4key", f"WITH {LAPS} SELECT a.id, b.compound AS other FROM laps a LEFT JOIN laps b ON a.driver = b.driver AND a.race = b.race AND a.year = b.year AND a.lap = b.lap - 1")
def jn_left_4key(spark, d):
    df = laps(spark, d)
    other = df.select("driver", "race", "year", (F.col("lap") - 1).alias("lap"), F.col("compound").alias("other"))
    return df.join(other, ["driver", "race", "year", "lap"], "left").select("id", "other")


def _shares(df, name):
    n = df.groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", X.r6(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias(name))


@query("jn_full_outer", "WITH a AS (SELECT user_id, round(count(*) / sum(count(*)) OVER (), 6) AS x FROM events WHERE event_id % 2 = 0 GROUP BY user_id), b AS (SELECT user_id, round(count(*) / sum(count(*)) OVER (), 6) AS y FROM events WHERE event_id % 2 = 1 GROUP BY user_id) SELECT coalesce(a.user_id, b.user_id) AS user_id, x, y FROM a FULL JOIN b ON a.user_id = b.user_id")
def jn_full_outer(spark, d):
    e = ev(spark, d)
    return _shares(e.where("event_id % 2 = 0"), "x").join(_shares(e.where("event_id % 2 = 1"), "y"), "user_id", "full")


@query("jn_cross_expand", "SELECT p_partkey, label, CAST(p_type = label AS INTEGER) AS is_target FROM part CROSS JOIN (SELECT DISTINCT p_type AS label FROM part)")
def jn_cross_expand(spark, d):
    """Rows by labels, as a ranking set needs it; the labels are a bounded domain, made an array first."""
    p = table(spark, d, "part").select("p_partkey", "p_type")
    labels = p.agg(F.collect_set("p_type").alias("labels"))
    return p.crossJoin(F.broadcast(labels)).select("p_partkey", "p_type", F.explode("labels").alias("label")).select("p_partkey", "label", (F.col("label") == F.col("p_type")).cast("int").alias("is_target"))


@query("jn_cross_grid", "SELECT * FROM " + ", ".join(f"(SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in vs)}]) AS {c}_t) {c}s" for c, vs in SMALL_GRID.items()))
def jn_cross_grid(spark, d):
    return spark.createDataFrame(list(product(*SMALL_GRID.values())), ", ".join(f"{c}_t double" for c in SMALL_GRID))


@query("jn_cross_groups", "SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment")
def jn_cross_groups(spark, d):
    """Existing combinations only."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"))


@query("jn_fold_idset", "SELECT event_id FROM events WHERE event_id IN (SELECT event_id FROM events WHERE ('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 7))::BIGINT % 5 = 2)")
def jn_fold_idset(spark, d):
    e = ev(spark, d).select("event_id")
    return e.join(e.where(X.id_fold(F.col("event_id"), 5) == 2), "event_id", "left_semi")


@query("jn_positional", "SELECT a.event_id, round(a.value - b.value, 6) AS gap FROM events a JOIN events b ON a.event_id = b.event_id + 1")
def jn_positional(spark, d):
    e = ev(spark, d).select("event_id", "value")
    return e.join(e.select((F.col("event_id") + 1).alias("event_id"), F.col("value").alias("w")), "event_id").select("event_id", X.r6(F.col("value") - F.col("w")).alias("gap"))


@query("srt_multi", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus, o_custkey, o_totalprice, o_orderkey")
def srt_multi(spark, d):
    return table(spark, d, "orders").orderBy("o_orderstatus", "o_custkey", "o_totalprice", "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("srt_desc_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def srt_desc_head(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("srt_nlargest", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 3")
def srt_nlargest(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(3)


@query("fn_join_list", "SELECT string_agg(p_type, ' ' ORDER BY n DESC, p_type) AS labels FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 3)")
def fn_join_list(spark, d):
    top = srt_nlargest(spark, d).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "p_type"))).alias("t"))
    return top.select(F.array_join(F.transform("t", lambda x: x["p_type"]), " ").alias("labels"))


@query("srt_best_of", "SELECT event_type, mean FROM (SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY event_type) ORDER BY mean DESC, event_type LIMIT 1")
def srt_best_of(spark, d):
    return ev(spark, d).groupBy("event_type").agg(X.r6(F.avg("value")).alias("mean")).orderBy(F.desc("mean"), "event_type").limit(1)


@query("set_union_concat", "SELECT user_id, 'a' AS part FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, 'b' FROM events WHERE event_id % 2 = 1")
def set_union_concat(spark, d):
    e = ev(spark, d)
    return e.where("event_id % 2 = 0").select("user_id", F.lit("a").alias("part")).unionByName(e.where("event_id % 2 = 1").select("user_id", F.lit("b").alias("part")))


_HALVES = "a AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 0), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 1)"


def halves(spark, d):
    e = ev(spark, d)
    return [e.where(f"event_id % 3 = {i}").select("user_id", "event_type") for i in (0, 1)]


@query("set_diff", f"WITH {_HALVES} SELECT * FROM a EXCEPT SELECT * FROM b")
def set_diff(spark, d):
    a, b = halves(spark, d)
    return a.subtract(b)


@query("set_intersect", f"WITH {_HALVES} SELECT * FROM a INTERSECT SELECT * FROM b")
def set_intersect(spark, d):
    a, b = halves(spark, d)
    return a.intersect(b)


@query("set_membership", f"WITH {_HALVES} SELECT count(*) FILTER (b.user_id IS NULL) AS only_a, count(*) FILTER (a.user_id IS NULL) AS only_b, count(*) FILTER (a.user_id IS NOT NULL AND b.user_id IS NOT NULL) AS shared FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type")
def set_membership(spark, d):
    """Train-only, test-only and shared tuples from one full join."""
    a, b = (x.distinct().withColumn(f"in{i}", F.lit(1)) for i, x in enumerate(halves(spark, d)))
    j = a.join(b, ["user_id", "event_type"], "full")
    return j.agg(F.count(F.when(F.col("in1").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("in0").isNull(), 1)).alias("only_b"), F.count(F.when(F.col("in0").isNotNull() & F.col("in1").isNotNull(), 1)).alias("shared"))


@query("set_unique", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def set_unique(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("agg_pivot", "SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS F, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS O, round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS P FROM orders GROUP BY 1")
def agg_pivot(spark, d):
    daily = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day"), "o_orderstatus").agg(F.sum("o_totalprice").alias("v"))
    wide = daily.groupBy("day").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.first("v"))
    return wide.select("day", *[F.round(c, 2).alias(c) for c in "FOP"])


@query("fn_split_ws", "SELECT p_partkey, len(string_split(p_name, ' ')) AS words, string_split(p_name, ' ')[1] AS head FROM part")
def fn_split_ws(spark, d):
    parts = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", F.size(parts).cast("long").alias("words"), parts[0].alias("head"))


@query("fn_array_sets", "SELECT n_nationkey, len(list_intersect([n_nationkey, 1, 2], [1, 2, 3])) AS i, len(list_distinct(list_concat([n_nationkey, 1, 2], [1, 2, 3]))) AS u FROM nation")
def fn_array_sets(spark, d):
    a, b = F.array("n_nationkey", F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(2), F.lit(3))
    return table(spark, d, "nation").select("n_nationkey", F.size(F.array_intersect(a, b)).cast("long").alias("i"), F.size(F.array_union(a, b)).cast("long").alias("u"))
