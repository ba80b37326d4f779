"""Sources and sinks: tables go out in a format and come back through its reader."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import expr as X
from ..session import table
from ..sources import text as T
from .feature_queries import scored
from .registry import query
from .sqlbits import BASKETS, EDGES, SCORED


def baskets(spark, d):
    """(basket, item): brands of an order."""
    li, part = table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), table(spark, d, "part").select("p_partkey", "p_brand")
    return li.join(part, li.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("item")).distinct()


def edges(spark, d):
    """(u, v): suppliers that share an order."""
    k = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s")).distinct()
    return k.alias("a").join(k.alias("b"), F.expr("a.k = b.k AND a.s < b.s")).select(F.col("a.s").alias("u"), F.col("b.s").alias("v")).distinct()


@query("src_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_csv(spark, d):
    path = T.scratch(spark, "csv")
    table(spark, d, "nation").write.option("header", True).csv(path)
    return T.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("src_csv_pd", "SELECT s_suppkey, s_acctbal FROM supplier")
def src_csv_pd(spark, d):
    path = T.scratch(spark, "csv")
    table(spark, d, "supplier").write.option("header", True).csv(path)
    return T.read_csv(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").select("s_suppkey", "s_acctbal")


@query("src_csv_typed", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderstatus FROM orders")
def src_csv_typed(spark, d):
    path = T.scratch(spark, "csv")
    table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus").write.option("header", True).csv(path)
    return T.read_csv(spark, path, "o_orderkey long, day date, o_orderstatus string")


@query("src_date_cols", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date FROM orders")
def src_date_cols(spark, d):
    return T.parse_date_columns(table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date")))


@query("src_baskets", f"WITH {BASKETS} SELECT CAST(replace(item, 'Brand#', '') AS BIGINT) AS item, count(*) AS support FROM baskets GROUP BY item")
def src_baskets(spark, d):
    path = T.scratch(spark, "baskets")
    lines = baskets(spark, d).groupBy("basket").agg(F.array_join(F.collect_list(F.regexp_replace("item", "Brand#", "")), " ").alias("value"))
    lines.select("value").write.text(path)
    return T.read_baskets(spark, path).groupBy("item").agg(F.count("*").alias("support"))


@query("src_edge_stream", f"WITH {EDGES} SELECT u, v FROM edges")
def src_edge_stream(spark, d):
    path = T.scratch(spark, "edges")
    edges(spark, d).select(F.concat_ws(" ", F.col("v"), F.col("u")).alias("value")).write.text(path)
    return T.read_edges(spark, path)


@query("src_edgelist", f"WITH {EDGES} SELECT u AS src, v AS dst, 1.0::DOUBLE AS w FROM edges UNION ALL SELECT v, u, 1.0::DOUBLE FROM edges")
def src_edgelist(spark, d):
    path = T.scratch(spark, "edgelist")
    edges(spark, d).write.csv(path)
    return T.read_edge_list(spark, path)


@query("src_adjacency", f"WITH {EDGES}, b AS (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges) SELECT u + 1 AS id, v + 1 AS neighbour FROM b")
def src_adjacency(spark, d):
    path = T.scratch(spark, "adjacency")
    e = edges(spark, d)
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    n = table(spark, d, "supplier").select(F.col("s_suppkey").alias("u"))
    rows = n.join(both, "u", "left").groupBy("u").agg(F.array_join(F.sort_array(F.collect_list(F.col("v") + 1)), " ").alias("value"))
    head = spark.createDataFrame([(-2, "% a comment"), (-1, "n m")], "u long, value string")
    head.unionByName(rows.select("u", F.coalesce("value", F.lit("")).alias("value"))).coalesce(1).sortWithinPartitions("u").select("value").write.text(path)
    return T.read_adjacency(spark, path)


@query("src_npy", f"WITH {SCORED} SELECT id, round(p1, 6) AS p FROM scored")
def src_npy(spark, d):
    """Predictions kept as Parquet keyed by id, where arrays by position would lose their rows."""
    path = T.scratch(spark, "oof")
    scored(spark, d).select("id", X.r6(F.col("p1")).alias("p")).write.parquet(path)
    return spark.read.parquet(path)


@query("src_json_params", "SELECT 'learning_rate' AS name, 0.05::DOUBLE AS value UNION ALL SELECT 'max_depth', 6 UNION ALL SELECT 'subsample', 0.8")
def src_json_params(spark, d):
    path = T.scratch(spark, "params")
    spark.createDataFrame([(json.dumps({"learning_rate": 0.05, "max_depth": 6}),)], "value string").coalesce(1).write.text(path)
    tuned = json.loads(spark.read.text(path).first()["value"])
    return spark.createDataFrame([(k, float(v)) for k, v in ({"learning_rate": 0.1, "max_depth": 3, "subsample": 0.8} | tuned).items()], "name string, value double")


@query("snk_submission", f"WITH {SCORED} SELECT id, round(p1, 6) AS prediction FROM scored")
def snk_submission(spark, d):
    path = T.scratch(spark, "submission")
    T.write_submission(scored(spark, d).select("id", X.r6(F.col("p1")).alias("prediction")), path)
    return T.read_csv(spark, path, "id long, prediction double")


@query("snk_ledger", "SELECT 'a' AS model, 0.123457::DOUBLE AS oof, 0.5::DOUBLE AS fold_1, CAST(NULL AS DOUBLE) AS fold_2 UNION ALL SELECT 'b', 0.333333, 0.1, 0.666667")
def snk_ledger(spark, d):
    one = T.append_ledger(None, spark.createDataFrame([("a", 0.12345678, 0.5)], "model string, oof double, fold_1 double"))
    return T.append_ledger(one, spark.createDataFrame([("b", 1 / 3, 0.1, 2 / 3)], "model string, oof double, fold_1 double, fold_2 double"))


@query("snk_round_log", "SELECT range AS round, 100 - range AS edge_cut FROM range(5)")
def snk_round_log(spark, d):
    path = T.scratch(spark, "rounds")
    for lo, hi in ((0, 2), (2, 5)):
        spark.range(lo, hi).select(F.col("id").alias("round"), (100 - F.col("id")).alias("edge_cut")).coalesce(1).write.mode("append").option("header", True).option("sep", "\t").csv(path)
    return spark.read.schema("round long, edge_cut long").option("header", True).option("sep", "\t").csv(path)


@query("snk_csv_pl", "SELECT r_regionkey, r_name FROM region")
def snk_csv_pl(spark, d):
    path = T.scratch(spark, "out")
    table(spark, d, "region").write.mode("overwrite").option("header", True).csv(path)
    return T.read_csv(spark, path, "r_regionkey int, r_name string")
